"""Collapsing source rows to persons, payroll spells and DMS/ERP accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import surrogate_key


def _first_and_last(order: list[str], first: dict[str, str], last: dict[str, str]) -> list[Column]:
    """Columns of the least and of the greatest row of a group by ``order``, in one aggregation without a sort."""
    place = F.struct(*order)
    lowest, highest = (F.struct(*[F.col(c).alias(n) for n, c in names.items()]) for names in (first, last))
    return [F.min_by(lowest, place).alias("_first"), F.max_by(highest, place).alias("_last")]


def hris_persons(stg_hris: DataFrame) -> DataFrame:
    """One row for each date of birth and personal address; rows without either are no person."""
    names = ("legal_first_name", "legal_last_name")
    first = {f"canonical_{n}": n for n in ("hire_date", *names, *(f"{n}_original" for n in names), "preferred_name")}
    kept = (*names, "preferred_name", "employment_status", "employment_type", "department", "job_title", "location", "manager_hris_id")
    last = {"current_hris_employee_id": "hris_employee_id", "latest_hire_date": "hire_date", "latest_termination_date": "termination_date"} | {f"current_{n}": n for n in kept}
    grouped = stg_hris.filter(F.col("date_of_birth").isNotNull() & F.col("personal_email_local_part").isNotNull()).groupBy("date_of_birth", "personal_email_local_part")
    people = grouped.agg(
        *_first_and_last(["hire_date", "hris_employee_id"], first, last),
        *[F.max(c).alias(c) for c in ("personal_email", "work_email", "work_email_local_part", "loaded_at")],
        F.count("*").alias("spell_count"),
        F.array_sort(F.collect_set("hris_employee_id")).alias("hris_employee_ids"),
    )
    return people.select(
        surrogate_key("date_of_birth", "personal_email_local_part").alias("hris_person_key"), "date_of_birth", "personal_email_local_part", "_first.*", "_last.*",
        "personal_email", "work_email", "work_email_local_part", "spell_count", "hris_employee_ids", "loaded_at", (F.col("spell_count") > 1).alias("has_rehires"),
        F.coalesce(F.col("_first.canonical_legal_last_name") != F.col("_last.current_legal_last_name"), F.lit(False)).alias("has_name_change_marriage"),
    )


def payroll_spells(stg_payroll: DataFrame) -> DataFrame:
    """One row for each payroll id; the id itself is never parsed."""
    names = ("legal_first_name", "legal_last_name")
    first = {"first_payroll_record_id": "payroll_record_id"} | {f"first_observed_{n}": n for n in (*names, *(f"{n}_original" for n in names))}
    last = {"most_recent_payroll_record_id": "payroll_record_id"} | {f"most_recent_{n}": n for n in (*names, "job_code", "cost_center")}
    spells = stg_payroll.filter(F.col("employee_payroll_id").isNotNull()).groupBy("employee_payroll_id").agg(
        *_first_and_last(["pay_period_start", "payroll_record_id"], first, last),
        F.min("pay_period_start").alias("first_pay_period_start"), F.max("pay_period_end").alias("most_recent_pay_period_end"), F.count("*").alias("pay_period_count"),
        F.sum("gross_amount_cad").alias("gross_amount_cad_total"), F.sum("hours_worked").alias("hours_worked_total"), F.avg("gross_amount_cad").alias("gross_amount_cad_avg_per_period"),
        F.countDistinct("sin_last_4").alias("sin_last_4_distinct_count"), F.max("loaded_at").alias("loaded_at"),
    )
    changed = F.col("_last.most_recent_legal_last_name") != F.col("_first.first_observed_legal_last_name")
    own = [c for c in spells.columns if c not in ("_first", "_last", "employee_payroll_id")]
    return spells.select(surrogate_key("employee_payroll_id").alias("payroll_spell_key"), "employee_payroll_id", "_first.*", "_last.*", *own, F.coalesce(changed, F.lit(False)).alias("has_intra_spell_last_name_change"))


def dms_erp_unified(stg_dms: DataFrame, stg_erp: DataFrame) -> DataFrame:
    """DMS users and ERP users side by side. A link to a user that is not there counts as ERP only, but not as a broken link."""
    d, e = stg_dms.alias("d"), stg_erp.alias("e")
    has_dms, has_erp = F.col("d.dms_user_id").isNotNull(), F.col("e.erp_user_id").isNotNull()
    either = [F.coalesce(f"d.{c}", f"e.{c}").alias(c) for c in ("short_first_name", "last_name", "short_first_name_original", "last_name_original")]
    of_dms = {"dms_username": "dms_username", "dms_location_code": "location_code", "dms_department_code": "department_code", "hire_date_dms": "hire_date_dms", "terminated_date_dms": "terminated_date_dms"}
    of_erp = {"erp_email": "erp_email", "erp_email_local_part": "erp_email_local_part", "erp_role_code": "role_code", "erp_permissions_group": "permissions_group", "erp_created_at": "created_at", "erp_last_login_at": "last_login_at"}
    return d.join(e, F.col("e.linked_dms_user_id") == F.col("d.dms_user_id"), "full_outer").select(
        surrogate_key("d.dms_user_id", "e.erp_user_id").alias("dms_erp_person_key"), "d.dms_user_id", "e.erp_user_id", F.col("e.linked_dms_user_id").alias("erp_linked_dms_user_id"),
        F.when(has_dms & has_erp, "DMS_AND_ERP").when(has_dms, "DMS_ONLY").when(has_erp, "ERP_ONLY_BROKEN_LINK").alias("merge_topology"),
        has_dms.alias("has_dms"), has_erp.alias("has_erp"), (has_erp & F.col("e.linked_dms_user_id").isNull()).alias("has_broken_link"), *either,
        *[F.col(f"d.{c}").alias(n) for n, c in of_dms.items()], *[F.col(f"e.{c}").alias(n) for n, c in of_erp.items()], F.greatest("d.loaded_at", "e.loaded_at").alias("loaded_at"),
    )
