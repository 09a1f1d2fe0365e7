"""Effective-dated spells and the daily workforce."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import surrogate_key
from .identity import LONG_AGO

OPEN_END = "9999-12-31"


def dim_employee(stg_hris: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row for each spell of a canonical person; the termination date is the first day off."""
    keys = ["date_of_birth", "personal_email_local_part"]
    from_person = ["canonical_person_id", "hris_person_key", "has_rehires", "has_name_change_marriage", "ats_candidate_count", "payroll_spell_count", "crm_user_count", "dms_user_count", "erp_user_count", "matched_external_source_system_count", "match_passes_used"]
    joined = stg_hris.join(canonical.select(*keys, *from_person, F.col("loaded_at").alias("_loaded")), keys)
    spells = Window.partitionBy("canonical_person_id")
    never = F.lit(LONG_AGO).cast("timestamp_ntz")
    names = [f"{n}{s}" for s in ("_original", "") for n in ("legal_first_name", "legal_last_name", "preferred_name")]
    dated = joined.select(
        "canonical_person_id", "hris_person_key", "hris_employee_id", F.col("hire_date").alias("effective_start_date"),
        F.coalesce(F.date_sub("termination_date", 1), F.lit(OPEN_END).cast("date")).alias("effective_end_date"), "termination_date",
        (F.row_number().over(spells.orderBy(F.desc("hire_date"), F.desc("hris_employee_id"))) == 1).alias("is_current_record"),
        F.row_number().over(spells.orderBy("hire_date", "hris_employee_id")).alias("employment_spell_number"), *names, F.col("employment_status").alias("source_employment_status"),
        "employment_type", "department", "job_title", "manager_hris_id", "location", *from_person[2:], F.greatest(F.coalesce("loaded_at", never), F.coalesce("_loaded", never)).alias("loaded_at"),
    )
    return dated.select(surrogate_key("canonical_person_id", "hris_employee_id", "effective_start_date").alias("employee_sk"), *dated.columns, F.col("termination_date").isNull().alias("is_open_ended_spell"))


def cohort_spells(stg_hris: DataFrame, hris_persons: DataFrame) -> DataFrame:
    """The columns of ``dim_employee`` that the marts count, which do not depend on any match."""
    keys = ["date_of_birth", "personal_email_local_part"]
    joined = stg_hris.join(hris_persons.select("hris_person_key", *keys), keys)
    return joined.select(F.concat(F.lit("cp_"), "hris_person_key").alias("canonical_person_id"), F.col("hire_date").alias("effective_start_date"), "termination_date", "department", "location", "employment_type")


def workforce_daily(dim: DataFrame, as_of: dt.date, since: dt.date | None = None) -> DataFrame:
    """One row for each spell and day from hire to termination (its day included) or ``as_of``; with ``since``, the days from then on.

    The days of a spell are generated from the spell itself; no calendar is joined.
    """
    start, last = F.col("effective_start_date"), F.least(F.coalesce("termination_date", F.lit(as_of)), F.lit(as_of))
    day, ended = F.col("snapshot_date"), F.col("termination_date")
    own = ["employee_sk", "canonical_person_id", "hris_person_key", "hris_employee_id", "employment_spell_number", "effective_start_date", "effective_end_date", "termination_date", "legal_first_name_original", "legal_last_name_original", "preferred_name_original", "employment_type", "department", "job_title", "manager_hris_id", "location"]
    rest = ["has_rehires", "has_name_change_marriage", "matched_external_source_system_count", "loaded_at"]
    first = F.greatest(start, F.lit(since)) if since else start
    days = dim.filter((last >= start) & (last >= first)).select(F.explode(F.sequence(first, last)).alias("snapshot_date"), *own, *rest)
    return days.select(
        surrogate_key("snapshot_date", "employee_sk").alias("daily_workforce_key"), "snapshot_date", *own, (ended.isNull() | (day < ended)).alias("is_active_on_date"), (day == start).alias("is_hire_date"),
        F.coalesce(day == ended, F.lit(False)).alias("is_termination_date"), F.datediff(day, start).alias("tenure_days"), *rest, F.lit(1).alias("employee_day_count"),
    )
