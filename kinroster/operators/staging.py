"""Clean mirrors of the six raw tables: one row out for each row in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import local_part


def _trim(*names: str) -> dict[str, Column]:
    return {n: F.trim(n) for n in names}


def _original(*names: str) -> dict[str, Column]:
    return {f"{n}_original": F.trim(n) for n in names} | {n: F.lower(F.trim(n)) for n in names}


def _email(name: str, local: str) -> dict[str, Column]:
    return {name: F.lower(F.trim(name)), local: local_part(F.col(name))}


def _select(df: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    columns = {k: v for g in groups for k, v in g.items()}
    return df.select(*[c.alias(n) for n, c in columns.items()])


def _as_is(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def stg_hris(raw: DataFrame) -> DataFrame:
    preferred = F.nullif(F.trim("preferred_name"), F.lit(""))
    return _select(
        raw, _trim("hris_employee_id"), _original("legal_first_name", "legal_last_name"), {"preferred_name_original": preferred, "preferred_name": F.lower(preferred)},
        _as_is("date_of_birth", "hire_date", "termination_date"), _email("personal_email", "personal_email_local_part"), _email("work_email", "work_email_local_part"),
        {n: F.upper(F.trim(n)) for n in ("employment_status", "employment_type")}, _trim("department", "job_title", "manager_hris_id", "location"), _as_is("loaded_at"),
    )


def stg_ats(raw: DataFrame) -> DataFrame:
    return _select(
        raw, _trim("ats_candidate_id"), _original("preferred_first_name", "last_name"), _email("email", "email_local_part"), _trim("phone"),
        _as_is("application_date", "offer_accepted_date"), _trim("sourced_from", "requisition_department", "requisition_job_title"), _as_is("loaded_at"),
    )


def stg_payroll(raw: DataFrame) -> DataFrame:
    return _select(
        raw, _trim("payroll_record_id", "employee_payroll_id"), _original("legal_first_name", "legal_last_name"),
        _as_is("sin_last_4", "pay_period_start", "pay_period_end", "gross_amount_cad", "hours_worked"), _trim("job_code", "cost_center"), _as_is("loaded_at"),
    )


def stg_crm(raw: DataFrame) -> DataFrame:
    return _select(
        raw, _trim("crm_user_id"), {"display_name_original": F.trim("display_name")}, _original("preferred_first_name", "last_name"), _email("crm_email", "crm_email_local_part"),
        _trim("location_id"), {"role": F.upper(F.trim("role"))}, _as_is("active", "created_at", "deactivated_at", "loaded_at"),
    )


def stg_dms(raw: DataFrame) -> DataFrame:
    return _select(
        raw, _trim("dms_user_id"), _original("short_first_name", "last_name"), {"dms_username": F.lower(F.trim("dms_username"))},
        _trim("location_code", "department_code"), _as_is("hire_date_dms", "terminated_date_dms", "loaded_at"),
    )


def stg_erp(raw: DataFrame) -> DataFrame:
    return _select(
        raw, _trim("erp_user_id", "linked_dms_user_id"), _original("short_first_name", "last_name"), _email("erp_email", "erp_email_local_part"),
        _trim("role_code", "permissions_group"), _as_is("created_at", "last_login_at"), {"has_broken_dms_link": F.col("linked_dms_user_id").isNull()}, _as_is("loaded_at"),
    )


#: raw table -> (staging table, its function)
STAGING = {
    "hris_employees": ("stg_hris", stg_hris),
    "ats_candidates": ("stg_ats", stg_ats),
    "payroll_records": ("stg_payroll", stg_payroll),
    "crm_sales_reps": ("stg_crm", stg_crm),
    "dms_users": ("stg_dms", stg_dms),
    "erp_users": ("stg_erp", stg_erp),
}
