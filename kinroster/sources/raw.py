"""The six raw tables: their declared columns, readers, and a loader that replaces a table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import Table

#: The columns of the raw tables, in order.
SCHEMAS = {
    "hris_employees": "hris_employee_id string, legal_first_name string, legal_last_name string, preferred_name string, date_of_birth date, personal_email string, work_email string, hire_date date, "
    "termination_date date, employment_status string, employment_type string, department string, job_title string, manager_hris_id string, location string, loaded_at timestamp_ntz",
    "ats_candidates": "ats_candidate_id string, preferred_first_name string, last_name string, email string, phone string, application_date date, offer_accepted_date date, sourced_from string, "
    "requisition_department string, requisition_job_title string, loaded_at timestamp_ntz",
    "payroll_records": "payroll_record_id string, employee_payroll_id string, legal_first_name string, legal_last_name string, sin_last_4 string, pay_period_start date, pay_period_end date, "
    "gross_amount_cad decimal(12,2), hours_worked decimal(8,2), job_code string, cost_center string, loaded_at timestamp_ntz",
    "crm_sales_reps": "crm_user_id string, preferred_first_name string, last_name string, display_name string, crm_email string, location_id string, role string, active boolean, "
    "created_at timestamp_ntz, deactivated_at timestamp_ntz, loaded_at timestamp_ntz",
    "dms_users": "dms_user_id string, short_first_name string, last_name string, dms_username string, location_code string, department_code string, hire_date_dms date, terminated_date_dms date, "
    "loaded_at timestamp_ntz",
    "erp_users": "erp_user_id string, linked_dms_user_id string, short_first_name string, last_name string, erp_email string, role_code string, permissions_group string, created_at timestamp_ntz, "
    "last_login_at timestamp_ntz, loaded_at timestamp_ntz",
}


def shaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the declared columns and types of a raw table; a missing column is an error, others are left out."""
    wanted = [c.rsplit(" ", 1) for c in SCHEMAS[name].split(", ")]
    missing = {c for c, _ in wanted} - {c.lower() for c in df.columns}
    if missing:
        raise ValueError(f"{name} lacks {sorted(missing)}")
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in wanted])


def declared(name: str) -> list[tuple[str, str]]:
    return [tuple(c.rsplit(" ", 1)) for c in SCHEMAS[name].split(", ")]


def read(spark: SparkSession, folder: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """The raw tables of a folder, ``<table>.parquet`` or, with headers, ``<table>.csv``. Reading is lazy."""
    reader, out = spark.read.option("header", True), {}
    for name in SCHEMAS:
        where = f"{folder}/{name}.{kind}"
        loaded = Table(spark, where) if kind == "parquet" else None
        out[name] = shaped(loaded.read() if loaded and loaded.exists else reader.format(kind).load(where), name)
    return out


def load(df: DataFrame, folder: str, name: str) -> None:
    """Replace the rows of a raw table with those of ``df``, in one step: readers see the old rows or the new ones."""
    Table(df.sparkSession, f"{folder}/{name}.parquet").replace(shaped(df, name))


#: Why a row is rejected: it does not have the file's columns, or a cell is not of its column's type.
MALFORMED, BAD_TYPE = "malformed row", "not of the declared type"
CORRUPT = "_corrupt_record"


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as text; ``_corrupt_record`` has the line of a row with too many or too few cells."""
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in [*names, CORRUPT])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def sorted_out(text: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of text in the declared columns and types, and the rejected ones: ``table_name, reason, columns, row``.

    ``columns`` names the cells that are not of their type. Empty cells are null and of any type.
    """
    wanted = declared(name)
    missing = {c for c, _ in wanted} - {c.lower() for c in text.columns}
    if missing:
        raise ValueError(f"{name} lacks {sorted(missing)}")
    cell = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    bad = F.array_compact(F.array(*[F.when(cell(c).isNotNull() & cell(c).try_cast(kind).isNull(), F.lit(c)) for c, kind in wanted if kind != "string"]))
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in text.columns else F.lit(False)
    marked = text.withColumns({"_bad": bad, "_malformed": corrupt})
    good = marked.filter(~F.col("_malformed") & (F.size("_bad") == 0)).select(*[(F.col(c) if kind == "string" else cell(c).try_cast(kind)).alias(c) for c, kind in wanted])
    whole = F.to_json(F.struct(*[F.col(c) for c, _ in wanted]))
    row = F.coalesce(F.col(CORRUPT), whole) if CORRUPT in text.columns else whole
    rejected = marked.filter(F.col("_malformed") | (F.size("_bad") > 0)).select(F.lit(name).alias("table_name"), F.when(F.col("_malformed"), MALFORMED).otherwise(BAD_TYPE).alias("reason"), F.col("_bad").alias("columns"), row.alias("row"))
    return good, rejected


class TooManyRejects(RuntimeError):
    pass


def bulk_load(spark: SparkSession, files: str, folder: str, names: tuple[str, ...] = tuple(SCHEMAS), most_rejected: float = 1.0) -> dict[str, tuple[int, int]]:
    """Load ``files/<table>.csv`` into the raw tables of ``folder``; rows loaded and rejected, by table.

    Rejected rows are the table ``folder/rejects/<table>``. Good rows replace the old ones in one step.
    If more than the share ``most_rejected`` is rejected, or the load breaks off, the old rows stay.
    """
    out = {}
    for name in names:
        good, rejected = sorted_out(text_rows(spark, f"{files}/{name}.csv"), name)
        rejects, staged = Table(spark, f"{folder}/rejects/{name}"), Table(spark, f"{folder}/{name}.parquet")
        rejects.replace(rejected)
        bad = rejects.read().count()
        units = staged.stage(good)
        rows = staged.staged(units, good.schema).count()
        if bad > most_rejected * (rows + bad):
            raise TooManyRejects(f"{name}: {bad} of {rows + bad} rows")
        staged.commit_staged(units, good.schema, rejected=bad)
        out[name] = (rows, bad)
    return out
