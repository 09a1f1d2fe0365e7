"""Data checks: each returns the rows that break a rule, so an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once; nulls are no value."""
    known = df.dropna(subset=list(columns)) if len(columns) == 1 else df
    return known.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(~F.col(column).isin(values))


def relationship(df: DataFrame, column: str, to: DataFrame, to_column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).join(to.select(F.col(to_column).alias(column)), column, "left_anti")


def holds(df: DataFrame, rule: Column) -> DataFrame:
    return df.filter(~rule)


def freshness(df: DataFrame, column: str, as_of, warn_days: int = 7, error_days: int = 30) -> DataFrame:
    """One row: the latest load and whether it is too old."""
    age = F.datediff(F.lit(as_of), F.to_date("loaded"))
    state = F.when(F.col("loaded").isNull() | (age > error_days), "ERROR").when(age > warn_days, "WARN").otherwise("PASS")
    return df.agg(F.max(column).alias("loaded")).select("loaded", state.alias("state"))


def balance(**sides: DataFrame) -> DataFrame:
    """A row with the counts of the named frames, if they differ."""
    names = list(sides)
    out = None
    for name, df in sides.items():
        count = df.agg(F.count("*").alias(name))
        out = count if out is None else out.join(count, F.lit(True))
    return out.filter(" OR ".join(f"{names[0]} <> {n}" for n in names[1:]))


#: Columns that no public mart may have.
IDENTIFIERS = (
    "canonical_person_id", "hris_person_key", "hris_employee_id", "employee_sk", "daily_workforce_key", "date_of_birth", "sin_last_4", "legal_first_name", "legal_last_name", "preferred_name",
    "legal_first_name_original", "legal_last_name_original", "preferred_name_original",
)


def identifying_columns(frames: dict[str, DataFrame], denied: tuple[str, ...] = IDENTIFIERS) -> list[tuple[str, str]]:
    """Columns of public marts that name a person."""
    return [(name, c) for name, df in frames.items() for c in df.columns if c.lower() in denied]


def catalog_columns(spark: SparkSession, database: str, denied: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """``table_name, column_name, is_denied`` of every view and table of a database, as the catalog lists them."""
    found = []
    for table in spark.catalog.listTables(database):
        if not table.isTemporary and not table.name.endswith("_files"):
            found += [(table.name, c.name, c.name.lower() in denied) for c in spark.catalog.listColumns(f"`{database}`.`{table.name}`")]
    return spark.createDataFrame(found, "table_name string, column_name string, is_denied boolean")


def overlapping_spells(dim: DataFrame) -> DataFrame:
    following = F.lead("effective_start_date").over(Window.partitionBy("canonical_person_id").orderBy("effective_start_date", "hris_employee_id"))
    return dim.withColumn("following", following).filter("effective_end_date >= following").select("canonical_person_id", "hris_employee_id", "effective_end_date", "following")


def repeated(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose value of the column occurs more than once."""
    return df.join(unique(df, column).select(column), column, "left_semi")


def meeting_spells(dim: DataFrame) -> DataFrame:
    """The spells that have a day, up to the last before their end, in common with another spell of their person."""
    order = Window.partitionBy("canonical_person_id").orderBy("effective_start_date")
    last = F.coalesce(F.date_sub("termination_date", 1), F.lit("9999-12-31").cast("date"))
    ends = dim.withColumn("_last", last).filter("_last >= effective_start_date")
    before = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumns({"_before": before, "_next": F.lead("effective_start_date").over(order)}).filter("_before >= effective_start_date OR _next <= _last").drop("_last", "_before", "_next")


def several_active_a_day(daily: DataFrame) -> DataFrame:
    return daily.filter("is_active_on_date").groupBy("canonical_person_id", "snapshot_date").agg(F.count("*").alias("n")).filter("n > 1")


def shown_though_suppressed(mart: DataFrame, *metrics: str) -> DataFrame:
    return mart.filter("NOT is_reportable").filter(" OR ".join(f"{m} IS NOT NULL" for m in metrics))


#: What staged tables have to hold: columns that are never null, the unique key, the values of codes, links to other tables.
STAGED = {
    "stg_hris": (("hris_employee_id", "legal_first_name", "legal_last_name", "hire_date", "employment_status"), "hris_employee_id", {"employment_status": ["ACTIVE", "TERMINATED", "ON_LEAVE"], "employment_type": ["FTE", "CONTRACTOR", "PART_TIME"]}, {}),
    "stg_ats": (("ats_candidate_id", "preferred_first_name", "last_name"), "ats_candidate_id", {"sourced_from": ["LinkedIn", "Referral", "Career Site", "Indeed", "Recruiter"]}, {}),
    "stg_payroll": (("payroll_record_id", "employee_payroll_id", "legal_first_name", "legal_last_name", "pay_period_start", "pay_period_end"), "payroll_record_id", {}, {}),
    "stg_crm": (("crm_user_id", "preferred_first_name", "last_name", "active", "created_at"), "crm_user_id", {"role": ["SALES_REP", "SUPPORT_AGENT", "MARKETING"]}, {}),
    "stg_dms": (("dms_user_id", "short_first_name", "last_name"), "dms_user_id", {}, {}),
    "stg_erp": (("erp_user_id", "short_first_name", "last_name"), "erp_user_id", {}, {"linked_dms_user_id": ("stg_dms", "dms_user_id")}),
}


def staged_checks(e) -> dict[str, DataFrame]:
    """The generic checks of every staged table, as violation frames."""
    found = {}
    for name, (needed, key, codes, links) in STAGED.items():
        df = getattr(e, name)
        found |= {f"{name}.{c}.not_null": not_null(df, c) for c in needed}
        found[f"{name}.{key}.unique"] = unique(df, key)
        found |= {f"{name}.{c}.accepted_values": accepted_values(df, c, values) for c, values in codes.items()}
        found |= {f"{name}.{c}.relationship": relationship(df, c, getattr(e, to), at) for c, (to, at) in links.items()}
    found["stg_payroll.period.in_order"] = holds(e.stg_payroll, F.col("pay_period_start") <= F.col("pay_period_end"))
    found["identity_source_nodes.system_and_key.unique"] = unique(e.identity_source_nodes, "source_system", "source_record_key")
    return found


def all_checks(e) -> dict[str, DataFrame]:
    """Every check of the engine's models, as violation frames."""
    usable = e.stg_hris.filter("date_of_birth IS NOT NULL AND personal_email_local_part IS NOT NULL")
    merged = [p.filter("auto_merge_qualified") for p in e.passes]
    matched = merged[0].select("source_record_key", "hris_person_key").union(merged[1].select("source_record_key", "hris_person_key")).union(merged[2].select("source_record_key", "hris_person_key"))
    external = e.identity_source_nodes.filter("source_system <> 'HRIS'")
    accounted = matched.select("source_record_key").distinct().union(e.stewardship_queue.select("source_record_key"))
    systems = {"ATS": e.stg_ats, "CRM": e.stg_crm, "DMS_ERP": e.dms_erp_unified, "PAYROLL": e.payroll_spells, "HRIS": e.hris_persons}
    grain = {f"nodes_{s.lower()}": balance(rows=df, nodes=e.identity_source_nodes.filter(F.col("source_system") == s)) for s, df in systems.items()}
    return {f"check_{n}": df for n, df in {
        "hris_persons_no_orphan_spells": balance(spells=usable, counted=e.hris_persons.select(F.explode("hris_employee_ids"))),
        "hris_persons_unique_key": unique(e.hris_persons, "hris_person_key"),
        "payroll_no_orphan_periods": e.payroll_spells.agg(F.sum("pay_period_count").alias("counted")).join(e.stg_payroll.filter("employee_payroll_id IS NOT NULL").agg(F.count("*").alias("periods")), F.lit(True)).filter("counted <> periods"),
        "payroll_period_range": e.payroll_spells.filter("first_pay_period_start > most_recent_pay_period_end").select("employee_payroll_id"),
        **grain,
        "dms_user_once": unique(e.dms_erp_unified, "dms_user_id"),
        "erp_user_once": unique(e.dms_erp_unified, "erp_user_id"),
        "broken_link_implies_erp": e.dms_erp_unified.filter("has_broken_link AND NOT has_erp").select("dms_erp_person_key"),
        "dms_erp_has_a_source": e.dms_erp_unified.filter("NOT has_dms AND NOT has_erp").select("dms_erp_person_key"),
        "source_merged_once": matched.groupBy("source_record_key").agg(F.countDistinct("hris_person_key").alias("n")).filter("n > 1"),
        "no_orphan_nodes": external.join(accounted, "source_record_key", "left_anti").select("source_record_key"),
        "queue_has_no_merged": e.stewardship_queue.join(matched, "source_record_key", "left_semi").select("source_record_key"),
        "work_email_stable": e.stg_hris.filter("work_email_local_part IS NOT NULL").join(e.hris_persons.select("date_of_birth", "personal_email_local_part", "hris_person_key"), ["date_of_birth", "personal_email_local_part"]).groupBy("hris_person_key").agg(F.countDistinct("work_email_local_part").alias("n")).filter("n > 1"),
        "dim_covers_spells": balance(spells=usable, rows=e.dim_employee),
        "dim_no_overlap": overlapping_spells(e.dim_employee),
        "daily_one_active_row": several_active_a_day(e.workforce_daily),
        "daily_bounds": e.workforce_daily.filter(F.col("snapshot_date").isNull() | (F.col("snapshot_date") < F.col("effective_start_date")) | (F.col("snapshot_date") > F.col("termination_date")) | (F.col("snapshot_date") > F.lit(e.cfg.as_of))).select("daily_workforce_key"),
        "headcount_suppressed_null": shown_though_suppressed(e.headcount_daily, "headcount", "reportable_cohort_employee_count").select("headcount_daily_key"),
        "attrition_suppressed_null": shown_though_suppressed(e.attrition_monthly, "start_headcount", "terminations", "attrition_rate").select("attrition_monthly_key"),
        "headcount_small_suppressed": e.headcount_daily.filter(F.col("is_reportable") & (F.col("headcount") < e.cfg.k)).select("headcount_daily_key"),
        "attrition_small_suppressed": e.attrition_monthly.filter(F.col("is_reportable") & (F.col("start_headcount") < e.cfg.k)).select("attrition_monthly_key"),
        "summary_adds_up": e.suppression_summary.filter("row_count <> reportable_row_count + suppressed_row_count").select("privacy_surface"),
    }.items()}
