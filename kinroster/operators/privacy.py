"""k-anonymous marts, their summary, and the audit log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions.keys import surrogate_key
from ..functions.privacy import masked, privacy_columns
from ..plans.tables import Table

DIMENSIONS = ("department", "location", "employment_type")
#: The column of a written mart whose values, first days of months, have folders of their own.
MONTH = "month"


def _dimensions() -> list[Column]:
    return [F.coalesce(c, F.lit("UNKNOWN")).alias(c) for c in DIMENSIONS]


def _headcount(cohorts: DataFrame, k: int) -> DataFrame:
    """The mart from exact cohort sizes ``n``."""
    keys, n = ["snapshot_date", *DIMENSIONS], F.col("n")
    shown = {"headcount": masked(n, n, k, "long"), "reportable_cohort_employee_count": masked(n, n, k, "long")} | privacy_columns(n, k)
    return cohorts.select(surrogate_key(*keys).alias("headcount_daily_key"), *keys, *[c.alias(name) for name, c in shown.items()])


def headcount_daily(daily: DataFrame, k: int) -> DataFrame:
    """Distinct active persons by day and cohort, exact: suppression depends on it."""
    active = daily.filter("is_active_on_date").select("snapshot_date", *_dimensions(), "canonical_person_id")
    return _headcount(active.groupBy("snapshot_date", *DIMENSIONS).agg(F.countDistinct("canonical_person_id").alias("n")), k)


def headcount_from_spells(spells: DataFrame, as_of: dt.date, k: int, since: dt.date | None = None) -> DataFrame:
    """The same mart without the daily rows; with ``since``, its days from then on.

    Spells of a person in one cohort are merged where they overlap or touch; each merged spell adds
    one on its first day and takes one away after its last. Running sums over these events give the
    sizes, and a size is written out for the days on which it holds. Work follows the number of
    spells and of result rows, not of employee days.
    """
    start, after = F.col("effective_start_date"), F.date_add(F.lit(as_of), 1)
    active = spells.select("canonical_person_id", *_dimensions(), start.alias("lo"), F.least(F.coalesce("termination_date", after), after).alias("hi")).filter("lo < hi")
    of_person = Window.partitionBy("canonical_person_id", *DIMENSIONS).orderBy("lo", "hi")
    reach = F.max("hi").over(of_person.rowsBetween(Window.unboundedPreceding, -1))
    islands = active.withColumn("new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(of_person))
    merged = islands.groupBy("canonical_person_id", *DIMENSIONS, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    both = F.array(F.struct(F.col("lo").alias("day"), F.lit(1).alias("by")), F.struct(F.col("hi").alias("day"), F.lit(-1).alias("by")))
    events = merged.select(*DIMENSIONS, F.explode(both).alias("e")).groupBy(*DIMENSIONS, F.col("e.day").alias("day")).agg(F.sum("e.by").alias("by"))
    of_cohort = Window.partitionBy(*DIMENSIONS).orderBy("day")
    sizes = events.select(*DIMENSIONS, "day", F.sum("by").over(of_cohort).alias("n"), F.lead("day").over(of_cohort).alias("next")).filter("n > 0")
    first = F.greatest("day", F.lit(since)) if since else F.col("day")
    shown = sizes.filter(F.col("next") > first)
    return _headcount(shown.select(F.explode(F.sequence(first, F.date_sub("next", 1))).alias("snapshot_date"), *DIMENSIONS, "n"), k)


def _attrition(persons: DataFrame, k: int) -> DataFrame:
    """The mart from one row for each month, cohort and person, which says whether it ``starts`` the month and ``leaves`` in it."""
    keys = ["month_start_date", *DIMENSIONS]
    cells = persons.groupBy(*keys).agg(F.count_if("starts").alias("n"), F.count_if("leaves").alias("left"))
    n, left = F.col("n"), F.col("left")
    rate = left.cast("double") / F.nullif(n, F.lit(0)).cast("double")
    shown = {"start_headcount": masked(n, n, k, "long"), "terminations": masked(left, n, k, "long"), "attrition_rate": masked(rate, n, k, "double")} | privacy_columns(n, k)
    return cells.select(surrogate_key(*keys).alias("attrition_monthly_key"), "month_start_date", F.last_day("month_start_date").alias("month_end_date"), *DIMENSIONS, *[c.alias(name) for name, c in shown.items()])


def attrition_monthly(daily: DataFrame, k: int) -> DataFrame:
    """Terminations over the persons active on the month's first snapshot day, by month and cohort.

    That day is the first of the whole month, not of the cohort.
    """
    rows = daily.select(F.trunc("snapshot_date", "MM").alias("month_start_date"), *_dimensions(), "snapshot_date", "canonical_person_id", "is_active_on_date", "is_termination_date")
    opening = F.broadcast(rows.groupBy("month_start_date").agg(F.min("snapshot_date").alias("first_day")))  # a row for each month
    first = (F.col("snapshot_date") == F.col("first_day")) & F.col("is_active_on_date")
    persons = rows.join(opening, "month_start_date").groupBy("month_start_date", *DIMENSIONS, "canonical_person_id")
    return _attrition(persons.agg(F.max(first).alias("starts"), F.max("is_termination_date").alias("leaves")), k)


def attrition_from_spells(spells: DataFrame, as_of: dt.date, k: int, since: dt.date | None = None) -> DataFrame:
    """The same mart from months of spells instead of days; with ``since``, a first of a month, its months from then on."""
    start, ended = F.col("effective_start_date"), F.col("termination_date")
    last = F.least(F.coalesce(ended, F.lit(as_of)), F.lit(as_of))
    first_month = F.greatest(F.trunc(start, "MM"), F.lit(since)) if since else F.trunc(start, "MM")
    months = F.sequence(first_month, F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH"))
    rows = spells.filter((last >= start) & (F.trunc(last, "MM") >= first_month)).select("canonical_person_id", *_dimensions(), start.alias("lo"), ended.alias("ended"), F.explode(months).alias("month_start_date"))
    opening = F.broadcast(rows.groupBy("month_start_date").agg(F.min(F.greatest("lo", "month_start_date")).alias("first_day")))  # a row for each month
    first = F.col("first_day")
    starts = (F.col("lo") <= first) & (F.col("ended").isNull() | (first < F.col("ended")))
    leaves = F.coalesce((F.trunc("ended", "MM") == F.col("month_start_date")) & (F.col("ended") <= F.lit(as_of)), F.lit(False))
    persons = rows.join(opening, "month_start_date").groupBy("month_start_date", *DIMENSIONS, "canonical_person_id")
    return _attrition(persons.agg(F.max(starts).alias("starts"), F.max(leaves).alias("leaves")), k)


def by_month(mart: DataFrame, date: str) -> DataFrame:
    """``mart`` with its ``month``, in the order in which it is asked for."""
    return mart.withColumn(MONTH, F.trunc(date, "MM")).sortWithinPartitions(MONTH, *[c for c in DIMENSIONS if c in mart.columns], date)


def suppression_summary(headcount: DataFrame, attrition: DataFrame, cfg: EngineConfig) -> DataFrame:
    """How much of each surface is suppressed."""

    def of(df: DataFrame, surface: str, grain: str) -> DataFrame:
        counts = df.agg(F.count("*").alias("row_count"), F.count_if("is_reportable").alias("reportable_row_count"), F.count_if(~F.col("is_reportable")).alias("suppressed_row_count"), F.min("k_anonymity_threshold").alias("k_anonymity_threshold"))
        return counts.select(
            surrogate_key(F.lit(surface), F.lit(grain)).alias("privacy_suppression_summary_key"), F.lit(surface).alias("privacy_surface"), F.lit(grain).alias("date_grain"), "row_count", "reportable_row_count",
            "suppressed_row_count", (F.col("suppressed_row_count").cast("double") / F.nullif("row_count", F.lit(0)).cast("double")).alias("suppressed_row_rate"), "k_anonymity_threshold", F.lit(cfg.stamp).cast("timestamp_ntz").alias("generated_at"),
        )

    return of(headcount, "workforce_headcount_daily", "daily").unionByName(of(attrition, "workforce_attrition_monthly", "monthly"))


AUDIT = "audit_event_id string, audited_at timestamp_ntz, actor string, query_surface string, purpose string, filters_json string, k_anonymity_threshold int, result_row_count long, suppressed_row_count long, privacy_policy_version string, dbt_invocation_id string"


def empty_audit_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], AUDIT)


def audit_event(spark: SparkSession, cfg: EngineConfig, actor: str, surface: str, purpose: str, filters: str, rows: int, suppressed: int, event_id: str) -> DataFrame:
    """One row for the log. Filters that are not JSON are logged as null."""
    values = [(event_id, cfg.stamp, actor, surface, purpose, filters, cfg.k, rows, suppressed, cfg.policy_version, cfg.run_id)]
    row = spark.createDataFrame(values, AUDIT)
    return row.withColumn("filters_json", F.when(F.try_parse_json("filters_json").isNotNull(), F.col("filters_json")))


def audit_table(spark: SparkSession, path: str) -> Table:
    """The log under ``path``: one row for each ``audit_event_id``, whatever is delivered twice."""
    return Table(spark, path, key=("audit_event_id",))


def append_audit(events: DataFrame, path: str) -> None:
    """Add events to the log, which is made if there is none.

    An event that is there already is replaced by its new row. Columns that the log does not have are
    added, and are null in older rows; columns that the events lack stay. Writers may come at once.
    """
    audit_table(events.sparkSession, path).merge(events, "append_new_columns")


def keep_audit_log(spark: SparkSession, path: str) -> None:
    """What a build does with the log: make it, empty, if it is not there, and leave it alone if it is."""
    if not audit_table(spark, path).exists:
        append_audit(empty_audit_log(spark), path)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """The log under ``path``; empty if nothing was logged yet."""
    log = audit_table(spark, path)
    return log.read() if log.exists else empty_audit_log(spark)


def order_events(orders: DataFrame, day: str, cfg: EngineConfig) -> DataFrame:
    """Access events as the log has them, derived from orders: each order was looked at on ``day``.

    Number and suppression of the rows follow from the customer and the order's status.
    """
    c = F.col
    return orders.select(
        F.md5(F.concat_ws("-", F.lit("order"), "o_orderkey")).alias("audit_event_id"), c(day).cast("timestamp_ntz").alias("audited_at"), F.concat(F.lit("actor-"), c("o_custkey") % 10).alias("actor"),
        F.when(c("o_orderstatus") == "O", "workforce_headcount_daily").otherwise("workforce_attrition_monthly").alias("query_surface"), c("o_orderpriority").alias("purpose"),
        F.to_json(F.struct(c("o_orderstatus").alias("status"))).alias("filters_json"), F.lit(cfg.k).alias("k_anonymity_threshold"), (c("o_custkey") % 100).alias("result_row_count"),
        F.when(c("o_orderstatus") == "F", c("o_custkey") % 100).otherwise(0).cast("long").alias("suppressed_row_count"), F.lit(cfg.policy_version).alias("privacy_policy_version"), F.lit(cfg.run_id).cast("string").alias("dbt_invocation_id"),
    )
