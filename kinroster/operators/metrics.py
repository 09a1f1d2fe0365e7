"""Metric queries over the marts, their audit, and what a dashboard shows of them."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import asdict, dataclass
from functools import reduce
from operator import and_

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from . import privacy

MOST_ROWS, USUAL_ROWS = 5000, 1000


@dataclass(frozen=True)
class Filters:
    """An empty value means that nothing is filtered. Both dates are inclusive."""

    start_date: dt.date | None = None
    end_date: dt.date | None = None
    department: str | None = None
    location: str | None = None
    employment_type: str | None = None
    limit: int = USUAL_ROWS
    privacy_surface: str | None = None

    def payload(self) -> dict:
        """What the audit log keeps: everything that was given."""
        given = {k: v for k, v in asdict(self).items() if v is not None}
        return {k: v.isoformat() if isinstance(v, dt.date) else v for k, v in given.items()}


@dataclass(frozen=True)
class Surface:
    name: str
    date: str
    columns: tuple[str, ...]
    order: tuple[str, ...]


_END = ("cohort_size_bucket", "is_reportable", "suppression_reason", "k_anonymity_threshold")
#: The surfaces that may be asked for.
SURFACES = {
    "headcount": Surface("workforce_headcount_daily", "snapshot_date", ("snapshot_date", *privacy.DIMENSIONS, "headcount", "reportable_cohort_employee_count", *_END), ("snapshot_date", *privacy.DIMENSIONS)),
    "attrition": Surface("workforce_attrition_monthly", "month_start_date", ("month_start_date", "month_end_date", *privacy.DIMENSIONS, "start_headcount", "terminations", "attrition_rate", *_END), ("month_start_date", *privacy.DIMENSIONS)),
    "suppression": Surface("privacy_suppression_summary", "", ("privacy_surface", "date_grain", "row_count", "reportable_row_count", "suppressed_row_count", "suppressed_row_rate", "k_anonymity_threshold", "generated_at"), ("privacy_surface",)),
}


class UnknownSurface(ValueError):
    pass


class SourceUnavailable(RuntimeError):
    """A mart that could not be read; a server would answer with this status."""

    status = 503


def identifier(name: str) -> str:
    """A table or schema name in upper case; anything but letters, digits and underscores is refused."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name.upper()


def bounded(limit: int) -> int:
    return max(1, min(limit, MOST_ROWS))


def metric_query(mart: DataFrame, surface: str, filters: Filters = Filters()) -> DataFrame:
    """The rows of a surface, filtered, ordered and limited; lazy, so the filters reach the scan."""
    if surface not in SURFACES:
        raise UnknownSurface(surface)
    known = SURFACES[surface]
    wanted = []
    if known.date:
        wanted += [F.col(known.date) >= F.lit(filters.start_date)] if filters.start_date else []
        wanted += [F.col(known.date) <= F.lit(filters.end_date)] if filters.end_date else []
        if privacy.MONTH in mart.columns:  # a table with a folder for each month: others are not listed
            wanted += [F.col(privacy.MONTH) >= F.lit(filters.start_date.replace(day=1))] if filters.start_date else []
            wanted += [F.col(privacy.MONTH) <= F.lit(filters.end_date)] if filters.end_date else []
        wanted += [F.col(n) == getattr(filters, n) for n in privacy.DIMENSIONS if getattr(filters, n)]
    elif filters.privacy_surface:
        wanted.append(F.col("privacy_surface") == filters.privacy_surface)
    rows = mart.filter(reduce(and_, wanted)) if wanted else mart
    return rows.select(*known.columns).orderBy(*known.order).limit(bounded(filters.limit))


@dataclass(frozen=True)
class Statement:
    """SQL with named markers, and their values; no value is ever part of the text."""

    sql: str
    args: dict

    def run(self, spark: SparkSession) -> DataFrame:
        return spark.sql(self.sql, args=self.args)


def table_name(database: str, name: str) -> str:
    """A table's full name, of identifiers only."""
    return f"{identifier(database)}.{identifier(name)}"


def statement(surface: str, filters: Filters = Filters(), database: str = "people_analytics", table: str | None = None, by_month: bool = True) -> Statement:
    """The query of ``metric_query`` as SQL over a named table, whose filters are bound values.

    ``table`` is the surface's table in ``database``. With ``by_month`` the table has a folder for each
    month, and others are not read.
    """
    if surface not in SURFACES:
        raise UnknownSurface(surface)
    known = SURFACES[surface]
    args: dict = {"table": table_name(database, table or known.name), "most": bounded(filters.limit)}
    where = []
    if known.date:
        for name, sign in (("start_date", ">="), ("end_date", "<=")):
            if day := getattr(filters, name):
                where.append(f"{known.date} {sign} :{name}")
                args[name] = day
                if by_month:
                    where.append(f"{privacy.MONTH} {sign} :{name}_month")
                    args[f"{name}_month"] = day.replace(day=1)
        for name in privacy.DIMENSIONS:
            if value := getattr(filters, name):
                where.append(f"{name} = :{name}")
                args[name] = value
    elif filters.privacy_surface:
        where.append("privacy_surface = :privacy_surface")
        args["privacy_surface"] = filters.privacy_surface
    text = f"SELECT {', '.join(known.columns)} FROM IDENTIFIER(:table)" + (" WHERE " + " AND ".join(where) if where else "")
    return Statement(f"{text} ORDER BY {', '.join(known.order)} LIMIT :most", args)


def metadata(summary: DataFrame) -> DataFrame:
    """One row over the suppression summary: surfaces, rows, reportable rows, k."""
    return summary.agg(F.array_join(F.array_sort(F.collect_set("privacy_surface")), "||").alias("surfaces"), F.count("*").alias("surface_count"), F.sum("row_count").alias("row_count"), F.count_if(F.col("suppressed_row_count") > 0).alias("surfaces_with_suppression"), F.min("k_anonymity_threshold").alias("k_anonymity_threshold"))


def metadata_response(summary: DataFrame) -> dict:
    row = metadata(summary).first().asDict()
    return row | {"surfaces": [s for s in (row["surfaces"] or "").split("||") if s.strip()]}


def as_json(df: DataFrame) -> DataFrame:
    """Columns of types that JSON has: days and times as ISO text, decimals as whole or floating numbers."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "date":
            out[name] = F.date_format(name, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            out[name] = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind.startswith("decimal"):
            out[name] = F.col(name).cast("long" if kind.endswith(",0)") else "double")
    return df.withColumns(out).toDF(*map(str.lower, df.columns))


def fetch(df: DataFrame) -> list[dict]:
    """At most ``MOST_ROWS`` rows as plain dictionaries with lower-case names."""
    return [r.asDict() for r in as_json(df).limit(MOST_ROWS).collect()]


def respond(spark: SparkSession, mart: DataFrame, surface: str, filters: Filters, cfg: EngineConfig, purpose: str, log_path: str, actor: str | None = None) -> dict:
    """The rows of a surface in an envelope, after the access was logged. A log that fails does not fail the answer."""
    if not 1 <= len(purpose) <= 255:
        raise ValueError("a purpose has 1 to 255 characters")
    query = metric_query(mart, surface, filters)
    try:
        rows = fetch(query)
    except (PySparkException, Py4JError) as error:
        raise SourceUnavailable(SURFACES[surface].name) from error
    hidden = sum(r.get("is_reportable") is False for r in rows)
    event = (actor or "anonymous", SURFACES[surface].name, purpose, json.dumps(filters.payload(), sort_keys=True), len(rows), hidden)
    try:
        privacy.append_audit(privacy.audit_event(spark, cfg, *event, str(uuid.uuid4())), log_path)
        logged = True
    except (PySparkException, Py4JError, OSError):  # the log is best effort: storage that fails does not fail the answer
        logged = False
    return {"data": rows, "row_count": len(rows), "suppressed_row_count": hidden, "audit_logged": logged}


def health() -> dict:
    return {"status": "ok"}


def root() -> dict:
    return {"service": "workforce metrics", "surfaces": sorted(SURFACES)}


def default_window(headcount: DataFrame) -> DataFrame:
    """The last seven days that the mart has."""
    return headcount.agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("end_date")).select(F.greatest("lo", F.date_sub("end_date", 6)).alias("start_date"), "end_date")


def latest_headcount(headcount: DataFrame) -> DataFrame:
    """Sum over the reportable cells of the last day that has one."""
    days = headcount.filter("headcount IS NOT NULL").groupBy("snapshot_date").agg(F.sum("headcount").alias("headcount"))
    return days.agg(F.max_by("headcount", "snapshot_date").alias("headcount"), F.max("snapshot_date").alias("snapshot_date"))


def latest_attrition(attrition: DataFrame) -> DataFrame:
    """Mean of the cells' rates, unweighted, in the last month that has one."""
    months = attrition.filter("attrition_rate IS NOT NULL").groupBy("month_start_date").agg(F.avg("attrition_rate").alias("attrition_rate"))
    return months.agg(F.max_by("attrition_rate", "month_start_date").alias("attrition_rate"), F.max("month_start_date").alias("month_start_date"))


def headcount_trend(headcount: DataFrame) -> DataFrame:
    return headcount.filter("headcount IS NOT NULL").groupBy("snapshot_date").agg(F.sum("headcount").alias("headcount"))


def attrition_trend(attrition: DataFrame) -> DataFrame:
    return attrition.filter("attrition_rate IS NOT NULL").groupBy("month_start_date").agg(F.avg("attrition_rate").alias("attrition_rate"))


def suppression_kpis(summary: DataFrame) -> DataFrame:
    """Reportable rows and the share of suppressed ones over all surfaces; 0 without rows."""
    total = summary.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n"), F.coalesce(F.sum("suppressed_row_count"), F.lit(0)).alias("hidden"))
    return total.select((F.col("n") - F.col("hidden")).alias("reportable_rows"), F.coalesce(F.try_divide(F.col("hidden").cast("double"), F.col("n")), F.lit(0.0)).alias("suppression_rate"))
