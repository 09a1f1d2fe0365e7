"""Files for people: CSV of review candidates, JSON and markdown of what was measured."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from . import metrics, residual


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header; written by the tasks that hold the rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short text as a folder with one file."""
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)


def metrics_json(rows: DataFrame) -> str:
    """Rows of (metric, name, value) as nested JSON: a number for each metric, or for each of its names."""
    out: dict = {}
    for metric, name, value in rows.collect():
        if name:
            out.setdefault(metric, {})[name] = value
        else:
            out[metric] = value
    return json.dumps(out, indent=2, sort_keys=True)


def review_report(title: str, rows: DataFrame, ranked: DataFrame, top: int = 10) -> str:
    """Markdown of the summary's rows and the best candidates of all."""
    best = metrics.fetch(residual.exported(residual.global_top(ranked, top)))
    return residual.report(title, sorted(tuple(r) for r in rows.collect()), best)
