"""k-anonymity of a cell, given the size of its cohort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_reportable(size: Column, k: int) -> Column:
    return size >= k


def masked(metric: Column, size: Column, k: int, kind: str = "decimal(38,6)") -> Column:
    return F.when(is_reportable(size, k), metric.cast(kind))


def suppression_reason(size: Column, k: int) -> Column:
    return F.when(~is_reportable(size, k), "K_ANONYMITY_THRESHOLD")


def size_bucket(size: Column, k: int) -> Column:
    return F.when(is_reportable(size, k), size.cast("string")).otherwise(f"<{k}")


def privacy_columns(size: Column, k: int) -> dict[str, Column]:
    """The columns that tell a reader what was suppressed."""
    return {"cohort_size_bucket": size_bucket(size, k), "is_reportable": is_reportable(size, k), "suppression_reason": suppression_reason(size, k), "k_anonymity_threshold": F.lit(k)}
