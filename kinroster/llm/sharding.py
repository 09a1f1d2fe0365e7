"""Sharding by histogram sort: near-equal bytes in every shard, one exchange.

Rows are ordered by (hash of the text, doc_id, position), so equal texts lie together. The
driver probes that order: it draws candidate boundaries from the rows, counts the exact bytes
and rows below each over all partitions, and draws again only inside intervals that hold a
boundary that is still off by more than the tolerance. The boundaries then cut the table into
buckets, and a single exchange brings each bucket together. A shard is a run of buckets; since
the number of rows below each bucket is known, slots are numbered without a second exchange.

No task sorts a whole shard: buckets grow in number with the bytes. A group of equal texts of
any size is cut like anything else, because doc_id and position take part in the order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import support

KEY = ("_hs_hash", "_hs_id", "_hs_at")
LOWEST = -(2**63)


@dataclass(frozen=True)
class Splitters:
    """Boundaries of the buckets, in order, and the rows below each bucket."""

    keys: np.ndarray
    rows_below: np.ndarray
    bytes_below: np.ndarray
    rounds: int


def packed(*parts: np.ndarray) -> np.ndarray:
    """Keys of three signed longs as byte strings that compare in the same order."""
    columns = [np.asarray(p, dtype="int64").view("uint64") ^ np.uint64(1 << 63) for p in parts]
    return np.ascontiguousarray(np.stack(columns, axis=1).astype(">u8")).view("S24").ravel()


def looked_up(keys: np.ndarray, values: np.ndarray, kind: str) -> Column:
    """For each row the value of its interval: ``values[i]`` where i ``keys`` are not above the row's key."""

    @F.pandas_udf(kind)
    def place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(values[np.searchsorted(keys, packed(a.to_numpy(), b.to_numpy(), c.to_numpy()), side="right")])

    return place(*KEY)


def below(keys: np.ndarray) -> Column:
    return looked_up(keys, np.arange(len(keys) + 1, dtype="int32"), "int")


def find_splitters(keyed: DataFrame, parts: int, tolerance: np.ndarray | float, draws: int = 8, seed: int = 17, most_rounds: int = 200) -> Splitters:
    """Boundaries that cut ``keyed`` (the key columns and ``_hs_size``) into ``parts`` of equal bytes.

    ``tolerance`` is in bytes, one for all boundaries or one for each. A boundary is also settled
    when no row is left between its neighbours. Each round sends ``draws`` keys for each open
    boundary to the driver, and one row of counts for each key. The rounds are few, since each makes
    the open intervals about ``draws`` times smaller; an error is raised if ``most_rounds`` don't suffice.
    """
    rows, size = (int(x or 0) for x in keyed.agg(F.count("*"), F.sum("_hs_size")).first())
    targets = np.arange(1, parts) * (size / parts)
    allowed = np.broadcast_to(np.asarray(tolerance, dtype=float), targets.shape)
    keys, lines, weight = np.array([], dtype="S24"), np.array([rows]), np.array([size])
    open_, done = np.arange(len(targets)) if rows else np.array([], dtype=int), 0
    while len(open_):
        if done == most_rounds:
            raise RuntimeError(f"{len(open_)} boundaries are not settled after {most_rounds} rounds")
        done += 1
        inside = np.searchsorted(np.cumsum(weight)[:-1], targets[open_], side="right")
        wanted, count = np.unique(inside, return_counts=True)
        chance = np.zeros(len(lines))
        chance[wanted] = np.minimum(1.0, draws * count / np.maximum(lines[wanted], 1))
        drawn = keyed.select(*KEY, looked_up(keys, chance * float(1 << 30), "double").alias("odds"))
        drawn = drawn.filter(F.pmod(F.xxhash64(*KEY, F.lit(seed + done)), F.lit(1 << 30)) < F.col("odds")).select(*KEY).toPandas()
        fresh = packed(*(drawn[k].to_numpy() for k in KEY))
        merged = np.union1d(keys, fresh)
        if len(merged) > len(keys):
            keys = merged
            seen = keyed.select(below(keys).alias("_hs_in"), "_hs_size").groupBy("_hs_in").agg(F.count("*").alias("n"), F.sum("_hs_size").alias("b")).toPandas()
            lines, weight = np.zeros(len(keys) + 1, dtype="int64"), np.zeros(len(keys) + 1, dtype="int64")
            lines[seen["_hs_in"]], weight[seen["_hs_in"]] = seen["n"], seen["b"]
        total = np.cumsum(weight)[:-1]
        near = nearest(total, targets)
        inside = np.searchsorted(total, targets, side="right")
        open_ = np.flatnonzero((np.abs(total[near] - targets) > allowed) & (lines[inside] > 1))
    if not rows:
        none = np.zeros(parts, dtype="int64")
        return Splitters(np.array([], dtype="S24"), none, none, 0)
    near = np.maximum.accumulate(nearest(np.cumsum(weight)[:-1], targets)) if len(keys) else np.array([], dtype=int)
    return Splitters(keys[near], np.concatenate([[0], np.cumsum(lines)[:-1][near]]), np.concatenate([[0], np.cumsum(weight)[:-1][near]]), done)


def nearest(ordered: np.ndarray, targets: np.ndarray) -> np.ndarray:
    right = np.clip(np.searchsorted(ordered, targets), 0, max(len(ordered) - 1, 0))
    left = np.maximum(right - 1, 0)
    return np.where(np.abs(ordered[left] - targets) <= np.abs(ordered[right] - targets), left, right)


def shard(df: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", size: Column | None = None, digest: Column | None = None, tolerance: float = 0.001, bucket_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``size`` is what to even out; by default the UTF-8 bytes of the text plus 8. ``digest`` groups equal
    texts; by default it is the text's xxhash64. Shards differ by
    at most ``tolerance`` of their mean, plus one row. ``bucket_bytes`` bounds what one task sorts.
    The input is written once to the shared folder, since every later pass must see the same rows
    in the same places.

    Null texts form one group of size 8; null ids come first in their group; empty and very long
    texts are rows like others; repeated rows are told apart by position; an empty table gives an
    empty table. Columns named ``shard`` or ``slot`` in the input are replaced; other extra
    columns are kept.
    """
    kind = dict(df.dtypes)[id_column]
    identity = F.col(id_column).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(id_column)
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + 8 if size is None else size
    digest = F.xxhash64(text_column) if digest is None else digest
    plain = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    keys = {KEY[0]: digest, KEY[1]: F.coalesce(identity, F.lit(LOWEST)), KEY[2]: F.monotonically_increasing_id(), "_hs_size": size}
    keyed = support.written(df.select(plain.alias("row"), *[c.alias(n) for n, c in keys.items()]), "shard")
    total = int(keyed.agg(F.sum("_hs_size")).first()[0] or 0)
    each = max(4, -(-total // (shards * bucket_bytes)))
    parts = shards * each
    coarse = np.arange(1, parts) % each == 0
    found = find_splitters(keyed, parts, np.where(coarse, tolerance * total / shards / 2, 0.1 * total / parts))
    start = found.rows_below - found.rows_below[(np.arange(parts) // each) * each]
    within = Window.partitionBy("_hs_bucket").orderBy(*KEY)
    return (
        keyed.withColumn("_hs_bucket", below(found.keys))
        .withColumn("_hs_start", looked_up(found.keys, start, "long"))
        .withColumn("shard", F.floor(F.col("_hs_bucket") / each).cast("int"))
        .withColumn("slot", (F.col("_hs_start") + F.row_number().over(within) - 1).cast("long"))
        .select("row.*", "shard", "slot")
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes, as digests."""
    docs = support.table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), support.crc32_of(F.col("text")).alias("text_crc32"), F.xxhash64("text").alias("hash"))
    return shard(slim, 24, size=F.col("size"), digest=F.col("hash")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
