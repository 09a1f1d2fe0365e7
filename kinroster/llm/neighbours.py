"""Nearest neighbours by a block matrix join with int8 tiles and error bounds.

Unit vectors are rounded to int8 with a scale of their own, and what rounding took away is kept as
a length. A tile multiplies a block of queries with a block of candidates in integers; by the
triangle inequality the true cosine lies within a known distance of the tile's value. Pairs whose
upper bound stays below the k-th best lower bound of their query cannot be among the k nearest in
that tile; the others are computed again from the original vectors in double precision. Each task
keeps a heap of k for each query, and the heaps are merged at the end. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support

#: Candidates and queries in a block: a tile of both fits in 64 MB.
BLOCK, QUERY_BLOCK = 4096, 1024
PACKED = "dim int, block int, ids binary, vectors binary"


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v`` (array of doubles) of the rows that take part, one for each id.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite components take no
    part. If an id has several vectors, the least of them in the order of arrays counts; repeated
    rows count once. An empty table gives an empty table; other columns are not read.
    """
    v = F.col(vector_column).cast("array<double>")
    rows = df.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(whole, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))


def packed(rows: DataFrame, block: int) -> DataFrame:
    """Rows in blocks of about ``block`` vectors of equal dimension, ids and vectors as packed bytes."""
    number = max(1, -(-rows.count() // block))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["v"].to_numpy()).astype("<f8")
        return pd.DataFrame({"dim": [vectors.shape[1]], "block": [int(pdf["block"].iloc[0])], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "vectors": [vectors.tobytes()]})

    return rows.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")}).groupBy("dim", "block").applyInPandas(pack, PACKED)


class Block:
    """A block with its int8 form: ``codes * scale`` is a unit vector but for a rest of length ``rest``."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.vectors = np.frombuffer(vectors, dtype="<f8").reshape(len(self.ids), dim)
        self.least = np.abs(self.vectors).max(axis=1)  # so that squares neither overflow nor vanish
        unit = self.vectors / self.least[:, None]
        unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127.0
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rounded = self.codes * self.scale[:, None]
        self.rest = np.sqrt(((unit - rounded) ** 2).sum(axis=1))
        self.length = np.sqrt((rounded * rounded).sum(axis=1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of components; scaled by powers of two, which change no digit, so that nothing overflows."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) for x in (a, b))
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        aa += a[:, i] * a[:, i]
        bb += b[:, i] * b[:, i]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def survivors(q: Block, c: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a tile that can be among the k nearest of their query."""
    exact = np.float32 if q.codes.shape[1] <= 1000 else np.float64  # integers of this size are exact in it
    tile = (q.codes.astype(exact) @ c.codes.astype(exact).T).astype(np.float64) * q.scale[:, None] * c.scale[None, :]
    bound = q.length[:, None] * c.rest[None, :] + q.rest[:, None] * c.length[None, :] + q.rest[:, None] * c.rest[None, :] + 1e-9
    tile[q.ids[:, None] == c.ids[None, :]] = -np.inf
    low = tile - bound
    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
    return np.nonzero((tile + bound >= kth[:, None]) & np.isfinite(tile))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries`` the k nearest of ``candidates`` by cosine.

    Both have ``id`` and ``v`` (see ``usable``). A candidate with the query's id is the query itself
    and is left out; vectors are compared with vectors of the same dimension; ties go to the smaller
    id; with fewer than k candidates all are returned, and with none no row. Queries are sent to
    every block of candidates, whole blocks at a time.
    """
    right = support.written(packed(candidates, block), "blocks")
    left = support.written(packed(queries, query_block), "queries")
    pairs = left.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).join(right.select("dim", "block"), "dim")
    pairs = pairs.join(right, ["dim", "block"])

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q, c = Block(row.dim, row.q_ids, row.q_vectors), Block(row.dim, row.ids, row.vectors)
                i, j = survivors(q, c, k)
                for a, b, s in zip(q.ids[i].tolist(), c.ids[j].tolist(), cosine(q.vectors[i], c.vectors[j]).tolist(), strict=True):
                    heap = heaps.setdefault(a, [])
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -b))
                    elif (s, -b) > heap[0]:
                        heapq.heapreplace(heap, (s, -b))
        found = [(a, -b, s) for a, heap in heaps.items() for s, b in heap]
        yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = pairs.select("dim", "q_ids", "q_vectors", "ids", "vectors").mapInPandas(tiles, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")


def op5(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    rows = support.written(usable(support.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return nearest(rows, rows.filter(F.col("id") % 50 == 0))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), n AS (
  SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_reduce(list_transform(q.e, lambda x, i: x * c.e[i]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
