"""Whitening of embeddings by the leading principal components, found by LOBPCG.

Entries become integers, whose sums are exact. Rows are packed into blocks once; a product of the
covariance with a few directions is one pass over the blocks, in which every row is centred before
it is multiplied, and whose partial sums go up a tree of tasks. The covariance itself is never
formed. An iteration takes one product, with the residuals: the Rayleigh-Ritz method picks the best
directions out of the present ones, the residuals and the previous step, and carries the products
along. Before it ends, the products are computed afresh, and the residuals of what is returned are
those that were measured then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import support

COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + OFFSET; entries of MOST or more don't fit.
SCALE, OFFSET, MOST = 1024, 100_000, float(1 << 40)
#: Rows in a block; partial sums that one task adds up.
BLOCK, FAN = 4096, 64
#: Residuals, as parts of the largest eigenvalue: wanted, and enough where rounding allows no more.
WANTED, ENOUGH, MOST_ROUNDS = 1e-14, 1e-11, 1000
#: Components with less than this part of the largest eigenvalue are none.
LEAST_SHARE = 1e-12

PACKED = "dim int, ids array<long>, x binary"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, x`` of the rows whose vector is not null and holds no null, non-finite or too large entry."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    return rows.filter(F.coalesce(whole, F.lit(False))).select("id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows in blocks of equal dimension, as a written table. Rows stay where they are."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, same in pdf.groupby(pdf["x"].map(len)):
                for at in range(0, len(same), block):
                    some = same.iloc[at : at + block]
                    ids = [None if pd.isna(i) else int(i) for i in some["id"].astype("Int64")]
                    yield pd.DataFrame({"dim": [dim], "ids": [ids], "x": [np.concatenate([*some["x"], np.zeros(0)]).astype("<i8").tobytes()]})

    return support.written(rows.mapInPandas(pack, PACKED), "vectors")


@dataclass(frozen=True)
class Centre:
    """Exact sums of ``n`` rows. A row is centred as whole numbers first, so no digit is lost to the size of the entries."""

    n: int
    sums: tuple[int, ...]

    def whole(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole parts of the means taken off, and the remainders of the sums."""
        floors = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return x - floors, np.array([s % self.n for s in self.sums], dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.whole(x)
        return whole - (rest / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 for each row, exactly; None where it exceeds a long."""
        whole, rest = self.whole(x)
        most = self.n * (int(np.abs(whole).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return (((whole * self.n - rest.astype(np.int64)) ** 2).sum(axis=1)).tolist()
        found = [sum((int(a) * self.n - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in whole]
        return [v if v < 1 << 63 else None for v in found]


def rows_of(row) -> np.ndarray:
    return np.frombuffer(row.x, dtype="<i8").reshape(len(row.ids), row.dim)


def summed(blocks: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``of_block`` over all blocks, up a tree of tasks of ``FAN`` partial sums each."""

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, some = np.zeros(shape), False
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                total, some = total + of_block(rows_of(row)), True
        if some:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "total": [total.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (np.frombuffer(t) for t in pdf.sort_values("part")["total"]))
        return pd.DataFrame({"part": [int(pdf["g"].iloc[0])], "total": [total.tobytes()]})

    tasks = blocks.rdd.getNumPartitions()
    partial = blocks.select("dim", "ids", "x").mapInPandas(in_task, "part long, total binary")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        partial = partial.withColumn("g", F.pmod("part", F.lit(tasks))).groupBy("g").applyInPandas(added, "part long, total binary")
    parts = [np.frombuffer(r["total"]) for r in partial.orderBy("part").collect()]
    return reduce(np.add, parts, np.zeros(int(np.prod(shape)))).reshape(shape)


def centre_of(blocks: DataFrame, dim: int) -> Centre:
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({"at": np.arange(-1, dim), "s": [len(row.ids), *rows_of(row).sum(axis=0).tolist()]})

    found = blocks.select("dim", "ids", "x").mapInPandas(sums, "at int, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    known = {r["at"]: int(r["s"]) for r in found.collect()}
    return Centre(known.get(-1, 0), tuple(known.get(i, 0) for i in range(dim)))


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` spans beyond the orthonormal ``against``."""
    for _ in range(2):
        length = np.sqrt((block * block).sum(axis=0))
        block = block[:, length > 0] / length[length > 0]
        block = block - against @ (against.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-10 * max(1.0, size.max(initial=0.0))]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, guard: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, eigenvectors (columns) and residuals of a symmetric matrix that is only known by its products.

    ``guard`` further directions (as many again, if not given) are carried along, since the last of a
    block is the slowest. Ends when all residuals are at most ``WANTED`` times the largest eigenvalue,
    or no longer fall and are at most ``ENOUGH`` times it; raises otherwise.
    """
    size = min(dim, wanted + (wanted if guard is None else guard))
    x = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, size)))[0]
    vx, fresh = product(x), True
    step, v_step = np.zeros((dim, 0)), np.zeros((dim, 0))
    best, since = np.inf, 0
    for _ in range(MOST_ROUNDS):
        values, turn = _ritz(x, vx, size)
        x, vx = x @ turn, vx @ turn
        rest = vx - x * values
        residual = np.sqrt((rest * rest).sum(axis=0))[:wanted]
        worst = residual.max(initial=0.0) / max(values[0], np.finfo(float).tiny)
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if worst <= WANTED or (worst <= ENOUGH and since > 5) or not values[0] > 0:
            if fresh:
                return values[:wanted], x[:, :wanted], residual
            x = np.linalg.qr(x)[0]
            vx, fresh = product(x), True
            continue
        more = orthonormal(rest, np.hstack([x, step]))
        basis, v_basis = np.hstack([x, more, step]), np.hstack([vx, product(more) if more.shape[1] else more, v_step])
        values, turn = _ritz(basis, v_basis, size)
        moved = turn.copy()
        moved[:size] = 0  # the step: what was not there before
        moved = orthonormal(moved, turn)
        x, vx, step, v_step, fresh = basis @ turn, v_basis @ turn, basis @ moved, v_basis @ moved, False
    raise RuntimeError(f"residuals of {worst} after {MOST_ROUNDS} rounds")


def _ritz(basis: np.ndarray, v_basis: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    inner = basis.T @ v_basis
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1][:size], vectors[:, ::-1][:, :size]


@dataclass(frozen=True)
class Whitener:
    """``vectors`` are unit eigenvectors (columns) with their ``values`` and certified ``residuals``; ``trace`` is that of the covariance."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(blocks: DataFrame, dim: int, components: int = COMPONENTS) -> Whitener:
    """The leading components of packed rows of one dimension. Components without variance are none."""
    centre = centre_of(blocks, dim)
    if not centre.n or not dim:
        return Whitener(centre, np.zeros(0), np.zeros((dim, 0)), np.zeros(0), 0.0)
    trace = float(summed(blocks, lambda x: (centre.centred(x) ** 2).sum(axis=0), (dim,)).sum()) / centre.n

    def product(directions: np.ndarray) -> np.ndarray:
        def of_block(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ directions)

        return summed(blocks, of_block, directions.shape) / centre.n

    values, vectors, residuals = lobpcg(product, dim, min(dim, components))
    some = values > LEAST_SHARE * max(values[0], 0.0)
    return Whitener(centre, values[some], vectors[:, some], residuals[some], trace)


def identity_error(blocks: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, in two passes."""
    k, n = len(model.values), model.centre.n
    if not k:
        return 0.0
    mean = summed(blocks, lambda x: model.whitened(x).sum(axis=0), (k,)) / n

    def of_block(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x) - mean
        return w.T @ w

    return float(np.abs(summed(blocks, of_block, (k, k)) / n - np.eye(k)).max())


def transform(blocks: DataFrame, model: Whitener) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained``: a row for each packed row and component."""
    k = len(model.values)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = rows_of(row)
                ids = pd.array([None if i is None or i != i else int(i) for i in row.ids], dtype="Int64")
                deviations = pd.array(model.centre.deviations(x), dtype="Int64")
                yield pd.DataFrame({
                    "vec_id": ids.repeat(k), "component": np.tile(np.arange(1, k + 1), len(ids)), "n": model.centre.n, "deviation": deviations.repeat(k),
                    "whitened": model.whitened(x).reshape(-1), "explained": np.tile(model.values / model.trace if k else model.values, len(ids)),
                })

    return blocks.select("dim", "ids", "x").mapInPandas(rows, OUT)


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row of ``df``.

    Vectors that are null or hold null, non-finite or too large entries (``MOST``) take no part.
    Vectors of different lengths are lists of their own, each with its own components; empty vectors
    have none. Null ids are kept, repeated ids and repeated rows are rows like others; equal
    eigenvalues share a space of which any basis may be returned; rows without any variance, and an
    empty table, give no rows. Other columns are not read.
    """
    spark: SparkSession = df.sparkSession
    blocks = packed(usable(df, id_column, vector_column))
    out = spark.createDataFrame([], f"{OUT}, identity_error double")
    for dim in sorted(r["dim"] for r in blocks.select("dim").distinct().collect()):
        same = blocks.filter(F.col("dim") == dim)
        model = fit(same, dim, components)
        out = out.union(transform(same, model).withColumn("identity_error", F.lit(identity_error(same, model))))
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened by their first 8 components."""
    return whiten(support.table(spark, sf_dir, "embeddings"))
