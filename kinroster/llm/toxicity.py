"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and read as UTF-8 bytes; its features are the hash buckets of its n-grams,
each counted once. Training takes a bounded sample of labelled rows: the log-count ratio of every
bucket comes from that sample, and logistic regression is fitted on the features times their
ratios. Scoring is a map over whole texts with the product of weights and ratios in one table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import support

ORDERS = (3, 4, 5)
BITS = 20
#: Labelled rows of each label that a fit uses at most; those with the smallest hash of doc_id.
SAMPLE = (2500, 3500)
#: Bytes of the texts of each label that a fit uses at most, in the same order; a fit holds about twelve times as much.
SAMPLE_BYTES = (16 << 20, 16 << 20)
#: Bytes of a window. A text is as toxic as its worst window, so length alone doesn't raise a score.
WINDOW = 4096
#: Texts with this score or more count as toxic.
THRESHOLD = 0.7


class Buckets:
    """The distinct n-gram buckets of each window of one text after another.

    Windows have ``WINDOW`` bytes and share as many as an n-gram needs, so every n-gram of the whole
    text lies in a window. Most texts are a single window.
    """

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS, window: int = WINDOW):
        self.orders, self.bits, self.window = orders, bits, window
        self.last = np.zeros(1 << bits, dtype=np.int64)

    def __call__(self, text: str | None) -> list[np.ndarray]:
        data = np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
        return [self.distinct(data[at : at + self.window + max(self.orders)]) for at in range(0, max(len(data) - max(self.orders), 1), self.window)]

    def distinct(self, data: np.ndarray) -> np.ndarray:
        found, mixed = [], data
        for n in range(2, max(self.orders) + 1):
            mixed = mixed[:-1] * np.uint32(0x01000193) + data[n - 1 :]
            if n in self.orders and len(mixed):
                found.append(((mixed + np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits))
        every = np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)
        at = np.arange(len(every))
        self.last[every] = at  # of equal buckets the last position stays
        return every[self.last[every] == at]


@dataclass(frozen=True)
class Model:
    """``weights`` holds, for each bucket, the fitted weight times the log-count ratio."""

    weights: np.ndarray
    bias: float

    def margin(self, window: np.ndarray) -> float:
        return float(self.weights[window].sum(dtype=np.float64))

    def score(self, windows: list[np.ndarray]) -> float:
        """Probability that the worst window is toxic."""
        margin = max(map(self.margin, windows)) + self.bias
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, margin))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, prior: float, least: float) -> np.ndarray:
    """log of how much likelier a bucket is under label 1; 0 where the evidence for a difference is weak.

    The ``prior`` pseudo-rows are split as the labels are, so a bucket that was never seen has ratio 0.
    Evidence is the root of the likelihood-ratio statistic of the bucket's counts.
    """
    share = labels.mean()
    ones, zeros = (np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == v]), minlength=size).astype(float) for v in (1, 0))
    total = ones + zeros
    evidence = 2 * sum(c * np.log(np.maximum(c, 1e-9) / np.maximum(total * s, 1e-9)) for c, s in ((ones, share), (zeros, 1 - share)))
    p, q = ((c + prior * s) / (s * (len(labels) + prior)) for c, s in ((ones, share), (zeros, 1 - share)))
    return np.where(evidence >= least * least, np.log(p / q), 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = 8, rate: float = 0.1, decay: float = 1e-3, prior: float = 10.0, least: float = 5.5, seed: int = 5) -> Model:
    """Log-count ratios, then logistic regression by AdaGrad over shuffled rows; both labels weigh alike.

    Without rows of both labels the model says 0.5 of everything.
    """
    labels = np.asarray(labels)
    ones, zeros = int(labels.sum()), int((1 - labels).sum())
    if not ones or not zeros:
        return Model(np.zeros(1 << bits, dtype=np.float32), 0.0)
    ratio = log_count_ratios(rows, labels, 1 << bits, prior, least)
    rows = [r[ratio[r] != 0] for r in rows]
    weights, bias = np.ones(1 << bits), 0.0
    squares, bias_square = np.ones(1 << bits), 1.0
    weigh = (0.5 * len(rows) / zeros, 0.5 * len(rows) / ones)
    for epoch in range(epochs):
        for i in np.random.default_rng(seed + epoch).permutation(len(rows)):
            at, y = rows[i], int(labels[i])
            r, w = ratio[at], weights[at]
            off = (1.0 / (1.0 + np.exp(-np.clip(w @ r + bias, -30, 30))) - y) * weigh[y]
            g = off * r + decay * (w - 1.0)
            squares[at] += g * g
            weights[at] = w - rate * g / np.sqrt(squares[at])
            bias_square += off * off
            bias -= rate * off / np.sqrt(bias_square)
    return Model((weights * ratio).astype(np.float32), float(bias))


def training_rows(windows: list[list[np.ndarray]], labels: np.ndarray, model: Model | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """A row for each window of a clean text, and for the worst window of a toxic text under ``model``; without a model for all of its windows."""
    kept = [(w, int(y)) for each, y in zip(windows, labels, strict=True) for w in (each if y == 0 or model is None else [max(each, key=model.margin)])]
    return [w for w, _ in kept], np.array([y for _, y in kept])


def learn(windows: list[list[np.ndarray]], labels: np.ndarray, bits: int = BITS, rounds: int = 3) -> Model:
    """A model of texts, each a list of windows.

    Of a toxic text with several windows nobody knows which are toxic. The first fit takes all of
    them; each of ``rounds`` more takes the window that is worst under the model before.
    """
    model = fit(*training_rows(windows, labels), bits=bits)
    for _ in range(rounds if any(y == 1 and len(each) > 1 for each, y in zip(windows, labels, strict=True)) else 0):
        model = fit(*training_rows(windows, labels, model), bits=bits)
    return model


def sample(labels: DataFrame, id_column: str, label_column: str, most: tuple[int, int] = SAMPLE) -> DataFrame:
    """At most ``most`` labelled ids of each label, those with the smallest hash: ``_id, y``."""
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).cast("int").alias("y"))
    one, zero = (known.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, most[0]), (0, most[1])))
    return one.unionByName(zero)


def train(
    df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most: tuple[int, int] = SAMPLE, most_bytes: tuple[int, int] = SAMPLE_BYTES,
    orders: tuple[int, ...] = ORDERS, bits: int = BITS,
) -> Model:
    """A model of the texts in ``df`` that ``labels`` (id and label) mark.

    The sample is bounded twice: by ``most`` rows of each label, and by ``most_bytes`` of their texts.
    It takes rows in the order of a hash of id and text until one of both is reached, at least one row,
    whatever their lengths. Repeated rows count once; an id that is labelled twice has the greater
    label; an id with several texts gives several rows; null and empty texts are rows without features;
    very long texts are used whole; null ids and labels other than 0 and 1 are not used; without rows
    of both labels the model says 0.5 of everything.

    The ids of the sample are broadcast, and its texts are fitted in one task. Only the finished table,
    and a number for each label, comes to the driver.
    """
    chosen = sample(labels, id_column, label_column, most)
    known = df.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    known = known.withColumn("h", F.xxhash64("_id", "_text"))
    sizes = known.groupBy("y", "h").agg(F.max(F.octet_length("_text")).alias("size"))
    ends = []
    for y, number, limit in ((1, *(x[0] for x in (most, most_bytes))), (0, *(x[1] for x in (most, most_bytes)))):
        first = sizes.filter(F.col("y") == y).orderBy("h").limit(number)
        upto = first.withColumn("upto", F.sum("size").over(Window.orderBy("h")) - F.when(F.row_number().over(Window.orderBy("h")) == 1, F.col("size")).otherwise(0))
        ends.append(upto.filter(F.col("upto") <= limit).agg(F.lit(y).alias("y"), F.max("h").alias("end")))
    end = {r["y"]: r["end"] for r in ends[0].union(ends[1]).collect() if r["end"] is not None}
    used = [(F.col("y") == y) & (F.col("h") <= h) for y, h in end.items()] or [F.lit(False)]
    rows = known.filter(reduce(lambda a, b: a | b, used)).groupBy("y", "h").agg(F.first("_text").alias("_text"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "y"])
        buckets = Buckets(orders, bits)
        model = learn([buckets(t) for t in pdf["_text"]], pdf["y"].to_numpy(), bits)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    found = rows.groupBy().applyInPandas(fitted, "weights binary, bias double").first()
    if found is None:
        return fit([], np.array([]), bits=bits)
    return Model(np.frombuffer(found["weights"], dtype=np.float32), found["bias"])


def probability(text: Column, model: Model, spark, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Column:
    """Probability that a text is toxic."""
    support.short_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: 2 ** bits floats

    def scores(texts: pd.Series) -> pd.Series:
        buckets, fitted = Buckets(orders, bits), shared.value
        return pd.Series([fitted.score(buckets(t)) for t in texts], dtype=float)

    return F.pandas_udf(scores, "double")(text)


def score(df: DataFrame, model: Model, text_column: str = "text", orders: tuple[int, ...] = ORDERS, bits: int = BITS, to: str = "score") -> DataFrame:
    """``df`` with ``score`` (or the name ``to``), the probability that the text is toxic.

    Null and empty texts get the score of a text without features; very long texts are scored whole,
    window by window; equal texts score alike; an empty table gives an empty table. A column named
    ``score`` is replaced; others are kept.
    """
    return df.withColumn(to, probability(F.col(text_column), model, df.sparkSession, orders, bits))


def without_toxic(df: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose score stays below ``threshold``, as they are; see ``score`` for odd texts."""
    return df.filter(probability(F.col(text_column), model, df.sparkSession) < threshold)


def held_out(identity: Column) -> Column:
    """Whether the row's label is kept from training."""
    return F.coalesce(support.crc32_of(identity) % 3 == 1, F.lit(False))


def op3(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = support.table(spark, sf_dir, "documents")
    labels = support.table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
