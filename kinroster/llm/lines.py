"""Line deduplication over an index that takes documents in and out again.

A line's key is the line without white space at its ends, in lower case (A-Z only). The index keeps

* references: a row for each key of each document, in segments that are only ever added to;
* counts: for each key the number of references, its least and its greatest document, exactly.
  Segments are added here too; the newest row of a key holds;
* filters: the keys are dealt by their digest to shards, and each shard has a cuckoo filter of the
  keys that have a reference.

``insert`` asks the filters first. A key that no filter knows is new for certain, and only the others
are looked up in the counts, where false positives fall out. ``delete`` counts the references of the
deleted documents' keys anew, and takes a key out of its filter when its last reference goes. Every
state is a version of its own, so a step that breaks off changes nothing, and what an earlier
document's lines have displaced comes back when that document goes.

Keys are told apart by 128 bits of their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.versions import Folder
from . import support

LEAST_LENGTH = 10
SPACE = " \t\n\x0b\x0c\r"
#: Buckets of a shard's filter, slots of a bucket, and keys for each slot beyond which the shards are doubled.
BUCKETS, SLOTS, FILL = 1 << 15, 4, 0.7
#: Keys with more than this share of all references are joined by broadcast; there are at most 1 / share of them.
HOT_SHARE = 1e-4
#: Rounds of displacement after which a filter counts as full.
MOST_KICKS = 500
#: A null id is the greatest document.
NO_ID = (1 << 63) - 1

COUNTS = "key binary, n long, least long, most long, version long"
FILTERS = "shard long, slots binary, full boolean"


def key_of(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(SPACE)), upper, upper.lower())


def digest(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 32))


def shard_of(key: Column, bits: int) -> Column:
    """The leading bits of a digest."""
    return F.shiftright(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), 32 - bits)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints; 0 is a free slot. A key may be in two buckets, each found from the other by its fingerprint."""

    def __init__(self, slots: bytes | None = None, buckets: int | None = None):
        self.slots = np.zeros((buckets or BUCKETS, SLOTS), dtype="<u2") if slots is None else np.frombuffer(slots, dtype="<u2").reshape(-1, SLOTS).copy()
        self.mask = len(self.slots) - 1

    def places(self, keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and first buckets of digests."""
        raw = np.frombuffer(b"".join(map(bytes, keys)), dtype="<u4").reshape(-1, 4)
        return (raw[:, 2] % 65535 + 1).astype(np.int64), (raw[:, 1] & self.mask).astype(np.int64)

    def other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ ((prints * 0x5BD1E995 >> 7) & self.mask)

    def contains(self, keys: pd.Series) -> np.ndarray:
        prints, at = self.places(keys)
        has = lambda b: (self.slots[b] == prints[:, None]).any(axis=1)
        return has(at) | has(self.other(at, prints))

    def _place(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts what fits into the free slots of its bucket; returns which did not."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]])
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        taken = self.slots[sorted_at] != 0
        fits = rank < SLOTS - taken.sum(axis=1)
        free_first = np.argsort(taken[fits], axis=1, kind="stable")
        self.slots[sorted_at[fits], free_first[np.arange(fits.sum()), rank[fits]]] = prints[order][fits]
        return order[~fits]

    def insert(self, keys: pd.Series) -> bool:
        """Adds distinct keys that are not in the filter; False if it is full, and then it is of no use."""
        prints, at = self.places(keys)
        random = np.random.default_rng(len(prints))
        left = self._place(prints, at)
        prints, at = prints[left], self.other(at[left], prints[left])
        for _ in range(MOST_KICKS):
            left = self._place(prints, at)
            prints, at = prints[left], at[left]
            if not len(prints):
                return True
            # One key of each full bucket takes a slot; what was there goes to its other bucket.
            _, one = np.unique(at, return_index=True)
            slot = random.integers(0, SLOTS, len(one))
            out = self.slots[at[one], slot].astype(np.int64)
            self.slots[at[one], slot] = prints[one]
            prints[one], at[one] = out, self.other(at[one], out)
        return False

    def remove(self, keys: pd.Series) -> None:
        """Takes out keys that are in the filter."""
        prints, at = self.places(keys)
        while len(prints):
            both = np.concatenate([self.slots[at], self.slots[self.other(at, prints)]], axis=1) == prints[:, None]
            if not both.any(axis=1).all():
                raise ValueError("a key is not in the filter")
            slot = both.argmax(axis=1)
            where = np.where(slot < SLOTS, at, self.other(at, prints)) * SLOTS + slot % SLOTS
            _, one = np.unique(where, return_index=True)
            self.slots.reshape(-1)[where[one]] = 0
            left = np.setdiff1d(np.arange(len(prints)), one)
            prints, at = prints[left], at[left]


def _filter_of(pdf: pd.DataFrame) -> Cuckoo:
    return Cuckoo(bytes(pdf["slots"].iloc[0])) if len(pdf) else Cuckoo()


def _probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    return keys.assign(known=_filter_of(filters).contains(keys["key"]) if len(keys) else False)


def _changed(added: bool):
    def change(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        shard = int((keys if len(keys) else filters)["shard"].iloc[0])
        held, full = _filter_of(filters), False
        if len(keys) and added:
            full = not held.insert(keys["key"])
        elif len(keys):
            held.remove(keys["key"])
        return pd.DataFrame({"shard": [shard], "slots": [held.slots.tobytes()], "full": [full]})

    return change


class LineIndex:
    """The index under ``path`` of the shared folder; a new one if there is none.

    A key needs ``least_length`` code points; an index keeps the length that it was made with.
    Documents are told apart by their id: rows of one id are one document, and rows without an id
    are one too, the greatest. To change a document, delete and insert it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least_length: int = LEAST_LENGTH):
        self.spark, self.path = spark, path or support.scratch_path(spark, "lines")
        self.versions = Folder(spark, f"{self.path}/versions")
        self.number, state = self.versions.latest()
        self.state = state or {"least_length": least_length, "bits": 0, "keys": 0, "references": 0, "filters": None, "segments": [], "counts": [], "deleted": []}

    def _write(self, df: DataFrame, name: str) -> str:
        where = support.scratch_path(self.spark, "part").rsplit("-", 1)[1]
        df.write.parquet(f"{self.path}/{name}-{where}")
        return f"{name}-{where}"

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _commit(self, **changes) -> LineIndex:
        state = self.state | changes
        if not self.versions.commit(self.number + 1, state):
            raise RuntimeError(f"another writer has changed the index {self.path}; open it again and repeat")
        self.number, self.state = self.number + 1, state
        return self

    def references_of(self, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
        """``doc, key`` for every key of every row, once a row."""
        keys = F.transform(F.split(F.col(text_column), "\n"), key_of)
        long = F.filter(keys, lambda k: F.length(k) >= self.state["least_length"])
        return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), F.explode(F.array_distinct(F.transform(long, digest))).alias("key"))

    def references(self) -> DataFrame:
        """``doc, key`` of the documents that are in the index."""
        found = []
        for name, version in self.state["segments"]:
            rows = self._read(name, "doc long, key binary")
            for gone, at in self.state["deleted"]:
                rows = rows.join(self._read(gone, "doc long"), "doc", "left_anti") if at > version else rows
            found.append(rows)
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], "doc long, key binary")

    def counts(self) -> DataFrame:
        """``key, n, least, most`` of the keys that have references."""
        if not self.state["counts"]:
            return self.spark.createDataFrame([], COUNTS).drop("version")
        rows = reduce(DataFrame.union, [self._read(name, COUNTS) for name in self.state["counts"]])
        if len(self.state["counts"]) > 1:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("n", "least", "most"), "version").alias("c")).select("key", "c.*")
        return rows.select("key", "n", "least", "most").filter("n > 0")

    def filters(self) -> DataFrame:
        return self._read(self.state["filters"], FILTERS) if self.state["filters"] else self.spark.createDataFrame([], FILTERS)

    def _by_shard(self, keys: DataFrame, filters: DataFrame, change, schema: str) -> DataFrame:
        sharded = keys.withColumn("shard", shard_of(F.col("key"), self.state["bits"]))
        return sharded.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(change, schema)

    def _built(self, counts: DataFrame, total: int) -> tuple[int, str]:
        """Filters of all keys, in as many shards as they need."""
        bits = self.state["bits"]
        while total > FILL * BUCKETS * SLOTS * (1 << bits):
            bits += 1
        while True:
            keys = counts.select("key", shard_of(F.col("key"), bits).alias("shard"))
            empty = self.spark.createDataFrame([], FILTERS)
            name = self._write(keys.groupBy("shard").cogroup(empty.groupBy("shard")).applyInPandas(_changed(True), FILTERS), "filters")
            if not self._read(name, FILTERS).filter("full").limit(1).count():
                return bits, name
            bits += 1  # a shard was unlucky

    def insert(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> LineIndex:
        """Take documents in."""
        version = self.number + 1
        segment = self._write(self.references_of(docs, id_column, text_column), "references")
        refs = self._read(segment, "doc long, key binary")
        own = refs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"))
        if self.state["filters"]:
            probed = self._by_shard(own, self.filters(), _probe, "key binary, n long, least long, most long, shard long, known boolean")
            probed = self._read(self._write(probed, "probed"), "key binary, n long, least long, most long, known boolean")
            hits = probed.filter("known").join(self.counts().select("key", F.col("n").alias("n0"), F.col("least").alias("l0"), F.col("most").alias("m0")), "key", "left")
            merged = hits.select("key", (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), F.least("least", "l0").alias("least"), F.greatest("most", "m0").alias("most"), F.col("n0").isNull().alias("fresh"))
            rows = merged.unionByName(probed.filter("NOT known").select("key", "n", "least", "most", F.lit(True).alias("fresh")))
        else:
            rows = own.withColumn("fresh", F.lit(True))
        name = self._write(rows.withColumn("version", F.lit(version).cast("long")), "counts")
        counts = self._read(name, f"{COUNTS}, fresh boolean")
        added = counts.agg(F.count_if("fresh").alias("keys"), F.sum("n").alias("n")).first()
        total = self.state["keys"] + added["keys"]
        before = self.state["counts"]
        if not self.state["filters"] or total > FILL * BUCKETS * SLOTS * (1 << self.state["bits"]):
            self.state = self.state | {"counts": [*before, name]}
            bits, filters = self._built(self.counts(), total)
        else:
            bits, filters = self.state["bits"], self._write(self._by_shard(counts.filter("fresh").select("key"), self.filters(), _changed(True), FILTERS), "filters")
            if self._read(filters, FILTERS).filter("full").limit(1).count():
                self.state = self.state | {"counts": [*before, name], "bits": bits + 1}
                bits, filters = self._built(self.counts(), total)
        references = self.state["references"] + refs.count()
        return self._commit(segments=[*self.state["segments"], [segment, version]], counts=[*before, name], filters=filters, bits=bits, keys=total, references=references)

    def delete(self, ids: DataFrame, id_column: str = "doc_id") -> LineIndex:
        """Take documents out, given by their ids; ids that are not in the index are no error."""
        version = self.number + 1
        gone = self._write(ids.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc")).distinct(), "deleted")
        out = self._read(gone, "doc long")
        live = self.references()
        touched = self._read(self._write(live.join(out, "doc", "left_semi").groupBy("key").agg(F.count("*").alias("less")), "touched"), "key binary, less long")
        left = live.join(out, "doc", "left_anti").join(touched.select("key"), "key", "left_semi")
        left = left.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"))
        rows = touched.join(left, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "least", "most", F.lit(version).cast("long").alias("version"))
        name = self._write(rows, "counts")
        unused = self._read(name, COUNTS).filter("n = 0").select("key")
        filters = self._write(self._by_shard(unused, self.filters(), _changed(False), FILTERS), "filters") if self.state["filters"] else None
        less = touched.agg(F.sum("less")).first()[0] or 0
        return self._commit(deleted=[*self.state["deleted"], [gone, version]], counts=[*self.state["counts"], name], filters=filters, keys=self.state["keys"] - unused.count(), references=self.state["references"] - less)

    def compact(self) -> LineIndex:
        """The same state with one segment of references and of counts."""
        version = self.number + 1
        refs, counts = self._write(self.references(), "references"), self._write(self.counts().withColumn("version", F.lit(version).cast("long")), "counts")
        return self._commit(segments=[[refs, version]], counts=[counts], deleted=[])

    def dropped(self) -> DataFrame:
        """``doc, keys``: the keys whose lines a document loses, since a smaller document has them."""
        repeated, refs = self.counts().filter("least < most"), self.references()
        many = max(1, int(self.state["references"] * HOT_SHARE))
        hot = F.broadcast(repeated.filter(F.col("n") > many).select("key", F.col("least").alias("hot")))  # 1 / HOT_SHARE keys at most
        rows = refs.join(hot, "key", "left")
        often = rows.filter("hot < doc").select("doc", "key")
        cold = repeated.filter(F.col("n") <= many).select("key", "least")
        seldom = rows.filter("hot IS NULL").join(cold, "key").filter("least < doc").select("doc", "key")
        return often.union(seldom).groupBy("doc").agg(F.collect_set("key").alias("keys"))

    def deduplicated(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """The rows of ``docs``, which are in the index, with ``n_lines``, ``n_dropped`` and the text without the dropped lines, ``kept``.

        Null and empty texts are one empty line; texts are read whole; equal rows are one document and
        lose the same lines; an empty table gives an empty table; other columns stay, and those named
        like the new ones are replaced.
        """
        support.short_batches(self.spark)
        names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept")]
        own = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).alias("row"), F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_column).alias("text"))
        joined = own.join(self.dropped(), "doc", "left").select("row", F.pandas_udf(without_lines, "n_lines long, n_dropped long, kept string")("text", "keys").alias("found"))
        return joined.select("row.*", "found.*")

    def drop(self) -> None:
        support.drop_path(self.spark, self.path)


def without_lines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """A text without the lines whose keys are given."""
    for texts, keys in batches:
        rows = []
        for text, found in zip(texts, keys, strict=True):
            text = text if isinstance(text, str) else ""
            lines = text.split("\n")
            if found is None or not len(found):
                rows.append((len(lines), 0, text))
                continue
            gone = set(map(bytes, found))
            left = [x for x in lines if hashlib.sha256(x.encode().strip(SPACE.encode()).lower()).digest()[:16] not in gone]
            rows.append((len(lines), len(lines) - len(left), "\n".join(left)))
        yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


#: The query's documents come in as so many deliveries, so that later ones meet the filters of earlier ones.
DELIVERIES = 2


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that smaller documents have."""
    docs = support.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark)
    for part in range(DELIVERIES):
        index.insert(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(DELIVERIES)) == part))
    return index.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP13_SQL = """
WITH lines AS (
  SELECT row, doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS least FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, coalesce(r.least < k.doc_id, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row
"""
