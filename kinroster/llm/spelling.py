"""Spelling variants: words one edit apart, and the frequent form that a rare one stands for.

An inverted index holds, for the words of one length, the q-grams at every position. One edit
destroys at most q of a word's grams and shifts those behind it by one place, so the postings that
a word has to look at are those of its own length and position (a replaced code point), or of one
code point less, at the same place or one before (an inserted one; a deleted one is the same pair
from its other side). Two words are candidates if they meet in as many postings as one edit leaves
intact, and candidates are compared.

Spread over a cluster, the index is cut by grams. The grams of a pair that survive an edit are more
than all but the ``q + 1`` rarest of either word, so two near words have one of these in common:
words are sent to the keys (length, gram, position) of their rarest grams only, and each key's words
get an index of their own. There the postings of a word's other grams, which are sorted runs of
words, are merged, many words at a time, and a word that comes up often enough is a candidate. The
merge is numpy's stable sort of the concatenated runs, which merges runs; a heap gives the same order,
but in Python takes over ten times as long. What "rarest" means is free to choose as long as all words agree,
so grams are counted in a table of fixed size. A key with many words is cut into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import support
from .words import mix

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words that have near words at all; longest gram; words from here on have four disjoint grams instead of all.
SHORTEST, LONGEST_GRAM, LONG = 3, 4, 65
#: Counters of grams; words of a tile's side; so many hot keys are broadcast at most.
COUNTERS, TILE, BROADCAST_KEYS = 1 << 18, 2048, 200_000
#: Rows that a task merges together, and postings.
ROWS, POSTINGS = 20_000, 4_000_000

_POWERS = np.multiply.accumulate(np.full(LONG, 0x9E3779B97F4A7C15, dtype=np.uint64))
TOKENS = "key long, role int, place int, word string, n long"


def gram(m: int) -> tuple[int, np.ndarray, int, int]:
    """For pairs whose shorter word has ``m`` code points: length of a gram, its positions there, and how many grams a replaced and an inserted code point destroy."""
    if m >= LONG:
        q = m // 4
        return q, np.array([0, q, 2 * q, m - q]), 1, 1
    q = max(1, min((m - 1) // 2, LONGEST_GRAM))
    return q, np.arange(m - q + 1), q, q - 1


def codes(words: np.ndarray, width: int) -> np.ndarray:
    """Code points of words, a row each, 0 behind their ends."""
    return words.astype(f"U{width}").view(np.uint32).reshape(len(words), width)


def gram_hashes(points: np.ndarray, q: int, at: np.ndarray) -> np.ndarray:
    """A hash of the ``q`` code points from each position on; the same in all tasks."""
    powers = _POWERS[:q] if q <= len(_POWERS) else np.multiply.accumulate(np.full(q, _POWERS[0], dtype=np.uint64))
    out = np.empty((len(points), len(at)), dtype=np.uint64)
    for column, p in enumerate(at.tolist()):
        out[:, column] = (points[:, p : p + q].astype(np.uint64) * powers).sum(axis=1)
    return mix(out + np.uint64(q))


def by_shape(words: pd.Series, role: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers by ``m``: a word takes part with its own length (role 0), and as the longer one of a pair (role 1)."""
    m = words.str.len().to_numpy() - role
    for value in np.unique(m[m >= SHORTEST]).tolist():
        yield value, np.flatnonzero(m == value)


def bucket_of(hashes: np.ndarray, m: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(m * 0x632BE59BD9B4E019 & (1 << 64) - 1)) % np.uint64(COUNTERS)).astype(np.int64)


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many words have a gram, by the gram's counter; grams that share a counter count together."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for pdf in batches:
            given = pdf["word"].to_numpy(dtype=object)
            for m, rows in by_shape(pdf["word"], 0):
                q, at, *_ = gram(m)
                np.add.at(total, bucket_of(gram_hashes(codes(given[rows], m), q, at), m).reshape(-1), 1)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"counter": some, "n": total[some]})

    found = words.select("word").mapInPandas(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found["counter"]] = found["n"]
    return np.minimum(out, (1 << 24) - 1).astype(np.uint32)


def tokens(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """``key, role, place, word, n``: the words at the keys of their rarest grams; ``place`` is the gram's position in the shorter word."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            given, n = pdf["word"].to_numpy(dtype=object), pdf["n"].to_numpy()
            for role in (0, 1):
                for m, rows in by_shape(pdf["word"], role):
                    q, at, hit, _ = gram(m)
                    own = np.unique(np.concatenate([at, at + 1])) if role else at
                    hashes = gram_hashes(codes(given[rows], m + role), q, own)
                    order = (counts[bucket_of(hashes, m)].astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
                    rare = order <= np.partition(order, hit, axis=1)[:, hit : hit + 1] if m < LONG or not role else np.ones(order.shape, dtype=bool)
                    for shift in range(role + 1):
                        i, j = np.nonzero(rare & np.isin(own - shift, at))
                        place = own[j] - shift
                        key = mix(hashes[i, j] + mix((place + np.int64(m) * (1 << 32)).astype(np.uint64)))
                        yield pd.DataFrame({"key": key.view(np.int64), "role": role, "place": place, "word": given[rows[i]], "n": n[rows[i]]})

    return words.mapInPandas(route, TOKENS)


def expanded(probe: np.ndarray, first: np.ndarray, count: np.ndarray, postings: np.ndarray, rows: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merges the runs ``postings[first : first + count]`` of each probe; pairs of a probe and a row that is in ``least`` runs or more.

    Probes are given in order, and so many are merged at a time as have ``POSTINGS`` postings together.
    """
    some = count > 0
    probe, first, count = probe[some], first[some], count[some]
    ends = np.cumsum(count)
    starts = np.flatnonzero(np.diff(probe, prepend=-1))
    at = 0
    while at < len(probe):
        limit = np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS)
        to = starts[np.searchsorted(starts, limit, side="right") - 1] if limit < len(probe) else len(probe)
        if to <= at:  # a probe with more postings than that
            following = np.searchsorted(starts, at, side="right")
            to = starts[following] if following < len(starts) else len(probe)
        c = count[at:to]
        where = np.arange(c.sum()) + np.repeat(first[at:to] - np.concatenate([[0], np.cumsum(c)[:-1]]), c)
        merged = np.sort(np.repeat(probe[at:to] * rows, c) + postings[where], kind="stable")
        new = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        often = merged[new[np.diff(np.append(new, len(merged))) >= least]]
        yield often // rows, often % rows
        at = to


def near(short: np.ndarray, long: np.ndarray, m: int) -> np.ndarray:
    """Whether pairs of words, as code points, are one edit apart; ``long`` has ``m`` or ``m + 1``."""
    if long.shape[1] == m:
        return (short != long).sum(axis=1) == 1
    before = np.cumprod(short == long[:, :m], axis=1).sum(axis=1)
    behind = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + behind >= m


def tile_pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Near words of whole tiles, each pair from both sides: ``word, other, other_n``."""
    tile = np.cumsum(np.any(np.diff(pdf[["key", "first", "second"]].to_numpy(), axis=0, prepend=0) != 0, axis=1)).astype(np.uint64)
    role, place, block = (pdf[c].to_numpy() for c in ("role", "place", "block"))
    across = (pdf["first"] != pdf["second"]).to_numpy()
    given, n = pdf["word"].to_numpy(dtype=object), pdf["n"].to_numpy()
    m_of = pdf["word"].str.len().to_numpy() - role
    for m in np.unique(m_of).tolist():
        short, long = np.flatnonzero((m_of == m) & (role == 0)), np.flatnonzero((m_of == m) & (role == 1))
        if not len(short):
            continue
        q, at, hit, hit_inserted = gram(m)
        points = codes(given[short], m)
        posted = mix(gram_hashes(points, q, at) + mix(tile[short, None] * np.uint64(1 << 24) + at.astype(np.uint64)[None, :]))
        other = at[None, :] != place[short, None]  # the key's own gram is common to all
        row = np.nonzero(other)[0]
        posted = posted[other]
        order = np.argsort(posted, kind="stable")
        index, postings = posted[order], row[order]
        ends = np.empty(len(order), dtype=np.int64)
        ends[order] = np.searchsorted(index, index, side="right")
        own = np.empty(len(order), dtype=np.int64)
        own[order] = np.arange(1, len(order) + 1)
        for i, j in expanded(row, own, ends - own, postings, len(short), len(at) - hit - 1):
            yield from verified(given, n, block, across, points, points, short[i], short[j], i, j, m)
        if not len(long):
            continue
        points_long = codes(given[long], m + 1)
        places = np.concatenate([at, at])
        both = np.concatenate([gram_hashes(points_long, q, at), gram_hashes(points_long, q, at + 1)], axis=1)
        probe = mix(both + mix(tile[long, None] * np.uint64(1 << 24) + places.astype(np.uint64)[None, :]))
        wanted = places[None, :] != place[long, None]
        wanted[:, len(at) :] &= both[:, : len(at)] != both[:, len(at) :]  # the same gram twice is one
        row, probe = np.nonzero(wanted)[0], probe[wanted]
        first = np.searchsorted(index, probe, side="left")
        for i, j in expanded(row, first, np.searchsorted(index, probe, side="right") - first, postings, len(short), len(at) - hit_inserted - 1):
            yield from verified(given, n, block, across, points, points_long, short[j], long[i], j, i, m)


def verified(given, n, block, across, points, points_long, a, b, i, j, m) -> Iterator[pd.DataFrame]:
    """The candidates ``a``, ``b`` (rows of the batch; ``i``, ``j`` of the code points) that are one edit apart."""
    apart = ~across[a] | (block[a] != block[b])
    a, b, i, j = a[apart], b[apart], i[apart], j[apart]
    good = near(points[i], points_long[j], m)
    a, b = a[good], b[good]
    yield pd.DataFrame({"word": np.concatenate([given[a], given[b]]), "other": np.concatenate([given[b], given[a]]), "other_n": np.concatenate([n[b], n[a]])})


def in_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole tiles, ``ROWS`` rows or more at a time, from batches in the order of tiles."""
    left: list[pd.DataFrame] = []
    for pdf in batches:
        left.append(pdf)
        if sum(map(len, left)) >= ROWS:
            rows = pd.concat(left, ignore_index=True)
            cut = np.flatnonzero(np.any(np.diff(rows[["key", "first", "second"]].to_numpy(), axis=0) != 0, axis=1))
            whole = int(cut[-1]) + 1 if len(cut) else 0
            if whole:
                yield from tile_pairs(rows.iloc[:whole].reset_index(drop=True))
            left = [rows.iloc[whole:]]
    if left and len(rows := pd.concat(left, ignore_index=True)):
        yield from tile_pairs(rows)


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, other, other_n``: all pairs of different words one edit apart, from both sides, some several times."""
    at_keys = support.written(tokens(words, gram_counts(words)), "tokens")
    hot = support.written(at_keys.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > TILE).select("key", F.ceil(F.col("members") / TILE).cast("int").alias("blocks")), "hot")
    few = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    rows = at_keys.join(few, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word", "role"), F.col("blocks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("first"), F.greatest("block", j).alias("second")))
    tiles = rows.select("key", "role", "place", "word", "n", "block", F.explode(sides).alias("t")).select("key", "t.first", "t.second", "role", "place", "word", "n", "block")
    dealt = tiles.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")
    return dealt.mapInPandas(in_tiles, "word string, other string, other_n long")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words`` (``word``, ``n``).

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is
    its near word of largest ``n`` (ties: the smallest by code points) if that is ``ratio`` times its own
    or more; its root is where following the forms ends.

    Words are distinct. Null words, and words of fewer than ``SHORTEST`` code points, have no near
    words; very long words are compared whole; an empty table gives an empty table; other columns are
    not read.
    """
    words = support.written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words.filter("word IS NOT NULL"))
    known = pairs.groupBy("word", "other").agg(F.min("other_n").alias("other_n"))
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    found = words.join(best, "word", "left")
    strong = -F.col("best.less") >= F.col("n") * ratio
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    found = support.written(found, "forms")
    roots = rooted(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def rooted(steps: DataFrame) -> DataFrame:
    """``word, root`` with every step followed to its end. Each round doubles the steps taken; a chain's counts grow tenfold, so it is short."""
    steps = support.written(steps, "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = support.written(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not longer.filter("moved").limit(1).count():
            return longer.select("word", "root")
        steps = longer.select("word", "root")


def runs(text: Column, least: int) -> Column:
    """Maximal runs of letters of at least ``least`` code points, in lower case (A-Z only)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.transform(F.regexp_extract_all(text, F.lit(RUN.replace("+", f"{{{least},}}")), F.lit(0)), lambda w: F.translate(w, upper, upper.lower()))


def counted(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_one_of: int | None = None) -> DataFrame:
    """``word, n``: words of all texts with their occurrences.

    With ``drop_one_of``, an occurrence whose hash is divisible by it loses a code point: known errors,
    by which the search can be measured. Null texts have no words, null ids count as empty text; texts
    are read whole; equal rows count each; other columns are not read.
    """
    found = df.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col(text_column), least_length)).alias("run"))
    word = F.col("run")
    if drop_one_of:
        found = found.withColumn("h", support.crc32_of(F.concat("id", F.lit(":"), "run")))
        at = F.col("h") % F.length("run")
        word = F.when(F.col("h") % drop_one_of == 0, F.concat(F.substr("run", F.lit(1), at.cast("int")), F.substr("run", at.cast("int") + 2))).otherwise(word)
    words = found.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of all words of the documents, one occurrence in 31 losing a code point."""
    return variants(counted(support.table(spark, sf_dir, "documents"), drop_one_of=31))


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS bytes FROM runs WHERE length(run) >= 7 GROUP BY id, run
), hashed AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295], list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc
), words AS (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cuts AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM pairs GROUP BY word
), tops AS (
  SELECT p.word, min(p.other) AS other FROM pairs p JOIN best b ON p.word = b.word AND p.other_n = b.most GROUP BY p.word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN t.other END AS form, CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN tops t ON w.word = t.word
), walk AS (
  SELECT word, word AS root FROM words
  UNION SELECT w.word, f.form FROM walk w JOIN forms f ON w.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w ON f.word = w.word JOIN forms e ON w.root = e.word AND e.form IS NULL
"""
