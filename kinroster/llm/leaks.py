"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

The inverted index holds the benchmark's items; the queries are the passages of every training
text. A passage has twice as many words as the longest item and starts half a passage after the
one before, so a leaked item always lies whole in a passage. Impacts are divided by the item's
threshold, a share of the score that the item itself would get, so that every item passes at 1.

For a batch of passages the three steps of block-max WAND run on arrays: passages whose terms'
greatest impacts do not add up to 1 are dropped; then, of the blocks of items that a passage's
terms occur in, those whose block maxima do not add up to 1; the rest is scored item by item. No
item above its threshold can be lost. What is retrieved has to share word triples with both the
question (the first part of the item) and the answer (the last part).

Items of fewer than ``LEAST_WORDS`` words are too short for that and are searched exactly.

Document frequencies, mean length and longest item are those of the whole benchmark. The index is
built by tasks, in parts of bounded size, and written to the shared folder; workers load a part
when they need it and keep the last ones. Texts are read and hashed once for all parts.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import support, words

K1, B = 1.2, 0.75
#: Share of an item's own score from which on a passage is retrieved; share of triples to confirm.
RETRIEVE, CONFIRM = 0.6, 0.5
ANSWER, TRIPLE, BLOCK, LEAST_WORDS = 1 / 3, 3, 8, 6
#: Items, and characters, of a part of the index.
PART_ITEMS, PART_CHARS = 20_000, 20_000_000

_PLAIN = bytes(32 if chr(c) in " \t\n\v\f\r" or c < 128 and not chr(c).isalnum() else c for c in range(256)).lower()
#: Scripts that are written without spaces (Thai to Lao, Burmese, Khmer, kana, Han), and punctuation beyond ASCII.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def lower(texts: pd.Series) -> Iterator[str | None]:
    """Texts in lower case; in scripts without spaces every character is a word."""
    for t in texts:
        t = t.lower() if isinstance(t, str) else None
        yield t if t is None or t.isascii() else _UNSPACED.sub(r" \1 ", _MARKS.sub(" ", t))


def plain_words(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run of lower-cased texts, without ASCII punctuation."""
    return words.word_hashes([x.translate(_PLAIN) for x in run])


def item_words(text: str) -> np.ndarray:
    return plain_words([next(lower([text])).encode("utf-8", "surrogatepass")])[0]


@dataclass(frozen=True)
class Numbers:
    """Of the items with at least ``LEAST_WORDS`` words of the whole benchmark: how many, their mean length, the longest."""

    items: int
    mean: float
    longest: int


@dataclass
class Index:
    items: list[int]
    terms: np.ndarray
    starts: np.ndarray = field(repr=False)
    item: np.ndarray = field(repr=False)
    impact: np.ndarray = field(repr=False)
    block_starts: np.ndarray = field(repr=False)
    block: np.ndarray = field(repr=False)
    block_most: np.ndarray = field(repr=False)
    most: np.ndarray = field(repr=False)
    parts: list[tuple[np.ndarray, np.ndarray]] = field(repr=False)
    longest: int = 0
    short: dict[int, tuple[np.ndarray, np.ndarray, list[int]]] = field(default_factory=dict, repr=False)


def build(rows: list[tuple[int, str]], numbers: Numbers | None = None, df: dict[int, int] | None = None, retrieve: float = RETRIEVE) -> Index:
    """Inverted index of (item_id, text).

    ``numbers`` and ``df`` (term hash to number of items) are those of the whole benchmark if ``rows``
    are a part of it; by default ``rows`` are all.
    """
    hashed = [(i, item_words(t)) for i, t in sorted(set(rows))]
    brief = [(i, w) for i, w in hashed if 0 < len(w) < LEAST_WORDS]
    hashed = [(i, w) for i, w in hashed if len(w) >= LEAST_WORDS]
    terms, term = np.unique(np.concatenate([w for _, w in hashed]) if hashed else np.zeros(0, dtype=np.uint64), return_inverse=True)
    lengths = np.array([len(w) for _, w in hashed], dtype=float)
    numbers = numbers or Numbers(len(hashed), float(lengths.mean()) if len(lengths) else 0.0, int(lengths.max()) if len(lengths) else 0)
    owner = np.repeat(np.arange(len(hashed)), lengths.astype(int))
    keys, tf = np.unique(term.astype(np.int64) * max(len(hashed), 1) + owner, return_counts=True)
    term, item = keys // max(len(hashed), 1), keys % max(len(hashed), 1)
    often = np.bincount(term, minlength=len(terms)) if df is None else np.array([df[t] for t in terms.view(np.int64).tolist()], dtype=float)
    idf = np.log(1 + (numbers.items - often + 0.5) / (often + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / max(numbers.mean, 1.0)))
    own = np.bincount(item, weights=impact, minlength=len(hashed))
    impact = impact / (retrieve * own[item])
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    blocks = -(-max(len(hashed), 1) // BLOCK)
    block_keys, first = np.unique(term * blocks + item // BLOCK, return_index=True)
    block_most = np.maximum.reduceat(impact, first) if len(first) else impact
    block_term = block_keys // blocks
    split = [len(w) - max(TRIPLE, round(len(w) * ANSWER)) for _, w in hashed]
    parts = [(np.unique(words.gram_hashes(w[: s + 1] if s + 1 >= TRIPLE else w, TRIPLE)), np.unique(words.gram_hashes(w[s:], TRIPLE))) for (_, w), s in zip(hashed, split, strict=True)]
    most = np.maximum.reduceat(impact, starts[:-1]) if len(terms) else impact
    index = Index([i for i, _ in hashed], terms, starts, item, impact, np.searchsorted(block_term, np.arange(len(terms) + 1)), block_keys % blocks, block_most, most, parts, numbers.longest)
    for n in {len(w) for _, w in brief}:
        same = sorted((int(words.gram_hashes(w, n)[0]), i) for i, w in brief if len(w) == n)
        whole, first = np.unique(np.array([h for h, _ in same], dtype=np.uint64), return_index=True)
        index.short[n] = whole, np.append(first, len(same)), [i for _, i in same]
    return index


def expand(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all list entries of the given lists, and to which of them each belongs."""
    sizes = starts[rows + 1] - starts[rows]
    which = np.repeat(np.arange(len(rows)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[rows][which], which


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all that reach 1, for distinct pairs of passage and term."""
    alive = np.bincount(passage, weights=index.most[term], minlength=number) >= 1 - 1e-9
    keep = alive[passage]
    passage, term = passage[keep], term[keep]
    blocks = -(-max(len(index.items), 1) // BLOCK)
    at, which = expand(index.block_starts, term)
    keys, inverse = np.unique(passage[which] * blocks + index.block[at], return_inverse=True)
    hopeful = keys[np.bincount(inverse, weights=index.block_most[at], minlength=len(keys)) >= 1 - 1e-9]
    if not len(hopeful):
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
    keep = np.isin(passage, hopeful // blocks)
    passage, term = passage[keep], term[keep]
    at, which = expand(index.starts, term)
    own, item = passage[which], index.item[at]
    keep = hopeful[np.minimum(np.searchsorted(hopeful, own * blocks + item // BLOCK), len(hopeful) - 1)] == own * blocks + item // BLOCK
    keys, inverse = np.unique(own[keep] * len(index.items) + item[keep], return_inverse=True)
    score = np.bincount(inverse, weights=index.impact[at[keep]], minlength=len(keys))
    found = score >= 1 - 1e-9
    return keys[found] // len(index.items), keys[found] % len(index.items), score[found]


def share(part: np.ndarray, grams: np.ndarray) -> float:
    return float(np.isin(part, grams).mean()) if len(part) else 1.0


def search(index: Index, hashes: np.ndarray, offsets: np.ndarray, confirm: float = CONFIRM) -> list[dict[int, tuple[float, float, float]]]:
    """For each text of a run: item number -> (score, question share, answer share) of its best confirmed passage."""
    found: list[dict[int, tuple[float, float, float]]] = [{} for _ in range(len(offsets) - 1)]
    if not len(index.terms) or not len(hashes):
        return found
    stride = index.longest
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    inside = np.flatnonzero(index.terms[at] == hashes)
    text = np.searchsorted(offsets, inside, side="right") - 1
    sizes = np.diff(offsets)
    strides = np.maximum(1, -(-sizes // stride))  # passages: one for each stride of a text, two strides long
    first = np.concatenate([[0], np.cumsum(strides)])
    own = first[text] + (inside - offsets[text]) // stride
    before = (inside - offsets[text]) >= stride
    keys = np.unique(np.concatenate([own, own[before] - 1]) * len(index.terms) + np.concatenate([at[inside], at[inside][before]]))
    for p, i, s in zip(*(x.tolist() for x in retrieve(index, keys // len(index.terms), keys % len(index.terms), int(first[-1]))), strict=True):
        t = int(np.searchsorted(first, p, side="right")) - 1
        a = int(offsets[t]) + (p - int(first[t])) * stride
        grams = words.gram_hashes(hashes[a : min(a + 2 * stride, int(offsets[t + 1]))], TRIPLE)
        question, answer = (share(part, grams) for part in index.parts[i])
        if question >= confirm and answer >= confirm:
            found[t][i] = max(found[t].get(i, (0.0, 0.0, 0.0)), (s, question, answer))
    return found


def exact(index: Index, hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """(text, item id) of the short items: their words one after another, or the whole text for items without a triple."""
    found, sizes = set(), np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    for n, (whole, first, ids) in index.short.items():
        if len(hashes) < n:
            continue
        at = np.arange(len(hashes) - n + 1)
        at = at[text[at] == text[at + n - 1]] if n >= TRIPLE else offsets[:-1][sizes == n]
        grams = words.gram_hashes(hashes, n)[at]
        place = np.minimum(np.searchsorted(whole, grams), len(whole) - 1)
        for p in np.flatnonzero(whole[place] == grams).tolist():
            found |= {(int(text[at[p]]), i) for i in ids[first[place[p]] : first[place[p] + 1]]}
    return sorted(found)


FOUND = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"


@dataclass(frozen=True)
class Stored:
    """An index in the shared folder."""

    folder: str
    parts: int


@lru_cache(maxsize=4)
def part_of(folder: str, k: int) -> Index | None:
    data = support.mapped(folder, f"index-{k}", "u1")
    return pickle.loads(data.tobytes()) if len(data) else None


def stored(benchmark: DataFrame, item_column: str, text_column: str, part_items: int = PART_ITEMS, part_chars: int = PART_CHARS) -> Stored:
    """Builds the benchmark's index, in as many parts of bounded size as it needs.

    A task builds a part from its items and from the document frequencies of their terms in the whole benchmark.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_column).cast("long").alias("i"), F.col(text_column).alias("t")).filter("i IS NOT NULL AND t != ''").distinct()

    @F.pandas_udf("array<bigint>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([item_words(t).view(np.int64) for t in texts], dtype=object)

    items = support.written(items.withColumn("words", hashes("t")), "items")
    number, chars = items.agg(F.count("*"), F.sum(F.length("t"))).first()
    made = Stored(support.scratch_path(spark, "index"), max(1, -(-number // part_items), -(-(chars or 0) // part_chars)))
    placed = items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(made.parts)).cast("int"))
    long = placed.filter(F.size("words") >= LEAST_WORDS)
    numbers = Numbers(*(x or 0 for x in long.agg(F.count("*"), F.avg(F.size("words")), F.max(F.size("words"))).first()))
    terms = long.select("part", F.explode(F.array_distinct("words")).alias("term")).groupBy("part", "term").agg(F.count("*").alias("n"))
    often = terms.join(terms.groupBy("term").agg(F.sum("n").alias("df")), "term").select(F.col("part").alias("of_part"), "term", "df")

    def write(own: pd.DataFrame, df: pd.DataFrame) -> pd.DataFrame:
        if len(own):
            index = build(list(zip(own["i"].tolist(), own["t"], strict=True)), numbers, dict(zip(df["term"].tolist(), df["df"].tolist(), strict=True)))
            support.save(made.folder, f"index-{own['part'].iloc[0]}", np.frombuffer(pickle.dumps(index), dtype=np.uint8))
        return pd.DataFrame({"n": [len(own)]})

    placed.select("part", "i", "t").groupBy("part").cogroup(often.groupBy("of_part")).applyInPandas(write, "n long").agg(F.sum("n")).collect()
    support.drop_written(items)
    return made


def leaks(texts: Column, index: Stored, spark) -> Column:
    """The items that each text holds."""
    support.short_batches(spark)

    def find(column: pd.Series) -> pd.Series:
        out = []
        for _, run in words.pieces(lower(column)):
            hashes, offsets = plain_words(run)
            found: list[list[tuple]] = [[] for _ in run]
            for k in range(index.parts):
                part = part_of(index.folder, k)
                if part is not None:
                    for text, each in enumerate(search(part, hashes, offsets)):
                        found[text] += [(part.items[i], s * RETRIEVE, q, a) for i, (s, q, a) in each.items()]
                    for text, i in exact(part, hashes, offsets):
                        found[text].append((i, 1.0, 1.0, 1.0))
            out += [[dict(zip(("item_id", "score", "question", "answer"), x, strict=True)) for x in sorted(each)] for each in found]
        return pd.Series(out, dtype=object)

    # not deterministic: otherwise the filter that Spark infers for explode() runs the search a second time
    return F.pandas_udf(find, FOUND).asNondeterministic()(texts)


def flagged(df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``df`` with ``leaks``: the benchmark items in its text, with their score as a share of the item's own, and overlaps.

    Items of 3 to ``LEAST_WORDS`` - 1 words are held by texts in which their words follow each other;
    items of 1 or 2 words, which chance repeats everywhere, only by texts of the same words.

    Null and empty texts hold none; very long texts are searched whole; repeated rows are searched
    alike; null and empty items, and those without a word, are in no text; repeated items count
    once; empty tables give no leaks. A column named ``leaks`` is replaced, others are kept.
    """
    index = stored(benchmark, item_column, item_text_column)
    return df.withColumn("leaks", leaks(F.col(text_column), index, df.sparkSession))


def decontaminate(df: DataFrame, benchmark: DataFrame, text_column: str = "text", **columns) -> DataFrame:
    """The rows of ``df`` whose text holds no benchmark item, as they are; see ``flagged`` for what holds one."""
    index = stored(benchmark, columns.get("item_column", "item_id"), columns.get("item_text_column", "text"))
    return df.filter(F.size(leaks(F.col(text_column), index, df.sparkSession)) == 0)


def op9(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    docs = support.table(spark, sf_dir, "documents").select("doc_id", "text")
    return flagged(docs, support.table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.score", "x.question", "x.answer")
