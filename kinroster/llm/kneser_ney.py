"""Interpolated modified Kneser-Ney n-gram model (trigrams by default), counted in Spark and memory-mapped by workers.

The model is a set of sorted arrays in the shared folder, cut into shards:

* the vocabulary: the sorted 64-bit hashes of all training words with their counts. A word's id is
  its rank. Beside them, in the same order, how many distinct words come before each.
* for each order, the contexts and the words after them. A context's key packs the ids of its words
  and is then permuted, so keys are spread evenly and a table of buckets finds them in a few steps.
  Contexts with a single word after them, which are most, are kept apart from the others.

An n-gram lies in the shard of the last word of its context. So a shard has every context of every
order that ends with that word as a whole, and one shuffle serves all orders. The n-grams of very
frequent context words are dealt over all shards by the last two words of their contexts; only
their bigrams then need a second, small shuffle.

Tasks count what they read in numpy and send sorted, delta-coded runs, one for each shard. One
task merges a shard and writes its arrays, so no task holds more than a shard. A file is written
under another name and then moved, so a task that is run again writes the same file again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import support, words

ORDER = 3
#: Bytes of text for a shard, tokens that a task counts at once, and bytes of text that are scored at once.
SHARD_BYTES, HELD, PIECE = 16 << 20, 3_000_000, 4 << 20
END = np.uint64(0x3D4D51C2D82B14B1)
BLOBS = "shard int, kind int, blob binary"
MULTI = np.dtype([("start", "<u8"), ("total", "<u8"), ("n", "<u4"), ("n1", "<u4"), ("n2", "<u4")])
ONE = np.dtype([("word", "<u4"), ("count", "u1")])
#: A count of this or more is kept beside the array, by position.
BIG = 255


@dataclass
class Layout:
    """Where the arrays are and how they are cut: a few numbers for each shard, and for each frequent word."""

    folder: str
    order: int
    shards: int
    offsets: list[int] = field(default_factory=list)  # of the ids, by shard of words
    frequent: list[int] = field(default_factory=list)  # ids whose n-grams lie in all shards
    frequent_sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), dtype=np.int64))
    tokens: int = 0
    discounts: list[list[float]] = field(default_factory=list)  # of the orders 1, 2, ...
    bigrams: int = 0  # distinct
    rest: float = 0.0  # the probability that words leave to the uniform distribution

    @property
    def vocabulary(self) -> int:
        return self.offsets[-1]

    @property
    def bits(self) -> int:
        """Bits of an id; the id after the last word stands for the start of texts."""
        return max(1, self.vocabulary.bit_length())


# Keys of contexts.


def permuted(x: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    """A permutation of the integers of ``bits`` bits, or its inverse."""
    mask, odd = (1 << bits) - 1, 0x9E3779B97F4A7C15
    by = np.uint64((pow(odd, -1, 1 << 64) if back else odd) & mask)
    x = (x * by) & np.uint64(mask)
    return ((x ^ (x >> np.uint64(bits // 2 + 1))) * by) & np.uint64(mask)


def context_shard(contexts: list[np.ndarray], layout: Layout, word: np.ndarray | None = None) -> np.ndarray:
    """Shard of contexts, given their ids by distance from the word that follows.

    Where the last id is frequent, the one before decides too; of contexts of one id, the ``word`` that follows.
    """
    last = contexts[0].astype(np.uint64)
    key = last + np.uint64(1)
    deal = contexts[1] if len(contexts) > 1 else word
    if deal is not None and layout.frequent:
        often = np.isin(last, np.array(layout.frequent, dtype=np.uint64))
        key = np.where(often, words.mix(key) + deal.astype(np.uint64), key)
    return (words.mix(key) & np.uint64(layout.shards - 1)).astype(np.int64)


def pair_shard(first: np.ndarray, second: np.ndarray, layout: Layout) -> np.ndarray:
    """Shard of a bigram of a frequent word."""
    return (words.mix(words.mix(first.astype(np.uint64) + np.uint64(1)) ^ second.astype(np.uint64)) & np.uint64(layout.shards - 1)).astype(np.int64)


def packed_ids(contexts: list[np.ndarray], bits: int) -> np.ndarray:
    key = np.zeros(len(contexts[0]), dtype=np.uint64)
    for c in reversed(contexts):
        key = (key << np.uint64(bits)) | c.astype(np.uint64)
    return key


# Runs of sorted rows, as blobs.


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, of which the first is sorted and sent as differences; byte plane after byte plane, compressed."""
    n, planes, widths = len(columns[0]), [], []
    for i, c in enumerate(columns):
        c = np.diff(c.astype("<u8"), prepend=np.uint64(0)) if i == 0 else c.astype("<u8")
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if n else 1
        widths.append(width)
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(n, 8)[:, :width].T).tobytes())
    body = b"".join(planes)
    head = np.array([n, len(columns), len(body)], dtype="<u8").tobytes() + bytes(widths)
    return head + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpacked(blob: bytes) -> list[np.ndarray]:
    n, width, size = np.frombuffer(blob, dtype="<u8", count=3).tolist()
    body = pa.decompress(blob[24 + width :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for i, w in enumerate(blob[24 : 24 + width]):
        full = np.zeros((n, 8), dtype=np.uint8)
        full[:, :w] = np.frombuffer(body, dtype=np.uint8, count=n * w, offset=at).reshape(w, n).T
        at += n * w
        c = full.view("<u8").ravel()
        out.append(np.cumsum(c, dtype=np.uint64) if i == 0 else c)
    return out


def summed(key: np.ndarray, word: np.ndarray | None, count: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Rows sorted by key and word, the counts of equal ones added up."""
    if not len(key):
        return key, word, count
    order = np.argsort(key, kind="stable") if word is None else np.lexsort((word, key))
    key, word = key[order], None if word is None else word[order]
    new = key[1:] != key[:-1] if word is None else (key[1:] != key[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(np.concatenate([[True], new]))
    return key[first], None if word is None else word[first], np.add.reduceat(count[order], first)


def merged(blobs: list[bytes]) -> list[np.ndarray]:
    """One sorted run of (key, count) or (key, word, count)."""
    parts = [np.concatenate(x) for x in zip(*map(unpacked, blobs), strict=True)]
    key, word, count = summed(parts[0], parts[1] if len(parts) == 3 else None, parts[-1].astype(np.int64))
    return [key, count] if word is None else [key, word, count]


def by_shard(blobs: DataFrame) -> DataFrame:
    return blobs.repartition("shard").sortWithinPartitions("shard")


def shard_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of one shard after another, from batches in the order of shards."""
    shard, held = None, []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.shard != shard and held:
                yield shard, held
                held = []
            shard = row.shard
            held.append(row.blob)
    if held:
        yield shard, held


def cut_by(shard: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by shard, and the slice of each shard that has rows."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    held, first = np.unique(shard[order], return_index=True)
    ends = np.append(first, len(shard))[1:]
    return order, [(int(s), slice(a, b)) for s, a, b in zip(held, first, ends, strict=True)]


# Tokens and the vocabulary.


def token_runs(batches: Iterator[pd.DataFrame], size: int = words.PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the tokens of runs of texts: words in lower case (A-Z), then one end for each text; and the texts' offsets."""
    for pdf in batches:
        for _, run in words.pieces(pdf["text"], size):
            hashes, offsets = words.word_hashes([x.lower() for x in run])
            number = np.arange(len(offsets))
            yield np.insert(hashes, offsets[1:], END), offsets + number


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a word: equal ranges of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


class Words:
    """Ids and counts of words, by binary search in the mapped arrays."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.starts = np.array(layout.offsets)

    def ids(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids with -1 for the unknown, and each token's place among them."""
        unique, inverse = np.unique(tokens, return_inverse=True)
        out = np.full(len(unique), -1, dtype=np.int64)
        _, parts = cut_by(word_shard(unique, self.layout.shards), self.layout.shards)
        for s, own in parts:
            known = support.mapped(self.layout.folder, f"hashes-{s}", "<u8")
            if len(known):
                at = np.minimum(np.searchsorted(known, unique[own]), len(known) - 1)
                out[own] = np.where(known[at] == unique[own], at + self.starts[s], -1)
        return out, inverse

    def about(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of an array in the order of ids; 0 for the id -1."""
        out = np.zeros(len(ids), dtype=np.int64)
        known = np.flatnonzero(ids >= 0)
        shard = np.searchsorted(self.starts[1:], ids[known], side="right")
        order, parts = cut_by(shard, self.layout.shards)
        for s, own in parts:
            rows = known[order[own]]
            out[rows] = support.mapped(self.layout.folder, f"{name}-{s}", "<i8")[ids[rows] - self.starts[s]]
        return out


def count_words(df: DataFrame, layout: Layout) -> DataFrame:
    """Writes the words of the training texts; returns ``shard, n, total``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(held: list[np.ndarray]) -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            _, parts = cut_by(word_shard(keys, layout.shards), layout.shards)
            return pd.DataFrame([(s, 0, packed(keys[own], counts[own])) for s, own in parts], columns=["shard", "kind", "blob"])

        held, number = [], 0
        for tokens, _ in token_runs(batches):
            held.append(tokens)
            number += len(tokens)
            if number >= HELD:
                yield flush(held)
                held, number = [], 0
        if held:
            yield flush(held)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, blobs in shard_runs(batches):
            keys, counts = merged(blobs)
            support.save(layout.folder, f"hashes-{shard}", keys.astype("<u8"))
            support.save(layout.folder, f"counts-{shard}", counts.astype("<i8"))
            yield pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    return by_shard(df.mapInPandas(count, BLOBS)).mapInPandas(write, "shard int, n long, total long")


def frequent_words(spark, layout: Layout) -> list[int]:
    """Ids of the words with a fourth of a shard's tokens or more: at most four for each shard."""
    least = max(2, layout.tokens // (4 * layout.shards))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["id"]:
                counts = support.mapped(layout.folder, f"counts-{s}", "<i8")
                yield pd.DataFrame({"id": np.flatnonzero(counts >= least) + layout.offsets[s]})

    return sorted(r["id"] for r in spark.range(layout.shards).mapInPandas(find, "id long").collect())


# The arrays of one order in one shard.


def numbers_of(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4, how many there are, and how many are 3 or more."""
    return np.array([*(int((counts == k).sum()) for k in (1, 2, 3, 4)), len(counts), int((counts >= 3).sum())], dtype="<i8")


def with_big(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in a byte, and the (position, count) of those that are too big for one."""
    big = np.flatnonzero(counts >= BIG)
    return np.minimum(counts, BIG).astype("u1"), np.stack([big, counts[big]], axis=1).astype("<u8")


def bucket_bits(n: int, bits: int) -> int:
    """Leading bits of a key that choose its bucket, so that about 32 of ``n`` keys share one and the rest has 32 bits if possible."""
    return min(bits, max((max(n, 1) // 32).bit_length(), min(bits - 32, 20), 0))


def save_keys(folder: str, name: str, keys: np.ndarray, bits: int) -> None:
    """Sorted keys without their leading bits, and where each bucket of equal leading bits begins."""
    lead = bucket_bits(len(keys), bits)
    rest = bits - lead
    support.save(folder, f"{name}-buckets", np.searchsorted(keys >> np.uint64(rest), np.arange((1 << lead) + 1, dtype=np.uint64)).astype("<u8"))
    support.save(folder, f"{name}-keys", (keys & np.uint64((1 << rest) - 1)).astype("<u4" if rest <= 32 else "<u8"))


def find_keys(folder: str, name: str, keys: np.ndarray, bits: int) -> np.ndarray:
    """Positions of keys among the saved ones, -1 for those that are not there."""
    buckets = support.mapped(folder, f"{name}-buckets", "<u8")
    lead = (len(buckets) - 1).bit_length() - 1
    rest = bits - lead
    held = support.mapped(folder, f"{name}-keys", "<u4" if rest <= 32 else "<u8")
    if not len(held):
        return np.full(len(keys), -1, dtype=np.int64)
    bucket = (keys >> np.uint64(rest)).astype(np.int64)
    return bisect(held, keys & np.uint64((1 << rest) - 1), buckets[bucket].astype(np.int64), buckets[bucket + 1].astype(np.int64))


def bisect(held: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each wanted value its position in its own range of ``held``, which is sorted there, or -1."""
    end, wanted = high, wanted.astype(held.dtype)
    for _ in range(int((high - low).max()).bit_length() if len(low) else 0):
        middle = np.minimum((low + high) >> 1, len(held) - 1)
        less = (held[middle] < wanted) & (low < high)
        low, high = np.where(less, middle + 1, low), np.where(less, high, np.where(low < high, middle, high))
    at = np.minimum(low, len(held) - 1)
    return np.where((low < end) & (held[at] == wanted), at, -1)


def save_order(folder: str, name: str, key: np.ndarray, word: np.ndarray, count: np.ndarray, bits: int) -> None:
    """The arrays of the sorted rows of one order."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    n = np.diff(first, append=len(key))
    one, many = first[n == 1], first[n > 1]
    save_keys(folder, f"{name}-one", key[one], bits)
    save_rows(folder, f"{name}-one", word[one], count[one])
    save_keys(folder, f"{name}-many", key[many], bits)
    inside = np.repeat(n > 1, n)
    save_rows(folder, f"{name}-many", word[inside], count[inside])
    info = np.zeros(len(many), dtype=MULTI)
    if len(many):
        sizes = n[n > 1]
        at, kept = np.cumsum(sizes) - sizes, count[inside]
        info["start"], info["n"] = at, sizes
        for field_, values in (("total", kept), ("n1", kept == 1), ("n2", kept == 2)):
            info[field_] = np.add.reduceat(values.astype(np.int64), at)
    support.save(folder, f"{name}-info", info)


def save_rows(folder: str, name: str, word: np.ndarray, count: np.ndarray) -> None:
    rows = np.zeros(len(word), dtype=ONE)
    rows["word"] = word
    rows["count"], big = with_big(count)
    support.save(folder, f"{name}-rows", rows)
    support.save(folder, f"{name}-big", big)


def counts_at(folder: str, name: str, at: np.ndarray) -> np.ndarray:
    """Counts of rows, those that are kept beside the array included."""
    out = support.mapped(folder, f"{name}-rows", ONE)["count"][at].astype(np.int64)
    full = np.flatnonzero(out == BIG)
    if len(full):
        big = support.mapped(folder, f"{name}-big", "<u8").reshape(-1, 2)
        out[full] = big[np.searchsorted(big[:, 0], at[full].astype(np.uint64)), 1]
    return out


def look_up(folder: str, name: str, keys: np.ndarray, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (context, word): its count, and total, n1, n2, n3 of the context; total 0 for a context that is not there."""
    count, about = np.zeros(len(keys), dtype=np.int64), np.zeros((len(keys), 4), dtype=np.int64)
    at = find_keys(folder, f"{name}-one", keys, bits)
    hit = np.flatnonzero(at >= 0)
    if len(hit):
        own = counts_at(folder, f"{name}-one", at[hit])
        about[hit] = np.stack([own, own == 1, own == 2, own >= 3], axis=1)
        count[hit] = np.where(support.mapped(folder, f"{name}-one-rows", ONE)["word"][at[hit]] == word[hit], own, 0)
    at = find_keys(folder, f"{name}-many", keys, bits)
    hit = np.flatnonzero(at >= 0)
    if len(hit):
        info = support.mapped(folder, f"{name}-info", MULTI)[at[hit]]
        n, n1, n2 = (info[x].astype(np.int64) for x in ("n", "n1", "n2"))
        about[hit] = np.stack([info["total"].astype(np.int64), n1, n2, n - n1 - n2], axis=1)
        low = info["start"].astype(np.int64)
        place = bisect(support.mapped(folder, f"{name}-many-rows", ONE)["word"], np.maximum(word[hit], 0), low, low + n)
        known = (place >= 0) & (word[hit] >= 0)
        count[hit[known]] = counts_at(folder, f"{name}-many", place[known])
    return count, about


# Counting n-grams.


def shifted(ids: np.ndarray, offsets: np.ndarray, by: int, start: int) -> np.ndarray:
    """The id ``by`` tokens before each token, ``start`` before a text's first."""
    place = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.full(len(ids), start, dtype=np.int64)
    inside = np.flatnonzero(place >= by)
    out[inside] = ids[inside - by]
    return out


def count_grams(df: DataFrame, layout: Layout) -> DataFrame:
    """Writes the n-grams of the training texts, order by order.

    Returns blobs: kind 1, for a shard of words, words and how many distinct words come before them;
    kind 2, for a shard of bigrams of frequent words, first word, second word and distinct words before.
    """
    length, bits, start = layout.order - 1, layout.bits, layout.vocabulary
    if length * bits > 64:
        raise ValueError(f"contexts of {length} words do not fit 64 bits with {layout.vocabulary} distinct words")
    frequent = np.array(layout.frequent, dtype=np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words(layout)

        def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
            shard, key, word = (np.concatenate(x) for x in zip(*held, strict=True))
            order, parts = cut_by(shard, layout.shards)
            key, word = key[order], word[order]
            ones = np.ones(len(key), dtype=np.int64)
            return pd.DataFrame([(s, 0, packed(*summed(key[own], word[own], ones[own]))) for s, own in parts], columns=["shard", "kind", "blob"])

        held, number = [], 0
        for tokens, offsets in token_runs(batches):
            ids, place = known.ids(tokens)
            word = ids[place]
            contexts = [shifted(word, offsets, by, start) for by in range(1, length + 1)]
            held.append((context_shard(contexts, layout, word), permuted(packed_ids(contexts, bits), length * bits), word))
            number += len(tokens)
            if number >= HELD:
                yield flush(held)
                held, number = [], 0
        if held:
            yield flush(held)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, blobs in shard_runs(batches):
            key, word, count = merged(blobs)
            out = []
            for k in range(layout.order, 1, -1):
                own = (k - 1) * bits
                plain = permuted(key, own, back=True)
                last = (plain & np.uint64((1 << bits) - 1)).astype(np.int64)
                if k == 2 and len(frequent):
                    often = np.isin(last, frequent)
                    out += pair_blobs(last[often], word[often].astype(np.int64), count[often], layout)
                    key, word, count, plain = key[~often], word[~often], count[~often], plain[~often]
                save_order(layout.folder, f"g{k}-{shard}", key, word, count, own)
                support.save(layout.folder, f"numbers-{k}-{shard}", numbers_of(count))
                if k > 2:  # each n-gram is one more predecessor of what follows its first word
                    shorter = permuted(plain & np.uint64((1 << (own - bits)) - 1), own - bits)
                    key, word, count = summed(shorter, word, np.ones(len(shorter), dtype=np.int64))
            out += word_blobs(word, layout)
            yield pd.DataFrame(out, columns=["shard", "kind", "blob"])

    return by_shard(df.mapInPandas(count, BLOBS)).mapInPandas(write, BLOBS)


def word_blobs(word: np.ndarray, layout: Layout) -> list[tuple[int, int, bytes]]:
    """Of the second words of distinct bigrams: how often each occurs, by shard of words."""
    own, number = np.unique(word.astype(np.int64), return_counts=True)
    _, parts = cut_by(np.searchsorted(np.array(layout.offsets[1:]), own, side="right"), layout.shards)
    return [(s, 1, packed(own[at], number[at])) for s, at in parts]


def pair_blobs(first: np.ndarray, second: np.ndarray, count: np.ndarray, layout: Layout) -> list[tuple[int, int, bytes]]:
    order, parts = cut_by(pair_shard(first, second, layout), layout.shards)
    first, second, count = first[order], second[order], count[order]
    return [(s, 2, packed(*summed(first[at].astype(np.uint64), second[at].astype(np.uint64), count[at]))) for s, at in parts]


def write_pairs(blobs: DataFrame, layout: Layout) -> DataFrame:
    """Writes the bigrams of frequent words; returns blobs of kind 1, and of kind 3 with the sums of the words as contexts."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, held in shard_runs(batches):
            first, second, count = merged(held)
            key = (first << np.uint64(layout.bits)) | second
            save_keys(layout.folder, f"often-{shard}", key, 2 * layout.bits)
            save_rows(layout.folder, f"often-{shard}", second, count)
            support.save(layout.folder, f"numbers-often-{shard}", numbers_of(count))
            own, at = np.unique(first, return_index=True)
            sums = [np.add.reduceat(x.astype(np.int64), at) for x in (count, count == 1, count == 2, count >= 3)]
            yield pd.DataFrame([*word_blobs(second, layout), (0, 3, packed(own, *sums))], columns=["shard", "kind", "blob"])

    return by_shard(blobs).mapInPandas(write, BLOBS)


def write_before(blobs: DataFrame, layout: Layout) -> DataFrame:
    """Writes how many distinct words come before each word, in the order of ids; returns the counts of these numbers."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, held in shard_runs(batches):
            before = np.zeros(layout.offsets[shard + 1] - layout.offsets[shard], dtype="<i8")
            own, number = merged(held)
            before[own.astype(np.int64) - layout.offsets[shard]] = number
            support.save(layout.folder, f"before-{shard}", before)
            yield pd.DataFrame([numbers_of(before[before > 0])], columns=["n1", "n2", "n3", "n4", "n", "more"])

    return by_shard(blobs).mapInPandas(write, "n1 long, n2 long, n3 long, n4 long, n long, more long")


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the numbers of things with counts 1 to 4.

    Where these are too few to tell, the discount is half of the count, at most 1.5; it never
    exceeds the count and is never below 0.
    """
    out = []
    for k in (1, 2, 3):
        usual = k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1] if n[k - 1] and n[k] and n[0] else k / 2
        out.append(min(max(usual, 0.0), float(k)))
    return out


def numbers(spark, layout: Layout, kinds: list[str]) -> dict[str, list[int]]:
    """Sums over all shards of the numbers that were saved beside the arrays."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["id"]:
                rows = [(kind, *support.mapped(layout.folder, f"numbers-{kind}-{s}", "<i8").tolist()) for kind in kinds]
                yield pd.DataFrame([r for r in rows if len(r) > 1], columns=["kind", "n1", "n2", "n3", "n4", "n", "more"])

    names = ("n1", "n2", "n3", "n4", "n", "more")
    found = spark.range(layout.shards).mapInPandas(read, "kind string, " + ", ".join(f"{x} long" for x in names)).groupBy("kind").agg(*[F.sum(x).alias(x) for x in names]).collect()
    return {k: [0] * 6 for k in kinds} | {r["kind"]: [int(r[x]) for x in names] for r in found}


def train(df: DataFrame, text_column: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Layout:
    """Counts the model of all texts and writes it to the shared folder. An empty table gives an empty model.

    ``order`` is the length of the longest n-grams, 2 or more; the ids of a context's words have to
    fit 64 bits together. Nothing is pruned.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout(support.scratch_path(spark, "model"), order, 1 << (max(1, -(-size // shard_bytes)) - 1).bit_length())
    support.short_batches(spark)
    found = {r["shard"]: r for r in count_words(texts, layout).collect()}
    layout.offsets = np.cumsum([0] + [found[s]["n"] if s in found else 0 for s in range(layout.shards)]).tolist()
    layout.tokens = sum(r["total"] for r in found.values())
    if not layout.tokens:
        return layout
    layout.frequent = frequent_words(spark, layout) + [layout.vocabulary]
    blobs = support.written(count_grams(texts, layout), "grams")
    pairs = support.written(write_pairs(blobs.filter("kind = 2"), layout), "pairs")
    sums = [unpacked(r["blob"]) for r in pairs.filter("kind = 3").select("blob").collect()]
    if sums:
        own, inverse = np.unique(np.concatenate([x[0] for x in sums]).astype(np.int64), return_inverse=True)
        each = np.concatenate([np.stack(x[1:], axis=1) for x in sums]).astype(np.int64)
        layout.frequent_sums = np.zeros((len(layout.frequent), 4), dtype=np.int64)
        np.add.at(layout.frequent_sums, np.searchsorted(layout.frequent, own)[inverse], each)
    n = [int(x or 0) for x in write_before(blobs.filter("kind = 1").union(pairs.filter("kind = 1")), layout).agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "n", "more")]).first()]
    kinds = numbers(spark, layout, [*map(str, range(2, order + 1)), "often"])
    kinds["2"] = [a + b for a, b in zip(kinds["2"], kinds["often"], strict=True)]
    layout.discounts = [discounts(n)] + [discounts(kinds[str(k)]) for k in range(2, order + 1)]
    layout.bigrams = kinds["2"][4]
    layout.rest = sum(d * x for d, x in zip(layout.discounts[0], (n[0], n[1], n[5]), strict=True)) / layout.bigrams
    support.drop_written(blobs, pairs)
    return layout


# Scoring.


def discounted(counts: np.ndarray, by: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3)], 0.0)


def contexts_of(layout: Layout, k: int, contexts: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count of (context, word) and sums of the context at order ``k``, for contexts by distance and words; unknown ids are -1."""
    count, about = np.zeros(len(word), dtype=np.int64), np.zeros((len(word), 4), dtype=np.int64)
    rows = np.flatnonzero(np.all([c >= 0 for c in contexts], axis=0))
    if k == 2 and layout.frequent:
        often = np.isin(contexts[0][rows], layout.frequent)
        own = rows[often]
        about[own] = layout.frequent_sums[np.searchsorted(layout.frequent, contexts[0][own])]
        own, rows = own[word[own] >= 0], rows[~often]
        order, parts = cut_by(pair_shard(contexts[0][own], word[own], layout), layout.shards)
        for s, part in parts:
            at = own[order[part]]
            place = find_keys(layout.folder, f"often-{s}", packed_ids([word[at], contexts[0][at]], layout.bits), 2 * layout.bits)
            count[at[place >= 0]] = counts_at(layout.folder, f"often-{s}", place[place >= 0])
    # The shards were chosen by the longest contexts, of which the last two words decide.
    shard = context_shard([c[rows] for c in contexts], layout)
    order, parts = cut_by(shard, layout.shards)
    keys = permuted(packed_ids([c[rows] for c in contexts], layout.bits), (k - 1) * layout.bits)
    for s, part in parts:
        at = order[part]
        count[rows[at]], about[rows[at]] = look_up(layout.folder, f"g{k}-{s}", keys[at], word[rows[at]], (k - 1) * layout.bits)
    return count, about


def score_run(layout: Layout, tokens: np.ndarray, offsets: np.ndarray, additive: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text of a run: tokens that training knows, base score and score."""
    sums = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  every text has its end
    if not layout.tokens:
        none = sums(np.zeros(len(tokens)))
        return none.astype(int), none, none  # log10(1 / (0 + 1 * (0 + 1))), and log10(1 / ((0 + 1) * (0 + 1)))
    known = Words(layout)
    ids, place = known.ids(tokens)
    kinds = layout.vocabulary + 1  # the words, and one for all that training does not know
    base = np.log10((known.about("counts", ids) + 1) / (float(layout.tokens + kinds) if additive else float(layout.tokens + 1) * kinds))
    before = known.about("before", ids)
    chance = (discounted(before, layout.discounts[0]) / layout.bigrams + layout.rest / (layout.vocabulary + 1))[place]
    word = ids[place]
    contexts = [shifted(word, offsets, by, layout.vocabulary) for by in range(1, layout.order)]
    for k in range(2, layout.order + 1):
        count, about = contexts_of(layout, k, contexts[: k - 1], word)
        total, by = np.maximum(about[:, 0], 1), layout.discounts[k - 1]
        weight = np.where(about[:, 0] > 0, about[:, 1:] @ np.array(by) / total, 1.0)
        chance = discounted(count, by) / total + weight * chance
    return sums((word >= 0).astype(np.int64)), sums(base[place]), sums(np.log10(chance))


SCORED = "n_tokens long, n_known long, base_score double, score double"


def score(df: DataFrame, layout: Layout, text_column: str = "text", additive: bool = False) -> DataFrame:
    """``df`` with ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10 probability), and ``perplexity`` of a token.

    The base score sums log10((c+1)/((N+1)*(V+1))) over tokens; with ``additive``, log10((c+1)/(N+1*(V+1))),
    the probability by counts with one added to each.

    Null and empty texts are a single end; very long texts are scored whole; repeated rows score
    alike; an empty table gives an empty table; a model of an empty table gives every token
    probability 1. Columns of the input with the names of the new ones are replaced, others are kept.
    """
    def scores(column: pd.Series) -> pd.DataFrame:
        out = [pd.DataFrame({"n_tokens": [], "n_known": [], "base_score": [], "score": []})]
        for tokens, offsets in token_runs(iter([pd.DataFrame({"text": column})]), PIECE):
            known, base, total = score_run(layout, tokens, offsets, additive)
            out.append(pd.DataFrame({"n_tokens": np.diff(offsets), "n_known": known, "base_score": base, "score": total}))
        return pd.concat(out[1:] or out, ignore_index=True)

    names = [c.split()[0] for c in SCORED.split(", ")]
    kept = df.drop(*names, "perplexity")
    lm = support.fresh(df, "lm")
    scored = kept.withColumn(lm, F.pandas_udf(scores, SCORED)(F.col(text_column)))
    own = F.col(lm)
    return scored.select(*kept.columns, *[own[n].alias(n) for n in names], F.pow(F.lit(10.0), -own["score"] / own["n_tokens"]).alias("perplexity"))


def held_out(identity: Column) -> Column:
    """Whether the row's text is kept from training."""
    return F.coalesce(support.crc32_of(identity) % 7 == 2, F.lit(False))


def op4(spark, sf_dir: str, additive: bool = False) -> DataFrame:
    """Score of every document by a model of those that are not held out."""
    docs = support.table(spark, sf_dir, "documents").select("doc_id", "text")
    layout = train(docs.filter(~held_out(F.col("doc_id"))))
    return score(docs, layout, additive=additive).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(layout.tokens).cast("long").alias("train_tokens"), "base_score", "score")
