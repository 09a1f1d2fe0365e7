"""N-gram Jaccard join by chosen paths.

A text's set holds the hashes of its five-word shingles; equal sets are one from the start. Every
set is embedded into ``COORDINATES`` min-hash tokens, so two sets share about as many tokens as
their Jaccard similarity says. In each run all sets start in one bucket. A bucket is split on
tokens that it samples, 1 / threshold of them on average, so a pair at the threshold stays together
on one path on average. Buckets of up to ``SMALL`` sets are compared pair by pair, on their
min-hashes with a wide margin, and give a spanning forest of what agrees; a set that the forest has
reached is compared with no further one, so near copies cost little. Larger buckets are split
again, however often it takes. Strangers that share boilerplate part on the way: at a similarity of
0.5 a split leaves 0.64 of a bucket together. Copies that agree loosely do not: each split leaves
most of their bucket together, and a round of Spark jobs for it costs far more than comparing some
thousand sets in one task.

Only sets that truly agree would never part. So a large bucket gets a centre, the commonest token at
each coordinate in a sample of its sets. If most of the sample lies within ``CLOSE`` of the centre,
every set within ``CLOSE`` is finished here: whatever is similar to it lies within ``CLOSE + REACH`` of
the centre, by the triangle inequality of the distance between embeddings, and all sets that do so are
linked. The others are split on.

Near copies walk together. A set that shares a band of tokens with many others takes the least set of
that band as its head, if all but ``NEAR`` of their tokens agree, and its paths are written under the
head's name, once for all sets that take them: a head walks the paths of all that it stands for, so no
path is lost. In a small bucket a head is compared with a margin that is wider by the distance of its
farthest set; where a bucket is still large, heads are replaced by their sets again.

The runs are independent. There are enough of them for pairs that meet after the first splits; sets
whose buckets were split further take part in more runs, as many as that depth needs. Together a pair
at the threshold is missed with probability ``1 - RECALL`` at most, over the spread of shared tokens
too.

What has been linked is then checked exactly: the linked sets are grouped by component, their
texts are read again, and each group's shingle sets are compared in tiles of bounded size. Tiles
return sums of links and a spanning forest, not pairs, so a group of n sets costs n rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, support, words

SHINGLE, THRESHOLD = 5, 0.8
COORDINATES, FIRST_DEPTH, STEP = 128, 3, 2
#: Further depths for which runs are added; a bucket that is split beyond the last needs as many as each doubling.
DEPTHS = (5, 9, 15, 25, 50, 100)
RECALL, SMALL = 0.9999, 2048
#: Sets whose pairs are compared all at once.
MATRIX = 64
#: Min-hash agreement may fall so far below the threshold, 5.7 standard deviations at 0.8.
MARGIN = 0.2
#: Distance of a set from a centre that finishes it, and of what may be similar to it: 0.2 at the threshold and 3.5 standard deviations.
CLOSE, REACH = 0.2, 0.32
#: Distance of a set from the head under whose name it walks; bands, tokens of a band, and sets of a band that have a head.
NEAR, BANDS, BAND, CROWD = 0.05, 4, 8, 16
#: Sets from which a bucket's centre is made; centres that are broadcast at most.
CENTRE_SAMPLE, BROADCAST_CENTRES = 64, 20_000
#: Sets in a tile's side, and their shingles; so many representatives at most are broadcast.
TILE, TILE_SHINGLES, BROADCAST_SETS = 512, 4_000_000, 400_000

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def survival(depth: int, threshold: float = THRESHOLD, share: float | np.ndarray | None = None) -> float | np.ndarray:
    """Probability that a pair shares a path of ``depth`` splits in one run; ``share`` of its tokens are common, ``threshold`` if not given."""
    share = threshold if share is None else share
    extra, gone = 1 / threshold - 1, 0.0
    for _ in range(depth):
        once = 1 - share + share * gone
        gone = once * (1 - extra + extra * once)
    return 1 - gone


def runs_for(recall: float = RECALL, depth: int = FIRST_DEPTH + STEP, threshold: float = THRESHOLD) -> int:
    """Fewest runs that miss a pair at the threshold with probability ``1 - recall`` at most, over the binomial spread of its common tokens."""
    common = np.arange(COORDINATES + 1)
    odds = np.array([math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in common.tolist()])
    parted = 1 - survival(depth, threshold, common / COORDINATES)
    low, high = 0, 1
    while odds @ parted**high > 1 - recall:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if odds @ parted**middle > 1 - recall else (low, middle)
    return high


def runs_of(recall: float = RECALL, threshold: float = THRESHOLD) -> Iterator[tuple[int, range]]:
    """Each of ``DEPTHS`` and its runs: the first of all sets, the others of sets that were split beyond the depth before."""
    done = 0
    for depth in DEPTHS:
        enough = max(done, runs_for(recall, depth, threshold))
        yield depth, range(done, enough)
        done = enough


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """The embedding of a set: 16 bits of the min-hash in every coordinate."""
    short = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), 2048):
        least = np.minimum(least, (short[at : at + 2048, None] * _FACTORS + _SHIFTS).min(axis=0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def set_hash(grams: np.ndarray) -> int:
    """64 bits of a set of distinct shingles, whatever their order."""
    total = words.mix(np.array([np.add.reduce(words.mix(grams ^ np.uint64(0xA0761D6478BD642F))) + np.uint64(len(grams))], dtype=np.uint64))
    return int(total.view(np.int64)[0])


def sets_of(texts: pd.Series, n: int = SHINGLE) -> Iterator[np.ndarray]:
    for _, run in words.pieces(texts):
        for grams in words.text_grams(*words.word_hashes(run), n):
            yield np.unique(grams)


def embedded(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(set_hash(g), min_hashes(g).tobytes(), len(g)) if len(g) else (None, None, 0) for g in sets_of(pdf["text"], n)]
        out = pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"]})
        out["sid"] = pd.array([r[0] for r in rows], dtype="Int64")
        out["sig"] = [r[1] for r in rows]
        out["shingles"] = [r[2] for r in rows]
        yield out


def split(node: np.ndarray, rows: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes: one sampled token each, and one more with the probability that is missing to 1 / threshold."""
    found = []
    for pick in (0, 1):
        draw = words.mix(node + np.uint64(0x632BE59BD9B4E019 + pick))
        keep = slice(None) if pick == 0 else (draw >> np.uint64(11)).astype(np.float64) / float(1 << 53) < 1 / threshold - 1
        at = (words.mix(draw) % np.uint64(COORDINATES))[keep]
        token = signatures[rows[keep], at.astype(np.int64)].astype(np.uint64)
        found.append((words.mix(draw[keep] ^ ((at << np.uint64(16)) + token)), rows[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def as_signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(len(column), COORDINATES)


def headed(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``sid, rep, apart`` of the sets that walk under the name of a head ``rep``, at that distance from it.

    Heads are an aggregation with partial sums, and joined by broadcast up to a count: no task holds a band.
    """
    bands = [F.xxhash64(F.lit(b), F.substring("sig", 2 * BAND * b + 1, 2 * BAND)) for b in range(BANDS)]
    at = sets.select("sid", "sig", F.explode(F.array(*bands)).alias("band"))
    crowds = scratch.written(at.groupBy("band").agg(F.count("*").alias("n"), F.min("sid").alias("rep")).filter(F.col("n") >= CROWD), "crowds")
    few = F.broadcast(crowds) if crowds.count() <= BROADCAST_CENTRES else crowds
    heads = sets.select(F.col("sid").alias("rep"), F.col("sig").alias("head")).join(few, "rep").select("band", "rep", "head")
    heads = scratch.written(heads, "heads")
    few = F.broadcast(heads) if heads.count() <= BROADCAST_CENTRES else heads
    met = at.join(few, "band").filter("sid != rep").select("sid", "sig", "rep", "head").mapInPandas(near_heads, "sid long, rep long, apart double")
    return scratch.written(met.groupBy("sid").agg(F.min(F.struct("rep", "apart")).alias("r")).select("sid", "r.*"), "headed")


def near_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        apart = (as_signatures(pdf["sig"]) != as_signatures(pdf["head"])).mean(axis=1)
        yield pdf[["sid", "rep"]].assign(apart=apart)[apart <= NEAR]


def once(paths: pd.DataFrame, ids: np.ndarray, reps: np.ndarray) -> pd.DataFrame:
    """Paths of a batch without those that sets of one head share."""
    return paths.drop_duplicates() if (ids != reps).any() else paths


def first_paths(sets: DataFrame, runs: range, threshold: float) -> DataFrame:
    """``path, sid`` of all sets (``sid, sig, rep``), under the names of their heads; a path may come several times."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            signatures, ids, reps = as_signatures(pdf["sig"]), pdf["sid"].to_numpy(), pdf["rep"].to_numpy()
            for run in runs if len(pdf) else ():
                rows = np.arange(len(pdf))
                node = words.mix(np.full(len(pdf), run + 1, dtype=np.uint64))
                for _ in range(FIRST_DEPTH):
                    node, rows = split(node, rows, signatures, threshold)
                yield once(pd.DataFrame({"path": node.view(np.int64), "sid": reps[rows]}), ids, reps)

    return sets.select("sid", "sig", "rep").mapInPandas(walk, "path long, sid long")


def further(rows: DataFrame, threshold: float) -> DataFrame:
    """One step of large buckets: ``path, sid`` of sets that are split on, under the names of their heads, and ``hub, sid`` of sets that are linked at their centre.

    ``rows`` has ``path, rep, sid, sig`` and of the bucket's centre ``centre, hub``, null where there is none.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            signatures, ids, reps = as_signatures(pdf["sig"]), pdf["sid"].to_numpy(), pdf["rep"].to_numpy()
            node = pdf["path"].to_numpy().view(np.uint64)
            far = np.ones(len(pdf))
            central = np.flatnonzero(pdf["hub"].notna().to_numpy())
            if len(central):
                far[central] = (signatures[central] != as_signatures(pdf["centre"].iloc[central])).mean(axis=1)
                linked = central[far[central] <= CLOSE + REACH]
                yield pd.DataFrame({"path": pd.array([None] * len(linked), dtype="Int64"), "hub": pdf["hub"].iloc[linked].astype("Int64").to_numpy(), "sid": ids[linked]})
            rows = np.flatnonzero(far > CLOSE)
            node = node[rows]
            for _ in range(STEP):
                node, rows = split(node, rows, signatures, threshold)
            paths = once(pd.DataFrame({"path": node.view(np.int64), "sid": reps[rows]}), ids, reps)
            yield pd.DataFrame({"path": paths["path"].astype("Int64"), "hub": pd.array([None] * len(paths), dtype="Int64"), "sid": paths["sid"]})

    return rows.mapInPandas(walk, "path long, hub long, sid long")


def centre_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The centre of a bucket's sample, if most of the sample is close to it, and the least close set as its ``hub``."""
    signatures = as_signatures(pdf["sig"])
    centre = np.empty(COORDINATES, dtype="<u2")
    for k in range(COORDINATES):
        tokens, times = np.unique(signatures[:, k], return_counts=True)
        centre[k] = tokens[times.argmax()]
    close = (signatures != centre).mean(axis=1) <= CLOSE
    some = 2 * close.sum() > len(pdf)
    return pd.DataFrame({"path": pdf["path"].iloc[:1], "centre": [centre.tobytes()], "hub": [pdf["sid"][close].min()]})[: int(some)]


def centres(large: DataFrame, sets: DataFrame, number: int) -> DataFrame:
    """``path, centre, hub`` of the ``number`` large buckets (``path, sid, n``) whose sets agree."""
    drawn = large.filter(F.pmod(F.xxhash64("sid", "path"), F.lit(1 << 30)) * F.col("n") < F.lit(CENTRE_SAMPLE << 30))
    drawn = F.broadcast(drawn) if number * CENTRE_SAMPLE <= BROADCAST_SETS else drawn
    return drawn.join(sets.select("sid", "sig"), "sid").select("path", "sid", "sig").groupBy("path").applyInPandas(centre_of, "path long, centre binary, hub long")


def forest(ids: np.ndarray, signatures: np.ndarray, reach: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a bucket that agree in a share of ``least`` min-hashes or more, less the reach of both."""
    free, edges = np.ones(len(ids), dtype=bool), []
    agreeing = agreement(signatures, reach, free, least)
    for root in range(len(ids)):
        reached = [root] if free[root] else []
        free[root] = False
        while reached:
            i = reached.pop()
            near = agreeing(i)
            free[near] = False
            edges += [(int(ids[i]), int(ids[j])) for j in near]
            reached += near.tolist()
    return edges


def agreement(signatures: np.ndarray, reach: np.ndarray, free: np.ndarray, least: float) -> Callable[[int], np.ndarray]:
    """What gives the sets still ``free`` that agree with a set; beyond ``MATRIX`` sets only those are compared, a set at a time."""
    if len(signatures) <= MATRIX:
        agree = (signatures[:, None, :] == signatures[None, :, :]).mean(axis=2) + reach[:, None] + reach[None, :] >= least
        return lambda i: np.flatnonzero(agree[i] & free)
    at, columns = np.arange(len(signatures)), np.ascontiguousarray(signatures.T)

    def agreeing(i: int) -> np.ndarray:
        nonlocal at, columns
        some = free[at]
        if 2 * np.count_nonzero(some) < len(at):
            at, columns, some = at[some], np.ascontiguousarray(columns[:, some]), some[some]
        share = (columns == signatures[i][:, None]).view(np.uint8).sum(axis=0, dtype=np.uint8) / COORDINATES
        return at[(share + reach[i] + reach[at] >= least) & some]

    return agreeing


def bucket_edges(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Edges of one bucket after another, from batches in the order of buckets; a bucket may lie in two batches."""
    left = None
    for pdf in batches:
        pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        cut = np.flatnonzero(np.diff(pdf["bucket"].to_numpy(), prepend=~pdf["bucket"].iloc[0])) if len(pdf) else np.array([0])
        left = pdf.iloc[cut[-1] :]
        yield edges_of(pdf.iloc[: cut[-1]], cut, least)
    if left is not None:
        yield edges_of(left, np.array([0, len(left)]), least)


def edges_of(pdf: pd.DataFrame, cut: np.ndarray, least: float) -> pd.DataFrame:
    ids, signatures, reach = pdf["sid"].to_numpy(), as_signatures(pdf["sig"]), pdf["reach"].to_numpy()
    found = [edge for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) for edge in forest(ids[a:b], signatures[a:b], reach[a:b], least)]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


class Scratch:
    """Written tables of a join that go when it is done."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(support.written(df, name))
        return self.tables[-1]

    def drop(self, *kept: DataFrame) -> None:
        support.drop_written(*[t for t in self.tables if not any(t is k for k in kept)])
        self.tables = [t for t in self.tables if any(t is k for k in kept)]


def bucketed(taking: DataFrame, sets: DataFrame, runs: range, depth: int, threshold: float, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame], DataFrame | None]:
    """Small buckets, links at centres, and the names of what was split beyond ``depth``, if any, in runs of the sets ``taking``."""
    paths = scratch.written(first_paths(taking, runs, threshold), "paths")
    small, linked, deep, at = [], [], [], FIRST_DEPTH
    while True:
        sizes = scratch.written(paths.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        few, many = sizes.filter(F.col("n") <= SMALL).select("path"), sizes.filter(F.col("n") > SMALL).select("path")
        number = many.count()
        if number:  # a head's path may have come from several batches
            met = scratch.written(paths.join(F.broadcast(many) if number <= BROADCAST_CENTRES else many, "path").distinct(), "large")
            again = scratch.written(met.groupBy("path").agg(F.count("*").alias("n")), "sizes")
            few, many = few.union(again.filter(F.col("n") <= SMALL).select("path")), again.filter(F.col("n") > SMALL)
            number, total = many.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        sets_of_path = paths.join(few, "path").groupBy("path").agg(F.sort_array(F.collect_set("sid")).alias("m"))
        small.append(scratch.written(sets_of_path.select("m").filter(F.size("m") > 1), "buckets"))
        if not number:
            break
        large = met.join(F.broadcast(many) if number <= BROADCAST_CENTRES else many, "path")
        hubs = scratch.written(centres(large, sets, number), "centres")
        few_hubs = F.broadcast(hubs) if hubs.count() <= BROADCAST_CENTRES else hubs
        named = large.select("path", F.col("sid").alias("rep"))
        rows = taking.select("rep", "sid", "sig").join(F.broadcast(named) if total <= BROADCAST_SETS else named, "rep").join(few_hubs, "path", "left")
        rows = rows.select("path", "rep", "sid", "sig", "centre", "hub")
        steps = scratch.written(further(rows, threshold), "steps")
        linked.append(steps.filter("hub IS NOT NULL").select(F.col("hub").alias("a"), F.col("sid").alias("b")))
        paths, at = steps.filter("path IS NOT NULL").select("path", "sid"), at + STEP
        if at > depth:
            deep.append(paths.select("sid"))
    if not deep:
        return small, linked, None
    every = deep[0]
    for more in deep[1:]:
        every = every.union(more)
    return small, linked, scratch.written(every.distinct(), "deep")


def candidate_edges(sets: DataFrame, threshold: float, recall: float, scratch: Scratch) -> DataFrame:
    """Pairs of set ids that may be similar, each linked group connected."""
    heads = headed(sets, scratch)
    known = F.broadcast(heads) if heads.count() <= BROADCAST_SETS else heads
    named = sets.select("sid", "sig").join(known.select("sid", "rep"), "sid", "left").select("sid", "sig", F.coalesce("rep", "sid").alias("rep"))
    small, linked, taking = [], [heads.select(F.col("rep").alias("a"), F.col("sid").alias("b"))], named
    for depth, runs in runs_of(recall, threshold):
        buckets, links, deep = bucketed(taking, sets, runs, depth, threshold, scratch)
        small, linked = small + buckets, linked + links
        if deep is None:
            break
        taking = scratch.written(named.join(deep.select(F.col("sid").alias("rep")), "rep", "left_semi").select("sid", "sig", "rep"), "deep-sets")
    else:
        if deep.limit(1).count():
            raise RuntimeError(f"buckets were split beyond {DEPTHS[-1]} times")
    buckets = small[0]
    for more in small[1:]:
        buckets = buckets.union(more)
    reach = known.groupBy(F.col("rep").alias("sid")).agg(F.max("apart").alias("reach"))
    compared = sets.select("sid", "sig").join(reach, "sid", "left").select("sid", "sig", F.coalesce("reach", F.lit(0.0)).alias("reach"))
    members = buckets.distinct().select(F.xxhash64("m").alias("bucket"), F.explode("m").alias("sid")).join(compared, "sid")
    members = members.repartition("bucket").sortWithinPartitions("bucket", "sid")
    edges = members.mapInPandas(lambda batches: bucket_edges(batches, threshold - MARGIN), "a long, b long")
    for more in linked:
        edges = edges.union(more)
    return edges


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every set of ``right`` (or of ``left``)."""
    every = left if right is None else left + right
    if len(every) <= 6:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in (left if right is None else right)] for a in left]).reshape(len(left), -1)
    tokens, row = np.concatenate(every), np.repeat(np.arange(len(every)), [len(g) for g in every])
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    number = np.cumsum(np.concatenate([[0], tokens[1:] != tokens[:-1]]))
    shared = np.bincount(number)[number] > 1  # a token of one set counts in no intersection
    row, number = row[shared], number[shared]
    number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]])) if len(number) else number
    total, width = np.zeros((len(left), len(every) - (0 if right is None else len(left))), dtype=np.float64), 4096
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [at, at + width])
        part = np.zeros((len(every), width), dtype=np.float32)
        part[row[a:b], number[a:b] - at] = 1
        total += part[: len(left)] @ (part if right is None else part[len(left) :]).T
    return np.rint(total).astype(np.int64)


def tile_links(ids: np.ndarray, copies: np.ndarray, block: np.ndarray, sets: list[np.ndarray], first: int, second: int, threshold: float) -> pd.DataFrame:
    """For the sets of a tile: copies that they are linked to, and the least set of their tile component."""
    left = np.flatnonzero(block == first)
    right = left if first == second else np.flatnonzero(block == second)
    sizes = np.array([len(g) for g in sets])
    shared = overlaps([sets[i] for i in left], None if first == second else [sets[i] for i in right])
    linked = shared >= threshold * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-9
    if first == second:
        np.fill_diagonal(linked, False)
    links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    np.add.at(links, left, linked @ copies[right])
    if first != second:
        np.add.at(links, right, linked.T @ copies[left])

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = top(left[i]), top(right[j])
        if a != b:
            root[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return pd.DataFrame({"sid": ids, "links": links, "root": ids[[top(i) for i in range(len(ids))]]})


def checked(batches: Iterator[pd.DataFrame], threshold: float, n: int) -> Iterator[pd.DataFrame]:
    """Runs of rows of one tile after another, in the order of tiles."""
    key, held = None, {}

    def finished() -> pd.DataFrame:
        ids = np.array(list(held), dtype=np.int64)
        copies, block, sets = (list(x) for x in zip(*held.values(), strict=True))
        return tile_links(ids, np.array(copies), np.array(block), sets, key[1], key[2], threshold)

    for pdf in batches:
        for row, grams in zip(pdf.itertuples(index=False), sets_of(pdf["text"], n), strict=True):
            if (row.comp, row.first, row.second) != key:
                if held:
                    yield finished()
                key, held = (row.comp, row.first, row.second), {}
            held[row.sid] = (row.copies, row.block, grams)
    if held:
        yield finished()


def join(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, is_kept`` for every row, and ``text_hash`` (xxhash64 of the text).

    A link joins two rows whose sets of ``shingle``-word shingles have a Jaccard similarity of
    ``threshold`` or more; ``n_links`` counts the rows a row is linked to, copies included;
    ``class_id`` is the least id of its connected component, and ``is_kept`` marks the rows with
    that id and the text that stands for the component.

    A text of fewer words has one shingle, of all its words. Null texts and texts without words
    have no links and are classes of their own; null ids are rows like others, but no component is
    named after them unless it has no other; repeated rows are links of each other; very long texts
    are taken whole; an empty table gives an empty table; other columns are not read.
    """
    support.short_batches(df.sparkSession)
    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("th", F.xxhash64("text"))
    docs = support.written(texts.mapInPandas(lambda batches: embedded(batches, shingle), "doc_id long, th long, sid long, sig binary, shingles long"), "documents")
    sets = support.written(docs.filter("sid IS NOT NULL").groupBy("sid").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep"), F.first("sig").alias("sig"), F.first("shingles").alias("shingles")), "sets")
    scratch = Scratch()
    groups = graph.components(candidate_edges(sets, threshold, recall, scratch))
    grouped = scratch.written(sets.join(groups, sets["sid"] == groups["node"]).select("sid", "copies", "rep", "shingles", F.col("label").alias("comp")), "grouped")
    # Blocks of sets and of shingles that a tile can hold.
    number = F.ceil(F.greatest(F.count("*") / TILE, F.sum("shingles") / TILE_SHINGLES)).cast("int")
    members = grouped.join(grouped.groupBy("comp").agg(number.alias("blocks")), "comp")
    members = members.select("sid", "copies", "comp", "blocks", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"), F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th"))
    members = support.written(members, "members")
    side = F.broadcast(members) if members.count() <= BROADCAST_SETS else members
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("first"), F.greatest("block", j).alias("second")))
    found = texts.join(side, (F.col("th") == F.col("r_th")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
    tiles = found.select("sid", "copies", "comp", "block", "text", F.explode(sides).alias("t")).select("comp", "t.first", "t.second", "sid", "copies", "block", "text")
    tiles = tiles.repartition("comp", "first", "second").sortWithinPartitions("comp", "first", "second")
    links = support.written(tiles.mapInPandas(lambda batches: checked(batches, threshold, shingle), "sid long, links long, root long"), "links")
    classes = graph.components(links.filter("sid != root").select(F.col("root").alias("a"), F.col("sid").alias("b")))
    counted = links.groupBy("sid").agg(F.sum("links").alias("links"))
    known = sets.select("sid", "copies", "rep").join(counted, "sid", "left").join(classes.withColumnRenamed("node", "sid"), "sid", "left")
    scratch.drop()
    known = support.written(known.select("sid", "rep", F.coalesce("label", "sid").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    named = known.groupBy("class").agg(F.min("rep").alias("kept"))
    known = known.join(named, "class").select("sid", "n_links", "kept")
    out = docs.select("doc_id", "th", "sid").join(known, "sid", "left")
    alone = F.col("kept").isNull()
    return out.select(
        "doc_id",
        F.col("th").alias("text_hash"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("kept.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | (F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.th") == F.col("th")))).alias("is_kept"),
    )


def deduplicate(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without all but one row of each linked component.

    The row that stays has the component's least id; of repeated rows one stays. Texts without words
    are no component and all stay. Rows that go are found by id and hash of the text; their table is
    broadcast while it has at most ``BROADCAST_SETS`` rows, and joined by a shuffle beyond.
    """
    flags = support.written(join(df, id_column, text_column, **options), "flags")
    key = ["doc_id", "text_hash"]
    gone = flags.filter("NOT is_kept").select(*key).distinct()
    twins = flags.filter("is_kept AND n_links > 0").groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    bounded = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_SETS else rows
    same = lambda rows: F.xxhash64(text_column).eqNullSafe(rows["text_hash"]) & df[id_column].cast("long").eqNullSafe(rows["doc_id"])
    gone, twins = bounded(support.written(gone, "gone")), bounded(support.written(twins, "twins"))
    left = df.join(gone, same(gone), "left_anti")
    digest = support.fresh(df, "digest")
    once = left.join(twins, same(twins), "left_semi").withColumn(digest, F.xxhash64(text_column)).dropDuplicates([id_column, digest]).drop(digest)
    return left.join(twins, same(twins), "left_anti").unionByName(once)


def op7(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents."""
    return join(support.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
