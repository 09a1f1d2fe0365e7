import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinroster.llm import mixing, sharding

from .common import DOCS, frame, odd_documents, table, words


def test_packed_keys_sort_like_tuples():
    rng = np.random.default_rng(1)
    parts = [rng.integers(-(2**62), 2**62, 200) % m for m in (3, 5, 2**40)]
    parts = [p - 2 for p in parts]
    assert np.argsort(sharding.packed(*parts), kind="stable").tolist() == sorted(range(200), key=lambda i: tuple(p[i] for p in parts))


def test_odd_documents_are_all_dealt(spark, tmp_path):
    rows = odd_documents()
    out = frame(sharding.op1(spark, table(spark, tmp_path, "documents", rows, DOCS)))
    size = lambda t: len((t or "").encode()) + 8
    expected = Counter((i, size(t), None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows)
    none = lambda x: None if x != x or x is None else int(x)
    assert Counter((none(a), none(b), none(c)) for a, b, c in zip(out.doc_id, out["size"], out.text_crc32, strict=True)) == expected
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_shards_are_even_when_a_third_is_one_text(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"text number {i} " * (1 + i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = frame(sharding.shard(df, 8, tolerance=0.01).select("doc_id", "shard", "slot", (F.octet_length("text") + 8).alias("size")))
    totals = out.groupby("shard")["size"].sum()
    assert len(totals) == 8 and totals.max() - totals.min() <= 0.02 * totals.mean() + 2 * out["size"].max()
    assert sorted(out.doc_id) == list(range(3000))


def test_rows_that_are_equal_in_everything_are_split(spark):
    df = spark.createDataFrame([(None, "x" * 50)] * 800, "doc_id long, text string")
    out = frame(sharding.shard(df, 4).select("shard", "slot"))
    assert out.groupby("shard").size().between(190, 210).all()


def test_one_bucket_in_many_and_open_boundaries(spark, monkeypatch):
    rows = [(i, f"text {i % 900} " * (1 + i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, find = [], sharding.find_splitters
    monkeypatch.setattr(sharding, "find_splitters", lambda *a: seen.append(a[1]) or find(*a))
    out = frame(sharding.shard(df, 2, bucket_bytes=4).select("shard", "slot"))
    assert seen[0] > 2 * 4096 and len(out) == 2000  # the buckets are as many as the bytes need
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    monkeypatch.undo()
    with pytest.raises(RuntimeError):
        sharding.find_splitters(keyed(df), 500, 0.0, draws=1, most_rounds=1)


def keyed(df):
    a, b, c = sharding.KEY
    return df.select(F.xxhash64("text").alias(a), F.col("doc_id").alias(b), F.monotonically_increasing_id().alias(c), F.octet_length("text").cast("long").alias("_hs_size")).cache()


def test_shards_match_a_plain_sort(spark):
    """Brute force: sort by hash and id, cut where the running sum of bytes comes nearest to each share."""
    df = spark.createDataFrame([(i, f"text {i} " * (1 + i % 9)) for i in range(1500)], "doc_id long, text string")
    out = frame(sharding.shard(df, 6, tolerance=0.0).select("doc_id", "shard", "slot", (F.octet_length("text") + 8).alias("size"), F.xxhash64("text").alias("h")))
    out = out.sort_values(["h", "doc_id"]).reset_index(drop=True)
    assert out["shard"].is_monotonic_increasing
    upto = out["size"].cumsum().to_numpy()
    cuts = [int(np.argmin(np.abs(upto - upto[-1] * k / 6))) + 1 for k in range(1, 6)]
    assert [int((out["shard"] < k).sum()) for k in range(1, 6)] == cuts
    assert all(g.slot.tolist() == list(range(len(g))) for _, g in out.groupby("shard"))


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.shard(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", "mine", 9)], "doc_id long, text string, shard string, slot int")
    assert sharding.shard(clash, 2).columns == ["doc_id", "text", "shard", "slot"] and sharding.shard(clash, 2).first()["slot"] == 0
    mine = spark.createDataFrame([(1, "a b", "x", 9, 1.5, "z")], "doc_id long, text string, _hs_hash string, _hs_bucket int, `a.b` double, row string")
    assert sharding.shard(mine, 2).drop("shard", "slot").first() == mine.first()


def fill(sizes, weights, total, cap=2):
    """Water-filling by rounds."""
    out, open_ = {}, dict(sizes)
    while True:
        level = total / sum(weights[s] for s in open_) if open_ else 0
        full = [s for s in open_ if level * weights[s] > cap * sizes[s]]
        if not full:
            return out | {s: level * weights[s] for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
            total -= out[s]
            del open_[s]


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 500), min_size=1))
def test_budgets(spark, sizes):
    got = {r["_mix_source"]: r["target"] for r in mixing.budgets(spark.createDataFrame(list(sizes.items()), "_mix_source string, source_size long")).collect()}
    order = sorted(sizes)
    want = fill(sizes, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert got == pytest.approx(want)


def test_mix_comes_near_its_targets_and_can_be_repeated(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}{j}" for j in range(1 + i * 7 % 40)), "en", f"s{i % 5}" if i % 11 else None, 1) for i in range(600)]
    where = table(spark, tmp_path, "documents", rows, DOCS)
    out, again = frame(mixing.op2(spark, where)), frame(mixing.op2(spark, where))
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    out["source"] = [rows[i][3] or "~" for i in out.doc_id]
    assert (out["size"] == [len(words(rows[i][1])) for i in out.doc_id]).all() and (out.taken <= 2 * out["size"]).all() and (out.taken % out["size"] == 0).all()
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1e-6
        assert g.source_size.iloc[0] == g["size"].sum()


def test_mix_of_odd_documents(spark, tmp_path):
    rows = odd_documents()
    out = frame(mixing.op2(spark, table(spark, tmp_path, "documents", rows, DOCS)))
    assert len(out) == len(rows) and (out.taken[out["size"] == 0] == 0).all()
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a b c", "s", 5)], "doc_id long, text string, source string, taken int")
    assert mixing.mix(clash).columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]


def test_a_crowded_edge_is_cut_again(spark):
    rows = [(i % 40 if i % 3 else 7, "the same words again" if i % 3 == 0 else f"w{i} " * (1 + i % 4), "a" if i % 5 else "b") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    one, many = (frame(mixing.mix(df, edge_rows=n)) for n in (10**6, 3))
    totals = [x.groupby("source").agg({"taken": "sum", "target": "first"}) for x in (one, many)]
    assert all((abs(t.taken - t.target) <= 2).all() for t in totals)
    assert sorted(one.taken) == pytest.approx(sorted(many.taken), abs=4)


def test_mixture_keeps_columns_as_they_are(spark):
    df = spark.createDataFrame([(i, "some words here", "s", 5.5, "t", i) for i in range(9)], "doc_id long, text string, source string, size double, taken string, _mix_key int")
    out = mixing.mixture(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
    assert mixing.mixture(df.limit(0)).count() == 0


def test_mixture_repeats_rows(spark):
    df = spark.createDataFrame([(i, "some words here", f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    taken = frame(mixing.mix(df)).set_index("doc_id")
    counts = Counter(r["doc_id"] for r in mixing.mixture(df).collect())
    assert all(counts[i] == taken.taken[i] // taken["size"][i] for i in range(40))
