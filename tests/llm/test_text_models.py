import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinroster.llm import kneser_ney, toxicity, words

from .common import DOCS, frame, odd_documents, table
from .common import words as plain

SF = "/root/testdata/sf0.01"


def test_word_hashes_follow_the_pattern():
    texts = ["a b  a", None, "", " \t\n", "x" * 9000 + " y", "é\xa0ü ſ", "b a", "a\x1cb a\x0bb"]
    seen = {}
    for first, run in words.pieces(texts, size=100):
        hashes, offsets = words.word_hashes(run)
        for i, text in enumerate(texts[first : first + len(run)]):
            own = hashes[offsets[i] : offsets[i + 1]].tolist()
            assert len(own) == len(plain(text))
            for h, w in zip(own, plain(text), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def brute_model(training, order=3):
    """Interpolated modified Kneser-Ney from dictionaries: counts at the highest order, distinct predecessors below."""
    pad = ["<s>"] * (order - 1)
    counts = {order: Counter(tuple(x) for t in training for x in zip(*([*pad, *t][k:] for k in range(order)), strict=False))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {k: kneser_ney.discounts([Counter(c.values())[x] for x in (1, 2, 3, 4)]) for k, c in counts.items()}
    total, rest = ({k: Counter() for k in counts} for _ in range(2))
    for k, c in counts.items():
        for g, n in c.items():
            total[k][g[:-1]] += n
            rest[k][g[:-1]] += off[k][min(n, 3) - 1]
    single = Counter(w for t in training for w in t)

    def chance(gram):
        k = len(gram)
        if not k:
            return 1 / (len(single) + 1)
        seen = total[k][gram[:-1]]
        if not seen:
            return chance(gram[1:])
        n, d = counts[k][gram], [0, *off[k]]
        return (max(n - d[min(n, 3)], 0) + rest[k][gram[:-1]] * chance(gram[1:])) / seen

    return single, chance


def tokens(text):
    return [*plain(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def check_scores(out, texts, kept, order=3):
    single, chance = brute_model([tokens(texts[i]) for i in kept], order)
    total, size, pad = sum(single.values()), len(single), ["<s>"] * (order - 1)
    for start in (pad, [*pad, "the"][1:], ["no such word"] * (order - 1)):
        assert sum(chance((*start, w)) for w in single) + chance((*start, "no such word")) == pytest.approx(1)
    for r in out.itertuples():
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(own), sum(w in single for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((single[w] + 1) / ((total + 1) * (size + 1))) for w in own))
        assert r.score == pytest.approx(sum(math.log10(chance(tuple([*pad, *own][i : i + order]))) for i in range(len(own))))
    return total


def test_kneser_ney_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = frame(kneser_ney.op4(spark, "/root/testdata/sf0.001"))
    kept = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    total = check_scores(out, texts, kept)
    assert set(out.train_tokens) == {total} and out.held_out.tolist() == [i not in kept for i in out.doc_id]


@pytest.mark.parametrize(("order", "shard_bytes"), [(2, 1 << 30), (2, 300), (3, 300), (4, 1000)])
def test_kneser_ney_of_any_order_in_many_shards(spark, order, shard_bytes):
    rng = random.Random(order)
    texts = {i: " ".join(rng.choice(["the", "the", "the", "a", *"bcdefgh", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(40))) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    layout = kneser_ney.train(df.filter("doc_id < 60"), order=order, shard_bytes=shard_bytes)
    assert (layout.shards > 1) == (shard_bytes < 1 << 20) and len(layout.frequent) > (layout.shards > 1)
    check_scores(frame(kneser_ney.score(df, layout)), texts, range(60), order)


def test_kneser_ney_counts_are_whole(spark):
    """Counts beyond a byte and beyond 32 bits, and blobs of them."""
    key = np.array([3, 3, 9], dtype=np.uint64)
    blob = kneser_ney.packed(key, np.array([5, 6, 7]), np.array([1, 300, 1 << 40]))
    assert [x.tolist() for x in kneser_ney.merged([blob, blob])] == [[3, 3, 9], [5, 6, 7], [2, 600, 1 << 41]]
    few, big = kneser_ney.with_big(np.array([1, 254, 255, 1 << 40]))
    assert few.tolist() == [1, 254, 255, 255] and big.tolist() == [[2, 255], [3, 1 << 40]]
    for bits in (1, 5, 33, 44, 64):
        x = np.random.default_rng(bits).integers(0, 1 << bits, 200, dtype=np.uint64)
        assert (kneser_ney.permuted(kneser_ney.permuted(x, bits), bits, back=True) == x).all()
    df = spark.createDataFrame([(i, "a b c " * 400) for i in range(3)], "doc_id long, text string")
    out = frame(kneser_ney.score(df, kneser_ney.train(df)))
    check_scores(out, {i: "a b c " * 400 for i in range(3)}, range(3))


def test_kneser_ney_of_odd_documents(spark, tmp_path):
    rows = odd_documents()
    out = frame(kneser_ney.op4(spark, table(spark, tmp_path, "documents", rows, DOCS)))
    assert len(out) == len(rows) and np.isfinite(out.score).all() and (out.n_tokens >= 1).all()
    empty = kneser_ney.train(spark.createDataFrame([], DOCS))
    assert kneser_ney.score(spark.createDataFrame([], DOCS), empty).count() == 0
    assert frame(kneser_ney.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty)).score.tolist() == [0.0]


def test_toxicity_on_held_out_labels(spark):
    out = frame(toxicity.op3(spark, SF)).set_index("doc_id")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.index]
    assert ((0 <= out.score) & (out.score <= 1)).all() and (out.predicted == (out.score >= 0.7)).all()
    held = [i for i in labels if out.held_out[i]]
    toxic, clean = ([out.score[i] for i in held if labels[i] == y] for y in (1, 0))
    assert np.mean([a > b or 0.5 * (a == b) for a in toxic for b in clean]) > 0.85  # some labels are wrong
    assert np.mean([s >= 0.7 for s in clean]) < 0.05


def grams(text, window):
    """The n-grams of each window of a text, by the definition."""
    data = f" {text} ".lower().encode()
    return [{data[at:][:window + 5][i : i + n] for n in toxicity.ORDERS for i in range(len(data[at:][: window + 5]) - n + 1)} for at in range(0, max(len(data) - 5, 1), window)]


def test_features_and_ratios_follow_their_definitions():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["idiot", "moron", "the", "sea", "Ö", "a"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    labels = np.array([int("idiot" in t) for t in texts])
    one = toxicity.Buckets(window=64)
    bucket = lambda gram: int(toxicity.Buckets(orders=(len(gram),)).distinct(np.frombuffer(gram, dtype=np.uint8).astype(np.uint32))[0])
    for t in texts:
        assert [set(w.tolist()) for w in one(t)] == [{bucket(g) for g in w} for w in grams(t, 64)]
    rows = [one(t)[0] for t in texts]
    got = toxicity.log_count_ratios(rows, labels, 1 << toxicity.BITS, prior=2.0, least=1.0)
    share = labels.mean()
    for b in set(np.concatenate(rows).tolist()):
        ones, zeros = (sum(b in set(r.tolist()) for r, y in zip(rows, labels, strict=True) if y == v) for v in (1, 0))
        p, q = ((c + 2.0 * s) / (s * (len(rows) + 2.0)) for c, s in ((ones, share), (zeros, 1 - share)))
        evidence = 2 * sum(c * math.log(c / ((ones + zeros) * s)) for c, s in ((ones, share), (zeros, 1 - share)) if c)
        assert got[b] == pytest.approx(math.log(p / q) if evidence >= 1.0 else 0.0)
    model = toxicity.Model(got.astype(np.float32), -0.3)
    for t in texts:
        margin = max(sum(float(got[bucket_]) for bucket_ in {bucket(g) for g in w}) for w in grams(t, 64)) - 0.3
        assert model.score(one(t)) == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-4)


def test_the_sample_is_bounded_whatever_the_lengths(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"bad text {i} " * (400 if i % 2 else 1)) for i in range(40)] + [(0, "again")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "reduce", lambda f, parts: seen.append(parts) or parts[0] | parts[1])
    toxicity.train(df, labels, most_bytes=(9000, 9000))
    sizes = [[r[0] for r in df.distinct().join(labels, "doc_id").filter(F.col("toxic") == y).withColumn("y", F.col("toxic")).withColumn("h", F.xxhash64("doc_id", "text")).filter(part).select(F.octet_length("text")).collect()] for y, part in zip((1, 0), seen[0], strict=True)]
    assert all(1 <= len(s) < 20 and sum(s) - max(s) <= 9000 for s in sizes) and any(max(s) > 4000 for s in sizes)


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices(["tion", "ea", "th", "in", "or", "er", "an"], k=rng.randrange(1, 4))) for _ in range(n))
    bad, good = [(i, f"{prose(rng.randrange(1500))} idiot moron {prose(1500)}") for i in range(60)], [(100 + i, prose(rng.choice((80, 2000)))) for i in range(120)]
    assert min(len(t) for _, t in bad) > toxicity.WINDOW + 8
    df = spark.createDataFrame(bad + good, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in bad + good], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    odd = [(1, f"{prose(40)} idiot moron {prose(40)}"), (2, f"{prose(4000)} idiot moron {prose(4000)}"), (3, prose(80)), (4, prose(8000))]
    scores = frame(toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model)).score
    assert min(scores[:2]) >= 0.7 > max(scores[2:])
    assert toxicity.without_toxic(df, model).count() == 120


def test_toxicity_ignores_length_and_handles_odd_rows(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices(["tion", "ea", "th", "in", "or", "er", "an"], k=rng.randrange(1, 4))) for _ in range(n))
    bad, good = [(i, f"{prose(40)} idiot {prose(40)} moron") for i in range(60)], [(100 + i, prose(80)) for i in range(120)]
    df = spark.createDataFrame(bad + good, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good] + [(None, 1), (100, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    calm = prose(30_000)
    odd = [(1, None, "x"), (2, "", "x"), (3, calm, "x"), (4, f"{calm} idiot moron {calm}", "x"), (4, "th an IDIOT Moron", "x")]
    out = frame(toxicity.score(spark.createDataFrame(odd, "doc_id long, text string, score string"), model))
    assert out.columns.tolist() == ["doc_id", "text", "score"] and len(out) == 5
    assert out.score[0] == out.score[1] and out.score[2] < 0.7 <= min(out.score[3], out.score[4])
    assert toxicity.without_toxic(df, model).count() == 120
    nothing = toxicity.train(df, labels.filter("toxic = 0"))
    assert frame(toxicity.score(df, nothing)).score.tolist() == [0.5] * 180
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0
