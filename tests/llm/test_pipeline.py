import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinroster.llm import support, toxicity

from .common import DOCS, frame, odd_documents, table
from .common import words as plain
from .test_pairs import brute_links
from .test_sharding_mixing import fill

LABELS, BENCH = "doc_id long, quality int, toxic int", "item_id long, text string"
ITEM = "which river runs through the old town of brenn and why was its bridge closed the bridge was closed because the spring flood took two pillars"


def corpus(seed=4):
    """Prose in three sources, toxic documents, near copies and documents with a benchmark item; and their labels."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["tion", "ea", "th", "in", "or", "er", "an", "ul"], k=rng.randrange(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    texts, kinds = [], []
    for i in range(240):
        kind = ("toxic", "near", "leak", "clean", "clean", "clean")[i % 6]
        body = prose(rng.randrange(60, 120))
        if kind == "toxic":
            body[10:10] = ["idiot", "moron", "you", "idiot"]
        if kind == "leak":
            body[5:5] = ITEM.split()
        if kind == "near" and i > 20:
            body = plain(texts[i - 6 if i % 12 else 1])  # one of the near copies before it
            body[rng.randrange(len(body))] = f"changed{i}"
        texts.append(" ".join(body))
        kinds.append(kind)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    return rows, [(i, 1, int(k == "toxic")) for i, k in enumerate(kinds) if i % 4 != 3], kinds


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, labels, kinds = corpus()
    where = table(spark, tmp_path, "documents", rows, DOCS)
    table(spark, tmp_path, "labels", labels, LABELS)
    table(spark, tmp_path, "benchmark", [(1, ITEM), (2, "another question that no document of this corpus answers at all")], BENCH)
    docs, out = support.table(spark, where, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = support.written(stage(spark, docs, where), name)
        out.append(frame(docs))
        assert name == "shards" or docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    clean, unique, safe, mixed, dealt = out
    text = {i: t for i, t, *_ in rows}
    model = toxicity.train(support.table(spark, where, "documents"), support.table(spark, where, "labels"))
    buckets = toxicity.Buckets()
    assert sorted(clean.doc_id) == [i for i in text if model.score(buckets(text[i])) < 0.7]
    assert {kinds[i] for i in set(text) - set(clean.doc_id)} == {"toxic"} and len(clean) <= 205
    left = sorted(clean.doc_id)
    _, roots = brute_links([text[i] for i in left])
    assert sorted(unique.doc_id) == sorted({left[r] for r in roots}) and len(unique) < len(clean) - 20
    assert sorted(safe.doc_id) == [i for i in sorted(unique.doc_id) if ITEM not in text[i]] and len(safe) < len(unique) - 10
    sizes = Counter()
    for i in safe.doc_id:
        sizes[f"s{i % 3}"] += len(plain(text[i]))
    want = fill(dict(sizes), dict(zip(sorted(sizes), (5, 2, 1), strict=True)), 1.5 * sum(sizes.values()))
    taken = Counter()
    for i in mixed.doc_id:
        taken[f"s{i % 3}"] += len(plain(text[i]))
    assert set(mixed.doc_id) <= set(safe.doc_id) and max(Counter(mixed.doc_id).values()) <= 2
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert Counter(dealt.doc_id) == Counter(mixed.doc_id) and set(dealt["shard"]) <= set(range(24))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in dealt.groupby("shard"))
    total = dealt.groupby("shard").text.apply(lambda t: sum(len(x.encode()) + 8 for x in t))
    assert total.max() - total.min() <= 2 * max(len(t.encode()) + 8 for t in text.values())
    again = frame(corpus_pipeline.run(spark, where))
    assert Counter(again.doc_id) == Counter(dealt.doc_id)


def test_pipeline_of_odd_documents(spark, tmp_path):
    rows = [(*r, "mine", 7) for r in odd_documents()]
    where = table(spark, tmp_path, "documents", rows, DOCS + ", leaks string, _score int")
    table(spark, tmp_path, "labels", [(1, 1, 0), (2, None, 1), (None, 1, 1), (6, 1, 1), (8, 0, 0)], LABELS)
    table(spark, tmp_path, "benchmark", [(1, "hi"), (2, None), (None, "x"), (3, "")], BENCH)
    out = corpus_pipeline.run(spark, where)
    assert out.columns == [*(c.split()[0] for c in DOCS.split(", ")), "leaks", "_score", "shard", "slot"]
    got = out.collect()
    assert all((r["leaks"], r["_score"]) == ("mine", 7) for r in got) and not {r["text"] for r in got} & {"hi", None, ""}


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_of_empty_tables(spark, tmp_path, labelled):
    where = table(spark, tmp_path, "documents", [] if labelled else odd_documents(), DOCS)
    table(spark, tmp_path, "labels", [(1, 1, 1), (2, 1, 0)] if labelled else [], LABELS)
    table(spark, tmp_path, "benchmark", [(1, ITEM)] if labelled else [], BENCH)
    out = corpus_pipeline.run(spark, where)
    assert (out.count() == 0) == labelled
    assert out.filter(F.col("shard").isNull()).count() == 0
