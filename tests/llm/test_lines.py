import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinroster.llm import lines
from kinroster.llm.lines import Cuckoo, LineIndex

from .common import DOCS, frame, odd_documents, table

UPPER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows):
    """(doc, lines, dropped, kept) of each row; a missing id is the greatest."""
    ids = [lines.NO_ID if d is None else d for d, _ in rows]
    holders = {}
    for d, (_, text) in zip(ids, rows, strict=True):
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = []
    for d, (given, text) in zip(ids, rows, strict=True):
        every = (text or "").split("\n")
        kept = [x for x in every if len(key(x)) < 10 or min(holders[key(x)]) == d]
        out.append((given, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=repr)


def keys(n, salt=""):
    return pd.Series([hashlib.sha256(f"{salt}{i}".encode()).digest()[:16] for i in range(n)])


def test_cuckoo_filter():
    held, mine, other = Cuckoo(buckets=1 << 10), keys(3600), keys(20_000, "x")
    assert held.insert(mine) and held.contains(mine).all()
    assert held.contains(other).mean() < 0.002
    held.remove(mine[:1800])
    assert held.contains(mine[1800:]).all() and held.contains(mine[:1800]).mean() < 0.01
    assert np.count_nonzero(held.slots) == 1800
    again = Cuckoo(held.slots.tobytes())
    again.remove(mine[1800:])
    assert not again.slots.any()
    with pytest.raises(ValueError):
        again.remove(mine[:1])
    assert not Cuckoo(buckets=1 << 4).insert(keys(65))  # more than it has slots
    assert Cuckoo().insert(keys(0)) and len(Cuckoo().contains(keys(0))) == 0


SHARED = ["All rights reserved.", "  all RIGHTS reserved.\t", "short", "", "Ärger über alles hier", "ärger über alles hier", "Subscribe to our newsletter"]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return ["\n".join(SHARED[rng.integers(len(SHARED))] if rng.random() < 0.5 else f"line number {rng.integers(60)} of a text" for _ in range(rng.integers(1, 8))) for _ in range(n)]


def test_what_is_inserted_and_deleted(spark, monkeypatch):
    """After any steps the index says what brute force says of the documents that are left; small filters grow."""
    monkeypatch.setattr(lines, "BUCKETS", 8)
    rows = list(enumerate(texts(120, 1)))
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = LineIndex(spark).insert(make(rows[40:80]))
    index.insert(make(rows[:40]))
    assert rows_of(index.deduplicated(make(rows[:80]))) == brute(rows[:80])
    index.delete(make([r for r in rows[:80] if r[0] % 3 == 0] + [(10_000, None)]))
    left = [r for r in rows[:80] if r[0] % 3]
    assert rows_of(index.deduplicated(make(left))) == brute(left)
    index = LineIndex(spark, index.path)  # as another session finds it
    assert index.number == 3
    index.insert(make([r for r in rows if r[0] % 3 == 0 or r[0] >= 80])).compact()
    assert rows_of(index.deduplicated(make(rows))) == brute(rows)
    counted = {r["key"]: r["n"] for r in index.counts().collect()}
    held = {}
    for _, text in rows:
        for k in {key(x) for x in text.split("\n") if len(key(x)) >= 10}:
            k = hashlib.sha256(k.encode()).digest()[:16]
            held[k] = held.get(k, 0) + 1
    assert {bytes(k): n for k, n in counted.items()} == held and index.state["keys"] == len(held) and index.state["references"] == sum(held.values())
    index.delete(make(rows))
    assert index.counts().count() == 0 and index.references().count() == 0 and index.state["keys"] == 0
    assert not any(np.frombuffer(bytes(r["slots"]), dtype="<u2").any() for r in index.filters().collect())
    index.drop()


def test_false_positives_of_filters_fall_out(spark, monkeypatch):
    monkeypatch.setattr(Cuckoo, "contains", lambda self, keys: np.ones(len(keys), dtype=bool))
    rows = list(enumerate(texts(60, 2)))
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = LineIndex(spark).insert(make(rows[::2])).insert(make(rows[1::2]))
    assert rows_of(index.deduplicated(make(rows))) == brute(rows)
    assert index.state["keys"] == index.counts().count()


def test_two_writers(spark):
    one = LineIndex(spark).insert(spark.createDataFrame([(1, "a line of one document")], "doc_id long, text string"))
    two = LineIndex(spark, one.path)
    one.delete(spark.createDataFrame([(1,)], "doc_id long"))
    with pytest.raises(RuntimeError):
        two.insert(spark.createDataFrame([(2, "a line of one document")], "doc_id long, text string"))
    assert LineIndex(spark, one.path).counts().count() == 0


def test_hot_lines_and_cold_ones(spark, monkeypatch):
    """A line of every document is joined apart from the others."""
    monkeypatch.setattr(lines, "HOT_SHARE", 0.05)
    rows = [(i, f"a line of all documents\nline of two documents {i // 2}\nline of one document {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(LineIndex(spark).insert(docs).deduplicated(docs)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [*odd_documents(), (20, "\n\nsame line here\n\nSAME LINE HERE  \nx\n", "en", "a", 1), (21, "same line here", "en", "a", 1), (22, "w" * 3_000_000 + "\n" + "same line here\n" * 1000, "en", "a", 1), (23, " same line here", "en", "a", 1)]
    where = table(spark, tmp_path, "documents", rows, DOCS)
    out = lines.op13(spark, where).collect()
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute([(r[0], r[1]) for r in rows])]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], DOCS)
    index = LineIndex(spark).insert(empty)
    assert index.deduplicated(empty).count() == 0 and index.delete(empty).counts().count() == 0


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "one line of text", "k", "d", 5, "q`r"), (2, "one line of text", "k", "d", 6, "q`r")], "doc_id long, text string, key string, doc string, n_lines int, `a``b` string")
    out = LineIndex(spark).insert(docs).deduplicated(docs)
    assert out.columns == ["doc_id", "text", "key", "doc", "a`b", "n_lines", "n_dropped", "kept"]
    assert [(r["key"], r["n_dropped"]) for r in out.orderBy("doc_id").collect()] == [("k", 0), ("k", 1)]
    assert frame(out)["a`b"].tolist() == ["q`r"] * 2


def test_keys_of_both_engines_agree(spark):
    given = ["  ÄB c\t", "İSTANBUL ZZ", "\x0b\x0ctabs\r", " em", "ß A"]
    out = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string").select("i", lines.digest(lines.key_of(F.col("g"))).alias("d")).orderBy("i").collect()
    assert [bytes(r["d"]) for r in out] == [hashlib.sha256(g.encode().strip(lines.SPACE.encode()).lower()).digest()[:16] for g in given]
