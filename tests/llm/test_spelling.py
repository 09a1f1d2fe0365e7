import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinroster.llm import spelling

from .common import DOCS, odd_documents, table


def near(a, b):
    """By the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio=10):
    """{word: (form, root, n, n_near, form_n)} from {word: n}."""
    usable = [w for w in n if len(w) >= 3]
    found = {w: [v for v in usable if near(w, v)] for w in usable}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(found.get(w, ())), n[form[w]] if w in form else None)
    return out


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def edited(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    return word[:i] + rng.choice(letters) + word[i + (kind == 0) :] if kind < 2 else word[:i] + word[i + 1 :]


def vocabulary(seed, size, letters, lengths):
    rng = random.Random(seed)
    n = {}
    while len(n) < size:
        word = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        n[word] = rng.choice([2, 3, 40, 500])
        for _ in range(rng.randrange(4)):
            word = edited(rng, word, letters)
            n.setdefault(word, rng.choice([1, 2, 5, 60]))
    return n


@pytest.mark.parametrize(("letters", "lengths"), [("ab", [3, 4, 5, 6, 7, 8, 9, 10]), ("abcdeéß", [7, 8, 9, 12, 15]), ("aé😀", [6, 20, 63, 64, 65, 66, 70, 130])])
def test_all_near_words_are_found(spark, letters, lengths):
    n = vocabulary(len(letters), 400, letters, lengths)
    assert got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_hot_keys_are_cut_into_tiles(spark, monkeypatch):
    """Words that share their rarest grams, in many tiles and small merges."""
    monkeypatch.setattr(spelling, "TILE", 8)
    n = {f"zqx{a}{b}{c}zzqxy": 2 + (a == b == c == "a") * 30 for a in "abcde" for b in "abcde" for c in "abcde"}
    assert got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_merges_of_any_size(monkeypatch):
    rng = np.random.default_rng(0)
    probe = np.sort(rng.integers(0, 40, 200))
    postings = rng.integers(0, 30, 3000)
    first, count = rng.integers(0, 2900, 200), rng.integers(0, 90, 200)
    want = Counter((int(p), int(x)) for p, f, c in zip(probe, first, count, strict=True) for x in postings[f : f + c])
    for size in (1, 50, 700, 1 << 20):
        monkeypatch.setattr(spelling, "POSTINGS", size)
        found = [(int(a), int(b)) for i, j in spelling.expanded(probe, first, count, postings, 30, 3) for a, b in zip(i, j, strict=True)]
        assert len(found) == len(set(found)) and set(found) == {k for k, v in want.items() if v >= 3}


def test_batches_of_rows_hold_whole_tiles(spark, monkeypatch):
    import pandas as pd

    n = vocabulary(9, 120, "abc", [5, 6, 7])
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = spelling.tokens(words, spelling.gram_counts(words)).toPandas().assign(first=0, second=0, block=0).sort_values("key", ignore_index=True)
    whole = {(r.word, r.other, r.other_n) for out in spelling.in_tiles(iter([rows])) for r in out.itertuples()}
    monkeypatch.setattr(spelling, "ROWS", 7)
    cut = [rows.iloc[i : i + 3] for i in range(0, len(rows), 3)]
    assert {(r.word, r.other, r.other_n) for out in spelling.in_tiles(iter(cut)) for r in out.itertuples()} == whole
    assert whole == {(a, b, n[b]) for a in n for b in n if near(a, b)}
    assert list(spelling.in_tiles(iter([]))) == [] and list(spelling.in_tiles(iter([pd.DataFrame(columns=rows.columns)]))) == []


def test_roots_of_long_chains(spark):
    n = {"aaaaaaa" + "b" * i: 10 ** (i + 1) for i in range(12)}
    out = got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert out == brute(n) and {v[1] for v in out.values()} == {"aaaaaaa" + "b" * 11}


def test_counts_and_errors_by_the_contract(spark, tmp_path):
    rng = random.Random(5)
    base = ["Straßenbahn", "ÉDUCATION", "government", "governments", "Übersicht", "naïveté", "seventh", "sixsix"]
    texts = [" ".join(rng.choice(base) + rng.choice(["", ",", "7", "-x"]) for _ in range(300)) for _ in range(60)]
    rows = [*odd_documents(), *[(100 + i, t, "en", "a", 1) for i, t in enumerate(texts)], (200, "x" * 200_000 + " " + "y" * 9, "en", "a", 1), (201, "x" * 200_000 + " " + "y" * 9, "en", "a", 1)]
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    out = got(spelling.op11(spark, table(spark, tmp_path, "documents", rows, DOCS)))
    assert out == brute(n)
    assert sum(v[0] is not None for v in out.values()) > 3


def test_odd_words(spark):
    words = spark.createDataFrame([("ab", 5, 1), ("abc", 50, 1), ("a", 1, 1), ("", 3, 1), (None, 7, 1), ("abd", 5, 1)], "word string, n long, form int")
    out = got(spelling.variants(words))
    assert out[None] == (None, None, 7, 0, None) and out["abd"] == ("abc", "abc", 5, 1, 50) and out["ab"][3] == 0 and len(out) == 6
    assert spelling.variants(words.limit(0)).count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert spelling.counted(empty).count() == 0
