import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinroster.llm import graph, jaccard, leaks, neighbours

from .common import DOCS, frame, odd_documents, table
from .common import words as plain


def shingles(text):
    w = plain(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(rows):
    """Links and least linked id by comparing all with all."""
    sets = [shingles(t) for t in rows]
    links, top = Counter(), list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                top[max(root(i), root(j))] = min(root(i), root(j))
    return links, [root(i) for i in range(len(rows))]


def near_copies(seed=3):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((4, 30, 120, 400)))]
        for _ in range(rng.choice((1, 3, 9))):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            texts += [" ".join(copy)] * rng.choice((1, 1, 2))
    group = [f"g{i}" for i in range(200)]
    texts += [" ".join([*group[:k], f"x{k}", *group[k + 1 :]]) for k in range(0, 180, 2)]  # more than a small bucket holds
    rng.shuffle(texts)
    return texts


def test_join_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 32)  # so that a group takes several tiles
    texts = near_copies()
    out = frame(jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).sort_values("doc_id")
    links, roots = brute_links(texts)
    assert out.n_links.tolist() == [links[i] for i in range(len(texts))]
    assert out.class_id.tolist() == roots


def test_join_of_odd_documents(spark, tmp_path):
    rows = odd_documents()
    out = frame(jaccard.op7(spark, table(spark, tmp_path, "documents", rows, DOCS)))
    got = Counter((None if i != i else int(i), int(n)) for i, n in zip(out.doc_id, out.n_links, strict=True))
    assert got == Counter({(1, 2): 2, (2, 2): 1, (3, 0): 1, (None, 0): 2, (4, 0): 1, (5, 0): 1, (6, 0): 1, (7, 0): 1, (8, 1): 1, (9, 1): 1})
    assert jaccard.join(spark.createDataFrame([], DOCS)).count() == 0
    kept = [r["doc_id"] for r in jaccard.deduplicate(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 3, None, None, 4, 5, 6, 7, 8]))


def test_runs_reach_the_recall():
    assert 1 - (1 - jaccard.survival(jaccard.FIRST_DEPTH + jaccard.STEP)) ** jaccard.runs_for() >= jaccard.RECALL


def test_runs_reach_the_recall_in_crowded_buckets(spark, monkeypatch):
    shared = np.random.default_rng(9).binomial(jaccard.COORDINATES, 0.8, 200_000)
    odds = np.bincount(shared, minlength=jaccard.COORDINATES + 1) / len(shared)

    def lost(depth, runs):
        gone = np.zeros(len(odds))
        for _ in range(depth):
            once = 1 - np.arange(len(odds)) / jaccard.COORDINATES * (1 - gone)
            gone = once * (0.75 + 0.25 * once)
        return float(odds @ gone**runs)

    for depth, runs in jaccard.runs_of():
        assert lost(depth, runs.stop) <= 1.3e-4  # the spread is sampled
        if depth == 15:
            break
    taken, paths = [], jaccard.first_paths
    monkeypatch.setattr(jaccard, "first_paths", lambda sets, runs, threshold: taken.append((sets.count(), runs)) or paths(sets, runs, threshold))
    monkeypatch.setattr(jaccard, "SMALL", 8)
    texts = [" ".join([*(f"g{i}" for i in range(140)), *(f"own{k}-{i}" for i in range(64))]) for k in range(150)]  # boilerplate: 0.51
    texts += [f"nothing like that number {k} at all" for k in range(30)]
    texts.append(texts[0] + " end")
    out = frame(jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).sort_values("doc_id")
    assert out.n_links.tolist() == [1] + [0] * (len(texts) - 2) + [1]
    (every, first), (crowded, more) = taken[:2]
    assert every == 181 and crowded <= 151 and first.stop == more.start


def test_large_buckets_are_finished_at_a_centre(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    linked, further = [], jaccard.further
    monkeypatch.setattr(jaccard, "further", lambda rows, threshold: linked.append(rows.filter("hub IS NOT NULL").count()) or further(rows, threshold))
    texts = near_copies(5)
    out = frame(jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).sort_values("doc_id")
    links, roots = brute_links(texts)
    assert linked[0] > 0
    assert out.n_links.tolist() == [links[i] for i in range(len(texts))]
    assert out.class_id.tolist() == roots


def crowds():
    """Two large groups of near copies that are just similar enough to each other in part, and strangers."""
    base = [f"g{i}" for i in range(1000)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 900, 10)]
    other = [*base[:895], *(f"o{i}" for i in range(105))]  # 0.81 of the base
    texts += [" ".join([*other[:k], f"y{k}", *other[k + 1 :]]) for k in range(0, 900, 10)]
    texts += [" ".join([*other[:-k], *(f"z{k}-{i}" for i in range(k))]) for k in (5, 75, 130)]
    texts += [f"nothing like that number {k} at all" for k in range(20)]
    random.Random(4).shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [jaccard.SMALL, 8])
def test_near_copies_walk_under_their_heads(spark, monkeypatch, small):
    """No link is lost, in small buckets or large ones, and a group's paths are few."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    taken, walked, headed = [], [], jaccard.headed
    monkeypatch.setattr(jaccard, "headed", lambda sets, scratch: taken.append(headed(sets, scratch)) or walked.append(taken[-1].count()) or taken[-1])
    texts = crowds()
    out = frame(jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).sort_values("doc_id")
    links, roots = brute_links(texts)
    assert walked[0] > 100
    assert out.n_links.tolist() == [links[i] for i in range(len(texts))]
    assert out.class_id.tolist() == roots


def test_copies_that_agree_loosely_are_not_split_again(spark, monkeypatch):
    """A group of 271 different copies with up to 9 of 150 words changed; splitting it again leaves most of it together."""
    monkeypatch.setattr(jaccard, "further", lambda *_: pytest.fail("a bucket of some hundred sets was split again"))
    rng = random.Random(7)
    base = [f"g{i}" for i in range(150)]
    texts = []
    for k in range(300):
        copy = list(base)
        for at in rng.sample(range(150), k % 10):
            copy[at] = f"x{k}-{at}"
        texts.append(" ".join(copy))
    texts += [f"nothing like that number {k} at all" for k in range(20)]
    out = frame(jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).sort_values("doc_id")
    links, roots = brute_links(texts)
    assert out.n_links.tolist() == [links[i] for i in range(len(texts))]
    assert out.class_id.tolist() == roots


def test_forests_of_large_buckets_connect_what_agrees():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 16, (4, jaccard.COORDINATES))
    signatures = base[rng.integers(0, 4, 700)].astype("<u2")
    for row in signatures:
        k = rng.integers(0, 45)
        row[rng.permutation(jaccard.COORDINATES)[:k]] = rng.integers(0, 1 << 16, k)
    reach = np.where(rng.random(700) < 0.1, 0.05, 0.0)
    agree = (signatures[:, None, :] == signatures[None, :, :]).mean(axis=2) + reach[:, None] + reach[None, :] >= 0.6
    edges = jaccard.forest(np.arange(700), signatures, reach, 0.6)
    assert all(agree[a, b] for a, b in edges)
    label = np.arange(700)
    for _ in range(700):
        least = np.where(agree, label[None, :], 700).min(axis=1)
        if (least == label).all():
            break
        label = least
    assert len(edges) == 700 - len(set(label.tolist())) and all(label[a] == label[b] for a, b in edges)


def test_a_head_takes_all_paths_of_its_sets():
    rng = np.random.default_rng(8)
    head = rng.integers(0, 1 << 16, jaccard.COORDINATES).astype("<u2")
    signatures = np.repeat(head[None, :], 50, axis=0)
    for k in range(1, 50):
        signatures[k, rng.integers(0, jaccard.COORDINATES, 6)] = rng.integers(0, 1 << 16, 6)

    def walk(rows):
        node = jaccard.words.mix(np.full(len(rows), 1, dtype=np.uint64))
        for _ in range(3):
            node, rows = jaccard.split(node, rows, signatures, 0.8)
        return set(node.tolist())

    every = walk(np.arange(50))
    assert every == set().union(*(walk(np.array([k])) for k in range(50))) and walk(np.array([0])) < every


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node, label in got.items():
        seen, todo = {node}, [node]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert label == min(seen)


def test_components_of_a_long_chain(spark):
    ids = list(range(1000))
    random.Random(2).shuffle(ids)
    chain = list(zip(ids, ids[1:], strict=False)) + [(2000 + i, 2001 + i) for i in range(400)] + [(2400, 1999)]
    labels = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(chain, "a long, b long"), most_rounds=20).collect()}
    assert labels == dict.fromkeys(range(1000), 0) | dict.fromkeys(range(1999, 2401), 1999)
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame(chain, "a long, b long"), most_rounds=1)


def brute_nearest(rows, k=5):
    known = {i: np.array(v, dtype=float) for i, v in rows}
    out = []
    for q in (i for i in known if i % 50 == 0):
        scored = sorted((-float(known[q] @ v / np.sqrt(known[q] @ known[q]) / np.sqrt(v @ v)), i) for i, v in known.items() if i != q and len(v) == len(known[q]))
        out += [(q, r + 1, i, round(-s, 10)) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_neighbours_are_exact(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[50][1]) for i in range(400, 440)] + [(450, (np.array(rows[50][1]) * 1e-30).tolist()), (451, [1.0, 2.0]), (500, [2.0, 1.0])]
    bad = [(600, None), (650, [0.0] * 24), (700, [float("nan")] * 24), (701, [None] * 24), (702, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (703, []), (400, rows[400][1])]
    where = table(spark, tmp_path, "embeddings", rows + bad, "vec_id long, embedding array<float>")
    out = frame(neighbours.op5(spark, where))
    exact = [(i, np.array(v, dtype=np.float32).tolist()) for i, v in rows]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in out.itertuples()}
    want = brute_nearest(exact)
    assert got.keys() == {(q, r) for q, r, _, _ in want}
    for q, r, _, s in want:
        assert got[q, r][1] == pytest.approx(s, abs=1e-9)
    assert [got[100, r][0] for r in range(1, 6)] == [i for q, _, i, _ in want if q == 100]
    assert [got[50, r][0] for r in range(1, 6)] == [400, 401, 402, 403, 404]  # ties go to the smaller id
    assert neighbours.op5(spark, table(spark, tmp_path, "embeddings", [], "vec_id long, embedding array<float>")).count() == 0


def test_error_bound_keeps_the_nearest():
    rng = np.random.default_rng(3)
    a, b = (neighbours.Block(16, np.arange(n).astype("<i8").tobytes(), (rng.normal(size=(n, 16)) * 10.0 ** rng.integers(-3, 4, (n, 1))).tobytes()) for n in (20, 300))
    a.ids = a.ids + 10_000
    i, j = neighbours.survivors(a, b, 5)
    unit = lambda x: x.vectors / np.linalg.norm(x.vectors, axis=1)[:, None]
    true = unit(a) @ unit(b).T
    for q in range(20):
        assert set(np.argsort(-true[q])[:5]) <= set(j[i == q])
    assert len(i) < 20 * 300 / 4


ITEM = "which river runs through the old town of brenn and why was its bridge closed the bridge was closed because the spring flood took two pillars"


def test_leaks(spark):
    other = "name the capital of the northern province and its patron saint answer the capital is larn and the patron is saint oda"
    bench = spark.createDataFrame([(1, ITEM), (2, other), (2, other), (3, None), (None, ITEM), (4, ""), (5, "yes")], "item_id long, text string")
    filler = " ".join(f"filler{i % 321} the of and river" for i in range(2500))
    question = " ".join(ITEM.split()[:16])
    rows = [(1, ITEM), (2, f"{filler} {ITEM.upper()}! {filler}"), (3, question + " nobody knows"), (4, filler), (5, None), (6, ""), (7, f"{ITEM} {other}"), (7, f"{ITEM} {other}"), (None, other), (8, "yes")]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, leaks string")
    out = leaks.flagged(df, bench)
    assert out.columns == ["doc_id", "text", "leaks"]
    got = [(r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in out.collect()]
    assert got == [(1, [1]), (2, [1]), (3, []), (4, []), (5, []), (6, []), (7, [1, 2]), (7, [1, 2]), (None, [2]), (8, [5])]
    kept = leaks.decontaminate(df, bench)
    assert kept.columns == df.columns and [(r["doc_id"], r["leaks"]) for r in kept.collect()] == [(i, "mine") for i in (3, 4, 5, 6)]
    empty = bench.filter("item_id = 99")
    assert leaks.decontaminate(df, empty).count() == len(rows) and leaks.flagged(df.limit(0), bench).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "\u5317\u4eac\u7684\u7b2c\u4e00\u5ea7\u6865\u662f\u4ec0\u4e48\u65f6\u5019\u5efa\u6210\u7684\u7b54\u6848\u662f\u4e00\u4e5d\u4e03\u4e8c\u5e74"
    bench = spark.createDataFrame([(1, "who founded larn"), (2, chinese), (3, "Yes!"), (4, "who founded larn"), (5, "\u7b2c\u4e00\u5ea7\u6865")], "item_id long, text string")
    texts = ["so: Who founded -- Larn? nobody", "who founded old larn", f"\u8fd9\u91cc\u5199\u7740\uff1a{chinese}\u3002", "yes", "yes yes", "founded larn", "who founded", "larn who"]
    out = leaks.flagged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).orderBy("doc_id").collect()
    assert [[x["item_id"] for x in r["leaks"]] for r in out] == [[1, 4], [], [2, 5], [3], [], [], [], []]


def test_an_index_in_parts_scores_like_one(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 40)))) for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"some words {t} and others" for _, t in items] + [" ".join(t.split()[::2]) for _, t in items]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    one, many = (leaks.stored(bench, "item_id", "text", part_items=n) for n in (1000, 7))
    assert (one.parts, many.parts) == (1, 8)
    found = [[r[0] for r in df.select(leaks.leaks(F.col("text"), index, spark)).collect()] for index in (one, many)]
    assert found[0] == found[1] and sum(map(len, found[0])) >= 50


def test_block_max_loses_nothing():
    """Retrieval by blocks against scores of all items."""
    rng = np.random.default_rng(4)
    names = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(names, rng.integers(8, 40)))) for i in range(60)]
    index = leaks.build(items)
    passages = [" ".join(rng.choice(names, 30)) + " " + (items[p][1] if p % 3 == 0 else items[p][1][:60]) for p in range(60)]
    hashed = [np.unique(leaks.plain_words([p.encode()])[0]) for p in passages]
    pairs = [(p, int(np.searchsorted(index.terms, h))) for p, hs in enumerate(hashed) for h in hs if h in index.terms]
    got = leaks.retrieve(index, np.array([p for p, _ in pairs]), np.array([t for _, t in pairs]), 60)
    want = set()
    for p in range(60):
        score = np.zeros(60)
        for q, t in pairs:
            if q == p:
                score[index.item[index.starts[t] : index.starts[t + 1]]] += index.impact[index.starts[t] : index.starts[t + 1]]
        want |= {(p, i) for i in np.flatnonzero(score >= 1 - 1e-9)}
    assert set(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want and len(want) >= 20
