import math

import numpy as np
import pytest

from kinroster.llm import whitening
from kinroster.llm.whitening import Centre, lobpcg

from .common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """By the definition, with whole numbers where they are asked for: {(id, component): (n, deviation, whitened, explained)}."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    c = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    out = {}
    for k in range(min(8, len(sums))):
        e, v = values[-1 - k], vectors[:, -1 - k]
        for (i, _), row, w in zip(rows, x, c @ v / math.sqrt(e), strict=True):
            out[i, k + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)), w, e / values.sum())
    return out


def compare(got, want):
    assert got.keys() == want.keys()
    for k in {k for _, k in want}:
        mine = np.array([got[key][2] for key in sorted(want) if key[1] == k])
        theirs = np.array([want[key][2] for key in sorted(want) if key[1] == k])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
    for key, (n, deviation, _, explained) in want.items():
        assert got[key][:2] == (n, deviation) and got[key][3] == pytest.approx(explained, rel=1e-9)
        assert got[key][4] < 1e-9


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.standard_normal(dim) * (0.1 + rng.random(dim)[0] + np.arange(dim) / dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "dim"), [(300, 40), (60, 9), (5, 12), (200, 3)])
def test_against_a_whole_decomposition(spark, tmp_path, n, dim):
    rows = vectors(n, dim)
    where = table(spark, tmp_path, "embeddings", [(*r, 0) for r in rows], SCHEMA)
    out = whitening.op12(spark, where).collect()
    got = {(r.vec_id, r.component): (r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out}
    want = brute(rows)
    if n <= dim:  # fewer directions with variance than dimensions
        want = {k: v for k, v in want.items() if k[1] < n}
    compare(got, want)


def test_a_tree_of_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = vectors(90, 20, 1)
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(9)
    got = {(r.vec_id, r.component): (r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(df).collect()}
    compare(got, brute(rows))


def test_odd_rows(spark):
    good = vectors(40, 6, 2)
    odd = [(100, None), (101, [1.0, None] + [1.0] * 4), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, [3e38] * 6), (105, []), (106, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, 0) for r in [*good, *odd, good[0]]], SCHEMA)
    out = whitening.whiten(df).collect()
    # A single vector of its length has no variance; a repeated row counts twice.
    assert {r.vec_id for r in out} == set(range(40)) and {r.n for r in out} == {41} and len(out) == 41 * 6
    nameless = spark.createDataFrame([(None, v, 0) for _, v in good], SCHEMA)
    assert [r.vec_id for r in whitening.whiten(nameless).collect()] == [None] * 240
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    assert whitening.whiten(same).count() == 0
    two = spark.createDataFrame([(i, [float(i)] * (2 + i % 2), 0) for i in range(20)], SCHEMA)
    assert {(r.vec_id % 2, r.component, r.n) for r in whitening.whiten(two).collect()} == {(0, 1, 10), (1, 1, 10)}


def test_large_entries_are_exact():
    x = np.array([[10**14, 5], [10**14 + 7, -3], [10**14 - 2, 9]])
    sums = x.astype(object).sum(axis=0)
    centre = Centre(3, tuple(map(int, sums)))
    assert centre.deviations(x) == [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert np.allclose(centre.centred(x), [[-5 / 3, 4 / 3], [16 / 3, -20 / 3], [-11 / 3, 16 / 3]], rtol=0, atol=1e-14)
    wide = Centre(10**10, tuple(10**10 * int(v) for v in x[0]))
    assert wide.deviations(x)[:2] == [0, None]


def test_lobpcg_on_hard_spectra():
    """Close eigenvalues, and equal ones at the edge of the block."""
    rng = np.random.default_rng(3)
    for values in (np.linspace(1.1, 1.0, 300), np.r_[[5.0] * 10, np.linspace(1, 0, 190)], np.r_[[2.0], np.zeros(99)], np.zeros(30)):
        q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        matrix, used = q * np.sort(values)[::-1] @ q.T, []
        found, vectors, residuals = lobpcg(lambda d, m=matrix, u=used: (u.append(d.shape[1]), m @ d)[1], len(values), 8)
        assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-11 and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10 and residuals.max() < 1e-10
        assert sum(used) < 100 * 16
