from __future__ import annotations

import numpy as np
import pytest

from boardsift.llm import embeddings as E


def brute(rows):
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def good(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.longdouble), np.array(b[1], np.longdouble)  # a wider range than a double has
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    return links, [min((rows[j][0] for j in range(n) if find(j) == find(i)), default=None) if good(rows[i]) else rows[i][0] for i in range(n)]


def vectors():
    r = np.random.default_rng(3)
    rows = []
    for label in (1, 2):
        for _ in range(20):
            base = r.normal(size=16)
            for _ in range(int(r.integers(1, 6))):
                rows.append((len(rows), (base + r.normal(size=16) * r.choice([0.02, 0.1, 0.25])).astype(np.float32).tolist(), label))
    dense = r.normal(size=16)
    rows += [(len(rows) + k, (dense + r.normal(size=16) * 0.01).astype(np.float32).tolist(), 1) for k in range(60)]
    n = len(rows)
    return [*rows, (n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [1.0, None], 1), (n + 5, rows[0][1], None), (n + 6, rows[0][1], 1), (n + 7, [1.0, 0.0], 1), (n + 8, [float("inf")] + [1.0] * 15, 1)]


@pytest.mark.parametrize("cell", [2000, 7])
def test_links_against_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(E, "CELL", cell)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    links, component = brute(rows)
    found = sum(got[i].n_links for i, _, _ in rows)
    assert found >= 0.97 * sum(links) and all(got[i].n_links <= n for (i, _, _), n in zip(rows, links, strict=True))
    assert np.mean([got[r[0]].component_id == c for r, c in zip(rows, component, strict=True)]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def exact(spark, rows):
    """Rows got and wanted, for rows whose links are all well above the threshold or well below."""
    from tests.llm.helpers import clashing

    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    return got, sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, *brute(rows), strict=True))


def test_ids_that_repeat_with_other_vectors(spark):
    r = np.random.default_rng(5)
    bases = r.normal(size=(6, 12))
    rows = [(i % 120, (bases[r.integers(6)] + r.normal(size=12) * 0.01).tolist(), 1) for i in range(240)]
    rows += [rows[0], rows[0], rows[7]]
    got, want = exact(spark, rows)
    assert got == want


def test_huge_and_tiny_components(spark):
    one = [[float(x) * size for x in (3, -1, 2, 5)] for size in (1e200, 2e200, 1e-200, 2e-200)]
    other = [[float(x) * size for x in (-3, 4, 2, 1)] for size in (1e307, 1.0, 1e-300)]
    got, want = exact(spark, [(i, v, 1) for i, v in enumerate(one + other)])
    assert got == want and [n for _, n, _, _ in got] == [3] * 4 + [2] * 3


def test_long_vectors_and_equal_ones(spark):
    r = np.random.default_rng(6)
    long = r.normal(size=5000)
    rows = [(9, long.tolist(), 1), (3, (long * 2).tolist(), 1), (4, (-long).tolist(), 1), (5, [1.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [-0.0, 1.0], 1), (8, [0.0, 1.0], 1)]
    got, want = exact(spark, rows)
    assert got == want


def test_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert E.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    (r,) = E.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1)], schema)).collect()
    assert (r.n_links, r.component_id, r.kept) == (0, None, False)


def test_nearest_lattice_point_is_nearest():
    y = np.random.default_rng(0).normal(size=(200, 8)) * 2
    p = E.nearest_e8(y)
    best = ((y - p) ** 2).sum(1)
    for v in E.shortest():
        assert (best <= ((y - p - v) ** 2).sum(1) + 1e-9).all()
    assert ((p * 2) % 1 == 0).all() and (p.sum(1) % 2 == 0).all()


def test_recall_at_the_threshold():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = r.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b = E.cells(x), E.cells(0.93 * x + np.sqrt(1 - 0.93**2) * u)
    meet = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert meet.mean() >= 0.98
