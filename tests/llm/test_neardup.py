import numpy as np
import pytest

from scriptorium.llm import neardup

SCHEMA = "vec_id long, embedding array<float>, n_links string, key long, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2) for i, v in rows], SCHEMA)


def brute(rows, least=0.95):
    """The definition: (vec_id, n_links, component_id, kept) of each row."""
    usable = lambda i, v: i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    x = [np.array(v, np.float32).astype(float) if usable(i, v) else None for i, v in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(top(k), []).append(i)
    comp = [min(groups[top(k)]) if i is not None else None for k, (i, _) in enumerate(rows)]
    return sorted(((i, n[k], comp[k], i == comp[k]) for k, (i, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def planted(rng, n=700, dim=24):
    """Random vectors, near copies of some at angles around the threshold, exact copies of one, scaled ones."""
    x = rng.normal(size=(n, dim))
    for k in range(0, n // 2, 5):
        for j in range(1, 4):
            x[k + j] = x[k] + rng.normal(size=dim) * rng.choice([0.05, 0.25, 0.33, 0.4]) * np.linalg.norm(x[k]) / np.sqrt(dim)
    x[::9] = x[2]
    x[1::50] = 1e-12 * x[1]
    x[3::50] = 1e12 * x[3]
    return x


@pytest.mark.parametrize("tile", [40, 8192])
def test_equals_brute_force(spark, monkeypatch, tile):
    """With many small tiles, sparse and dense blocks, and with one."""
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "TOGETHER", 2)
    monkeypatch.setattr(neardup, "STRIP", (16, 64))
    rows = list(zip(range(5000, 5700), planted(np.random.default_rng(4)))) + [(3, None), (4, []), (5, [0.0] * 24), (6, [float("nan")] * 24), (7, [1.0] * 23 + [None]), (8, [float("inf")] * 24)]
    assert got(neardup.dedup(frame(spark, rows))) == brute(rows)


def test_other_lengths_ids_and_empty_tables(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 3))
    rows = [(9, x[0]), (2, x[0]), (2, x[0] + 1e-4), (2, x[1]), (None, x[0]), (7, [1.0]), (8, [2.0]), (6, [-1.0]), (5, [1.0, 1.0]), (4, [0.0, -0.0]), (1, [-0.0, 3.0, 0.0]), (3, [0.0, 3.0, -0.0])]
    assert got(neardup.dedup(frame(spark, rows))) == brute(rows)
    assert neardup.dedup(frame(spark, [])).count() == 0
    assert got(neardup.dedup(frame(spark, [(1, None)]))) == [(1, 0, 1, True)]


def test_links_lose_nothing_and_roots_are_least():
    rng = np.random.default_rng(8)
    x = neardup.units(planted(rng, 900, 40))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = neardup.links(x @ axes, x @ axes, x, x, 0.95)
    want = np.argwhere(x @ x.T >= 0.95)
    assert set(zip(i.tolist(), j.tolist())) == set(map(tuple, want.tolist()))
    assert neardup.roots(6, np.array([5, 3, 1]), np.array([3, 4, 2])).tolist() == [0, 1, 1, 3, 3, 3]


def test_cells_fill_space():
    x = np.random.default_rng(2).normal(size=(1000, 5))
    low, high = neardup.cells(x, 16)
    inside = ((x[:, None] >= low) & (x[:, None] < high)).all(2)
    assert len(low) == 16 and (inside.sum(1) == 1).all() and inside.sum(0).max() < 100
    assert len(neardup.cells(np.zeros((50, 3)), 4)[0]) == 1
