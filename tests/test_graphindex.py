import numpy as np
import pytest

from scriptorium.operators import graphindex


def frame(spark, x, name="vec_id", vector="embedding", first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], f"{name} long, {vector} array<float>")


def units(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def made(kind, n=12_000, dim=32):
    rng = np.random.default_rng(3)
    if kind == "even":
        return units(rng.normal(size=(n, dim)))
    if kind == "clustered":
        return units(rng.normal(size=(300, dim))[rng.integers(0, 300, n)] + 0.1 * rng.normal(size=(n, dim)))
    return (np.full(dim, 3.0) + 0.05 * rng.normal(size=(n, dim))).astype(np.float32)  # one tight cluster, not units


@pytest.mark.parametrize("kind", ["even", "clustered", "tight"])
def test_recall_and_share_of_rows(spark, tmp_path, kind):
    x = made(kind)
    path, n = f"file://{tmp_path}/graph", 10_000
    assert graphindex.add(frame(spark, x[:n]), path) == 1
    q = frame(spark, x[n : n + 200], "query_id", "q", first=10**6)
    got = {}
    for r in graphindex.search(spark, path, q, 10).collect():
        got.setdefault(r.query_id - 10**6, {})[r.rank] = (r.vec_id, r.score)
    score = np.round(x[n : n + 200].astype(float) @ x[:n].astype(float).T, 6)
    hits = 0
    for i in range(200):
        best = np.lexsort((np.arange(n), -score[i]))[:10]
        own = [got[i][k] for k in range(1, 11)]
        assert own == sorted(own, key=lambda e: (-e[1], e[0])) and all(s == pytest.approx(score[i, v], abs=2e-6) for v, s in own)
        hits += len({v for v, _ in own} & set(best.tolist()))
    assert hits >= 0.9 * 2000
    share = [r.compared / n for r in graphindex.compared(spark, path, q, 10).collect()]
    assert len(share) == 200 and np.mean(share) < 0.1


def test_batches_parts_copies_and_odd_rows(spark, tmp_path):
    x = made("even", 900, 8)
    x[100:160] = x[7]
    path = f"file://{tmp_path}/graph"
    assert graphindex.add(frame(spark, x[:500]), path, rows=200) == 3 and graphindex.add(frame(spark, x[500:], first=500), path) == 1
    assert graphindex.add(spark.createDataFrame([(1, None), (2, [float("nan")] * 8), (None, [1.0] * 8), (3, [None] * 8)], "vec_id long, embedding array<float>"), path) == 0
    asked = frame(spark, x[::90], "query_id", "q")
    got = {}
    for r in graphindex.search(spark, path, asked, 5, skip_self=False).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    score = np.round(x[::90].astype(float) @ x.astype(float).T, 6)
    hits = sum(len({v for _, v, _ in got[i]} & set(np.lexsort((np.arange(900), -score[i]))[:5].tolist())) for i in range(10))
    assert hits >= 45
    selves = graphindex.search(spark, path, spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 900, 45)], "query_id long, q array<float>"), 3, skip_self=True)
    assert selves.filter("query_id = vec_id").count() == 0
    assert graphindex.search(spark, path, spark.createDataFrame([], "query_id long, q array<float>"), 3).count() == 0
    with pytest.raises(FileNotFoundError):
        graphindex.search(spark, f"file://{tmp_path}/none", asked, 3)
    with pytest.raises(ValueError):
        graphindex.add(frame(spark, x * np.linspace(1, 5, 900)[:, None]), path)


def test_every_row_of_a_small_part_is_found():
    for n in (1, 2, 5, 130, 300):
        x = made("even", n, 6)
        part = graphindex.built(np.arange(n), x)
        links = [np.frombuffer(z, "<i4").reshape(-1, graphindex.DEGREE) for z in part["links"]]
        y = graphindex.raised(x.astype(float))
        hand, count = graphindex.walked(y, links, np.c_[x, np.zeros(n)].astype(np.float32), 8)
        assert (hand[:, 0] == np.arange(n)).all() and (count <= n).all()
        for net in links:
            assert all(len(set(row[row >= 0])) == (row >= 0).sum() and i not in row for i, row in enumerate(net.tolist() and net))
