import random

import numpy as np

from scriptorium.operators import gate


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_pages_of_unequal_counts_equal_the_definition(spark):
    """Ties, lines below the least similarity, empty lines, one line against many, and pages too far apart."""
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))
    pages = [(str(k), [line() for _ in range(n)], [line() for _ in range(m)]) for k, (n, m) in enumerate([(n, m) for n in range(1, 9) for m in range(0, 9)] * 3)]
    for k in range(10):
        ref = [line() + str(x) for x in range(30)]
        pages.append((f"long{k}", [x for x in ref if rng.random() > 0.06], ref))
    pages += [("none", ["a"], None), ("empty", [], ["a"])]
    got = {}
    df = gate.align_pages(spark.createDataFrame(pages, "page_id string, hyp array<string>, ref array<string>"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        got.setdefault(r.page_id, {})[r.idx] = (r.ref_idx, r.aligned)
    for page, hyp, ref in pages:
        n, m = len(hyp), -1 if ref is None else len(ref)
        want = None
        if ref is not None:
            sim = np.array([[1 - distance(h, r) / max(len(h), len(r), 1) for r in ref] for h in hyp]).reshape(n, m)
            want = gate.align(n, m, sim)
        assert got.get(page, {}) == {i: (x, want is not None) for i, x in enumerate(want if want is not None else [None] * n)}, (page, hyp, ref)


def test_long_pages(spark):
    ref = [f"line number {k} of a long page" for k in range(300)]
    hyp = [x for k, x in enumerate(ref) if k not in (10, 150, 151)]
    got = gate.align_pages(spark.createDataFrame([("p", hyp, ref)], "page_id string, hyp array<string>, ref array<string>")).collect()
    assert {r.idx: ref[r.ref_idx] for r in got} == dict(enumerate(hyp))
