import random
import zlib

import numpy as np
import pytest

from scriptorium.llm import quality


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark):
    """Good texts are prose, bad ones repeat or hold marks; labels go with the text alone, some are wrong."""
    rng, rows, labels = random.Random(6), [], []
    for i in range(600):
        good = rng.random() < 0.6
        if good:
            t = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60))) + "."
        else:
            t = rng.choice(("buy now " * rng.randrange(5, 40), "### $$$ %% " * rng.randrange(3, 20), "A1B2 " * rng.randrange(10, 30)))
        rows.append((i, t))
        labels.append((i, int(good) if rng.random() < 0.97 else int(not good)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "some text of no id"), (7, "x"), (7, "x")], "doc_id long, text string")
    return rows, labels, docs, spark.createDataFrame([*labels, (950, None), (None, 1)], "doc_id long, quality int")


def plain_features(t):
    """Some features by their definitions."""
    raw, w = t.encode(), t.lower().split()
    n = max(len(raw), 1)
    return {
        "log_bytes": np.log1p(len(raw)), "digits": sum(48 <= c < 58 for c in raw) / n, "upper": sum(65 <= c < 91 for c in raw) / n, "non_ascii": sum(c >= 128 for c in raw) / n,
        "newlines": raw.count(b"\n") / n, "log_words": np.log1p(len(w)), "distinct_words": len(set(w)) / len(w) if w else 0, "top_word": max((w.count(x) for x in set(w)), default=0) / max(len(w), 1),
        "repeats": sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1), "distinct_lines": len(set(t.split("\n"))) / len(t.split("\n")), "stops": sum(c in b".?" for c in raw) / n,
    }


def test_features_equal_their_definitions():
    rng = random.Random(1)
    texts = ["", "a", "A b. B! a", "x\nx\ny", "é ü 12", " ", "".join(rng.choice("ab AB1.,\n|é") for _ in range(4000))] + ["".join(rng.choice("ab AB1.\n") for _ in range(60)) for _ in range(40)]
    got = quality.features([t.encode() for t in texts])
    for t, row in zip(texts, got):
        for name, value in plain_features(t).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value, abs=1e-9), (t[:20], name)


def slow_score(model, row):
    """One table after another."""
    bins = [int(np.searchsorted(e, v, side="right")) for e, v in zip(model.edges, row)]
    f = model.intercept + sum(t[b] for t, b in zip(model.one, bins))
    for (i, j), t in model.two.items():
        f += t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]]
    return 1 / (1 + np.exp(-f))


def test_scores_are_sums_of_tables(corpus):
    _, _, docs, labels = corpus
    table = quality.feature_table(docs)
    model = quality.fit(table, labels)
    rows = {r.doc_id: np.array(r.f) for r in table.collect()}
    got = {r.doc_id: r for r in quality.score(table, model).collect()}
    assert len(model.two) == quality.PAIRS and any(np.abs(t).max() > 0 for t in model.two.values())
    for i, r in got.items():
        assert r.score == pytest.approx(slow_score(model, rows[i]), abs=1e-9) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_accuracy_on_held_out_only(corpus, spark):
    rows, labels, docs, known = corpus
    table = quality.feature_table(docs)
    got = {r.doc_id: r.score for r in quality.score(table, quality.fit(table, known)).collect()}
    held = [(i, q) for i, q in labels if held_out(i)]
    good, bad = ([got[i] for i, q in held if q == k] for k in (1, 0))
    assert len(held) > 60 and np.mean([a > b for a in good for b in bad]) > 0.9
    turned = spark.createDataFrame([(i, 1 - q if held_out(i) else q) for i, q in labels], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in quality.score(table, quality.fit(table, turned)).collect()} == got


def test_odd_rows(corpus, spark):
    _, _, docs, labels = corpus
    table = quality.feature_table(docs)
    model = quality.fit(table, labels)
    got = [(r.doc_id, r.score) for r in quality.score(table, model).collect()]
    assert len(got) == 605 and len({s for i, s in got if i in (900, 901)}) == 1 and sum(i is None for i, _ in got) == 1
    assert len({s for i, s in got if i == 7}) == 2 and sum(i == 7 for i, _ in got) == 3
    assert quality.fit(table, labels.limit(0)) is None and quality.fit(table.limit(0), labels) is None
    assert quality.score(table.limit(0), model).count() == 0
    assert {(r.score, r.predicted) for r in quality.score(table, None).collect()} == {(0.5, 1)}
    clash = spark.createDataFrame([(1, "a b", 5, 0.1, 3, [1.0])], "doc_id long, text string, predicted int, score double, quality int, f array<float>")
    assert quality.score(quality.feature_table(clash), model).columns == ["doc_id", "score", "predicted"]
    long = spark.createDataFrame([(1, "word and more " * 300_000)], "doc_id long, text string")
    assert 0 <= quality.score(quality.feature_table(long), model).first().score <= 1


def test_the_sample_is_bounded_and_fixed(corpus):
    _, _, docs, labels = corpus
    table = quality.feature_table(docs)
    a, b = (quality.fit(t, labels, most=100) for t in (table, table.repartition(5)))
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.one, b.one))
