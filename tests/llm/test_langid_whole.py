"""The language model comes from all rows that may be learned from, not from a sample."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from scriptorium.llm import langid
from scriptorium.llm.common import stored

WORDS = {"la": "abcde", "lb": "vwxyz", "lc": "klmno"}
SCHEMA = "doc_id long, text string, lang string"


def prose(rng, lang, n=12):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def rows(spark):
    """More rows than sample() holds; five outside of it, and five that are held out, are of a third language."""
    rng = random.Random(5)
    out = [(i, prose(rng, g), g) for i in range(3000) for g in (("la", "lb")[i % 2],)]
    seen = set(langid.sample(spark.createDataFrame(out, SCHEMA))["text"])
    assert len(seen) == langid.TRAIN_DOCS
    rare = [i for i, t, _ in out if t not in seen and not langid.crc_held_out(i)][:5] + [i for i, *_ in out if langid.crc_held_out(i)][:5]
    return [(i, prose(rng, "lc") if i in rare else t, "lc" if i in rare else g) for i, t, g in out]


def test_a_language_outside_of_the_sample_is_learned(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    assert "lc" not in set(langid.sample(df)["lang"])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: g for i, _, g in rows}
    got = {r.doc_id: r for r in langid.op9_language_id(spark, str(tmp_path)).collect()}
    assert {i for i, g in want.items() if g == "lc"} == {i for i, r in got.items() if r.lang_pred == "lc"}
    assert np.mean([got[i].lang_pred == g for i, g in want.items() if got[i].held_out]) > 0.99


def test_the_pipeline_takes_no_sample(spark, rows, monkeypatch):
    monkeypatch.setattr(langid, "sample", None)
    kept = {r.doc_id for r in pipeline.language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert len(kept & {i for i, _, g in rows if g != "lc"}) >= 2985


def test_a_rare_language_in_many_tasks(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(langid, "TASK_BYTES", 4000)
    monkeypatch.setattr(langid, "LANG_BYTES", 1000)
    nets = [langid.learn(stored(langid.vocabulary(df.repartition(n)))) for n in (1, 3)]
    assert nets[0].labels == ["la", "lb", "lc"] and nets[0].dump() == pytest.approx(nets[1].dump(), abs=1e-4)
    best = nets[0].documents([t.encode() for _, t, _ in rows]).argmax(1)
    assert np.mean([("la", "lb", "lc")[k] == g for k, (_, _, g) in zip(best, rows)]) > 0.99
    assert all(("la", "lb", "lc")[k] == g for k, (_, _, g) in zip(best, rows) if g == "lc")


def odd():
    rng = random.Random(2)
    texts = [prose(rng, "la") for _ in range(30)] + ["  ab\n\nab\tq" + "x" * 60, "é" * 50 + " ñ,ñ", "abc " * 600_000, "12 !!", "", None, "これは " * 3]
    return [(k, t, ("la", "lb", None)[k % 7 % 3]) for k, t in enumerate(texts)] + [(None, "abc", "la"), (1, "abc", "la"), (1, "abc", "lb")]


def brute_learnable():
    return [(i, t, g) for i, t, g in odd() if i is not None and g is not None and t and not langid.crc_held_out(i) and any(c.isalpha() for c in t)]


def test_words_are_counted_over_whole_texts(spark):
    want = Counter()
    for _, t, g in brute_learnable():
        for at in range(0, len(t), langid.PART):
            want.update((g, w) for w in re.findall(r"[ \t\n\x0b\f\r]?[^ \t\n\x0b\f\r]{1,24}", t[at : at + langid.PART]))
    assert {(r.lang, r.word): r.n for r in langid.vocabulary(spark.createDataFrame(odd(), SCHEMA)).collect()} == want


def test_trigrams_and_bound_are_those_of_all_rows(spark):
    df = spark.createDataFrame(odd(), SCHEMA)
    model = langid.acquaint(df, stored(langid.vocabulary(df)))
    apart = {r.doc_id for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id, 11), 3) = 0 AS a").collect() if r.a}
    parts = [[t for i, t, _ in brute_learnable() if (i in apart) == k] for k in (False, True)]
    assert all(parts)
    want = langid.Familiar(parts[0])
    means, square, n = want.means(parts[1])
    assert np.array_equal(model.logs, want.logs) and model.usual == np.median(n)
    mean = np.average(means, weights=n)
    assert model.spread == pytest.approx(np.sqrt(np.average(square, weights=n) - mean**2))
    low = np.quantile(means, langid.STRAY)
    want.settle(low, ["qq zz"], 0, 0, 1)
    assert model.bound <= low + 1e-9


@pytest.mark.parametrize("texts", [[], ["12 !!"], ["abc"]])
def test_small_tables(spark, texts):
    ids = [i for i in range(50) if not langid.crc_held_out(i)]
    df = spark.createDataFrame([(ids[k], t, "la") for k, t in enumerate(texts)], SCHEMA)
    words = stored(langid.vocabulary(df))
    net, model = langid.learn(words), langid.acquaint(df, words)
    if texts != ["abc"]:
        assert net is None and model is None
    else:
        assert net.labels == ["la"] and model.knows(["abc"])[0]


def test_gradient_with_shares():
    net = langid.ByteNet(["a", "b"], hidden=3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(97, 101, (4, 6)), rng.dirichlet([1, 1], (6, 4)), rng.random((6, 4))

    def loss():
        return -((y * np.log(net.positions(x))).sum(-1) * w).sum() / w.sum()

    g = net.gradient(x, y, w)
    for name, at in (("rec", (0, 1, 4)), ("out", (2, 1)), ("bias", (0,)), ("table", (0, 98, 5)), ("table", (1, 99, 7))):
        base = net.p[name][at]
        net.p[name][at] = base + 1e-3
        up = loss()
        net.p[name][at] = base - 1e-3
        down = loss()
        net.p[name][at] = base
        assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=1e-4)


def test_a_task_learns_within_little_memory():
    """Words of a task are no objects by the thousand: a few bytes of arrays for each byte of words (pipeline, check_h)."""
    rng, n = random.Random(1), 60_000
    words = sorted({" " + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)})
    rows = pa.table({"word": words[::-1], "langs": pa.array([[0, 1]] * len(words), pa.list_(pa.int32())), "shares": [[1e-5, 2e-5]] * len(words), "n": [3] * len(words), "cell": pa.array([2] * len(words), pa.int32())})
    tracemalloc.start()
    out = langid._learner(langid.ByteNet(["a", "b"]), 0)(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["cell"].to_pylist() == [2] and out["size"].to_pylist() == [sum(map(len, words))]
    assert peak < 45e6, peak
