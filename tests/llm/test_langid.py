import random

import numpy as np
import pytest

from scriptorium.llm import langid

WORDS = {"la": "abcde", "lb": "vwxyz"}


def prose(rng, lang, n=20):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, g), g, f"s{i % 3}") for i in range(240) for g in (("la", "lb")[rng.randrange(2)],)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def slow_score(net, raw):
    """The mean distribution over all positions, one position and one unit at a time."""
    h, total = net.h, np.zeros(len(net.labels))
    p = {k: v.astype(float) for k, v in net.p.items()}
    for w in range(0, len(raw), langid.WINDOW):
        window = raw[w : w + langid.WINDOW]
        n, padded = len(window), window.ljust(langid.WINDOW, b"\0")
        states = []
        for d, seq in enumerate((padded, padded[::-1])):
            s, own = np.zeros(h), []
            for byte in seq:
                a, g = p["table"][d, byte], s @ p["rec"][d]
                r, z = 1 / (1 + np.exp(-(a[:h] + g[:h]))), 1 / (1 + np.exp(-(a[h : 2 * h] + g[h : 2 * h])))
                new = np.tanh(a[2 * h :] + r * g[2 * h :])
                s = z * s + (1 - z) * new
                own.append(s)
            states.append(own if d == 0 else own[::-1])
        for t in range(n):
            e = np.concatenate([states[0][t], states[1][t]]) @ p["out"] + p["bias"]
            e = np.exp(e - e.max())
            total += e / e.sum()
    return total / max(len(raw), 1)


def test_scores_equal_a_plain_forward_pass():
    net = langid.ByteNet(["a", "b", "c"], hidden=4)
    rng = random.Random(1)
    texts = ["", "x", "é" * 70, "".join(rng.choice("abc déñ\n") for _ in range(300)), "z" * 128, "y" * 129]
    got = net.documents([t.encode() for t in texts], block=2)
    assert got == pytest.approx(np.array([slow_score(net, t.encode()) for t in texts]), abs=2e-5)


def test_accuracy_on_held_out_only(corpus):
    rows, df = corpus
    sample = langid.sample(df)
    learned = set(sample["text"])
    held = [(i, g) for i, t, g, _ in rows if langid.crc_held_out(i)]
    assert held and not {t for i, t, _, _ in rows if langid.crc_held_out(i)} & learned
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(sample)).collect()}
    assert np.mean([got[i].lang_pred == g for i, g in held]) > 0.95


def test_labels_and_ids_are_no_inputs(spark, corpus):
    _, df = corpus
    net = langid.fit(langid.sample(df))
    a = {r.text: (r.lang_pred, r.score) for r in langid.predict(df, net).collect()}
    changed = df.selectExpr("doc_id + 1000 AS doc_id", "text", "'zz' AS lang", "'x' AS source")
    assert {r.text: (r.lang_pred, r.score) for r in langid.predict(changed, net).collect()} == a


def test_odd_texts_and_clashing_columns(spark, corpus):
    net = langid.fit(langid.sample(corpus[1]))
    rows = [(1, None), (1, ""), (None, "½ ² ①"), (None, "12 !! \u0301"), (2, "ª"), (3, "abc " * 500_000), (3, "abcde"), (3, "abcde")]
    df = spark.createDataFrame([(i, t, "old", 9.0, "f") for i, t in rows], "doc_id long, text string, lang_pred string, score double, _found string")
    got = langid.predict(df, net)
    assert got.columns == ["doc_id", "text", "_found", "lang_pred", "score"]
    found = sorted(((r.doc_id, r.text, r.lang_pred, r.score) for r in got.collect()), key=repr)
    assert len(found) == 8 and {t for _, t, g, _ in found if g == "und"} == {None, "", "½ ² ①", "12 !! \u0301"}
    assert all(s == 0 for _, _, g, s in found if g == "und") and len({r for r in found if r[1] == "abcde"}) == 1
    assert langid.predict(df.limit(0), net).count() == 0 and langid.predict(df.limit(0), None).count() == 0


def test_the_sample_does_not_depend_on_order(spark):
    rows = [(5, f"abc {k}", ("la", "lb")[k % 2]) for k in range(40)] + [(6, "abc", None), (None, "abc", "la"), (9, None, "la"), (11, "", "lb")]
    schema = "doc_id long, text string, lang string"
    a, b = (langid.sample(spark.createDataFrame(x, schema).repartition(n), most=10) for x, n in ((rows, 1), (rows[::-1], 3)))
    assert a.equals(b) and len(a) == (0 if langid.crc_held_out(5) else 10)
    assert langid.fit(langid.sample(spark.createDataFrame([(2, "1 2", "la")], schema))) is None


def test_a_step_runs_over_contiguous_arrays_of_one_gate():
    net = langid.ByteNet(["a", "b", "c"])
    rows, rec = net._gates()
    assert rows.shape == (3 * 2 * 256, net.h) and rec.shape == (3, 2, net.h, net.h) and rows.flags.c_contiguous and rec.flags.c_contiguous
    x = np.random.default_rng(0).integers(0, 256, (256, langid.WINDOW), np.uint8)
    keep = {}
    s = net.states(x, keep)
    assert keep["gates"].shape == (langid.WINDOW, 3, 2, 256, net.h)
    # Both passes are kept by position: the backward one begins at the end, the forward one at the start.
    assert np.array_equal(keep["before"][1, 0], s[0, 0]) and np.array_equal(keep["before"][1, 1], s[1, -1]) and not keep["before"][0].any()
