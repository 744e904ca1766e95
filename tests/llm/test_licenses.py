import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import licenses

SCHEMA = "doc_id long, text string, labels string, row long, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 3, "x") for i, t in rows], SCHEMA)


def brute(text, notices=licenses.NOTICES, threshold=licenses.THRESHOLD):
    """(n_words, base places, labels, score) by looking at every block."""
    w = [x for x in re.split(licenses.GAP, "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, best = {label for _, label in base}, 0.0
    for label, t in notices:
        own = licenses.words_of(t)
        for s in range(0, len(w), len(own)):
            n = len(set(own) & set(w[s : s + 2 * len(own)]))
            if n >= licenses.alpha(len(set(own)), threshold):
                labels.add(label)
                best = max(best, n / len(set(own)))
    return len(w), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted(labels)), 1.0 if base else best


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = [w for _, t in licenses.NOTICES for w in licenses.words_of(t)] + ["cc", "by", "the", "ordinary", "ünï", "words", "here"] * 20
    out = [None, "", "!!", "the text was released under license", "Released under the\nMIT\nLicense.", "Apache License cc\nby gnu general public license"]
    for _, t in licenses.NOTICES:
        own = t.split()
        out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(40))) + "\n" + "\n".join(" ".join(own[i : i + 7]).upper() for i in range(0, len(own), 7)))
        drop = rng.randrange(len(own))
        out.append(" ".join(own[:drop] + own[drop + 1 :]) + " " + " ".join(rng.choice(words) for _ in range(30)))
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(40)]
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1.0])
def test_equals_brute_force(spark, texts, threshold):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.score) for r in licenses.scan(frame(spark, enumerate(texts)), threshold=threshold).collect()}
    want = {i: brute(t, threshold=threshold) for i, t in enumerate(texts)}
    assert {i: x[:5] for i, x in got.items()} == {i: x[:5] for i, x in want.items()}
    assert all(got[i][5] == pytest.approx(want[i][5]) for i in got)


def test_notices_are_found_over_line_ends(spark):
    wrapped = "x y z\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following\n * conditions are met:\n"
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, [(1, wrapped), (2, "the text was released under license"), (3, "Released under the Apache License")])).collect()}
    assert got == {1: "bsd", 2: "", 3: "apache"}


def test_rows_keep_their_own_labels(spark):
    rows = [(None, "Released under the MIT License."), (None, "plain"), (7, "Licensed under CC BY-NC 4.0"), (7, "plain"), (7, "plain"), (8, None)]
    got = sorted(((r.doc_id, r.labels, r.score) for r in licenses.scan(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, "mit", 1.0), (None, "", 0.0), (7, "cc-by,cc-by-nc", 1.0), (7, "", 0.0), (7, "", 0.0), (8, "", 0.0)], key=repr)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_the_positional_filter_removes_pairs(spark):
    """In row 1 all tokens of the block that come after the first common one, a, are missing: v and w are rarer than a."""
    notices = (("n", "a b c d"), ("other", "v w x y z"))
    df = frame(spark, [(1, "v w a"), (2, "d c b a"), *((10 + i, "a b c d d") for i in range(3))])
    vocabulary = sorted("abcdvwxyz")
    rows = licenses.stored(licenses.places(df, licenses.PHRASES, vocabulary))
    met = licenses.candidates(rows, licenses.global_order(rows, vocabulary), notices, 0.5).withColumn("ok", licenses.possible())
    assert met.filter("NOT ok").count() > 0 and met.filter("ok").count() > 0
    lost = met.filter("NOT ok AND label = 'n'").withColumn("n", F.size(F.array_intersect("ranks", "own")))
    assert lost.count() > 0 and lost.filter("n >= alpha").count() == 0


def test_counts_and_a_short_notice(spark):
    notices = (("apache-2.0", "licensed under the apache license version 2.0"), ("permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"))
    texts = ["The MIT License. MIT-license\ncc by", None, "", "!!", "Licensed under the Apache License, Version 2.0.", "permission is hereby granted, free of charge, to any person obtaining a copy of software"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, enumerate(texts)), notices=notices, threshold=0.8).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (7, 3, 1, 5, "cc-by,mit")
    assert all(got[i].n_words == 0 and got[i].first_word is None and got[i].labels == "" for i in (1, 2, 3))
    assert got[4].labels == "apache,apache-2.0" and got[5].base_labels == "" and got[5].labels == "permission" and 0.8 <= got[5].score < 1


def test_a_very_long_text(spark):
    filler = "license the of software " * 20_000
    text = filler + "Released under the MIT License " + filler + "Licensed under CC BY-NC 4.0"
    got = licenses.scan(frame(spark, [(1, text)]), notices=licenses.NOTICES[2:3] + licenses.NOTICES[6:7]).first()
    assert got.labels == "cc-by,cc-by-nc,mit" and got.n_base == 2 and got.n_words == len(licenses.words_of(text))
