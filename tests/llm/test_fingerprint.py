import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import fingerprint

SCHEMA = "doc_id long, text string, hash string, part long, n_chars string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "h", 1, "c") for i, t in rows], SCHEMA)


def canon(t):
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).casefold()).split())


def brute(rows):
    """(doc_id, n_chars, edited sha, canonical text, canonical edited text, near_edited, near_next) of each row, by the definition."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), canon(t), canon(edited), float(canon(t) == canon(edited)), float(canon(t) == canon(after))))
    return out


def check(got, rows):
    want = brute(rows)
    key = lambda x: (repr(x[0]), x[1], x[2])
    got, want = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got), key=key), sorted(want, key=key)
    assert [(g[:3], g[5:]) for g in got] == [(w[:3], w[5:]) for w in want]
    names = {}
    for g, w in zip(got, want):
        for f, c in ((g[3], w[3]), (g[4], w[4])):
            assert names.setdefault(f, c) == c, "one fingerprint for different texts"
    assert len(names) == len({c for w in want for c in w[3:5]})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    letters = "aAbBéÉe\u0301ßſ  \t\n日각가\u11a8x\u0323\u0307"
    out = [(i * 3 % 701, "".join(rng.choice(letters) for _ in range(rng.randrange(12)))) for i in range(230)]
    return out + [(9000, None), (9001, ""), (9002, "x"), (9003, "X "), (9004, "long " * 50_000), (9005, "LONG  " * 50_000), (9010, "ab"), (9011, "ab"), (9012, "ab")]


def test_equals_brute_force_over_many_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(fingerprint, "NEIGHBOURS", 7)
    check(fingerprint.edited_likeness(frame(spark, rows)).collect(), rows)


def test_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "NEIGHBOURS", 2)
    rows = [(5, "one"), (5, "two"), (5, "two"), (None, "last b"), (None, "last a"), (1, "first"), (2, None)]
    check(fingerprint.edited_likeness(frame(spark, rows)).collect(), rows)
    check(fingerprint.edited_likeness(frame(spark, [(None, "Ab")])).collect(), [(None, "Ab")])
    assert fingerprint.edited_likeness(frame(spark, [])).count() == 0


def test_collisions_are_told_apart_by_bytes(spark, rows):
    some = rows[:60] + rows[-4:]
    check(fingerprint.edited_likeness(frame(spark, some), hash_of=lambda c: F.length(c).cast("string")).collect(), some)


def test_canonical_form_of_random_sequences(spark):
    rng = random.Random(6)
    marks = [chr(c) for c in range(0x300, 0x370)] + [chr(c) for c in range(0x1100, 0x1200)]
    letters = [chr(c) for c in (*range(0x20, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xAC00, 0xAC60))]
    texts = ["".join(rng.choice(marks if rng.random() < 0.4 else letters) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("canon", fingerprint.folded(F.col("text")))
    wrong = [r.text for r in df.collect() if r.canon != unicodedata.normalize("NFC", unicodedata.normalize("NFD", r.text).casefold())]
    assert not wrong, [ascii(t) for t in wrong[:5]]
