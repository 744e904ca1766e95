import random

import numpy as np
import public_tokenizers
import pytest
import regex

from scriptorium.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(bpe.default_ranks(), public_tokenizers.PATTERN)


def each_match(text, enc):
    return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in enc._encode_single_piece(m.encode())]


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000, " " * 1_000_000 + "b", "a" * 1_000_000, "!" * 1_000_000, " \n" * 500_000 + "x", "日é" * 400_000, "\x1c" * 200_000 + " a"])
def test_very_long_runs(enc, text):
    ids = bpe.encode_text(text, enc)
    assert ids.tolist() == each_match(text, enc) and enc.decode_bytes(ids.tolist()) == text.encode()


def test_long_runs_in_a_task(spark):
    texts = ["a" + " " * 600_000, "word " * 100_000, None, "", "b" * 200_000 + " c"]
    df = spark.createDataFrame([(i // 2 if i < 4 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((r.decoded for r in bpe.encode(df).collect()), key=len)
    assert got == sorted(((t or "").encode() for t in texts), key=len)


def test_all_cuts_equal_the_library(enc):
    rng = random.Random(3)
    for k in range(300):
        t = "".join(rng.choice("ab1 .,'s \n\t日\x1c\u00a0") * rng.choice((1, 1, 1, 30)) for _ in range(60))
        assert bpe.encode_text(t, enc, longest=k % 40 + 1).tolist() == enc.encode_ordinary(t)


def test_classes_agree_with_the_library(enc):
    """Letters, numbers and white space are the same for the library's pattern engine and the one used for long runs."""
    for c in range(0x80, 0x110000, 97):
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}1{chr(c)}! {chr(c)}"
            assert each_match(t, enc) == enc.encode_ordinary(t), hex(c)


def test_repeated_ids_stay_apart(spark):
    df = spark.createDataFrame([(5, "one"), (5, "two two"), (None, "x")], "doc_id long, text string")
    assert sorted((len(np.frombuffer(r.ids, "<u4")), r.doc_id is None) for r in bpe.encode(df).collect())[0][0] >= 1 and bpe.encode(df).count() == 3
