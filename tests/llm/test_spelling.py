import random
import re
import zlib
from collections import Counter

import pytest

from scriptorium.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, root string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "r") for i, t in rows], SCHEMA)


def edits(w, alphabet):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
    return (out | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}) - {w}


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    alphabet = {c for w in n for c in w}
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in edits(w, alphabet) if x in n]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def texts(seed, n=60, alphabet="abÀ"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(250)]
    weights = [rng.choice([1, 1, 8, 60]) for _ in words]
    return [(i, " ".join(w.upper() if rng.random() < 0.05 else w for w in rng.choices(words, weights, k=400))) for i in range(n)]


@pytest.mark.parametrize("chunk", [2048, 5])
def test_equals_brute_force(spark, monkeypatch, chunk):
    """Many repeated grams, with whole and with split keys."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    monkeypatch.setattr(spelling, "BUCKET", 500)
    rows = texts(1)
    want = brute(rows)
    assert got(spelling.variants(frame(spark, rows))) == want
    assert len(want) > 80 and any(w[1] and w[1] != w[2] for w in want)


def test_natural_words_and_odd_rows(spark):
    body = "colour " * 40 + "color " * 7 + "colours " * 6 + "Colour's behaviour×behaviour÷naïvété naïvete NAÏVÉTÉ " * 5 + "x" * 30 + " "
    rows = [(1, body), (2, body.upper()), (None, body), (None, body), (3, None), (4, ""), (5, "colouŕ colour_colour colour1colour\n" * 3), (1, body), (6, "longword " * 100_000), (7, "longwrod" + "longwor " * 6)]
    want = brute(rows)
    assert got(spelling.variants(frame(spark, rows))) == want
    assert {"longword", "colour", "naïvete", "naÏvÉtÉ", "longwor"} <= {w[0] for w in want}
    for none in ([], [(1, None)], [(1, "a bb ccc")]):
        assert spelling.variants(frame(spark, none)).count() == 0


def test_chains_reach_their_last_form(spark):
    words = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(k, " ".join([w] * 5 * 6**k)) for k, w in enumerate(words)]
    want = brute(rows)
    assert got(spelling.variants(frame(spark, rows))) == want and {w[2] for w in want} == {"abcdefghij"}


def test_index_finds_every_word_one_edit_away():
    rng = random.Random(3)
    for longer in (False, True):
        for _ in range(60):
            size = rng.randint(6, 9)
            words = sorted({"".join(rng.choice("ab") for _ in range(size)) for _ in range(80)})
            asked = "".join(rng.choice("ab") for _ in range(size - longer))
            want = [k for k, w in enumerate(words) if w in edits(asked, "ab")]
            assert spelling.Index(words).near(asked, longer) == want
