import random

import pytest

from scriptorium.llm import linededup


def brute(rows, sites):
    """rows: (doc_id, source, text) -> text after removal, per row."""
    where, first = {}, {}
    for k, (d, s, t) in enumerate(rows):
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                where.setdefault(line.strip(" "), set()).add(s)
                at = (d is None, d or 0, i)
                if line.strip(" ") not in first or at < first[line.strip(" ")][0]:
                    first[line.strip(" ")] = (at, (d, s, t))
    bad = {x for x, s in where.items() if len(s - {None}) >= sites}
    out = []
    for d, s, t in rows:
        keep = [x for i, x in enumerate((t or "").split("\n")) if x.strip(" ") not in bad or ((d is None, d or 0, i), (d, s, t)) == first[x.strip(" ")]]
        out.append(None if t is None else "\n".join(keep))
    return out


@pytest.mark.parametrize("sites", [2, 3, 10])
def test_equals_brute_force(spark, sites):
    rng = random.Random(sites)
    pool = [f"line {k}" for k in range(12)] + ["", "  ", " line 3 "]
    rows = [(i, f"s{rng.randrange(14)}" if i % 9 else None, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randrange(9)))) for i in range(150)]
    rows += [(None, "s1", "line 1\nnull id\nline 1"), (None, "s2", "line 2\nother null"), (700, None, None), (701, "s1", "")]
    df = spark.createDataFrame([(d, t, s, 7, 8, "gone") for d, s, t in rows], "doc_id long, text string, source string, n_lines int, n_removed int, gone string")
    got = linededup.dedup(df, sites=sites)
    assert got.columns == ["doc_id", "text", "source", "gone", "n_lines", "n_removed"]
    want = brute(rows, sites)
    have = sorted(((r.doc_id, r.source, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr)
    assert have == sorted(((d, s, w, 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") - (w.count("\n") if w else -1 if w == "" and removed(t, w) else 0)) for (d, s, t), w in zip(rows, want)), key=repr)


def removed(t, w):
    """Whether all lines went (an empty rest of several lines), in contrast to one empty line that stayed."""
    return t != "" and all(x.strip(" ") for x in t.split("\n"))


def test_rows_that_share_a_doc_id_keep_their_own_lines(spark):
    rows = [(5, "keep A\nkeep B", "s0"), (5, "footer\nown", "s1"), *((100 + i, f"footer\nown {i}", f"s{i}") for i in range(12)), (None, "footer\nnull 1", "s2"), (None, "footer\nnull 2", "s3")]
    got = {(r.doc_id, r.text) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {(5, "keep A\nkeep B"), (5, "footer\nown"), (None, "null 1"), (None, "null 2"), (100, "own 0"), (111, "own 11")} <= got and len(got) == 16


def test_repeated_rows_and_a_very_long_text(spark):
    long = "\n".join(f"u{i}\nmenu" for i in range(20_000))
    rows = [(1, "menu\na", "s0"), (1, "menu\na", "s0"), *((i, "menu", f"s{i}") for i in range(2, 14)), (50, long, "s1")]
    got = {}
    for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_removed))
    assert got[1] == [("menu\na", 0)] * 2 and got[2] == [("", 1)] and got[50] == [("\n".join(f"u{i}" for i in range(20_000)), 20_000)]


def test_empty_table(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
