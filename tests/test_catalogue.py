import math
import os

import duckdb
import numpy as np
import pytest

from scriptorium.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert len(df.collect()) > 0 and df.columns


def test_every_vector_is_asked_for_its_cells(spark):
    got = catalogue.QUERIES["ann_cells_topk"](spark, SF)
    assert got.select("query_id").distinct().count() == catalogue.table(spark, SF, "embeddings").count()


def test_every_window_is_asked_for_itself(spark, tmp_path):
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}", "en", "s", 1) for i in (3, 199, 200, 5000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.n: r.queries for r in catalogue.QUERIES["self_retrieval_sweep"](spark, str(tmp_path)).collect()}
    assert got == {5: 4, 15: 4, 30: 4}


def test_line_alignment_equals_a_plain_one(spark):
    """Against the definition on every page, with the similarities taken in Python."""
    from scriptorium.functions import text
    from scriptorium.operators import gate

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    got = {}
    for r in catalogue.QUERIES["line_alignment"](spark, SF).collect():
        got.setdefault(r.page_id, {})[r.idx] = (r.ref_idx, r.aligned)
    pages = {}
    for r in catalogue.lines(spark, SF).orderBy("page_id", "line_idx").collect():
        pages.setdefault(r.page_id, []).append((r.line_idx, r.text))
    checked = 0
    for page, rows in list(pages.items())[::5]:
        hyp, ref = [t for _, t in rows], [t for i, t in rows if i % 4 != 3]
        if len(hyp) == len(ref) or max(map(len, hyp)) > 600:
            continue
        sim = np.array([[1 - distance(h, r) / max(len(h), len(r), 1) for r in ref] for h in hyp]).reshape(len(hyp), len(ref))
        want = gate.align(len(hyp), len(ref), sim)
        assert {i: x for i, (x, _) in got[page].items()} == dict(enumerate(want or [None] * len(hyp))), page
        checked += 1
    assert checked > 3 and text


def test_cells_find_nine_of_ten(spark):
    got = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["ann_cells_topk"](spark, SF).collect()}
    want = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["vector_topk"](spark, SF).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_spans_redact_to_the_same_text(spark):
    from scriptorium.functions import pii

    texts = {r.doc_id: r.text for r in catalogue.table(spark, SF, "documents").collect()}
    spans = {}
    for r in catalogue.QUERIES["pii_spans"](spark, SF).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.type))
    redacted = {r.doc_id: r.t for r in catalogue.table(spark, SF, "documents").select("doc_id", pii.redact("text").alias("t")).collect()}
    for i, t in texts.items():
        found = sorted(spans.get(i, []))
        assert found == list(pii.spans(t or ""))
        at, out = 0, ""
        for start, end, kind in found:
            out, at = out + t[at:start] + f"[REDACTED_{kind}]", end
        assert redacted[i] == (None if t is None else out + t[at:])
