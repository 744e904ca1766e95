from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT
from scriptorium.functions import pii, text
from scriptorium.operators import chunks, gate, governance, images, layout, metrics, retrieval
from scriptorium.sources import readers

LINE = "doc_id long, line_idx int, text string, page_id string, chunk_id string, conf double, tier string"


def lines(spark, *docs):
    rows = [(d, i, t, f"p{i}", f"l{d}_{i}", c, tier) for d, ls in enumerate(docs) for i, (t, c, tier) in enumerate(ls)]
    return spark.createDataFrame(rows, LINE)


def test_windows_sizes_overlap_and_pages(spark):
    df = lines(spark, [("w1 w2 w3 w4", 0.9, "gold"), ("w5 w6 w7 w8", 0.9, "gold"), ("w9 w10 w11 w12", 0.9, "gold")])
    got = chunks.windows(df, replace(DEFAULT, chunk_tokens=6, overlap=2)).orderBy("chunk_id").collect()
    assert [r.n_tokens for r in got] == [6, 6, 4]
    assert got[0].text.split()[-2:] == got[1].text.split()[:2]
    assert [r.page_ids for r in got] == [["p0", "p1"], ["p1", "p2"], ["p2"]]


def test_windows_do_not_cross_documents_and_tier_is_conservative(spark):
    df = lines(spark, [("a b c d e", 0.95, "gold"), ("", 0.1, "silver")], [("v w x y z", 0.8, "silver")])
    got = {r.doc_id: r for r in chunks.windows(df, replace(DEFAULT, chunk_tokens=6, overlap=2)).collect()}
    assert len(got) == 2 and got[0].tier == "gold" and got[1].tier == "silver"
    mixed = lines(spark, [("a", 0.95, "gold"), ("b", 0.9, "gold"), ("c", 0.8, "silver")])
    row = chunks.windows(mixed, replace(DEFAULT, chunk_tokens=50, overlap=5)).first()
    assert row.tier == "silver" and abs(row.ocr_confidence - 0.8833333) < 1e-6


@pytest.mark.parametrize("overlap", [10, 15])
def test_bad_overlap(spark, overlap):
    with pytest.raises(ValueError):
        chunks.windows(lines(spark), replace(DEFAULT, chunk_tokens=10, overlap=overlap))


def test_reading_order_of_one_row(spark):
    rows = [("p", "a", 90.0, 600, 100, 80, 30, 1, 1, 1, 0), ("p", "b", 91.0, 50, 102, 100, 28, 1, 1, 2, 1), ("p", "c", 89.0, 50, 200, 90, 30, 1, 1, 3, 2)]
    words = spark.createDataFrame(rows, "page_id string, text string, conf double, left int, top int, width int, height int, block_num int, par_num int, line_num int, word_idx int")
    got = layout.reading_order(layout.to_lines(words)).orderBy("region_idx").collect()
    assert [r.x0 for r in got] == [50, 600, 50] and got[-1].line_num == 3
    assert [r.region_id for r in got] == ["p_r000", "p_r001", "p_r002"]


def test_banding_anchor_is_first_member(spark):
    ls = spark.createDataFrame([("p", 0, i * 4, 10, i * 4 + 10, 0.9, 1, 1, i, i, 10) for i in range(4)], "page_id string, x0 int, y0 int, x1 int, y1 int, mean_conf double, block_num int, par_num int, line_num int, first_seen int, h int")
    assert [r.band for r in layout.reading_order(ls).orderBy("line_num").collect()] == [0, 0, 1, 1]


def test_upper_median(spark):
    assert spark.sql("SELECT array(1,2,3,4) a").select(layout.upper_median(F.col("a"))).first()[0] == 3


def test_alignment():
    assert gate.align(3, 3, None) == [0, 1, 2]
    assert gate.align(3, 9, None) is None
    sim = np.array([[1.0, 0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 0.2]])
    assert gate.align(3, 4, sim) == [0, 2, None]


def test_gate_first_match_wins(spark):
    rows = [("abcdefghij", None, "abcdefghij", True, False), ("", None, "x", True, True), ("same", "same", "zzz", True, True), ("x", None, None, True, True), ("abcdefghij", None, "abcdefghix", True, True), ("abc", None, "xyz", True, True)]
    df = spark.createDataFrame(rows, "norm string, gold string, ref string, aligned boolean, known boolean")
    got = [r.g for r in df.select(gate.decide(*(F.col(c) for c in df.columns)).alias("g")).collect()]
    assert [g.reason for g in got] == ["layout_provenance_mismatch", "REJECT_TOO_SHORT", None, "reference_alignment_failed", None, "cer_above_threshold"]
    assert [g.tier for g in got] == ["raw", "raw", "gold", "raw", "silver", "raw"]


def test_pii_rules():
    assert pii.redacted("line, contact rabi@example.com for details") == "line, contact [REDACTED_EMAIL] for details"
    assert [s[2] for s in pii.spans("id 123456789")] == ["PHONE"]
    assert [s[2] for s in pii.spans("12345678@x.com")] == ["EMAIL"]
    assert pii.redacted("ফোন ১২৩৪৫৬৭৮৯০").endswith("[REDACTED_PHONE]")


def test_text_functions(spark):
    df = spark.createDataFrame([("a\x1cb  c", "doc_p1_p0002")], "t string, p string")
    r = df.select(text.tokens(F.col("t")).alias("k"), text.page_doc(F.col("p")).alias("d"), text.word_count(F.lit(""))).first()
    assert r.k == ["a", "b", "c"] and r.d == "doc_p1" and r[2] == 0
    w = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "a array<string>, b array<string>")
    assert w.select(text.word_distance(F.col("a"), F.col("b"))).first()[0] == 2


def test_snapshot_orders_by_path_parts(spark):
    import hashlib

    rows = [("a.txt", b"2"), ("a/b", b"1")]
    got = governance.snapshot(spark.createDataFrame(rows, "path string, content binary")).first().version_id
    parts = "".join(hashlib.sha256(x).hexdigest() for x in (b"1", b"2"))
    assert got == hashlib.sha256(parts.encode()).hexdigest()[:16]


def test_hooks_use_return_values(spark):
    hooks = governance.Hooks()
    hooks.register("after_ocr", lambda df: df.limit(0))
    assert hooks.run("after_ocr", spark.range(3)).count() == 0
    with pytest.raises(ValueError):
        hooks.register("never", print)


def test_policy(spark):
    rows = spark.createDataFrame([(1, r, 0.1 if r < 15 else 0.9) for r in range(1, 41)] + [(2, 1, 0.0)], "query_id int, rank int, evidence double")
    got = {r.query_id: r for r in retrieval.trajectory(rows).collect()}
    assert got[1].k_used == 20 and got[2].abstained
    assert [r[0] for r in spark.createDataFrame([(30,), (40,)], "k int").select(retrieval.next_k(F.col("k"))).collect()] == [40, None]


def test_self_nearest_and_missing_index(spark, tmp_path):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "gamma delta"), (2, "epsilon zeta")], "vec_id long, text string")
    v = retrieval.encode(docs, replace(DEFAULT, dim=64))
    q = v.filter("vec_id = 2").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    r = retrieval.top_k(q, v, 1).first()
    assert r.vec_id == 2 and abs(r.score - 1) < 1e-4
    with pytest.raises(FileNotFoundError, match="write_index"):
        readers.read_index(spark, str(tmp_path / "none"))


def test_tolerant_gold(spark):
    rows = ["# note", "", "{bad", '{"page_id": "p1", "text": "one"}', '{"page_id": "", "text": "x"}', '{"page_id": "p2", "text": "REPLACE ME now"}']
    assert [tuple(r)[-2:] for r in readers.parse_gold(spark.createDataFrame([(r,) for r in rows], "value string"), "value").collect()] == [("p1", "one")]


def test_images():
    page = np.full((300, 400), 250, np.uint8)
    for y in range(40, 280, 40):
        page[y : y + 6, 20:380] = 0
    assert 0 <= images.otsu(page) < 250 and images.skew(page) == pytest.approx(0, abs=0.6)
    assert (images.binarized(page) == 0).mean() > DEFAULT.blank_ink


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1, "a"), (0.1, 0, "b")], "c double, y int, g string")
    assert metrics.ece(df, "c", "y").first().ece == pytest.approx(0.1)
    assert metrics.subgroup_gap(df, "g", "y").first().gap == 1.0
    f1 = spark.createDataFrame([("a b b", "b b c")], "h string, r string").select(metrics.token_f1(F.col("h"), F.col("r"))).first()[0]
    assert f1 == pytest.approx(2 / 3)
