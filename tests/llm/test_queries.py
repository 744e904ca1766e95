import os

import duckdb
import pytest

from scriptorium.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_nearest": {"query_id", "rank", "vec_id", "score"},
    "op2_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op3_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op4_licenses": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op5_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op6_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op8_line_dedup": {"doc_id", "n_lines", "n_removed", "kept_sha256"},
    "op9_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op10_quality": {"doc_id", "held_out", "score", "predicted"},
    "op11_neardup": {"vec_id", "n_links", "component_id", "kept"},
    "op12_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    "op13_spelling": {"word", "form", "root", "n", "n_near", "form_n"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    assert sorted(map(plain, df.select(*names).collect()), key=repr) == sorted(map(plain, want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_covers_every_document(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(df.columns) >= COLUMNS[name]
    if "doc_id" in COLUMNS[name]:
        want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
        assert df.select("doc_id").distinct().exceptAll(want).isEmpty() and want.exceptAll(df.select("doc_id").distinct()).isEmpty()
