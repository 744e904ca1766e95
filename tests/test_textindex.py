import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import retrieval, textindex


def corpus(seed, n=900):
    """Common and rare words, very long and very short texts, and one document in fifty that is full of a rare word."""
    rng = random.Random(seed)
    common, rare = [f"w{k}" for k in range(30)], [f"r{k}" for k in range(400)]
    rows = []
    for k in range(n):
        t = [rng.choice(common) if rng.random() < 0.9 else rng.choice(rare) for _ in range(rng.choice([0, 3, 30, 300]))]
        if k % 50 == 0:
            t += [rng.choice(rare)] * 40
        rows.append((k * 7, " ".join(t)))
    return [*rows, (100_001, None), (100_002, "")]


QUERIES = [(0, "w1 r1 r2"), (1, "w1 w2 W3"), (2, "r5"), (3, "nothing here"), (4, None), (5, ""), (6, "r7 r7 r8 r9 w0")]


def ranked(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", "score").collect())


def test_batches_give_the_same_rows_as_no_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "RANGE", 8)
    rows, path = corpus(1), f"file://{tmp_path}/index"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    for part in range(3):
        textindex.add(docs.filter(F.pmod("doc_id", F.lit(3)) == part), path)
        so_far = docs.filter(F.pmod("doc_id", F.lit(3)) <= part)
        for k in (1, 5, 2000):
            assert ranked(textindex.search(spark, path, queries, k)) == ranked(retrieval.bm25(so_far, queries, k)), (part, k)
    one = textindex.Search(spark, path, queries.filter("query_id = 6"), 3)
    one.run()
    assert one.ranges.count() > 50 and one.read.count() < 0.5 * one.ranges.count()  # the others are never joined with their documents


def test_only_named_batches_and_asked_terms_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "r3")], "query_id long, text string")
    with pytest.raises(FileNotFoundError):
        textindex.search(spark, path, queries, 3)
    textindex.add(docs, path)
    want = ranked(textindex.search(spark, path, queries, 3))
    # A writer that failed before it named its batch.
    spark.read.parquet(f"{path}/postings").drop("batch").write.parquet(f"{path}/postings/batch=broken")
    assert ranked(textindex.search(spark, path, queries, 3)) == want
    search = textindex.Search(spark, path, queries, 3)
    heads = search.postings.select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "batch" in heads.split("PartitionFilters")[1].split("]")[0] and "r3" in heads.split("PushedFilters")[1].split("]")[0] and "docs" not in heads.split("ReadSchema")[1]
    assert {r.term for r in search.postings.select("term").distinct().collect()} == {"r3"}
    one = spark.read.parquet(path + "/postings").filter("batch <> 'broken'").select("term", F.input_file_name().alias("f")).collect()
    for f in {r.f for r in one}:
        assert [r.term for r in one if r.f == f] == sorted(r.term for r in one if r.f == f)


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    textindex.add(spark.createDataFrame([], "doc_id long, text string"), path)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    assert textindex.search(spark, path, queries, 3).count() == 0
    textindex.add(spark.createDataFrame([(5, "r7"), (3, "r7")], "doc_id long, text string"), path)
    assert [r[:3] for r in ranked(textindex.search(spark, path, queries, 3))] == [(6, 1, 3), (6, 2, 5)]
