import hashlib
import random

from pyspark.sql import functions as F

from scriptorium.operators import governance, retrieval


def joined(spark, points, ranges):
    p = spark.createDataFrame([(x,) for x in points], "page_num long")
    r = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ranges)], "work int, start long, end long")
    return sorted((r.work, r.page_num) for r in governance.assign_ranges(p, r).collect())


def test_ranges_of_all_widths(spark):
    rng = random.Random(2)
    points = [rng.randint(-200, 200) for _ in range(150)] + [None, 2**40, -(2**40), 0, 0]
    ranges = [(a, a + rng.choice([0, 1, 2, 3, 7, 8, 100, 2**41])) for a in (rng.randint(-250, 250) for _ in range(80))] + [(5, 4), (None, 3), (3, None), (-(2**62), 2**62), (-(2**63), 2**63 - 1)]
    want = sorted((k, x) for k, (a, b) in enumerate(ranges) for x in points if None not in (a, b, x) and a <= x <= b)
    assert joined(spark, points, ranges) == want
    assert joined(spark, [], ranges) == [] and joined(spark, points, []) == []


def test_many_ranges_meet_without_a_nested_loop(spark):
    ranges = spark.range(1_000_000).select((F.col("id") * 3).alias("start"), (F.col("id") * 3 + F.col("id") % 5).alias("end"))
    pages = spark.range(0, 3_000_000, 997).select(F.col("id").alias("page_num"))
    met = governance.assign_ranges(pages, ranges)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sum(1 for x in range(0, 3_000_000, 997) for k in (x // 3 - 1, x // 3) if 0 <= k and 3 * k <= x <= 3 * k + k % 5)
    assert met.count() == want


def test_running_sums_and_splits(spark):
    rng = random.Random(4)
    rows = [(k * 3 - 500, rng.choice([0, 1, 50, None])) for k in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, n_words long")
    got = sorted((r.doc_id, r.before, r.part) for r in governance.split_by_words(df).collect())
    total, at, want = sum(n or 0 for _, n in rows), 0, []
    for k, n in sorted(rows):
        want.append((k, at, "train" if at * 100 < 65 * total else "val" if at * 100 < 87 * total else "test"))
        at += n or 0
    assert got == want
    plan = governance.running_sum(df, "doc_id", "n_words")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert governance.split_by_words(df.limit(0)).count() == 0
    assert {r.part for r in governance.split_by_words(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_words long")).collect()} == {"train"}
    whole = [(r.doc_id, r.part) for r in governance.split_by_words(spark.createDataFrame([(1, 64), (2, 30), (3, 6), (4, 1)], "doc_id long, n_words long")).orderBy("doc_id").collect()]
    assert whole == [(1, "train"), (2, "train"), (3, "test"), (4, "test")]


def test_snapshot_orders_by_path_parts_and_streams(spark):
    rng = random.Random(1)
    files = [(f"{rng.choice('abc')}/{rng.choice(['x', 'x y', 'é', 'Z'])}{k}.txt", bytes([k % 256])) for k in range(400)] + [("a.txt", b"1"), ("a/b", b"2"), ("a", b"3")]
    rng.shuffle(files)
    got = governance.snapshot(spark.createDataFrame(files, "path string, content binary").repartition(7)).collect()
    digests = "".join(hashlib.sha256(c).hexdigest() for _, c in sorted(files, key=lambda f: [p.encode() for p in f[0].split("/")]))
    assert [tuple(r) for r in got] == [(hashlib.sha256(digests.encode()).hexdigest()[:16], 403)]
    empty = governance.snapshot(spark.createDataFrame([], "path string, content binary")).collect()
    assert [tuple(r) for r in empty] == [(hashlib.sha256(b"").hexdigest()[:16], 0)]


def test_feedback_adds_the_terms_of_found_documents(spark):
    docs = spark.createDataFrame([(1, "apple pie crust crust"), (2, "apple crust butter"), (3, "car engine"), (4, "car crust"), (5, None), (6, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Apple"), (2, "zebra"), (3, None)], "query_id long, text string")
    hits = retrieval.bm25(docs, queries, 2)
    got = retrieval.feedback_terms(docs, queries, hits, 2)
    terms = {(r.query_id, r.place): r.term for r in got.collect()}
    assert set(terms) == {(1, 1), (1, 2)} and "apple" not in terms.values() and "crust" in terms.values()
    more = {r.query_id: r.text for r in retrieval.expanded(queries, got).collect()}
    assert more == {1: f"Apple {terms[1, 1]} {terms[1, 2]}", 2: "zebra", 3: ""}


def test_places_in_a_group_of_any_size(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["corpus", "corpus", "corpus", "a", "b", None]), f"p{k:05d}") for k in range(900)]
    df = spark.createDataFrame(rows, "page_id long, doc_id string, id string")
    want = []
    for g in {r[1] for r in rows}:
        want += [(r[0], k) for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: r[2]), 1)]
    got = governance.placed(df.repartition(5), "doc_id", "id")
    assert sorted((r.page_id, r.place) for r in got.collect()) == sorted(want) and governance.placed(df.limit(0), "doc_id", "id").count() == 0
