import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import jaccard

SCHEMA = "doc_id long, text string, root long, cid string, n_shingles string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", "n") for i, t in rows], SCHEMA)


def brute(rows, width=5, share=80):
    """(n_shingles, component_id) of each row, by the definition."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    met = {(i, j) for own in holders.values() for a, i in enumerate(own) for j in own[a + 1 :]}
    for i, j in met:
        n = len(sets[i] & sets[j])
        if 100 * n >= share * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    return [(d, len(s), None if least[find(i)][0] else least[find(i)][1]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def check(spark, rows, **limits):
    got = sorted((tuple(r) for r in jaccard.join(frame(spark, rows), **limits).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted(brute(rows, *limits.values()), key=repr)


def cluster(rng, words, n, edits):
    page = [rng.choice(words) for _ in range(n)]
    while True:
        copy = list(page)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(n)] = rng.choice(words)
        yield " ".join(copy)


@pytest.fixture(scope="module")
def rows():
    """Clusters whose members link in chains, across sizes and at the threshold; passages that many share; ties and repeats."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(words) for _ in range(40))
    out = [None, "", " \t\n", "one two", "One  TWO", "one two three four five", "one two three four five six"]
    for n, edits, k in ((30, 2, 40), (60, 4, 40), (120, 6, 30), (12, 1, 20)):
        source = cluster(rng, words, n, edits)
        out += [next(source) for _ in range(k)]
    chain = [rng.choice(words) for _ in range(80)]
    for _ in range(25):
        chain = chain[2:] + [rng.choice(words) for _ in range(2)]
        out.append(" ".join(chain))
    out += [shared + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 14))) for _ in range(60)]
    out += [" ".join(f"t{k}x{i}" for i in range(24)) + (" x" * 0 if k % 2 else "") for k in (1, 1, 2)]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return [(None if i % 31 == 5 else i // 2 if i % 17 == 3 else i, t) for i, t in zip(ids, out)]


@pytest.mark.parametrize("share", [80, 60, 95])
def test_equals_brute_force(spark, rows, share):
    check(spark, rows, width=5, share=share)


def test_exact_threshold(spark):
    """9 of 10 shingles and 8 of 10: 100 * 8 >= 80 * 10 links, 7 of 9 does not."""
    w = [f"a{i}" for i in range(40)]
    check(spark, [(1, " ".join(w[:13])), (2, " ".join(w[:12])), (3, " ".join(w[:12] + w[30:32])), (4, " ".join(w[20:33])), (5, " ".join(w[20:31]))])


def test_small_chunks_and_batches(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 500)
    monkeypatch.setattr(jaccard, "BATCH_MOST", 500)
    check(spark, rows)


def test_without_links_to_hubs_the_rest_finds_all(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *_: pairs.limit(0))
    check(spark, rows)


def test_five_thousand_near_copies_cost_one_comparison_each(spark):
    rng = random.Random(8)
    source = cluster(rng, [f"w{i}" for i in range(5000)], 200, 3)
    rows = [(i, next(source)) for i in range(5000)] + [(9000 + i, " ".join(f"z{i}y{j}" for j in range(60))) for i in range(50)]
    got = {r.doc_id: r.component_id for r in jaccard.join(frame(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(5000)) and all(got[9000 + i] == 9000 + i for i in range(50))
    classes, texts = made(spark, rows)
    pairs = jaccard.hub_pairs(classes, 80)
    assert pairs.count() <= classes.count()
    linked = jaccard.components(jaccard.verified(pairs, texts, 5, 80)).withColumnRenamed("node", "cid")
    comps = classes.select("cid").join(linked, "cid", "left").select("cid", F.coalesce("root", "cid").alias("comp"))
    assert comps.select("comp").distinct().count() < 50


def made(spark, rows):
    docs = frame(spark, rows)
    sent = jaccard.shingle_rows(docs, 64, 1 << 20, 5)
    answered = sent.groupBy("dest", F.when(F.col("dest") < 0, F.col("batch")).alias("own")).applyInPandas(lambda x: jaccard._count(x), "dest long, batch long, blob binary")
    able = jaccard.stored(answered.groupBy("batch").applyInPandas(jaccard._answer(80), "doc_id long, key long, n long, digest binary, a long, b long, centre double, prefix array<long>")).filter("prefix IS NOT NULL")
    classes = jaccard.stored(able.dropDuplicates(["digest"]).select(F.monotonically_increasing_id().alias("cid"), "a", "b", "n", "centre", "prefix"))
    return classes, jaccard.class_texts(docs, classes)


def test_a_very_long_text_and_equal_sets(spark):
    base = [f"v{i % 977}q{i % 13}" for i in range(60_000)]
    rows = [(3, " ".join(base)), (2, " ".join(base[:-40])), (7, " ".join(base) + " " + " ".join(base)), (None, "x " * 300_000), (8, "x " * 6)]
    check(spark, rows)


def test_token_collisions_lose_no_link(spark, rows, monkeypatch):
    """With 12 bits most tokens stand for several shingles."""
    monkeypatch.setattr(jaccard, "BITS", 12)
    sent = jaccard.shingle_rows(frame(spark, rows), 64, 1 << 20, 5)
    assert sent.count() > 0  # workers read BITS anew, so the join itself runs in this process
    texts = [t for _, t in rows]
    sets = [jaccard.word_shingles(t, 5) for t in texts]
    assert all(len(s) == n for s, (_, n, _) in zip(sets, brute(rows)))


def test_sizes_grow_slowly():
    assert jaccard.sizes(0) == (64, jaccard.BATCH_BYTES)
    buckets, batch = jaccard.sizes(170 << 40)
    assert 170 << 40 <= buckets * jaccard.BUCKET_MOST and batch == jaccard.BATCH_MOST


def test_empty_table(spark):
    assert jaccard.join(frame(spark, [])).count() == 0 and jaccard.join(frame(spark, [(1, None), (None, "")])).count() == 2
