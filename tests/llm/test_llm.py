import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bpe, fingerprint, graphs, jaccard, langid, linededup, packing, quality, repeats, suffixes, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double"


def docs(spark, *texts, lang="en"):
    """Documents with columns whose names clash with those of results; the site changes from row to row."""
    return spark.createDataFrame([(i, t, lang, f"src{i % 12}", len(t or ""), "clash", 0.5) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [texts[0], texts[0] + " tail", shared + " x " + texts[3], "y " + shared, None, "", "é" * 70, "é" * 90, texts[0]]
    return texts


def test_suffix_sort_with_spills_and_recursion():
    rng = random.Random(5)
    for k in range(300):
        t = "".join(rng.choice("ab" if k % 3 else "abcdef") for _ in range(rng.randrange(1, 60)))
        order, lcp = suffixes.suffix_sort(np.frombuffer(t.encode(), np.uint8), queue=3, in_memory=2)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want
        for p, (a, b) in enumerate(zip(want, want[1:])):
            n = next((i for i in range(min(len(t) - a, len(t) - b)) if t[a + i] != t[b + i]), min(len(t) - a, len(t) - b))
            assert min(lcp[p + 1], suffixes.DEPTH) == min(n, suffixes.DEPTH)


def test_repeats_match_definition(spark, prose):
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove(docs(spark, *prose)).collect()}
    assert got == repeats.brute_force(list(enumerate(prose)))
    assert repeats.remove(docs(spark, "a").limit(0)).count() == 0


def test_jaccard_matches_brute_force(spark, prose):
    sets = []
    for t in prose:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, *prose)).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert jaccard.join(docs(spark, "a").limit(0)).count() == 0


def test_jaccard_keeps_null_ids_and_one_row_of_each_group(spark):
    import corpus_pipeline as p

    words = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(6)]
    rows = [(None, words[0]), (5, words[0]), (7, words[0] + " z"), (None, words[1]), (None, words[2]), (None, words[2]), (3, words[3]), (3, words[3]), (0, words[4]), (None, None), (None, ""), (4, None)]
    df = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(df).collect()), key=repr)
    assert got == sorted([(None, 5), (5, 5), (7, 5), (None, None), (None, None), (None, None), (3, 3), (3, 3), (0, 0), (None, None), (None, None), (4, 4)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in p.near_copies(spark, df, "").collect()), key=repr)
    assert kept == sorted([(5, words[0]), (None, words[1]), (None, words[2]), (3, words[3]), (0, words[4]), (None, None), (None, ""), (4, None)], key=repr)
    few = df.filter("source IN ('s0', 's3', 's8', 's10', 's11')")
    cut = sorted(tuple(r) for r in p.repeated_strings(spark, few, "").select("source", "doc_id", "text", "lang").collect())
    assert cut == [("s0", None, words[0], "en"), ("s10", None, "", "en"), ("s11", 4, "", "en"), ("s3", None, words[1], "en"), ("s8", 0, words[4], "en")]
    assert p.near_copies(spark, df.limit(0), "").count() == 0


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(20)] + [("z1", "z2"), ("z1", "z1")]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert set(got.values()) == {"n000", "z1"} and len(got) == 23


def test_packing_covers_every_token_once(spark, prose):
    pieces = packing.pack(docs(spark, *prose), window=64, pool=8).collect()
    words = packing.word_tokenizer(packing.default_tokenizer())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    for i, t in enumerate(prose):
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == words.whole(t or "").tobytes() + np.array([2], "<u4").tobytes()
        assert all(p.doc_tokens == sum(x.length for x in own) for p in own)
    assert packing.pack(docs(spark, "a").limit(0)).count() == 0


def test_best_fill_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        room, sums = rng.randrange(1, 60), {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = packing.best_fill(counts, room)
        assert all(got[n] <= counts[n] for n in got) and sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)


def test_word_tokenizer_equals_library():
    words, rng = packing.word_tokenizer(packing.default_tokenizer()), random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("aB'sstTé ÄÖß.,!?-_12² \n\tªº<|>΄Σ日re'll") for _ in range(rng.randrange(30)))
        assert words.ids(t).tolist() == words.whole(t).tolist()


def test_bpe_round_trip_and_safe_cuts(spark, prose):
    enc = bpe.encoding(bpe.default_ranks(), __import__("public_tokenizers").PATTERN)
    for r in bpe.encode(docs(spark, *prose)).collect():
        t = prose[r.doc_id] or ""
        assert r.decoded == t.encode() and np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t)
    rng = random.Random(9)
    for _ in range(100):
        t = "".join(rng.choice("ab1 .,'s \n\t日") for _ in range(300))
        assert bpe.encode_text(t, enc, longest=7).tolist() == enc.encode_ordinary(t)
    assert bpe.encode(docs(spark, "a").limit(0)).count() == 0


def test_fingerprints(spark):
    texts = ["Café́ A  b", "café́ a b", None, "", "x" * 9, "Café", "café"]
    got = {r.doc_id: r for r in fingerprint.edited_likeness(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert got[2].fingerprint == got[3].fingerprint and got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1.0 and got[4].near_next == 0.0
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs(spark, *texts)).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}
    collided = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs(spark, *texts), hash_of=lambda c: F.lit("same")).collect()}
    assert [collided[2] == collided[3], collided[5] == collided[6], len(set(collided.values()))] == [True, True, len(set(plain.values()))]
    assert unicodedata.normalize("NFC", texts[5]).lower() == texts[6]
    assert fingerprint.edited_likeness(docs(spark, "a").limit(0)).count() == 0


def test_fingerprints_of_canonical_copies(spark):
    korean, marks = "한국어 각", "ẹ́ ǭ q\u0323\u0307"
    same = [(korean, unicodedata.normalize("NFD", korean)), ("각", "가\u11a8"), ("ẹ\u0301", "é\u0323"), ("e\u0323\u0301\u0327", "e\u0327\u0301\u0323"), (marks, unicodedata.normalize("NFD", marks))]
    same += [("x\u0301\u0323\u0327\u0315\u0308", unicodedata.normalize("NFD", "x\u0301\u0323\u0327\u0315\u0308")), ("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος"), ("Å", "Å"), ("Å", "Å")]
    texts = [t for pair in same for t in pair] + ["e\u0301\u0300", "e\u0300\u0301", "가", "각"]
    got = {r.doc_id: r.fingerprint for r in fingerprint.edited_likeness(docs(spark, *texts)).collect()}
    for i, (a, b) in enumerate(same):
        assert a != b and got[2 * i] == got[2 * i + 1], ascii((a, b))
    assert got[len(texts) - 4] != got[len(texts) - 3] and got[len(texts) - 2] != got[len(texts) - 1]
    canon = [r[0] for r in docs(spark, *texts).orderBy("doc_id").select(fingerprint.canonical(F.col("text"))).collect()]
    assert canon == [unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).casefold()) for t in texts]


def test_line_dedup_keeps_first(spark):
    texts = [f"own line {i}\nshared footer\n\ntail {i}" for i in range(12)] + [None, ""]
    got = {r.doc_id: r for r in linededup.dedup(docs(spark, *texts)).collect()}
    assert got[0].text == texts[0] and all(got[i].text == f"own line {i}\n\ntail {i}" and got[i].n_removed == 1 for i in range(1, 12))
    assert got[12].text is None and got[13].text == "" and linededup.dedup(docs(spark, "a").limit(0)).count() == 0
    few = docs(spark, *texts).withColumn("source", F.lit("one"))
    assert linededup.dedup(few).agg(F.sum("n_removed")).first()[0] == 0


def test_vectors_recall_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(1500, None), (1600, [0.0] * 16), (1700, [float("nan")] * 16), (1800, [1.0])] + [(7, x[7].astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.search(df).collect()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        hits += len({r.vec_id for r in own} & set(want))
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
    assert hits >= 0.9 * 150 and {r.query_id for r in got} == set(range(0, 1500, 100))
    assert vectors.search(df.limit(0)).count() == 0 and vectors.search(df.filter("vec_id = 1500")).count() == 0


def test_gradient_of_the_network():
    net = langid.ByteNet(["a", "b"], hidden=3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (4, 6)), np.array([0, 1, 1, 0])

    def loss():
        return -np.log(net.positions(x)[:, np.arange(4), y]).mean()

    g = net.gradient(x, y)
    for name, at in (("rec", (0, 1, 4)), ("rec", (1, 2, 8)), ("out", (2, 1)), ("bias", (0,)), ("table", (0, 98, 5))):
        base = net.p[name][at]
        net.p[name][at] = base + 1e-2
        up = loss()
        net.p[name][at] = base - 1e-2
        down = loss()
        net.p[name][at] = base
        assert g[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_language_held_out_and_odd_texts(spark):
    rng, texts, langs = random.Random(3), [], []
    for _ in range(160):
        k = rng.randrange(2)
        texts.append(" ".join("".join(rng.choice("abcde" if k else "vwxyz") for _ in range(5)) for _ in range(20)))
        langs.append("la" if k else "lb")
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))] + [(900, None, "la"), (901, "", None), (902, "12 !!", "lb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(langid.sample(df))).collect()}
    held = [i for i in range(160) if langid.crc_held_out(i)]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert langid.fit(langid.sample(df.limit(0))) is None and langid.predict(df, None).filter("lang_pred <> 'und'").count() == 0


def test_pipeline_rejects_what_is_in_no_learned_language(spark):
    import corpus_pipeline as p

    rng = random.Random(8)
    words = {g: ["".join(rng.choice(x) for x in ("bdlmnr", v, "lnrst", v)[: rng.randrange(2, 5)]) for _ in range(200)] for g, v in (("la", "aei"), ("lb", "ouy"))}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(40)), g) for i in range(300) for g in (("la", "lb")[i % 2],)]
    rows += [(900 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)), None) for i in range(20)]
    rows += [(930, "при вет мир как дела сегодня хорошая погода", None), (931, "これは日本語の文章です", None), (932, "12 !!", None), (933, None, None), (934, words["la"][0] + " " + words["la"][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in p.language(spark, df, "").collect()}
    assert len(got & set(range(300))) >= 299 and {i for i in got if i >= 900} == {934}
    none = {r.doc_id for r in p.language(spark, df.withColumn("lang", F.lit(None).cast("string")), "").collect()}
    assert none == {r[0] for r in rows} - {932, 933}


def test_quality_held_out(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(400):
        good = rng.random() < 0.7
        rows.append((i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) if good else "buy " * rng.randrange(20, 40)))
        labels.append((i, int(good)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    table = quality.feature_table(df)
    model = quality.fit(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.score(table, model).collect()}
    assert len(got) == 402 and np.mean([got[i].predicted == q for i, q in labels]) > 0.95 and 0 <= got[900].score <= 1
    assert quality.score(table.limit(0), model).count() == 0 and quality.fit(table, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_pipeline_stages_keep_columns(spark, prose, tmp_path):
    import corpus_pipeline as p

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = docs(spark, *(x for x in prose for _ in range(2))).select(columns)
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, now, "")
        assert kept.columns == columns, name
        now = p.stored(kept)
    assert now.count() > 20 and p.STAGES[-1][1](spark, now, "").select("doc_id").distinct().count() == now.count()
