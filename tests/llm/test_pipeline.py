import random
import zlib

import numpy as np
import pytest
from test_jaccard import brute as brute_components
from test_linededup import brute as brute_lines

import corpus_pipeline as pipeline
from scriptorium.llm import common, langid, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, SCHEMA + extra)


def plain(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Two languages; boilerplate on 12 sites, near and exact copies, passages, nulls, repeated ids and rows, U+FFFD, no letters."""
    rng = random.Random(11)
    words = {g: ["".join(rng.choice(x) for x in ("bdlmnr", v, "lnrst", v)) for _ in range(400)] for g, v in (("la", "aei"), ("lb", "ouy"))}

    def prose(g, n):
        return " ".join(rng.choice(words[g]) for _ in range(n))

    passage, out = prose("la", 20) + " é\ufffdü " + prose("la", 5), []
    for i in range(160):
        g = ("la", "lb")[i % 2]
        parts = [prose(g, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4))]
        if i % 4 == 0:
            parts.insert(rng.randrange(len(parts) + 1), "bali rimo menu sala")
        if i % 10 == 3:
            parts[-1] += " \ufffd " + passage + " ñ"
        out.append((i, "\n".join(parts), g if i % 7 else None, f"s{i % 12}"))
    for i in range(20):
        t = out[i * 3][1].split(" ")
        if i % 2:
            t[len(t) // 2] = rng.choice(words["la"])
        out.append((300 + i if i % 5 else (None, i)[i % 2], " ".join(t), "la", "copy"))
    out += [out[5], out[5], (None, None, "la", "s1"), (None, "", None, None), (401, None, None, "s2"), (402, "12 !! 34", "la", "s3"), (403, "bali rimo menu sala", "la", "s4")]
    out += [(7, prose("la", 30), "lb", "other"), (None, prose("lb", 30), "lb", "s9"), (404, "xq zk jw vv qx kz wj " * 9, None, "s5"), (405, "これは日本語の文章です。今日は天気がいい。", None, "s6")]
    return [(*r, len(r[1] or "")) for r in out]


def slow_language(spark, rows):
    """Keeps rows by the same model, row by row, outside Spark."""
    sample = langid.sample(frame(spark, rows).select("doc_id", "text", "lang"))
    net, model = langid.fit(sample), langid.familiar(sample)
    keep = []
    for r in rows:
        raw = (r[1] or "").encode()
        letters = any(c.isalpha() for c in r[1] or "")
        if letters and net.documents([raw])[0].max() >= pipeline.LEAST_SCORE and model.knows([r[1]])[0]:
            keep.append(r)
    return keep


def slow_lines(rows):
    out = []
    for (d, t, g, s, n), new in zip(rows, brute_lines([(r[0], r[3], r[1]) for r in rows], 10)):
        if new == t or (new or "").strip(" "):
            out.append((d, new, g, s, None if new is None else len(new)))
    return out


def slow_near(rows):
    """Groups by the definition, by row; one of the smallest doc_id stays of each."""
    groups = brute_components([(k, r[1]) for k, r in enumerate(rows)])
    best = {}
    for (k, n, component), r in zip(groups, rows):
        key = (r[0] is None, r[0] or 0, k)
        own = component if n else ("none", k)
        if own not in best or key < best[own][0]:
            best[own] = (key, r)
    return [r for _, r in best.values()]


def slow_strings(rows, width=50):
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            first[raw[i : i + width]] = min(key(d), first.get(raw[i : i + width], key(d)))
    out = []
    for d, t, g, s, _ in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < key(d):
                gone[i : i + width] = b"\1" * width
        at, kept = 0, ""
        for c in t or "":
            size = len(c.encode())
            kept += c if not any(gone[at : at + size]) else ""
            at += size
        if not any(gone) or kept.strip(" "):
            out.append((d, kept, g, s, len(kept)))
    return out


def same_but_for_the_choice(got, want):
    """Of copies with one doc_id (or none) any may stay, so these are compared by number."""
    assert sorted(repr(r[0]) for r in got) == sorted(repr(r[0]) for r in want)
    unique = lambda rows: sorted((r for r in rows if sum(x[0] == r[0] for x in rows) == 1 and r[0] is not None), key=repr)
    assert unique(got) == unique(want)


def test_language(spark, rows):
    got = plain(pipeline.language(spark, frame(spark, rows), ""))
    assert got == sorted(slow_language(spark, rows), key=repr)
    assert not {402, 404, 405} & {r[0] for r in got} and {r[0] for r in got} >= set(range(160)) and all(r[1] for r in got)


def test_lines(spark, rows):
    assert plain(pipeline.lines(spark, frame(spark, rows), "")) == sorted(slow_lines(rows), key=repr)


def test_near_copies(spark, rows):
    got = plain(pipeline.near_copies(spark, frame(spark, rows), ""))
    same_but_for_the_choice(got, slow_near(rows))
    assert len(got) < len(rows) and sum(r[1] is None for r in got) == 2


def test_repeated_strings(spark, rows):
    got = plain(pipeline.repeated_strings(spark, frame(spark, rows), ""))
    assert got == sorted(slow_strings(rows), key=repr)
    assert any("\ufffd" in r[1] for r in got) and got != sorted(rows, key=repr)


def test_sequences(spark, rows):
    pieces = pipeline.sequences(spark, frame(spark, rows), "").collect()
    words = packing.word_tokenizer(packing.default_tokenizer())
    want = sorted((repr(d), np.append(words.whole(t or ""), [2]).astype("<u4").tobytes()) for d, t, *_ in rows)
    held, spans = {}, {}
    for p in pieces:
        spans.setdefault(p.sequence_id, []).append((p.offset, p.length))
        held.setdefault((repr(p.doc_id), p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    ids = {}
    for d, raw in want:
        ids.setdefault((d, len(raw) // 4), []).append(raw)
    assert {k: sum(n for _, n, _ in v) for k, v in held.items()} == {k: sum(len(x) // 4 for x in v) for k, v in ids.items()}
    for k, own in held.items():
        assert all(any(zlib.crc32(raw[4 * s : 4 * (s + n)]) == crc for raw in ids[k]) for s, n, crc in own)
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0


def test_run_applies_all_stages(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    place = common.mark()
    got = pipeline.run(spark, str(tmp_path))
    assert common.mark() == place + 1  # of all tables only the result stays
    want = slow_strings(slow_near(slow_lines(slow_language(spark, rows))))
    words = packing.word_tokenizer(packing.default_tokenizer())
    per = {}
    for p in got.collect():
        if p.start == 0:
            per.setdefault(p.doc_id, []).append(p.doc_tokens)
    assert sorted(map(repr, (d for d, n in per.items() for _ in n))) == sorted(repr(r[0]) for r in want)
    for d, t, *_ in want:
        if d is not None and sum(r[0] == d for r in want) == 1:
            assert per[d] == [len(words.whole(t)) + 1]


def test_columns_with_clashing_names_and_empty_tables(spark, rows):
    extra = ", n_lines int, n_removed string, _lang string, _score double, _known int, _row long, _rest string, key long, batch int"
    wide = frame(spark, [(*r, 1, "a", "b", 0.5, 2, 3, "c", 4, 5) for r in rows], extra)
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, wide, "")
        assert kept.columns == wide.columns
        assert {tuple(r) for r in kept.select(*wide.columns[5:]).distinct().collect()} == {(1, "a", "b", 0.5, 2, 3, "c", 4, 5)}
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame(spark, []), "").count() == 0
