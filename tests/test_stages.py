"""Sources, the whole gate, images, stores, hooks, streams and parameters, on small files and tables."""

import io
import json
import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium import config, logs
from scriptorium.config import DEFAULT
from scriptorium.functions import pii, text
from scriptorium.operators import gate, governance, images, metrics, retrieval, stores
from scriptorium.sources import readers
from scriptorium.streaming import streams

REGION = "page_id string, idx int, text string, conf double, bbox array<int>"
TEXT = "page_id string, text string"


def regions(spark, *texts, page="d_p0001"):
    return spark.createDataFrame([(page, i, t, 0.9, [0, 70 * i, 400, 30]) for i, t in enumerate(texts)], REGION)


def verdicts(df):
    return [(r.evidence_tier, r.accepted, r.reject_reason, r.cer) for r in df.orderBy("page_id", "idx").collect()]


THREE = ("the first printed line", "a second line of text", "and the third one here")


def test_gate_without_texts(spark):
    got = gate.audit(regions(spark, *THREE))
    assert verdicts(got) == [("raw", False, "reference_alignment_failed", None)] * 3 and gate.accepted(got).count() == 0
    assert got.columns[-4:] == ["reference_text_normalized", "evidence_tier", "accepted", "reject_reason"] and got.first().ocr_config == "--oem 1 --psm 7 -l eng"


def test_gate_gold_and_one_wrong_line(spark):
    gold = spark.createDataFrame([("d_p0001", "\n".join((*THREE[:2], "THIS DOES NOT MATCH")))], TEXT)
    got = gate.audit(regions(spark, *THREE), gold=gold)
    assert verdicts(got)[:2] == [("gold", True, None, 0.0)] * 2 and verdicts(got)[2][:2] == ("raw", False)
    assert [(r.id, r.doc_id, r.page_ids) for r in gate.accepted(got).orderBy("id").collect()] == [(f"d_p0001_l00{i}", "d", ["d_p0001"]) for i in range(2)]


@pytest.mark.parametrize(("lines", "want"), [
    ((*THREE, "one more line"), ["silver"] * 3),
    (("a heading that was not detected", *THREE), ["silver"] * 3),
    ((*THREE, *(f"extra {i}" for i in range(6))), ["reference_alignment_failed"] * 3),
    ((THREE[0], THREE[1], "qq zz xx ww vv kk jj yy"), ["silver", "silver", "cer_above_threshold"]),
    ((THREE[0], "  ", THREE[1], THREE[2]), ["silver"] * 3),
])
def test_gate_references(spark, lines, want):
    refs = spark.createDataFrame([("d_p0001", "\n".join(lines)), ("other_p0001", "x")], TEXT)
    assert [r[2] or r[0] for r in verdicts(gate.audit(regions(spark, *THREE), refs=refs))] == want


def test_gate_short_lines_and_moved_regions(spark):
    rows = regions(spark, *THREE)
    refs = spark.createDataFrame([("d_p0001", "\n".join(THREE))], TEXT)
    assert {r[2] for r in verdicts(gate.audit(rows, refs=refs, config=replace(DEFAULT, min_line_chars=1000)))} == {"REJECT_TOO_SHORT"}
    layout = rows.select(F.format_string("%s_r%03d", "page_id", "idx").alias("region_id"), "bbox")
    moved = layout.withColumn("bbox", F.when(F.col("region_id").endswith("r000"), F.array(*map(F.lit, (9999, 9999, 5, 5)))).otherwise(F.col("bbox")))
    assert [r[2] for r in verdicts(gate.audit(rows, layout=moved, refs=refs))] == ["layout_provenance_mismatch", None, None]
    assert [r[2] for r in verdicts(gate.audit(rows, layout=layout.limit(0), refs=refs))] == [None] * 3
    assert gate.audit(rows.limit(0), layout, refs, refs).count() == 0
    assert gate.page_config() == "--psm 4 -l eng"


def test_transcription_is_pluggable(spark):
    rows = spark.createDataFrame([(1, b"abc", 3, 1), (2, b"", 0, 0), (3, None, 4, 4)], "id int, crop binary, w int, h int")
    got = {r.id: (r.text, r.conf) for r in gate.transcribed(rows, lambda c, w, h: (c.decode(), 0.5)).collect()}
    assert got == {1: ("abc", 0.5), 2: ("", 0.0), 3: ("", 0.0)}


def page(skewed=0.0):
    gray = np.full((120, 160), 245, np.uint8)
    for y in range(20, 100, 16):
        gray[y : y + 5, 15:145] = 15
    return images.rotated(gray, skewed) if skewed else gray


def test_page_files_and_images(spark, tmp_path):
    for name in ("work/scan_0001.png", "work/scan_0002.PNG", "flat_p0003.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(images.png(page()))
    (tmp_path / "work" / "notes.txt").write_text("no page")
    files = {r.id: (r.doc_id, r.page_num) for r in readers.page_files(spark, str(tmp_path)).collect()}
    assert files == {"work_p0001": ("work", 1), "work_p0002": ("work", 2), "flat_p0003": ("flat", 3)}
    got = readers.page_images(spark, str(tmp_path / "work")).collect()
    assert {r.rel for r in got} == {"scan_0001.png", "scan_0002.PNG"}
    assert all((np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) == page()).all() for r in got)
    walked = readers.corpus_files(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.filename) for r in walked} == {("work", "scan_0001.png"), ("work", "scan_0002.PNG"), ("work", "notes.txt")}
    with pytest.raises(FileNotFoundError):
        readers.page_files(spark, str(tmp_path / "none"))
    (tmp_path / "work" / "none.png").write_bytes(images.png(page()))
    with pytest.raises(Exception, match="no page number"):
        readers.page_files(spark, str(tmp_path)).collect()


def test_colour_images_become_gray_and_broken_ones_fail(spark, tmp_path):
    raw = b"".join(b"\0" + bytes((200, 100, 50)) * 4 for _ in range(3))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    (tmp_path / "a1.png").write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))
    row = readers.page_images(spark, str(tmp_path)).first()
    assert set(row.pixels) == {round(0.299 * 200 + 0.587 * 100 + 0.114 * 50)} and (row.width, row.height) == (4, 3)
    (tmp_path / "b2.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="could not read image"):
        readers.page_images(spark, str(tmp_path)).collect()


def test_roots_with_odd_names(spark, tmp_path):
    root = tmp_path / "a+b (c).d"
    (root / "w").mkdir(parents=True)
    (root / "w" / "s7.png").write_bytes(images.png(page()))
    assert [r.id for r in readers.page_files(spark, str(root)).collect()] == ["w_p0007"] or "%" in readers.page_files(spark, str(root)).first().path


def test_image_stage(spark):
    blank = np.full((120, 160), 250, np.uint8)
    rows = [(k, 160, 120, g.tobytes()) for k, g in enumerate((page(), blank, page(4.0)))]
    got = {r.page_id: r for r in images.cleaned(spark.createDataFrame(rows, "page_id long, width int, height int, pixels binary")).collect()}
    assert set(got) == {0, 2} and all(r.ink_ratio > 5 * DEFAULT.blank_ink and r.png.startswith(b"\x89PNG") for r in got.values())
    assert abs(images.skew(page(4.0))) == pytest.approx(4.0, abs=0.6) and abs(images.skew(images.deskewed(page(4.0)))) <= 1.0
    assert (images.rotated(page(), 0.0) == page()).all() and images.rotated(blank, 7.0).min() == 250
    counted = images.ink(spark.createDataFrame([(1, 4, 2, bytes([0, 0, 7, 0x00, 0x10, 0x01, 255, 0]))], "page_id int, width int, height int, pixels binary")).first()
    assert counted.ink_ratio == 4 / 8
    assert images.enhanced(counted) is counted and images.enhanced(1, True, lambda x: x + 1) == 2
    with pytest.raises(ValueError):
        images.enhanced(counted, True)


def test_denoising_keeps_edges():
    rng = np.random.default_rng(1)
    noise = (page().astype(int) + rng.integers(-40, 41, (120, 160))).clip(0, 255).astype(np.uint8)
    assert images.noisy(noise)
    clean = images.denoised(noise[:40, :60], h=40)
    assert np.abs(clean.astype(int) - page()[:40, :60]).mean() < np.abs(noise[:40, :60].astype(int) - page()[:40, :60]).mean() / 2
    flat = np.full((12, 12), 90, np.uint8)
    assert (images.denoised(flat) == flat).all()


def test_pages_are_written_by_document(spark, tmp_path):
    pages = spark.createDataFrame([("d1", "p1", images.png(page())), ("d2", "p2", b"x")], "doc_id string, page_id string, png binary")
    readers.write_pages(pages, str(tmp_path / "clean"))
    assert {p.name for p in (tmp_path / "clean").iterdir() if p.is_dir()} == {"doc_id=d1", "doc_id=d2"}


def test_json_last_wins_by_file_and_place(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"k": k % 3, "v": f"a{k}"}) + "\n" for k in range(5000)) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"k": 1, "v": "b"}) + "\n")
    got = {r.k: r.v for r in readers.json_last(spark, str(tmp_path), "k int, v string", "k").collect()}
    assert got == {0: "a4998", 1: "b", 2: "a4997"}
    assert readers.json_last(spark, str(tmp_path / "none"), "k int, v string", "k").count() == 0
    (tmp_path / "c.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_last(spark, str(tmp_path), "k int, v string", "k").collect()


def test_gold_and_reference_files(spark, tmp_path):
    gold = tmp_path / "gold"
    gold.mkdir()
    (gold / "1.jsonl").write_text('# note\n{"page_id": "p1", "text": "old"}\n{"page_id": "p2", "text": "REPLACE ME"}\nbroken\n')
    (gold / "2.jsonl").write_text('{"page_id": "p1", "text": "new"}\n\n{"page_id": "p3", "text": "three"}\n')
    (gold / "readme.txt").write_text('{"page_id": "p9", "text": "not read"}')
    assert {r.page_id: r.text for r in readers.gold_labels(spark, str(gold)).collect()} == {"p1": "new", "p3": "three"}
    single = tmp_path / "labels.txt"
    single.write_text('{"page_id": "p1", "text": "a"}\n{"page_id": "p1", "text": "b"}\n')
    assert [r.text for r in readers.gold_labels(spark, str(single)).collect()] == ["b"]
    (tmp_path / "d_p0001.ref.txt").write_text("one\ntwo\n")
    (tmp_path / "d_p0002.ref.txt").write_text(" \n")
    assert {r.page_id: r.text for r in readers.reference_texts(spark, str(tmp_path)).collect()} == {"d_p0001": "one\ntwo\n", "d_p0002": None}


def test_tasks(spark, tmp_path):
    (tmp_path / "tasks.jsonl").write_text('# template\n{"id": "t1", "question": "q", "verifiable": true, "judged": false, "gold": "g", "gold_pages": ["p1"], "needs_research": false}\n{bad\n')
    (row,) = readers.tasks(spark, str(tmp_path / "tasks.jsonl")).collect()
    assert row.id == "t1" and row.verifiable and row.gold_pages == ["p1"]


def test_index_round_trip_and_checks(spark, tmp_path):
    schema = "id string, doc_id string, text string, page_ids array<string>, embedding array<float>"
    chunks = spark.createDataFrame([("d_c00000", "d", "a", ["p1"], [1.0, 0.0]), ("d_c00001", "d", "b", ["p1", "p2"], [0.0, 1.0])], schema)
    readers.write_index(chunks, str(tmp_path / "index"), dim=2)
    got = readers.read_index(spark, str(tmp_path / "index")).orderBy("id").collect()
    assert [(r.id, r.text, r.page_ids) for r in got] == [("d_c00000", "a", ["p1"]), ("d_c00001", "b", ["p1", "p2"])]
    for bad, kind in ((chunks, "trees"), (chunks.withColumn("embedding", F.when(F.col("id") == "d_c00000", F.col("embedding"))), "exact"), (chunks.withColumn("embedding", F.when(F.col("id") == "d_c00000", F.col("embedding")).otherwise(F.array(F.lit(1.0).cast("float")))), "exact")):
        with pytest.raises(ValueError):
            readers.write_index(bad, str(tmp_path / "bad"), kind)


def test_retrieval_with_prefixes_and_blocks(spark, monkeypatch):
    seen = []
    monkeypatch.setitem(retrieval.MODELS, "spy", lambda: lambda texts, dim: seen.append(texts) or np.zeros((len(texts), dim), np.float32))
    with pytest.raises(ValueError, match="unknown model"):
        retrieval.loaded("none")
    assert retrieval.loaded("spy") is retrieval.loaded("spy")
    docs = spark.createDataFrame([(i, f"alpha{i} beta{i % 7}") for i in range(60)], "vec_id long, text string")
    conf = replace(DEFAULT, dim=64)
    v = retrieval.encode(docs, conf)
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in v.select("embedding").limit(5).collect())
    asked = docs.select(F.col("vec_id").alias("query_id"), "text")
    got = retrieval.retrieve(asked, v, 3, conf).collect()
    assert len(got) == 180 and all(r.score <= 1.0 for r in got)
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plain = sorted(map(tuple, retrieval.top_k(q, v, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 11)
    assert sorted(map(tuple, retrieval.top_k(q, v, 4).collect())) == plain
    assert retrieval.cell_top_k(q, v.limit(0), 3).count() == 0 and retrieval.top_k(q.limit(0), v, 3).count() == 0


def test_deep_redaction(spark):
    schema = "id string, t string, a array<string>, m map<string,string>, s struct<q:string,l:array<struct<e:string,n:int>>>"
    rows = [("doc123456789_p0001", "leak@example.com", ["a b@c.de", None], {"k@x.yz": "1234567 89"}, ("q", [("z@y.xx", 5)])), ("d2", None, None, None, None), ("d3", "plain", [], {}, ("q", []))]
    got = {r.id: r for r in pii.scrub(spark.createDataFrame(rows, schema), "t", "a", "m", "s").collect()}
    assert got["doc123456789_p0001"] == ("doc123456789_p0001", "[REDACTED_EMAIL]", ["a [REDACTED_EMAIL]", None], {"k@x.yz": "[REDACTED_PHONE]"}, ("q", [("[REDACTED_EMAIL]", 5)]))
    assert got["d2"][1:] == (None,) * 4 and got["d3"] == rows[2]


def test_hits_cover_all_patterns(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789+- ab@.c১২\t") for _ in range(rng.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.redact("t").alias("r"), F.size(pii.detect("t")).alias("n"))
    assert all(r.r == pii.redacted(texts[r.i]) for r in df.collect())


def test_word_distances_of_many_tokens(spark):
    a = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(a, [*a[:1000], "x", *a[1002:]]), ([], ["a"]), (["a", "b"], ["b", "a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.word_distance(F.col("a"), F.col("b"))).collect()] == [2, 1, 2]
    glued = spark.createDataFrame([("so , it is ।",)], "t string").select(text.wer_tokens(F.col("t"))).first()[0]
    assert glued == ["so,", "it", "is।"]
    lines = spark.createDataFrame([(" a \n\n b\r\nc\x1cd ",)], "t string").select(text.text_lines(F.col("t"))).first()[0]
    assert lines == ["a", "b", "c", "d"]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(text.unit(F.col("v"))).collect()
    assert np.allclose(unit[0][0], [0.6, 0.8]) and unit[1][0] == [0.0, 0.0]


def test_review_queue_models_and_cache(spark, tmp_path):
    path = str(tmp_path)
    items = stores.enqueue(spark.createDataFrame([("c1", 0.2), ("c2", None)], "chunk string, score double"), f"{path}/review")
    ids = {r.chunk: r.id for r in items.collect()}
    assert {r.id for r in stores.waiting(spark, f"{path}/review").collect()} == set(ids.values())
    stores.resolve(spark.createDataFrame([(ids["c1"], "keep")], "id string, decision string"), f"{path}/review")
    assert [json.loads(r.item)["chunk"] for r in stores.waiting(spark, f"{path}/review").collect()] == ["c2"]
    assert stores.waiting(spark, f"{path}/none").count() == 0
    rows = spark.createDataFrame([("ocr", "m/1", {"cer": 0.1}, 1), ("ocr", "m/2", {"cer": 0.05}, 2)], "component string, path string, metrics map<string,double>, ts int")
    first, again = (sorted(r.version for r in stores.register(rows, f"{path}/models").collect()) for _ in range(2))
    assert first == again and len(set(first)) == 2 and all(len(v) == 12 for v in first)
    assert stores.latest(rows, "component", "ts").first().path == "m/2"
    at = "timestamp_seconds({})"
    for k, v in ((1, "a"), (2, "b")):
        stores.put(spark.range(1).select(F.lit("x").alias("key"), F.lit(v).alias("value"), F.expr(at.format(k)).alias("ts")), f"{path}/cache")
    keys = spark.createDataFrame([("x",), ("y",)], "key string")
    assert {r.key: r.value for r in stores.get(spark, f"{path}/cache", keys).collect()} == {"x": "b", "y": None}


def test_notes_are_recalled(spark, tmp_path):
    stores.remember(spark.createDataFrame([(1, "the gate rejects short lines"), (2, "windows overlap by tokens")], "note_id long, text string"), f"{tmp_path}/notes")
    asked = spark.createDataFrame([(7, "overlap of windows")], "query_id long, text string")
    (row,) = stores.recall(spark, f"{tmp_path}/notes", asked, 1).collect()
    assert (row.query_id, row.rank, row.note_id) == (7, 1, 2)


def test_functions_in_sql_text(spark):
    from scriptorium.functions import sql

    assert sql.register(spark) == ["pii_spans", "form_c", "redact"]
    assert spark.sql("SELECT redact('to a@b.cd') r, form_c('e\u0301') c").first() == ("to [REDACTED_EMAIL]", "é")
    rows = spark.sql("SELECT t.id, s.* FROM VALUES (1, 'a@b.cd or 12345678'), (2, NULL), (3, 'x') t(id, text), LATERAL pii_spans(t.text) s ORDER BY s.start").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 6, "EMAIL"), (1, 10, 18, "PHONE")]


def test_traces_are_appended(spark, tmp_path):
    step = "'r1' AS run, {0} AS step, 'retrieve' AS tool, map('k', '10') AS args, 0.3 AS top_score, 10 AS k, 5 AS n, false AS abstained"
    for n in (1, 2):
        stores.log(spark.range(1).selectExpr(*step.format(n).split(", ", 3)[:3], "map('k', '10') AS args", "0.3 AS top_score", "10 AS k", "5 AS n", "false AS abstained"), f"{tmp_path}/trace")
    assert [r.step for r in stores.read(spark, f"{tmp_path}/trace", stores.TRACE).orderBy("step").collect()] == [1, 2]


def test_wiring_and_tools(spark):
    order = []
    features = {name: (lambda df, name=name: order.append(name)) for name, _ in governance.WIRING}
    hooks = governance.wire(features | {"pii": lambda df: pii.scrub(df, "text")})
    out = hooks.run("after_ocr", spark.createDataFrame([("d_p0001", "to a@b.cd")], "id string, text string")).first()
    assert out == ("d_p0001", "to [REDACTED_EMAIL]")
    hooks.run("on_tool_call", spark.range(1))
    assert order == ["tracing", "guardrails"]
    with pytest.raises(ValueError, match="no feature"):
        governance.wire({"pii": print})
    tools = governance.Tools()
    tools.add("calculator", governance.calculate)
    value = spark.createDataFrame([("2 * 4",)], "e string").select(tools.call("calculator", F.col("e"))).first()[0]
    assert value == 8 and "retrieve" in tools.missing() and len(tools.NAMES) == 9
    for bad in (lambda: tools.add("other", print), lambda: tools.call("cite"), lambda: governance.extract("phone", F.lit("x"))):
        with pytest.raises(ValueError):
            bad()


def test_snapshot_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b").write_bytes(b"1")
    (tmp_path / "a.txt").write_bytes(b"2")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select(F.regexp_replace("path", f"^.*{tmp_path.name}/", "").alias("path"), "content")
    digests = [hashlib.sha256(x).hexdigest() for x in (b"1", b"2")]
    assert governance.snapshot(files).first().version_id == hashlib.sha256("".join(digests).encode()).hexdigest()[:16]
    assert {r.path: (r.sha256, r.size) for r in governance.manifest(files).collect()} == {"a/b": (digests[0], 1), "a.txt": (digests[1], 1)}
    for _ in range(2):
        readers.append_log(governance.snapshot(files), str(tmp_path) + "-versions")
    assert spark.read.json(str(tmp_path) + "-versions").count() == 2


def test_streams(spark, tmp_path):
    rows = [(k, f"2026-01-0{1 + k % 3} 0{k % 9}:00:00", k % 4, "view", float(k)) for k in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.unionAll(events).write.parquet(f"{tmp_path}/events")
    source = lambda: readers.stream(spark, f"{tmp_path}/events", events.schema)
    once = streams.run_available(streams.deduplicated(source()), "once", checkpoint=f"{tmp_path}/once")
    assert once.count() == 40 and once.select("event_id").distinct().count() == 40
    want = sorted(map(tuple, streams.sessions(events).collect()))
    assert sum(n for *_, n in want) == 40 and sorted(map(tuple, streams.run_available(streams.sessions(events_stream(spark, events, tmp_path, "s")), f"sessions_{tmp_path.name.replace('-', '_')}", "complete", f"{tmp_path}/sess").collect())) == want
    assert streams.sliding(events).agg(F.sum("n")).first()[0] == 160
    made = streams.ingested(source(), lambda df: df.select("event_id", (F.col("value") * 2).alias("v")), f"{tmp_path}/ingest")
    assert made.count() == 80
    events.limit(3).write.mode("append").parquet(f"{tmp_path}/events")
    assert streams.ingested(source(), lambda df: df.select("event_id", (F.col("value") * 2).alias("v")), f"{tmp_path}/ingest").count() == 83


def events_stream(spark, events, tmp_path, name):
    events.write.parquet(f"{tmp_path}/{name}")
    return readers.stream(spark, f"{tmp_path}/{name}", events.schema)


def test_parameters_and_logs(tmp_path):
    (tmp_path / "c.yaml").write_text("# parameters\nseed: 7\nchunk:\n  chunk_tokens: 64  # tokens\n  overlap: 8\nocr:\n  ocr_lang: 'ben'\n  unknown: x\n")
    got = config.load(str(tmp_path / "c.yaml"))
    assert (got.seed, got.chunk_tokens, got.overlap, got.ocr_lang, got.k) == (7, 64, 8, "ben", 10)
    assert json.loads(config.snapshot(got))["seed"] == 7
    with pytest.raises(ValueError):
        config.parsed("no key here")
    out = io.StringIO()
    log = logs.logger(f"test-{tmp_path.name}", out)
    log.info('a "quoted" %s', "line")
    row = json.loads(out.getvalue())
    assert row["msg"] == 'a "quoted" line' and row["lvl"] == "INFO" and logs.logger(f"test-{tmp_path.name}") is log


def test_percentiles_and_f1(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=9001)] + [("b", 1.0), ("b", 2.0), ("c", 5.0), ("d", None)] + [("e", 3.0)] * 6000 + [("e", 4.0)] * 300
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.p for r in metrics.exact_percentile(df, "g", "v", 0.95).collect()}
    for g in "abce":
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], 0.95)), g
    assert "d" not in got
    pairs = spark.createDataFrame([(1, "a b b", "b b c"), (2, "", ""), (3, "x", "y")], "pair int, hyp string, ref string")
    assert {r.pair: round(r.f1, 6) for r in metrics.f1_of_pairs(pairs).collect()} == {1: 0.666667, 2: 0.0, 3: 0.0}
    flags = spark.createDataFrame([(0.3, True), (0.1, True), (None, None), (0.0, False)], "psi double, ok boolean")
    assert [r[0] for r in flags.select(metrics.retrain(F.col("psi"), F.col("ok"))).collect()] == [True, False, False, True]
