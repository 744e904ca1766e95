import random

import numpy as np
import pyarrow as pa

from scriptorium.llm import packing

SCHEMA = "doc_id long, text string, start long, ids string, sequence_id string, n_chars string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", "s", "n") for i, t in rows], SCHEMA)


def held(pieces, window):
    """Documents by (doc_id, number of tokens) as the ids of their pieces; checks sequences on the way."""
    sequences, docs = {}, {}
    for p in pieces:
        assert 0 < p.length <= window and len(p.ids) == 4 * p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.ids))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        if at & (at - 1):
            assert at == window or window & (window - 1) == 0
            padding += window - at
    return docs, padding


def test_odd_rows(spark):
    words = packing.word_tokenizer(packing.default_tokenizer())
    rows = [(None, "null id one"), (None, "another without an id"), (5, "first of five"), (5, "second row with that id"), (5, "second row with that id"), (6, None), (7, ""), (8, "\x1c ² _ 日本")]
    docs, padding = held(packing.pack(frame(spark, rows), window=16, pool=4).collect(), 16)
    want = {}
    for i, t in rows:
        ids = words.whole(t or "").tolist() + [packing.END]
        want.setdefault((i, len(ids)), []).append(ids)
    assert padding == 0 and set(docs) == set(want)
    for key, own in docs.items():
        assert sum(len(x) // 4 for _, x in own) == sum(map(len, want[key]))
        for start, raw in own:
            ids = np.frombuffer(raw, "<u4").tolist()
            assert any(x[start : start + len(ids)] == ids for x in want[key])
    assert packing.pack(frame(spark, [])).count() == 0


def test_a_very_long_text_is_cut_into_windows(spark):
    words = packing.word_tokenizer(packing.default_tokenizer())
    text = " ".join(f"word{i % 977}" for i in range(120_000))
    pieces = sorted(packing.pack(frame(spark, [(1, text)])).collect(), key=lambda p: p.start)
    assert b"".join(p.ids for p in pieces) == np.append(words.whole(text), [packing.END]).astype("<u4").tobytes()
    assert all(p.length == packing.WINDOW for p in pieces[:-8])


def test_no_padding_but_at_the_end(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(rng.randrange(1, 900)))) for i in range(400)]
    pieces = packing.pack(frame(spark, rows)).collect()
    docs, padding = held(pieces, packing.WINDOW)
    assert padding == 0 and len(docs) <= 400 and sum(p.length for p in pieces) == sum(n for _, n in {(p.doc_id, p.doc_tokens) for p in pieces})


class Counted:
    """A tokenizer whose texts are their numbers of ids."""

    def ids(self, text):
        return np.arange(int(text), dtype="<u4")


def test_long_documents_leave_only_what_waits():
    import tracemalloc

    batches = lambda n: (pa.RecordBatch.from_pydict({"doc_id": list(range(k, k + 50)), "text": ["200001"] * 50}) for k in range(0, n, 50))
    tracemalloc.start()
    seen = total = 0
    try:
        for b in packing.packed(batches(1500), Counted(), packing.Packer(), 0):
            seen += b.num_rows
            total += sum(b.column("length").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 1500 * 200_002 and seen > 1500 * 48 and peak < 60e6  # 1.2 GB of ids


def test_pieces_of_long_and_short_documents_hold_their_ids():
    sizes = [0, 5000, 4095, 4094, 9000, 1, 20_000, 3000, 700, 12_287] * 30
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(sizes))), "text": [str(n) for n in sizes]})
    got = {}
    for b in packing.packed([batch], Counted(), packing.Packer(pool=8), 0):
        for r in b.to_pylist():
            got.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
    for k, n in enumerate(sizes):
        pieces = sorted(got[k], key=lambda p: p[0])
        ids = np.concatenate([p[1] for p in pieces])
        assert ids.tolist() == [*range(n), 2] and all(p[2] == n + 1 for p in pieces)
        assert [p[0] for p in pieces] == [0, *np.cumsum([len(p[1]) for p in pieces])[:-1].tolist()]
