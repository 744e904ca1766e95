import hashlib
import random
import subprocess
import sys

import numpy as np
import pytest

from scriptorium.llm import repeats, suffixes

SCHEMA = "doc_id long, text string, key long, batch long, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, 5, "clash") for i, t in rows], SCHEMA)


def slow(rows, width):
    """The definition by row: rows of one doc_id are not smaller than each other, null ids are larger than all."""
    first, key = {}, lambda d: (d is None, d or 0)
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            first[w] = min(key(d), first.get(w, key(d)))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < key(d):
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df, **limits):
    return sorted(((r.doc_id, r.n_bytes, len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove(df, **limits).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [texts[0], texts[0] + " tail", shared + " x " + texts[3], "y " + shared, None, "", "é" * 70, "é" * 90, texts[0], "ab" * 200, "ba" * 150, "z" * 400, "z" * 49, "z" * 50]
    ids = [k if k % 9 else None if k % 2 else 18 for k in range(len(texts))]
    return list(zip(ids, texts))


@pytest.mark.parametrize(("width", "seed"), [(50, 20), (100, 20), (30, 20), (150, 40)])
def test_equals_the_definition(spark, rows, width, seed):
    assert found(frame(spark, rows), width=width, seed=seed) == slow(rows, width)


@pytest.mark.parametrize(("width", "seed"), [(50, 20), (31, 20), (64, 21)])
def test_split_anchors_give_the_same(spark, rows, monkeypatch, width, seed):
    monkeypatch.setattr(repeats, "HOT", 1)
    assert found(frame(spark, rows), width=width, seed=seed) == slow(rows, width)


def test_parts_of_a_block_hold_equal_strings_under_one_anchor():
    rng = random.Random(9)
    where = {}
    for _ in range(60):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 200)))
        for data, _, _, anchor, start, end, _ in repeats.blocks([text]):
            for a, s, e in zip(anchor.tolist(), start.tolist(), end.tolist()):
                block, seen = data[s:e].tobytes(), set()
                for x, part, own in repeats.split(block, a, 50, 20):
                    assert block[x : x + len(part)] == part
                    for k in range(len(part) - 49):
                        assert where.setdefault(part[k : k + 50], (a, own)) == (a, own)
                        seen.add(x + k)
                assert seen == set(range(len(block) - 49))


def test_null_and_repeated_ids_and_rows(spark):
    a, b = "one passage that is long enough to be found again, surely ", "another passage of some length that stands in two rows "
    rows = [(5, a + "x"), (5, a + "y"), (5, b), (7, b + a), (None, a), (None, b + "z"), (None, b + "z"), (3, None), (3, "")]
    assert found(frame(spark, rows)) == slow(rows, 50)
    assert repeats.remove(frame(spark, [])).count() == 0


def test_stretches_of_a_long_text(spark, monkeypatch):
    """Blocks are cut where a stretch ends; the result is the same."""
    rng = random.Random(1)
    text = "".join(rng.choice("abcd ") for _ in range(6000))
    whole = list(repeats.blocks([text.encode(), text[1000:3000].encode()]))
    monkeypatch.setattr(repeats, "STRETCH", 700)
    cut = list(repeats.blocks([text.encode(), text[1000:3000].encode()]))
    covered = lambda parts: {(d, p) for _, doc, at, _, start, end, _ in parts for d, a, n in zip(doc.tolist(), at.tolist(), (end - start).tolist()) for p in range(a, a + n - 49)}
    assert covered(whole) == covered(cut) == {(0, p) for p in range(5951)} | {(1, p) for p in range(1951)}
    for data, doc, at, _, start, end, _ in cut:
        assert all((text if d == 0 else text[1000:3000]).encode()[a : a + e - s] == data[s:e].tobytes() for d, a, s, e in zip(doc.tolist(), at.tolist(), start.tolist(), end.tolist()))


def test_blocks_of_one_key_are_compared(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(repeats.hashing, "mix", lambda h: h & np.uint64(3))
    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(3000))
    batch = repeats.Batch(pd.DataFrame({"key": [1, 2], "text": [text, text[500:2500]]}), 50, 20)
    every = batch.bytes(np.arange(len(batch.own)))
    assert all(every[i] == every[j] for i, j in enumerate(batch.own.tolist())) and len(set(batch.own.tolist())) >= len(set(every))


def test_a_very_long_text(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(400_000))
    got = {r.doc_id: (r.n_bytes, [(s, e) for s, e in zip(r.starts, r.ends)]) for r in repeats.remove(frame(spark, [(1, text), (2, "aa " + text[700_000:760_000] + " zz"), (0, text[1_500_000:1_500_060])])).collect()}
    (start, end), = got[2][1]
    assert got[1] == (len(text), [(1_500_000, 1_500_060)]) and start <= 3 and end >= 60_003 and got[0][1] == []


@pytest.mark.parametrize("limits", [{"queue": 3, "in_memory": 2, "memory": 0}, {"queue": 50, "in_memory": 20, "memory": 64}, {}])
@pytest.mark.parametrize("depth", [64, 100])
def test_suffix_order_and_common_prefixes(monkeypatch, limits, depth):
    monkeypatch.setattr(suffixes, "AT_ONCE", 7 if limits else 1 << 20)
    monkeypatch.setattr(suffixes._stretches, "__defaults__", (suffixes.AT_ONCE,))
    rng = random.Random(5)
    for k in range(200):
        t = "".join(rng.choice("ab" if k % 3 else "abcdef") for _ in range(rng.randrange(1, 80)))
        t = "a" * rng.randrange(1, 150) + t if k % 11 == 0 else t[:5] * 12 + t if k % 7 == 0 else t
        order, lcp = suffixes.suffix_sort(np.frombuffer(t.encode(), np.uint8), depth=depth, **limits)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want
        for p, (a, b) in enumerate(zip(want, want[1:])):
            most = min(len(t) - a, len(t) - b)
            n = next((i for i in range(most) if t[a + i] != t[b + i]), most)
            assert min(lcp[p + 1], depth) == min(n, depth)


def test_holders_of_wide_strings_in_small_memory():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(300))).encode() for _ in range(20)] + [b"ab" * 150, b"b" + b"ab" * 120]
    docs = np.array([rng.randrange(9) for _ in texts])
    for limits in ({}, {"memory": 100, "at_once": 13, "queue": 20, "in_memory": 5}):
        for width in (20, 100):
            low, begin = repeats.holders(texts, docs, width, **limits)
            got = [np.asarray(low[b : b + max(len(t) - width + 1, 0)]) for t, b in zip(texts, begin.tolist())]
            first = {}
            for t, d in zip(texts, docs.tolist()):
                for i in range(len(t) - width + 1):
                    first[t[i : i + width]] = min(d, first.get(t[i : i + width], 99))
            assert [x.tolist() for x in got] == [[first[t[i : i + width]] for i in range(len(t) - width + 1)] for t in texts]


def test_a_sort_larger_than_its_bounds_of_memory():
    """2,000,000 symbols; what the process holds grows by half of the 40 bytes a symbol that text, types, names and result alone would take."""
    code = """
import random, re, sys
import numpy as np
from scriptorium.llm import suffixes
def held():
    return sum(map(int, re.findall(r"(?:RssAnon|RssShmem):\\s+(\\d+)", open("/proc/self/status").read()))) / 1024
rng = np.random.default_rng(1)
words = rng.integers(97, 123, (3000, 6)).astype(np.uint8)
text = np.memmap(sys.argv[1], np.uint8, "w+", shape=2_000_000)
text[:] = np.concatenate([words[rng.integers(0, 3000, 250_000)], np.full((250_000, 2), 32, np.uint8)], axis=1).ravel()
before, most = held(), 0
feed = suffixes._Scan.feed
def watched(self, pos, lcp):
    global most
    if self.feeds % 64 == 0:
        most = max(most, held())
    return feed(self, pos, lcp)
suffixes._Scan.feed = watched
suffixes._stretches.__defaults__ = (1 << 17,)
suffixes.AT_ONCE = 1 << 17
order, lcp = suffixes.suffix_sort(text, queue=100_000, in_memory=100_000, memory=1 << 20)
pick = rng.integers(1, len(text), 2000)
for p in pick.tolist():
    a, b = text[order[p - 1] : order[p - 1] + 200].tobytes(), text[order[p] : order[p] + 200].tobytes()
    assert a <= b
assert isinstance(order, np.memmap) and len(np.unique(order)) == len(text)
print(most - before)
"""
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        got = subprocess.run([sys.executable, "-c", code, f.name], capture_output=True, text=True, timeout=500)
    assert got.returncode == 0, got.stderr[-2000:]
    assert float(got.stdout) < 40, got.stdout


def test_queues_spill_at_the_size_that_queries_sort(monkeypatch):
    """A stretch of blocks as the query sorts it passes the queues' bound; what they keep stays near it."""
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 3000, 40_000)) for _ in range(10)]
    texts.append(texts[0][1000:3000])
    assert sum(map(len, texts)) > repeats.SORT_BYTES / 2
    spilled, held, spill, push = [], [], suffixes.DiskQueue.spill, suffixes.DiskQueue.push
    monkeypatch.setattr(suffixes.DiskQueue, "spill", lambda self: spilled.append(self.held) or spill(self))
    monkeypatch.setattr(suffixes.DiskQueue, "push", lambda self, *a: (push(self, *a), held.append(self.held)))
    low, begin = repeats.holders(texts, np.arange(len(texts)))
    assert spilled and max(held) <= suffixes.QUEUE and max(spilled) < 6 * suffixes.QUEUE
    last = begin[10]
    assert (np.asarray(low[last : last + 2000 - 49]) == 0).all() and (np.asarray(low[begin[3] : begin[3] + 100]) == 3).all()
