"""Removes bytes of strings that also start in a document with a smaller doc_id, by suffix arrays over shards.

Every string of WIDTH bytes has an anchor, the least hash of its substrings of SEED bytes; equal strings have equal anchors.
Neighbouring strings with one anchor form a block. Anchors are counted first: blocks whose anchor stands in one
document alone can't repeat; one that stands very often is split by the bytes around it. The others go to the shard of their
anchor, where blocks of equal bytes become one with the
smallest doc_id; a block that is alone under its anchor then is settled, and so are the strings of the others whose hash no
other string of their anchors has. What is left is sorted by its suffixes with common
prefixes, whole anchors at a time and SORT_BYTES or one anchor at most; strings that share WIDTH bytes are neighbours there
and get the smallest doc_id of all that hold them. Documents then remove what a smaller doc_id holds.

Shards and batches follow the bytes of the corpus. The sorting keeps text, order and queues in files beyond its bounds of
memory (see suffixes); the texts of a shard itself are in the memory of its task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import table
from .suffixes import MEMORY, array, suffix_sort

WIDTH, SEED = 50, 20
#: Bytes of text of a shard; they grow with the root of the corpus beyond 64 GB, up to the second number.
SHARD_BYTES, SHARD_MOST = 16 << 20, 256 << 20
#: Bytes of text of a batch of documents, least and most; it grows with the number of shards, so that parts don't get too small.
BATCH_BYTES, BATCH_MOST = 2 << 20, 32 << 20
#: Bytes that are hashed at once; longer texts are cut into stretches that overlap by WIDTH - 1.
STRETCH = 1 << 20
#: Bytes of blocks that are sorted together.
SORT_BYTES = 4 << 20
#: Bytes of blocks up to which strings that are like no other are told by their hashes and stay out of the sorting.
FILTER_BYTES = 8 << 20
LAST = (1 << 63) - 1
#: Number of the block in its batch, start, end, smallest doc_id.
_RUN = np.dtype([("o", "<u4"), ("s", "<u4"), ("e", "<u4"), ("d", "<i8")])
#: Number in the batch, where in that block it begins, part of the anchor, smallest doc_id, whether the batch has the block in several documents, length.
_BLOCK = np.dtype([("o", "<u4"), ("x", "<u4"), ("a", "<u4"), ("d", "<i8"), ("m", "?"), ("n", "<u4")])
#: An anchor that stands in so many batches (twice where in several documents of one) is split by the bytes around it.
HOT = 1000


def shape(text_bytes: int) -> tuple[int, int]:
    """Number of shards and bytes of a batch for so many bytes of text."""
    shard = min(SHARD_MOST, SHARD_BYTES * max(1.0, (text_bytes / (64 << 30)) ** 0.5))
    shards = max(64, int(text_bytes / shard) + 1)
    return shards, min(BATCH_MOST, max(BATCH_BYTES, shards * 2048))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n, span = len(x) - w + 1, 1
    while span * 2 <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n]) if span < w else x[:n]


def _stretches(texts: list[bytes], width: int):
    """Groups of (text, offset, piece) of about STRETCH bytes; a text's pieces overlap by width - 1."""
    group, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - width + 1, 0), STRETCH):
            piece = t[at : at + STRETCH + width - 1]
            group.append((k, at, piece))
            size += len(piece)
            if size >= STRETCH:
                yield group
                group, size = [], 0
    if group:
        yield group


def blocks(texts: list[bytes], width: int = WIDTH, seed: int = SEED):
    """Yields the data of a stretch and arrays (text, start in it, anchor, start and end in the data) of its blocks."""
    for group in _stretches(texts, width):
        data, bounds = hashing.joined([piece for _, _, piece in group])
        number, offset = np.array([k for k, _, _ in group]), np.array([at for _, at, _ in group])
        n = len(data) - width + 1
        with np.errstate(over="ignore"):
            p = hashing.prefix(data)
            least = _least(hashing.windows(p, seed), width - seed + 1)
        change = np.append(True, least[1:] != least[:-1])
        change[bounds[1:-1][bounds[1:-1] < n]] = True
        start = np.flatnonzero(change)
        own = np.searchsorted(bounds, start, side="right") - 1
        last = np.minimum(np.append(start[1:], n) - 1, bounds[own + 1] - width)
        keep = last >= start
        start, last, own = start[keep], last[keep], own[keep]
        yield data, number[own], offset[own] + start - bounds[own], least[start], start, last + width, p


class Batch:
    """The documents of a batch in a fixed order, and its blocks; own: the first block of the same bytes."""

    def __init__(self, docs: pd.DataFrame, width: int, seed: int):
        texts = [t.encode() if isinstance(t, str) else b"" for t in docs["text"]]
        ids = docs["key"].tolist()
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.texts, self.ids = [texts[i] for i in self.order], np.array([ids[i] for i in self.order], np.int64)
        parts, key, base = [], [np.zeros(0, np.uint64)], 0
        for data, doc, at, anchor, start, end, p in blocks(self.texts, width, seed):
            with np.errstate(over="ignore"):
                key.append(hashing.mix(hashing.ranges(p, start, end) ^ (anchor * np.uint64(3))))
            parts.append((data, doc, at, anchor, start + base, end + base))
            base += len(data)
        self.data = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.uint8)
        self.doc, self.at, self.anchor, self.start, self.end = (np.concatenate([x[k] for x in parts] or [np.zeros(0, np.uint64 if k == 3 else np.int64)]) for k in range(1, 6))
        key = np.concatenate(key)
        order = np.argsort(key, kind="stable")
        first = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
        self.own = np.empty(len(key), np.int64)
        self.own[order] = order[first][np.cumsum(first) - 1]
        self._compare(order[~first])

    def _compare(self, later: np.ndarray) -> None:
        """A block that has another one's key but not its bytes stands for itself."""
        for k in range(0, len(later), 1 << 16):
            i = later[k : k + (1 << 16)]
            j = self.own[i]
            size = self.end[i] - self.start[i]
            differs = size != self.end[j] - self.start[j]
            for step in range(int(size.max())):
                live = step < size
                differs |= live & (self.data[np.minimum(self.start[i] + step, len(self.data) - 1)] != self.data[np.minimum(self.start[j] + step, len(self.data) - 1)])
                if size.max() > 4 * WIDTH and not live.any():
                    break
            self.own[i[differs]] = i[differs]

    def bytes(self, which: np.ndarray) -> list[bytes]:
        whole = self.data.data
        return [bytes(whole[s:e]) for s, e in zip(self.start[which].tolist(), self.end[which].tolist())]


def _deal(order_key: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashing.mix(order_key) % np.uint64(buckets)).astype(np.int64)


def _anchors(buckets: int, width: int, seed: int):
    def run(docs: pd.DataFrame) -> pd.DataFrame:
        """The anchors of a batch, each with whether several of its documents have it."""
        found = [(x[3], x[1]) for x in blocks([t.encode() if isinstance(t, str) else b"" for t in docs["text"]], width, seed)]
        if not found:
            return pd.DataFrame({"dest": [], "batch": [], "blob": []})
        a, d = (np.concatenate([x[k] for x in found]) for k in range(2))
        order = np.argsort(a, kind="stable")  # the documents of an anchor stay in order
        a, d = a[order], d[order]
        first = np.append(True, a[1:] != a[:-1])
        index = np.flatnonzero(first)
        several = np.minimum.reduceat(d, index) != np.maximum.reduceat(d, index)
        a = a[first]
        dest = _deal(a, buckets)
        order = np.lexsort((a, dest))
        a, several, dest = a[order], several[order], dest[order]
        edges = np.flatnonzero(np.append(True, dest[1:] != dest[:-1]))
        out = [(dest[s], docs["batch"].iloc[0], a[s:e].tobytes() + several[s:e].astype(np.uint8).tobytes()) for s, e in zip(edges, np.append(edges[1:], len(a)))]
        return pd.DataFrame(out, columns=["dest", "batch", "blob"])

    return run


def _shared(got: pd.DataFrame, hot: int) -> pd.DataFrame:
    """Answers each batch with its anchors that stand in two documents or more, and whether they are hot."""
    parts = [(np.frombuffer(b, "<u8", len(b) // 9), np.frombuffer(b, np.uint8, offset=len(b) // 9 * 8)) for b in got["blob"]]
    _, inverse = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([1 + s for _, s in parts]))[inverse]
    out, at = [], 0
    for batch, (a, _) in zip(got["batch"], parts):
        n = total[at : at + len(a)]
        at += len(a)
        if (n > 1).any():
            out.append((batch, a[n > 1].tobytes() + (n[n > 1] >= hot).astype(np.uint8).tobytes()))
    return pd.DataFrame(out, columns=["batch", "blob"])


def split(text: bytes, anchor: int, width: int, seed: int) -> list[tuple[int, bytes, int]]:
    """The parts (start, text, anchor) of a block by the bytes around its anchor, on the side where a string has more of them.

    Equal strings have their anchor (its first place in the string) at the same distance, so they stand in parts of one anchor.
    """
    with np.errstate(over="ignore"):
        places = np.flatnonzero(hashing.windows(hashing.prefix(np.frombuffer(text, np.uint8)), seed) == np.uint64(anchor))
    half, starts = (width - seed) // 2, np.arange(len(text) - width + 1)
    at = places[np.searchsorted(places, starts)]
    late = at - starts > half
    edges = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (late[1:] != late[:-1])))
    out = []
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(starts)]):
        p = int(at[s])
        around = b"<" + text[p - half - 1 : p + seed] if late[s] else b">" + text[p : p + width - half]
        out.append((s, text[s : e - 1 + width], int.from_bytes(hashlib.blake2b(around, digest_size=8).digest(), "little")))
    return out


def _packed(rows: np.ndarray, texts: list[bytes]) -> bytes:
    """Rows of _BLOCK, column by column, and their texts; compressed."""
    step = np.diff(rows["o"], prepend=np.uint32(0))
    return np.int64(len(rows)).tobytes() + zstandard.compress(b"".join([step.tobytes(), *(rows[c].tobytes() for c in "xadmn"), *texts]), 3)


def _unpacked(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    n, whole, at = int(np.frombuffer(blob, "<i8", 1)[0]), zstandard.decompress(blob[8:]), 0
    rows = np.empty(n, _BLOCK)
    for c in "oxadmn":
        kind = _BLOCK[c]
        rows[c] = np.frombuffer(whole, kind, n, at)
        at += n * kind.itemsize
    rows["o"] = np.cumsum(rows["o"], dtype=np.uint32)
    texts = []
    for size in rows["n"].tolist():
        texts.append(whole[at : at + size])
        at += size
    return rows, texts


def _send(buckets: int, width: int, seed: int):
    def run(docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        """The batch's different blocks with shared anchors, by shard: with the smallest doc_id; texts compressed."""
        out: list[tuple] = []
        if len(docs) and len(got):
            batch = Batch(docs, width, seed)
            known = np.concatenate([np.frombuffer(b, "<u8", len(b) // 9) for b in got["blob"]])
            often = np.concatenate([np.frombuffer(b, np.uint8, offset=len(b) // 9 * 8) for b in got["blob"]])
            by_anchor = np.argsort(known)
            known, often = known[by_anchor], often[by_anchor]
            at = np.minimum(np.searchsorted(known, batch.anchor), len(known) - 1)
            kept = np.flatnonzero(known[at] == batch.anchor)
            order = kept[np.lexsort((batch.doc[kept], batch.own[kept]))]  # documents stand by ascending id
            own = batch.own[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            ids = batch.ids[batch.doc[order]]
            rows = np.zeros(len(first), _BLOCK)
            rows["o"], rows["d"], rows["m"] = own[first], ids[first], ids[np.append(first[1:], len(own)) - 1] > ids[first] if len(own) else False
            rows["a"], rows["n"] = batch.anchor[own[first]] & np.uint64(0xFFFFFFFF), (batch.end - batch.start)[own[first]]
            anchors, texts = batch.anchor[own[first]], batch.bytes(own[first])
            hot = np.flatnonzero(often[at[own[first]]]).tolist()
            if hot:
                more = [(i, *part) for i in hot for part in split(texts[i], int(anchors[i]), width, seed)]
                cold = np.setdiff1d(np.arange(len(rows)), hot)
                parts = rows[[i for i, *_ in more]]
                parts["x"], parts["n"], parts["a"] = [x for _, x, _, _ in more], [len(t) for _, _, t, _ in more], [a & 0xFFFFFFFF for *_, a in more]
                rows, texts = np.concatenate([rows[cold], parts]), [texts[i] for i in cold.tolist()] + [t for _, _, t, _ in more]
                anchors = np.concatenate([anchors[cold], np.array([a for *_, a in more], np.uint64)])
            dest = _deal(anchors, buckets)
            order = np.lexsort((rows["o"], dest))
            edges = np.flatnonzero(np.append(True, np.diff(dest[order]) != 0)) if len(rows) else []
            for s, e in zip(edges, np.append(edges[1:], len(rows)) if len(rows) else []):
                out.append((dest[order[s]], docs["batch"].iloc[0], _packed(rows[order[s:e]], [texts[i] for i in order[s:e].tolist()])))
        return pd.DataFrame(out, columns=["dest", "batch", "blob"])

    return run


def holders(texts: list[bytes], docs: np.ndarray, width: int = WIDTH, memory: int = MEMORY, at_once: int = 1 << 20, **limits) -> tuple[np.ndarray, np.ndarray]:
    """The smallest doc of all texts that hold the string of width bytes, by its start in the texts one after another (each
    followed by one place), and where each text begins; LAST or another's where a string would pass the end of its text."""
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(begin[-1])
    flat = array(n, np.int16, memory)
    for a in range(0, len(texts), 1024):
        part = b"\0".join(texts[a : a + 1024]) + b"\0"
        flat[begin[a] : begin[a] + len(part)] = np.frombuffer(part, np.uint8).astype(np.int16) + 1
    flat[begin[1:] - 1] = 0
    order, lcp = suffix_sort(flat, memory=memory, depth=width, **limits)
    least, out = array(n, np.int64, memory), array(n, np.int64, memory)
    for final in (False, True):  # strings that share width bytes are neighbours: first the least of each group, then to all its members
        group = -1
        for a in range(0, n, at_once):
            pos = np.asarray(order[a : a + at_once])
            new = np.asarray(lcp[a : a + at_once]) < width
            new[0] |= a == 0
            number = group + np.cumsum(new)
            if final:
                out[pos] = least[number]
            else:
                owner = np.searchsorted(begin, pos, side="right") - 1
                value = np.where(pos + width <= begin[owner] + sizes[owner], docs[owner], LAST)
                edges = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                low = np.minimum.reduceat(value, edges)
                if not new[0]:
                    low[0] = min(low[0], least[number[0]])
                least[number[edges]] = low
            group = int(number[-1])
    return out, begin


def _runs(low: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of strings of one smallest doc in each text: (text, start, end, doc)."""
    where = np.repeat(np.arange(len(sizes)), sizes - width + 1)
    pos = np.arange(len(where)) + np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(sizes - width + 1)[:-1]]), sizes - width + 1)
    value = np.asarray(low)[pos]
    edges = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (value[1:] != value[:-1])))
    start = pos[edges] - begin[where[edges]]
    size = np.diff(np.append(edges, len(where)))
    return where[edges], start, start + size, value[edges]


def _sorted_groups(anchors: np.ndarray, sizes: np.ndarray, most: int):
    """Indices of blocks in stretches of whole anchors, of about most bytes."""
    order = np.argsort(anchors, kind="stable")
    total, edges = np.cumsum(sizes[order]), np.append(np.flatnonzero(np.diff(anchors[order])) + 1, len(order))
    at = 0
    for e in edges.tolist():
        if at < e and total[e - 1] - (total[at - 1] if at else 0) >= most or e == len(order):
            yield order[at:e]
            at = e


def _alike(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Runs of strings of width bytes in each text (text, start, end), and whether each of them has the hash of another.

    Equal strings have equal hashes, so a string of any other run stands nowhere else.
    """
    data, bounds = hashing.joined(texts)
    n = np.diff(bounds) - width + 1
    where = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        h = hashing.windows(hashing.prefix(data), width)[pos + bounds[where]]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    shared = np.zeros(len(h), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    edges = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (shared[1:] != shared[:-1])))
    return where[edges], pos[edges], pos[edges] + np.diff(np.append(edges, len(where))), shared[edges]


def _least_runs(texts: list[bytes], least: np.ndarray, width: int) -> list[tuple[np.ndarray, ...]]:
    """Arrays (text, start, end, smallest doc) of all runs of strings of the texts. Only strings that are like another are sorted.

    What one anchor alone brings beyond FILTER_BYTES is sorted whole, by files.
    """
    sizes = np.array([len(t) for t in texts])
    if sizes.sum() > FILTER_BYTES:
        low, begin = holders(texts, least, width)
        return [_runs(low, begin, sizes, width)]
    text, s, e, shared = _alike(texts, width)
    out = [(text[~shared], s[~shared], e[~shared], least[text[~shared]])]
    text, s, e = text[shared], s[shared], e[shared]
    if len(text):
        low, begin = holders([texts[k][a : b - 1 + width] for k, a, b in zip(text.tolist(), s.tolist(), e.tolist())], least[text], width)
        part, a, b, d = _runs(low, begin, e - s + width - 1, width)
        out.append((text[part], s[part] + a, s[part] + b, d))
    return out


def _judge(width: int):
    def run(got: pd.DataFrame) -> pd.DataFrame:
        """Answers each batch: for its blocks, runs of strings that a smaller doc_id holds."""
        parts = [_unpacked(b) for b in got["blob"]]
        r, number = np.concatenate([rows for rows, _ in parts]), {}
        own = np.array([number.setdefault(t, len(number)) for _, texts in parts for t in texts])
        texts = list(number)
        least, anchor = np.full(len(texts), LAST), np.zeros(len(texts), np.uint32)
        np.minimum.at(least, own, r["d"])
        anchor[own] = r["a"]
        _, which, count = np.unique(anchor, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(count[which] > 1)
        sizes, found = np.array([len(t) for t in texts]), []
        for part in _sorted_groups(anchor[mixed], sizes[mixed], SORT_BYTES) if len(mixed) else ():
            part = mixed[part]
            found += [(part[text], s, e, d) for text, s, e, d in _least_runs([texts[i] for i in part.tolist()], least[part], width)]
        settled = np.setdiff1d(np.arange(len(texts)), mixed)
        found.append((settled, np.zeros(len(settled), np.int64), sizes[settled] - width + 1, least[settled]))
        text, s, e, d = (np.concatenate([x[k] for x in found]) for k in range(4))
        order = np.argsort(text, kind="stable")
        text, s, e, d = text[order], s[order], e[order], d[order]
        lo, hi = (np.searchsorted(text, np.arange(len(texts)), side=side) for side in ("left", "right"))
        out, at = [], 0
        for batch, (rows, _) in zip(got["batch"], parts):
            mine = own[at : at + len(rows)]
            at += len(rows)
            n = (hi - lo)[mine]
            row = np.repeat(np.arange(len(rows)), n)
            run_ = np.repeat(lo[mine], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            keep = (d[run_] < rows["d"][row]) | rows["m"][row]
            row, run_ = row[keep], run_[keep]
            if len(row):
                answer = np.zeros(len(row), _RUN)
                answer["o"], answer["s"], answer["e"], answer["d"] = rows["o"][row], rows["x"][row] + s[run_], rows["x"][row] + e[run_], d[run_]
                out.append((batch, answer.tobytes()))
        return pd.DataFrame(out, columns=["batch", "blob"])

    return run


def _whole(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """The spans widened to whole characters of UTF-8."""
    out: list[list[int]] = []
    for s, e in spans:
        while s and text[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(text) and text[e] & 0xC0 == 0x80:
            e += 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _cut(width: int, seed: int, whole: bool):
    def run(docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "n_bytes", "kept", "starts", "ends", *(["rest"] if "rest" in docs else [])]
        if not len(docs):
            return pd.DataFrame({c: [] for c in names})
        batch = Batch(docs, width, seed)
        runs = np.concatenate([np.frombuffer(b, _RUN) for b in got["blob"]]) if len(got) else np.zeros(0, _RUN)
        runs = runs[np.argsort(runs["o"], kind="stable")]
        lo, hi = (np.searchsorted(runs["o"], batch.own, side=side) for side in ("left", "right"))
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        x = runs[np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        good = x["d"] < batch.ids[batch.doc[which]]
        which, x = which[good], x[good]
        gone: list[list] = [[] for _ in batch.texts]
        for d, s, e in zip(batch.doc[which].tolist(), (batch.at[which] + x["s"]).tolist(), (batch.at[which] + x["e"] - 1 + width).tolist()):
            gone[d].append((s, e))
        kept, starts, ends = [], [], []
        for t, spans in zip(batch.texts, gone):
            merged: list[list[int]] = []
            for s, e in sorted(spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            if whole:
                merged = _whole(t, merged)
            bounds = [0, *(x for se in merged for x in se), len(t)]
            kept.append(b"".join(t[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
            starts.append([s for s, _ in merged])
            ends.append([e for _, e in merged])
        out = {"key": batch.ids, "n_bytes": [len(t) for t in batch.texts], "kept": kept, "starts": starts, "ends": ends}
        if "rest" in docs:
            rest = docs["rest"].tolist()
            out["rest"] = [rest[i] for i in batch.order]
        return pd.DataFrame(out)

    return run


def remove(docs: DataFrame, width: int = WIDTH, seed: int = SEED, rest: str | None = None, whole: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, kept (binary) and the removed runs (starts, ends: arrays of byte offsets).

    A null text is empty. Rows with one doc_id are not smaller than each other, so they don't remove each other's bytes;
    a null doc_id counts as larger than any. With whole, runs are widened to whole characters, so that kept is UTF-8. A string
    column rest goes along; other columns are not read; an empty table gives no rows.
    """
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets, batch_bytes = shape(size or 0)
    batches = max(1, -(-n // 2000), -(-(size or 0) // batch_bytes))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), "text", *([F.col(rest).alias("rest")] if rest else []))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("key", "text"), F.lit(batches)))
    sent = rows.groupBy("batch").applyInPandas(_anchors(buckets, width, seed), "dest long, batch long, blob binary")
    hot = HOT
    shared = sent.groupBy("dest").applyInPandas(lambda got: _shared(got, hot), "batch long, blob binary")
    held = rows.groupBy("batch").cogroup(shared.groupBy("batch")).applyInPandas(_send(buckets, width, seed), "dest long, batch long, blob binary")
    judged = held.groupBy("dest").applyInPandas(_judge(width), "batch long, blob binary")
    out = rows.groupBy("batch").cogroup(judged.groupBy("batch")).applyInPandas(_cut(width, seed, whole), "key long, n_bytes long, kept binary, starts array<long>, ends array<long>" + (", rest string" if rest else ""))
    return out.select(F.nullif(F.col("key"), F.lit(LAST)).alias("doc_id"), "n_bytes", "kept", "starts", "ends", *([F.col("rest").alias(rest)] if rest else []))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of remove(): sizes, number of removed runs, SHA-256 of what stays."""
    removed = remove(table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> dict[int, tuple[int, int, int, str]]:
    """The definition, for tests: doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    first: dict[bytes, int] = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            first[w] = min(d, first.get(w, d))
    out = {}
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out
