"""Packs tokenised documents into fixed windows by minimum bin slack.

Whole windows of a long document are cut off first. What is left of each document (its remainder, under one window)
waits in a pool; a bitset dynamic programme over the pool's multiset of lengths finds the subset whose sum comes closest
to the window, and back-tracking gives how many of each length it takes. A gap that is left is closed with a cut of the
longest waiting remainder. At the end of a task the rest, under one window, goes into sequences of powers of two, which
need no padding. Tasks are independent, so nothing is shuffled; a task that is run anew gives the same sequences.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW, END = 4096, 2
#: Remainders that wait at once in a task, for memory: at most POOL * WINDOW * 4 bytes, besides HELD ids and one document.
POOL, HELD = 2048, 1 << 20
#: Word ids kept per worker.
CACHE = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """The ids of tokenizers.Tokenizer.encode(text, add_special_tokens=False), with words kept.

    The vocabulary merges within words only. For texts of ASCII and Latin-1 letters the words are found here and each new
    one is encoded by the library; any other text goes to the library whole.
    """

    PLAIN = re.compile("[\x00-\x7e\xa1-\xac\xae-\xffŒœ‘-”]*")
    WORDS = re.compile("[a-zªµºß-öø-ÿœ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \\t-\\ra-zªµºß-öø-ÿœ0-9]+")
    ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe_<]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def ids(self, text: str) -> np.ndarray:
        if not self.PLAIN.fullmatch(text) or self.ODD.search(text):
            return self.whole(text)
        known, words = self.known, self.WORDS.findall(unicodedata.normalize("NFC", text).lower())
        missing = list(set(words).difference(known))
        if missing:
            if len(known) > CACHE:
                known.clear()
                missing = list(set(words))
            ids = self.whole(" ".join(missing))
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(missing):
                return self.whole(text)
            raw, at = ids.tobytes(), 0
            for word, end in zip(missing, ends.tolist()):
                known[word] = raw[at:end]
                at = end
        found = map(known.__getitem__, words)
        return np.frombuffer(b"".join(found), dtype="<u4")


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset, at most counts[n] of each length n, whose sum comes closest to room without passing it.

    One bit per reachable sum; after each length (longest first) the set of sums is kept for back-tracking.
    """
    mask, sums, steps, full = (1 << (room + 1)) - 1, 1, [], 1 << room
    for n in sorted((n for n in counts if 0 < n <= room), reverse=True):
        steps.append((n, sums))
        left, part = min(counts[n], room // n), 1
        while left:  # binary splitting: any number up to the count
            take = min(part, left)
            sums |= (sums << (n * take)) & mask
            left -= take
            part *= 2
        if sums & full:
            break
    at, chosen = sums.bit_length() - 1, {}
    if sums >> (room + 1):
        raise AssertionError("a sum passes the window")
    for n, before in reversed(steps):
        taken = 0
        while not (before >> at) & 1:
            at -= n
            taken += 1
        if taken:
            chosen[n] = taken
    return chosen


class Packer:
    """Packs the documents of one task. out gets (doc index, start, length, sequence, offset) of each piece."""

    def __init__(self, window: int = WINDOW, pool: int = POOL):
        self.window, self.pool, self.sequence = window, pool, 0
        self.waiting: dict[int, list] = defaultdict(list)
        self.n = self.total = 0

    def add(self, doc, tokens: int, out: list) -> None:
        at = 0
        while tokens - at >= self.window:
            out.append((doc, at, self.window, self.sequence, 0))
            self.sequence += 1
            at += self.window
        if tokens > at:
            self.put(doc, at, tokens - at)
            if self.n > self.pool:
                self.drain(out, self.pool // 2)

    def put(self, doc, start: int, length: int) -> None:
        self.waiting[length].append((doc, start))
        self.n += 1
        self.total += length

    def take(self, length: int):
        items = self.waiting[length]
        doc, start = items.pop()
        if not items:
            del self.waiting[length]
        self.n -= 1
        self.total -= length
        return doc, start

    def drain(self, out: list, keep: int) -> None:
        """Fills windows until at most keep remainders wait (or less than a window)."""
        while self.n > keep and self.total >= self.window:
            offset = 0
            longest = max(self.waiting)
            doc, start = self.take(longest)  # the longest always goes in, so that none waits for ever
            out.append((doc, start, longest, self.sequence, 0))
            offset = longest
            for n, k in best_fill({n: len(x) for n, x in self.waiting.items()}, self.window - longest).items():
                for _ in range(k):
                    doc, start = self.take(n)
                    out.append((doc, start, n, self.sequence, offset))
                    offset += n
            while offset < self.window:
                n = max(self.waiting)
                doc, start = self.take(n)
                used = min(n, self.window - offset)
                out.append((doc, start, used, self.sequence, offset))
                offset += used
                if n > used:
                    self.put(doc, start + used, n - used)
            self.sequence += 1

    def finish(self, out: list) -> None:
        self.drain(out, 0)
        room = 1 << (self.total.bit_length() - 1) if self.total else 0
        offset = 0
        while self.n:
            n = max(self.waiting)
            doc, start = self.take(n)
            used = min(n, room - offset)
            out.append((doc, start, used, self.sequence, offset))
            offset += used
            if n > used:
                self.put(doc, start + used, n - used)
            if offset == room:
                self.sequence, offset = self.sequence + 1, 0
                room = 1 << (self.total.bit_length() - 1) if self.total else 0


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(batches, words, packer: Packer, base: int):
    """Record batches of pieces for record batches of (doc_id, text). Of a document only the ids that wait are kept: the rest go
    once HELD ids, or 4096 pieces, are ready."""
    live, grown, counter, ready, out = {}, [], 0, 0, []

    def rows():
        cols = [[] for _ in range(7)]
        for doc, start, length, sequence, offset in out:
            doc_id, ids, first, left, total = live[doc]
            for c, v in zip(cols, (doc_id, start, length, ids[start - first : start - first + length].tobytes(), total, base + sequence, offset)):
                c.append(v)
            live[doc][3] = left - length
            if left == length:
                del live[doc]
        for doc in grown:
            if doc in live:
                own = live[doc]
                first = own[4] - own[3]
                own[1], own[2] = own[1][first - own[2] :].copy(), first
        out.clear(), grown.clear()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(words.ids(text.as_py() or ""), np.array([END], "<u4")).astype("<u4")
            live[counter] = [doc_id, ids, 0, len(ids), len(ids)]
            packer.add(counter, len(ids), out)
            if len(ids) >= packer.window:
                grown.append(counter)
                ready += len(ids)
            counter += 1
            if len(out) >= 4096 or ready >= HELD:
                ready = 0
                yield rows()
        if out:
            ready = 0
            yield rows()
    packer.finish(out)
    if out:
        yield rows()


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """Pieces of all documents with their ids (binary, little-endian unsigned 32-bit).

    Each document is its ids and the end id 2; a null text is empty, so it has that id alone. Rows that share a doc_id are
    packed one by one, a null doc_id stays null. Other columns are not read; an empty table gives no rows. sequence_id holds the task in its upper
    bits, so sequences of different tasks never meet.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        yield from packed(batches, word_tokenizer(path), Packer(window, pool), TaskContext.get().partitionId() << 40)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of the pieces of every whole text."""
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    """pieces with the CRC-32 of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
