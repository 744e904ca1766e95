"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of WINDOW bytes. In each window one recurrent pass runs forward and one backward; every
position gets a distribution over the languages from both states, and a document's distribution is the mean over all its
positions. Trained here in numpy by back-propagation through time. Spark counts the words of all rows that may be learned
from, whole texts; tasks learn from each different word, with its shares of the languages as target, and the mean of their
networks starts the next round.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

WINDOW, HIDDEN = 128, 8
#: Words, with the white space before them (longer ones in parts); characters of a text that are cut into words at once.
WORD, PART = r"\s?\S{1,24}", 1_000_000
#: Rounds of learning, bytes of different words that a task learns from in one, and bytes of each language that it gets if there are so many.
ROUNDS, TASK_BYTES, LANG_BYTES = 4, 1_600_000, 20_000
#: Bounds of sample(), by which fit() and familiar() learn from a table without Spark: labelled rows, and characters of one.
TRAIN_DOCS, TRAIN_LENGTH = 1500, 100_000
#: Bytes of the pieces that back-propagation runs over; steps, pieces per step, rate.
PIECE, STEPS, BATCH, RATE = 64, 500, 128, 0.02
#: Texts that are handled at once, in bytes.
BLOCK_BYTES = 1 << 18
_LETTER, _SPACE = regex.compile(r"\p{L}"), regex.compile(r"\s")
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class ByteNet:
    """table: (2, 256, 3H) input weights with bias by direction and byte; rec: (2, H, 3H); out: (2H, C), bias (C)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels, self.h, c = labels, hidden, len(labels)
        self.p = {
            "table": rng.normal(0, 0.3, (2, 256, 3 * hidden)),
            "rec": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)),
            "out": rng.normal(0, 0.3, (2 * hidden, c)),
            "bias": np.zeros(c),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def dump(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, values: np.ndarray) -> ByteNet:
        at = 0
        for k in sorted(self.p):
            self.p[k] = values[at : at + self.p[k].size].reshape(self.p[k].shape).copy()
            at += self.p[k].size
        return self

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """table (3 * 2 * 256, H) and rec (3, 2, H, H) by gate, so that all steps run over contiguous arrays; halved for the gates that go through tanh."""
        half = np.array([0.5, 0.5, 1], self.p["rec"].dtype)[:, None, None, None]
        table, rec = (self.p[k].reshape(2, -1, 3, self.h).transpose(2, 0, 1, 3) * half for k in ("table", "rec"))
        return table.reshape(-1, self.h), np.ascontiguousarray(rec)

    def states(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: (B, L) bytes. (2, L, B, H) states by position, of the pass forward and of the one backward."""
        b, length, h = *x.shape, self.h
        table, rec = self._gates()
        # (L, 3, 2, B): the rows of table at every step
        at = np.stack([x.T, x.T[::-1]], 1)[:, None] + (np.arange(6) * 256).reshape(3, 2, 1)
        out = np.empty((2, length, b, h), rec.dtype)
        s, g = np.zeros((2, b, h), rec.dtype), np.empty((3, 2, b, h), rec.dtype)
        a, new = np.empty_like(g), np.empty_like(s)
        if keep is not None:
            shape = (length, 2, b, h)
            keep |= {"at": at[:, 0], "before": np.empty(shape, rec.dtype), "gates": np.empty((length, 3, 2, b, h), rec.dtype), "inner": np.empty(shape, rec.dtype)}
        for t in range(length):
            table.take(at[t], axis=0, out=a, mode="clip")
            np.matmul(s, rec, out=g)
            rz, n = a[:2], a[2]
            rz += g[:2]
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            if keep is not None:
                keep["before"][t], keep["inner"][t] = s, g[2]
            g[2] *= rz[0]
            n += g[2]
            np.tanh(n, out=n)
            if keep is not None:
                keep["gates"][t] = a
            np.subtract(s, n, out=new)
            new *= rz[1]
            new += n
            out[0, t], out[1, length - 1 - t] = new
            s, new = new, s
        return out

    def _shares(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(C, L, B): the distribution at every position."""
        s, h = self.states(x, keep), self.h
        weights = self.p["out"].T
        logit = weights[:, :h] @ s[0].reshape(-1, h).T
        logit += weights[:, h:] @ s[1].reshape(-1, h).T
        logit += self.p["bias"][:, None]
        logit -= logit.max(axis=0)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=0)
        if keep is not None:
            keep["s"] = s
        return logit.reshape(-1, *s.shape[1:3])

    def positions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(L, B, C): the distribution at every position."""
        return self._shares(x, keep).transpose(1, 2, 0)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions; y: (B,) labels, or (L, B, C) shares of the labels with (L, B) weights."""
        keep, h = {}, self.h
        d = np.ascontiguousarray(self.positions(x, keep))
        s, (length, b, c) = keep["s"], d.shape
        if weight is None:
            d[:, np.arange(len(y)), y] -= 1
            d /= d.shape[0] * d.shape[1]
        else:
            d -= y
            d *= (weight / weight.sum())[..., None]
        d = d.reshape(-1, c)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"] = d.sum(0)
        g["out"] = np.concatenate([s[k].reshape(-1, h).T @ d for k in range(2)])
        ds = np.stack([(d @ self.p["out"][:h].T).reshape(length, b, h), (d @ self.p["out"][h:].T).reshape(length, b, h)[::-1]], 1)
        rec = self.p["rec"].reshape(2, h, 3, h).transpose(2, 0, 3, 1).copy()
        back = np.zeros_like(ds[0])
        inputs, dg = np.empty((length, 3, *back.shape), back.dtype), np.empty((length, 3, *back.shape), back.dtype)
        for t in range(length - 1, -1, -1):
            r, z, n = keep["gates"][t]
            da = inputs[t]
            back += ds[t]
            np.multiply(back * (1 - z), 1 - n * n, out=da[2])
            np.multiply(da[2] * keep["inner"][t], r * (1 - r), out=da[0])
            np.multiply(back * (keep["before"][t] - n), z * (1 - z), out=da[1])
            dg[t] = da
            dg[t, 2] *= r
            back *= z
            back += np.matmul(dg[t], rec).sum(0)
        before = keep["before"].transpose(1, 3, 0, 2).reshape(2, h, -1)
        g["rec"] = np.matmul(before, dg.transpose(2, 0, 3, 1, 4).reshape(2, -1, 3 * h))
        rows = keep["at"].ravel().astype(np.uint16)
        order = np.argsort(rows, kind="stable")
        found, first = np.unique(rows[order], return_index=True)
        each = inputs.transpose(0, 2, 3, 1, 4).reshape(-1, 3 * h)
        g["table"].reshape(512, -1)[found] = np.add.reduceat(each[order], first, axis=0)
        return g

    def _descend(self, gradients: Iterable[tuple[dict[str, np.ndarray], float]]) -> ByteNet:
        """Adam over (gradient, rate) pairs."""
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for step, (found, at) in enumerate(gradients, 1):
            for k, g in found.items():
                g = np.clip(g, -1, 1)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (at * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 2) -> ByteNet:
        """Classes are drawn evenly."""
        rng = np.random.default_rng(seed)
        groups = [g for c in range(len(self.labels)) if len(g := np.flatnonzero(y == c))]

        def gradients():
            for step in range(1, steps + 1):
                pick = np.concatenate([rng.choice(g, -(-batch // len(groups))) for g in groups])
                yield self.gradient(x[pick].astype(np.int64), y[pick]), rate * min(1, step / 20, 2 * (steps + 1 - step) / steps)

        return self._descend(gradients())

    def train_words(self, words: list[bytes], shares: np.ndarray, weight: np.ndarray, part: int = 0, parts: int = 1, least: int = STEPS, batch: int = BATCH, rate: float = RATE) -> ByteNet:
        """From every word once at least, in pieces of words of one likeliest language; part of parts sets the rate.

        shares: (n, C), how the languages share a word; weight: (n,). A batch has as many pieces of a language as it has of all,
        at least a quarter of an even part (few pieces come again); in its loss languages are even.
        """
        rng, best = np.random.default_rng((part, 4)), shares.argmax(1)
        x, own = [], []
        for c in np.unique(best).tolist():
            order = rng.permutation(np.flatnonzero(best == c).astype(np.int32))
            raw, index = b"".join(words[k] for k in order), np.repeat(order, [len(words[k]) for k in order])
            n = -(-len(raw) // PIECE)
            x.append(np.frombuffer(raw.ljust(n * PIECE, b"\0"), np.uint8).reshape(n, PIECE))
            own.append(np.append(index, np.full(n * PIECE - len(index), -1, np.int32)).reshape(n, PIECE))
        sizes = [len(k) for k in x]
        take = [max(1, batch // (4 * len(x)), round(batch * n / sum(sizes))) for n in sizes]
        steps = max(least, *(-(-n // k) for n, k in zip(sizes, take)))
        shares, weight = np.append(shares, np.zeros((1, shares.shape[1])), 0).astype(np.float32), np.append(weight, 0).astype(np.float32)

        def gradients():
            for step in range(steps):
                pick = [np.arange(step * k, (step + 1) * k) % n for n, k in zip(sizes, take)]
                w = [weight[o[p]] for o, p in zip(own, pick)]
                w = np.concatenate([k / k.sum() for k in w]).T
                index = np.concatenate([o[p] for o, p in zip(own, pick)]).T
                at = (part + step / steps) / parts
                yield self.gradient(np.concatenate([k[p] for k, p in zip(x, pick)]).astype(np.int64), shares[index], w), rate * min(1, (step + 1) / 20, 2 * (1 - at))

        return self._descend(gradients())

    def documents(self, texts: list[bytes], block: int = 1024) -> np.ndarray:
        """(n, C): the mean distribution over all positions of each text; zeros for an empty one."""
        sizes = np.array([len(t) for t in texts], np.int64)
        count = -(-sizes // WINDOW)
        total = np.zeros((len(texts), len(self.labels)))
        owner = np.repeat(np.arange(len(texts)), count)
        padded = np.zeros(int(count.sum()) * WINDOW, np.uint8)
        starts = np.concatenate([[0], np.cumsum(count)[:-1]]) * WINDOW
        for t, s in zip(texts, starts.tolist()):
            padded[s : s + len(t)] = np.frombuffer(t, np.uint8)
        x = padded.reshape(-1, WINDOW)
        inside = sizes[owner] - (np.arange(len(x)) * WINDOW - starts[owner])
        for k in range(0, len(x), block):
            p = self._shares(x[k : k + block])
            short = inside[k : k + block]
            if (short < WINDOW).any():
                p *= np.arange(WINDOW)[:, None] < short[None]
            np.add.at(total, owner[k : k + block], p.sum(1, dtype=np.float64).T)
        return total / np.maximum(sizes, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def sample(docs: DataFrame, most: int = TRAIN_DOCS, longest: int = TRAIN_LENGTH) -> pd.DataFrame:
    """(lang, text) of at most most labelled rows that may be learned from, the first by a hash of their doc_id; whole texts."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, 3 * most / max(1, rows.select("doc_id", "lang").count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = rows.filter(F.length("text").between(1, longest)).select("lang", "text", F.xxhash64("doc_id", F.lit(9)).alias("o"), F.xxhash64("text").alias("p"))
    return rows.orderBy("o", "p", "text", "lang").limit(most).select("lang", "text").toPandas()


def learnable(docs: DataFrame) -> DataFrame:
    """All rows that may be learned from and hold letters."""
    return docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(lang, word, n): how often each WORD stands in the rows of a language, counted over the whole texts of all learnable rows."""
    parts = F.expr(f"transform(sequence(0, (length(text) - 1) div {PART}), k -> substring(text, cast(k * {PART} + 1 AS int), {PART}))")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return learnable(docs).select("lang", F.explode(parts).alias("text")).select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def learn(words: DataFrame) -> ByteNet | None:
    """The network of a stored vocabulary(); None if that is empty.

    Each different word is learned from, its target being how often the languages use it, each by its own number of words. In
    each of ROUNDS tasks go on from the same network with words of their own, and their mean is the next one; a vocabulary of
    up to TASK_BYTES is one task's in each round. Words of languages that have few go to several tasks, so that none forgets them.
    """
    size = F.sum(F.octet_length("word"))
    langs = words.groupBy("lang").agg(F.sum("n").alias("n"), size.alias("size")).orderBy("lang").collect()
    if not langs:
        return None
    net, total = ByteNet([r.lang for r in langs]), sum(r["size"] for r in langs)
    tasks, rounds = (1, 1) if total <= TASK_BYTES else (max(1, round(total / TASK_BYTES / ROUNDS)), ROUNDS)
    cells = tasks * rounds
    facts = [(r.lang, k, float(r.n), min(cells, -(-cells * LANG_BYTES // r["size"]))) for k, r in enumerate(langs)]
    facts = words.sparkSession.createDataFrame(facts, "lang string, k int, total double, copies int")
    found = words.join(F.broadcast(facts), "lang").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("n") / F.col("total")).alias("share")))).alias("f"), F.sum("n").alias("n"), F.max("copies").alias("copies"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.pmod(F.xxhash64("word", F.lit(7)) + k, F.lit(cells)).cast("int")))
    found = stored(found.select("word", F.col("f.k").alias("langs"), F.col("f.share").alias("shares"), "n", cell.alias("cell")))
    for part in range(ROUNDS):
        own = found.filter(F.col("cell") % rounds == part % rounds).repartitionByRange(tasks, "cell")
        nets = sorted(own.groupBy("cell").applyInArrow(_learner(net, part), "cell int, size long, net binary").collect())
        # A cell without words has no row; small tables may have few cells with any.
        if nets:
            weight = np.array([r["size"] for r in nets], float)
            mean = np.average([np.frombuffer(r.net, np.float32) for r in nets], axis=0, weights=weight).astype(np.float32)
            net.load(mean)
    return net


def _learner(net: ByteNet, part: int) -> Callable[[pa.Table], pa.Table]:
    labels, start = net.labels, net.dump()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word").combine_chunks()
        words = rows["word"].cast(pa.binary()).to_pylist()
        langs, found = (rows[k].chunk(0) for k in ("langs", "shares"))
        shares = np.zeros((len(rows), len(labels)), np.float32)
        shares[np.repeat(np.arange(len(rows)), langs.value_lengths().to_numpy()), langs.flatten().to_numpy()] = found.flatten().to_numpy()
        shares /= shares.sum(1, keepdims=True)
        weight = 1 + np.log2(rows["n"].to_numpy().astype(float))
        own = ByteNet(labels).load(start).train_words(words, shares, weight, part, ROUNDS, -(-STEPS // ROUNDS))
        return pa.table({"cell": rows["cell"].slice(0, 1), "size": [sum(map(len, words))], "net": [own.dump().tobytes()]})

    return run


def fit(rows: pd.DataFrame) -> ByteNet | None:
    """The network of a sample(); None if nothing can be learned from. Texts are cut into pieces of PIECE bytes, all are drawn from."""
    rows = rows[[bool(_LETTER.search(t)) for t in rows["text"]]]
    if rows.empty:
        return None
    labels = sorted(rows["lang"].unique())
    raw = [t.encode() for t in rows["text"]]
    pieces = np.array([-(-len(t) // PIECE) for t in raw])
    x = np.frombuffer(b"".join(t.ljust(n * PIECE, b"\0") for t, n in zip(raw, pieces.tolist())), np.uint8).reshape(-1, PIECE)
    y = np.repeat([labels.index(g) for g in rows["lang"]], pieces)
    return ByteNet(labels).train(x, y)


#: Trigram buckets as a power of two, share of held-out documents that may fall under the bound, noise texts.
BUCKETS, STRAY, NOISE = 18, 0.001, 600
_WORDS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams around all letters, in lower case, and the text of each."""
    parts = [b" " + t.lower().encode() + b" " for t in texts]
    data = _WORDS[np.frombuffer(b"".join(parts), np.uint8)]
    own = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    at = np.flatnonzero(data != 32)
    x = data.astype(np.uint32)
    return ((x[at - 1] << 16 | x[at] << 8 | x[at + 1]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS), own[at]


def _groups(texts: list[str]):
    """Yields (number of the text, part of it) pairs of about BLOCK_BYTES characters; longer texts are cut at white space."""
    group, size = [], 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t):
            cut = _SPACE.search(t, at + BLOCK_BYTES) if len(t) - at > BLOCK_BYTES else None
            end = cut.start() if cut else len(t)
            group.append((k, t[at:end]))
            size, at = size + end - at, end
            if size >= BLOCK_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


class Familiar:
    """Whether a text's trigrams are those of the learned languages: their mean log frequency against a calibrated bound."""

    def __init__(self, texts: list[str] = (), found: np.ndarray | None = None):
        found = self.counts(texts) if found is None else found
        self.logs = np.log((found + 0.1) / max(found.sum(), 1)).astype(np.float32)
        self.bound, self.spread, self.usual = -np.inf, 0.0, 1.0

    @staticmethod
    def counts(texts: list[str]) -> np.ndarray:
        """How often the trigrams of each bucket stand in the texts."""
        found = np.zeros(1 << BUCKETS)
        for group in _groups(texts):
            found += np.bincount(_trigrams([t for _, t in group])[0], minlength=1 << BUCKETS)
        return found

    def means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean log frequency, mean of its square, and number of trigrams of each text."""
        total, square, n = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        for group in _groups(texts):
            grams, own = _trigrams([t for _, t in group])
            own, logs = np.array([k for k, _ in group])[own], self.logs[grams].astype(float)
            total += np.bincount(own, logs, len(texts))
            square += np.bincount(own, logs * logs, len(texts))
            n += np.bincount(own, minlength=len(texts))
        some = np.maximum(n, 1)
        return total / some, square / some, n

    def calibrate(self, held: list[str], noise: list[str]) -> Familiar:
        """Between texts that were not learned from and noise; where these overlap, at the lowest of the former but STRAY."""
        means, square, n = self.means(held)
        return self.settle(np.quantile(means[n > 0], STRAY), noise, np.average(means, weights=n), np.average(square, weights=n), np.median(n[n > 0]))

    def settle(self, low: float, noise: list[str], mean: float, square: float, usual: float) -> Familiar:
        """By the quantile STRAY, the mean and its square over all trigrams, and the median number, of texts not learned from."""
        high = np.quantile(self.means(noise)[0], 0.95)
        self.bound = float((low + high) / 2 if high < low else low)
        self.spread, self.usual = float(np.sqrt(max(square - mean**2, 0))), float(usual)
        return self

    def knows(self, texts: list[str]) -> np.ndarray:
        """Short texts get the slack that chance gives them."""
        means, _, n = self.means(texts)
        slack = 2 * self.spread * np.maximum(1 / np.sqrt(np.maximum(n, 1)) - 1 / np.sqrt(self.usual), 0)
        return (n > 0) & (means >= self.bound - slack)


def _shuffled(held: list[str]) -> Callable[[random.Random], str]:
    def text(rng: random.Random) -> str:
        t = list(rng.choice(held))
        rng.shuffle(t)
        return "".join(t)

    return text


def _noise(shuffled: Callable[[random.Random], str]) -> list[str]:
    """Letters of known texts in any order, even letters, and letters of one script at a time."""
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x24F, 0x2FA0) if chr(c).isalpha()]
    out = []
    for k in range(NOISE):
        if k % 3 == 0:
            out.append(shuffled(rng))
            continue
        at = rng.randrange(len(letters) - 40)
        own = "abcdefghijklmnopqrstuvwxyz" if k % 3 == 1 else letters[at : at + 40]
        out.append(" ".join("".join(rng.choice(own) for _ in range(rng.randrange(2, 11))) for _ in range(20)))
    return [t for t in out if _LETTER.search(t)]


def familiar(rows: pd.DataFrame) -> Familiar | None:
    """Learned from two thirds of a sample(), calibrated on the rest; None if nothing can be learned from."""
    texts = [t for t in rows["text"] if _LETTER.search(t)]
    if not texts:
        return None
    held = texts[::3]
    return Familiar([t for k, t in enumerate(texts) if k % 3] or held).calibrate(held, _noise(_shuffled(held)))


def _trigram_counts(batches):
    found = np.zeros(1 << BUCKETS)
    for batch in batches:
        found += Familiar.counts(batch.column(0).to_pylist())
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at].astype(np.int64))], names=["bucket", "n"])


def acquaint(docs: DataFrame, words: DataFrame) -> Familiar | None:
    """Of all learnable rows: learned from two thirds, by a hash of their doc_id, calibrated on the rest; None if there are none.

    Either part is all rows where it would be empty. Letters of noise are as frequent as in words, the vocabulary() of docs.
    """
    rows = learnable(docs).select("text", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0).alias("apart"))
    parts = {r.apart for r in rows.select("apart").distinct().collect()}
    if not parts:
        return None
    learned, held = (rows.filter(F.col("apart") == k if k in parts else F.lit(True)).select("text") for k in (False, True))
    counts = learned.mapInArrow(_trigram_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(1 << BUCKETS)
    found[counts["bucket"]] = counts["n"]
    model = Familiar(found=found)

    def means(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.float64()) for k in model.means(batch.column(0).to_pylist())], names=["mean", "square", "n"])

    judged = stored(held.mapInArrow(means, "mean double, square double, n double")).filter("n > 0")
    every = judged.agg(F.count("*").alias("rows"), F.sum(F.col("mean") * F.col("n")).alias("mean"), F.sum(F.col("square") * F.col("n")).alias("square"), F.sum("n").alias("n"), F.percentile("n", F.lit(0.5)).alias("usual")).first()
    place = STRAY * (every.rows - 1)
    a, b = (judged.orderBy("mean").limit(k).agg(F.max("mean")).first()[0] for k in (int(place) + 1, min(int(place) + 2, every.rows)))
    chars = words.select("lang", "n", F.explode(F.split("word", "")).alias("c")).groupBy("lang", "c").agg(F.sum("n").alias("n")).orderBy("lang", "c").collect()
    letters = {}
    for r in chars:
        letters.setdefault(r.lang, ([], []))[0].append(r.c)
        letters[r.lang][1].append(r.n)
    size = [sum(n) for _, n in letters.values()]

    def shuffled(rng: random.Random) -> str:
        c, n = rng.choices(list(letters.values()), size)[0]
        return "".join(rng.choices(c, n, k=int(every.usual) + 1))

    return model.settle(a + (b - a) * (place - int(place)), _noise(shuffled), every["mean"] / every.n, every.square / every.n, every.usual)


def _parts(texts: list[str]):
    """Stretches (from, to) of the texts of about BLOCK_BYTES, one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def predict(docs: DataFrame, net: ByteNet | None, lang: str = "lang_pred", score: str = "score", model: Familiar | None = None, known: str = "known") -> DataFrame:
    """docs with the predicted language, its probability, and with a model whether it knows the text; they replace columns of these names.

    The probability is the mean over all positions of the whole text. `und` and 0 where the text is null or holds no letter,
    or nothing was learned. Rows are independent, so repeated rows and ids get equal results; all other columns of docs stay;
    an empty table gives none.
    """
    docs = docs.drop(lang, score, *([known] if model else []))
    if net is None:
        return docs.withColumn(lang, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for s, e in _parts(texts):
                part = texts[s:e]
                p = net.documents([t.encode() for t in part])
                some = np.array([bool(_LETTER.search(t)) for t in part])
                best = p.argmax(1)
                out = [pa.array([net.labels[k] if x else UNKNOWN for k, x in zip(best.tolist(), some)], pa.string()), pa.array(np.where(some, np.minimum(p.max(1), 1.0), 0.0), pa.float64())]
                if model:
                    out.append(pa.array(model.knows(part), pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.slice(s, e - s).columns, *out], names=[*batch.schema.names, lang, score, *([known] if model else [])])

    new = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), *([T.StructField(known, T.BooleanType())] if model else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out; a null doc_id has a null held_out."""
    docs = table(spark, sf_dir, "documents")
    net = learn(stored(vocabulary(docs.select("doc_id", "text", "lang"))))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
