"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits, round by round and feature by feature, shallow trees (two splits of one feature's bins) on the
gradient of the logistic loss; their sum per feature is a lookup table over its bins. The strongest pairs then get
two-dimensional tables in the same way. A score is the intercept plus one addition per table, looked up by bin.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import stored, table

#: Bound of the training sample (labelled documents), and of everything that grows with it.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 48, 8, 8, 150, 0.1
CUT = 0.3
FEATURES = (
    "log_bytes", "letters", "digits", "upper", "spaces", "marks", "odd_marks", "non_ascii", "newlines", "bars", "log_words", "word_len",
    "distinct_words", "repeats", "top_word", "line_len", "distinct_lines", "stops", "shouts", "commas",
)

_CLASS = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "digits": range(48, 58), "upper": range(65, 91), "spaces": [32, *range(9, 14)],
    "marks": [x for x in range(33, 127) if not chr(x).isalnum()],
    "odd_marks": list(b"#$%&*@^~<>{}[]\\/|=+_"), "non_ascii": range(128, 256), "newlines": [10], "bars": list(b"|"),
    "stops": list(b".?"), "shouts": list(b"!"), "commas": list(b",;:"),
}
_SHARE = {}
for _name, _codes in _CLASS.items():
    _SHARE[_name] = np.zeros(256, np.uint8)
    _SHARE[_name][list(_codes)] = 1


def features(texts: list[bytes]) -> np.ndarray:
    """(n, features) of whole texts, vectorised over their joined bytes."""
    data, bounds = hashing.joined(texts)
    size = np.diff(bounds)
    n, out = len(texts), {}
    full = np.maximum(size, 1)
    owner = np.repeat(np.arange(n), size)
    per = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) if len(data) else np.zeros((n, 256))
    for name, one in _SHARE.items():
        out[name] = (per @ one) / full
    w, wb = hashing.words(data, bounds)
    count = np.diff(wb)
    some = np.maximum(count, 1)
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(count)
    out["word_len"] = (size - out["spaces"] * size) / some
    distinct, top, again, lines = (np.zeros(n) for _ in range(4))
    for i in range(n):
        own = w[wb[i] : wb[i + 1]]
        if len(own):
            c = np.unique(own, return_counts=True)[1]
            distinct[i], top[i] = len(c) / len(own), c.max() / len(own)
            again[i] = (own[1:] == own[:-1]).sum() / len(own)
        parts = texts[i].split(b"\n")
        lines[i] = len(set(parts)) / len(parts)
    out |= {"distinct_words": distinct, "top_word": top, "repeats": again, "distinct_lines": lines}
    out["line_len"] = np.log1p(size / (1 + out["newlines"] * size))
    return np.stack([out[f] for f in FEATURES], axis=1)


class AdditiveModel:
    """intercept + sum of one-feature tables + sum of two-feature tables over bins."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.intercept, self.one, self.two = 0.0, [], {}

    @staticmethod
    def _steps(g: np.ndarray, h: np.ndarray, splits: int = 2) -> np.ndarray:
        """A tree over ordered bins with at most so many splits: the Newton step of each bin."""
        parts = [(0, len(g))]
        for _ in range(splits):
            best = (1e-9, None)
            for k, (s, e) in enumerate(parts):
                gs, hs = np.cumsum(g[s:e])[:-1], np.cumsum(h[s:e])[:-1]
                if not len(gs):
                    continue
                gt, ht = g[s:e].sum(), h[s:e].sum()
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, s + at + 1))
            if best[1] is None:
                break
            k, at = best[1]
            s, e = parts.pop(k)
            parts += [(s, at), (at, e)]
        step = np.zeros(len(g))
        for s, e in parts:
            step[s:e] = -g[s:e].sum() / (h[s:e].sum() + 1)
        return step

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        x = np.nan_to_num(x)
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b = self.bins(x)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.intercept = float(np.log(share / (1 - share)))
        self.one = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for k, t in enumerate(self.one):
                p = 1 / (1 + np.exp(-f))
                step = RATE * self._steps(np.bincount(b[:, k], p - y, len(t)), np.bincount(b[:, k], p * (1 - p), len(t)))
                t += step
                f += step[b[:, k]]
        coarse = [(np.arange(len(t)) * PAIR_BINS // len(t)) for t in self.one]
        c = np.stack([coarse[k][b[:, k]] for k in range(x.shape[1])], axis=1)
        p = 1 / (1 + np.exp(-f))

        def gain(ij):
            cell = c[:, ij[0]] * PAIR_BINS + c[:, ij[1]]
            g, h = np.bincount(cell, p - y, PAIR_BINS**2), np.bincount(cell, p * (1 - p), PAIR_BINS**2)
            return (g**2 / (h + 1)).sum()

        for i, j in sorted(combinations(range(x.shape[1]), 2), key=gain, reverse=True)[:PAIRS]:
            self.two[i, j] = np.zeros((PAIR_BINS, PAIR_BINS))
        for _ in range(ROUNDS // 3):
            for (i, j), t in self.two.items():
                p = 1 / (1 + np.exp(-f))
                cell = c[:, i] * PAIR_BINS + c[:, j]
                g, h = np.bincount(cell, p - y, PAIR_BINS**2).reshape(t.shape), np.bincount(cell, p * (1 - p), PAIR_BINS**2).reshape(t.shape)
                # Depth two: the best cut of the first feature, then one cut of the second on either side.
                first = self._steps(g.sum(1), h.sum(1), 1)
                at = int(np.flatnonzero(np.diff(first))[0]) + 1 if np.diff(first).any() else PAIR_BINS
                step = np.zeros(t.shape)
                for part in (slice(0, at), slice(at, PAIR_BINS)):
                    step[part] = RATE * self._steps(g[part].sum(0), h[part].sum(0), 1)
                t += step
                f += step[c[:, i], c[:, j]]
        self.coarse = coarse
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(np.nan_to_num(x))
        f = np.full(len(b), self.intercept)
        for k, t in enumerate(self.one):
            f += t[b[:, k]]
        for (i, j), t in self.two.items():
            f += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-f))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def feature_table(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, f: array of FEATURES) of every row, from its whole text; a null text is empty.

    Null and repeated keys are rows like others, other columns are not read, an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                for k in range(0, max(len(texts), 1), 128):
                    part = texts[k : k + 128]
                    if part:
                        f = features(part).astype(np.float32)
                        values = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(part)), values], names=[key, "f"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, f array<float>")


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> AdditiveModel | None:
    """From at most most labelled rows (by hash) that may be learned from; None if there are none.

    Null labels and rows without a doc_id teach nothing; where a doc_id repeats, each pair of text and label counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("_y"))
    share = min(1.0, 2 * most / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    got = rows.join(known, "doc_id").select("f", "_y", F.xxhash64("doc_id").alias("o")).orderBy("o", "f", "_y").limit(most).toPandas()
    return None if got.empty else AdditiveModel().fit(np.stack(got["f"]).astype(float), got["_y"].to_numpy(float))


def score(rows: DataFrame, model: AdditiveModel | None, cut: float = CUT) -> DataFrame:
    """rows (with f, which goes) with score and predicted, which replace columns of these names; 0.5 where nothing was learned.

    Rows are scored one by one, so repeated rows score alike, and a null key has its score; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def added(f: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(f).astype(float)) if len(f) else np.zeros(0))

    value = added("f") if model else F.lit(0.5)
    return rows.withColumn("score", value).withColumn("predicted", (F.col("score") >= cut).cast("int")).drop("f")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled ones that are not held out; a null doc_id has a null held_out."""
    rows = stored(feature_table(table(spark, sf_dir, "documents")))
    model = fit(rows, table(spark, sf_dir, "labels"))
    return score(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
