"""A stored graph index of vectors: navigable graphs, one for each part of the rows, searched best first.

Rows are dealt into parts by a hash of their id, so parts are even whatever the vectors are like, and a batch that is added
brings parts of its own. A part is one row of the table: ids, vectors and, for its levels, links. Each level holds one of
SHRINK rows of the one below (drawn by hash); a row links with those of its nearest neighbours that no linked one is
nearer to, and back. A search walks down the levels, with the width best rows in hand, and compares only rows that it meets.

Inner products become distances by one more component, sqrt(M * M - |x| * |x|), M being the largest norm of the part. The k
best of the parts are merged by a window whose limit Spark applies within tasks first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import dot
from ..sources.readers import exists

#: Rows of a part, links of a row, neighbours that are looked at for them, rows of a level for one of the next, rows of the top one.
ROWS, DEGREE, LOOKED, SHRINK, TOP = 65_536, 32, 48, 16, 128
#: Rows in hand of a search, and queries walked at once.
WIDTH, AT_ONCE = 35, 128
#: Queries that are sent to all tasks at once; more come in turns.
QUERIES = 65_536
PART = "part string, n int, dim int, ids binary, vectors binary, links array<binary>"


def raised(x: np.ndarray) -> np.ndarray:
    norms = (x * x).sum(1)
    return np.c_[x, np.sqrt(np.maximum(norms.max() - norms, 0))].astype(np.float32)


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each row, nearest first, with squared distances."""
    half = 0.5 * (x * x).sum(1)
    out, far = np.zeros((len(x), k), np.int32), np.zeros((len(x), k), np.float32)
    for s in range(0, len(x), 512):
        d = half[None] - x[s : s + 512] @ x.T
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        some = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) else np.broadcast_to(np.arange(len(x)), d.shape)[:, :k]
        d = np.take_along_axis(d, some, 1)
        order = np.argsort(d, axis=1, kind="stable")
        out[s : s + 512], far[s : s + 512] = np.take_along_axis(some, order, 1), 2 * (np.take_along_axis(d, order, 1) + half[s : s + 512, None])
    return out, far


def linked(x: np.ndarray, degree: int = DEGREE, looked: int = LOOKED) -> np.ndarray:
    """(rows, degree): links of each row, -1 where there are fewer."""
    n, k = len(x), min(looked, len(x) - 1)
    if k < 1:
        return np.full((n, degree), -1, np.int32)
    near, far = nearest(x, k)
    keep = np.zeros((n, k), bool)
    for s in range(0, n, 1024):
        own = x[near[s : s + 1024]]
        square = (own * own).sum(2)
        between = square[:, :, None] + square[:, None] - 2 * own @ own.transpose(0, 2, 1)
        for j in range(k):
            hidden = (keep[s : s + 1024] & (between[:, j] < far[s : s + 1024, j, None])).any(1)
            keep[s : s + 1024, j] = ~hidden
    keep &= np.cumsum(keep, axis=1) <= degree // 2 + degree // 4
    keep[:, :4] = True  # copies and tight groups would hide each other
    i, j = np.nonzero(keep)
    a, b, d = np.r_[i, near[i, j]], np.r_[near[i, j], i], np.r_[far[i, j], far[i, j]]
    order = np.lexsort((b, d, np.repeat([0, 1], len(i)), a))  # own links first, then those of others, nearest first
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    seen = np.lexsort((b, a))
    same = (a[seen][1:] == a[seen][:-1]) & (b[seen][1:] == b[seen][:-1])
    new[np.maximum(seen[1:], seen[:-1])[same]] = False
    a, b = a[new], b[new]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, degree), -1, np.int32)
    out[a[place < degree], place[place < degree]] = b[place < degree]
    return out


def built(ids: np.ndarray, x: np.ndarray) -> dict:
    """One part. Rows are in the order of their draw, so that a level is the first rows of the one below."""
    y, links, n = raised(x.astype(np.float64)), [], len(x)
    while n > TOP:
        links.append(linked(y[:n]).tobytes())
        n = -(-n // SHRINK)
    return {"n": len(x), "dim": x.shape[1], "ids": ids.astype("<i8").tobytes(), "vectors": x.astype("<f4").tobytes(), "links": links}


def walked(y: np.ndarray, links: list[np.ndarray], q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(width best rows of each query, how many rows were compared); -1 where there are fewer."""
    top = len(y)
    for _ in links:
        top = -(-top // SHRINK)
    half = 0.5 * (y * y).sum(1)
    d = half[None, :top] - q @ y[:top].T
    hand = np.argsort(d, axis=1, kind="stable")[:, :width].astype(np.int32)
    value = np.take_along_axis(d, hand, 1)
    compared = np.full(len(q), top)
    for net in reversed(links):
        most = width if net is links[0] else max(width // 4, 8)
        hand, value = hand[:, :most], value[:, :most]
        if hand.shape[1] < most:
            more = most - hand.shape[1]
            hand, value = np.pad(hand, ((0, 0), (0, more)), constant_values=-1), np.pad(value, ((0, 0), (0, more)), constant_values=np.inf)
        seen, done = np.zeros((len(q), len(net)), bool), hand < 0
        rows = np.arange(len(q))
        seen[np.repeat(rows, most)[(hand >= 0).ravel()], hand[hand >= 0]] = True
        while True:
            left = np.where(done, np.inf, value)
            at = left.argmin(1)
            live = np.flatnonzero(np.isfinite(left[rows, at]))
            if not len(live):
                break
            done[live, at[live]] = True
            met = net[hand[live, at[live]]]
            new = (met >= 0) & ~seen[live[:, None], met]
            r, c = np.nonzero(new)
            node = met[r, c]
            seen[live[r], node] = True
            far = np.full(met.shape, np.inf, np.float32)
            far[r, c] = half[node] - np.einsum("nd,nd->n", y[node], q[live[r]])
            compared[live] += new.sum(1)
            ids, d, old = np.c_[hand[live], met], np.c_[value[live], far], np.c_[done[live], np.zeros(met.shape, bool)]
            order = np.argsort(d, axis=1, kind="stable")[:, :most]
            hand[live], value[live], done[live] = (np.take_along_axis(z, order, 1) for z in (ids, d, old))
            gone = ~np.isfinite(value)
            hand[gone], done[gone] = -1, True
    return hand, compared


def add(vectors: DataFrame, path: str, rows: int = ROWS) -> int:
    """Adds a batch of vectors (vec_id, embedding, all of one length) to an index, and returns its number of parts.

    Null vectors, and those with a null or non-finite component, are left out. Vectors of different lengths, or with norms
    further apart than a factor of two, are an error: inner products then follow norms more than places. Each batch is one
    append of whole parts.
    """
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    n, least, most, short, long = held.agg(F.count("*"), F.min(norm), F.max(norm), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not n:
        return 0
    if short != long or most > 2 * least:
        raise ValueError(f"vectors of {short} to {long} components and norms {least} to {most}; make them units, or search with top_k()")
    parts = -(-n // rows)
    draw = F.xxhash64(F.lit(5), "vec_id")

    def build(key, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["draw", "vec_id"], kind="stable")
        return pd.DataFrame([{"part": f"{key[0]}", **built(got["vec_id"].to_numpy(), np.stack(got["embedding"]))}])

    dealt = held.withColumn("draw", draw).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    dealt.groupBy("part").applyInPandas(build, PART).write.mode("append").parquet(path)
    return parts


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, width: int = WIDTH, skip_self: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product found for each query (query_id, q)."""
    found = _found(spark, path, queries, k, width, skip_self, digits).filter("vec_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def compared(spark: SparkSession, path: str, queries: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """(query_id, compared): how many rows of all parts a search compares with each query."""
    found = _found(spark, path, queries, k, width, False, 6).filter("vec_id IS NULL")
    return found.groupBy("query_id").agg(F.sum("score").cast("long").alias("compared"))


def _found(spark: SparkSession, path: str, queries: DataFrame, k: int, width: int, skip_self: bool, digits: int) -> DataFrame:
    """(query_id, vec_id, score) of each part, and a row without vec_id that counts the rows compared."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no graph index in {path}; build one with add()")
    index, kind = spark.read.schema(PART).parquet(path), "query_id long, vec_id long, score double"
    asked, turns = queries.select(F.col("query_id").cast("long").alias("query_id"), "q"), max(1, -(-queries.count() // QUERIES))
    out = None
    for turn in range(turns):
        held = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).toPandas()
        if held.empty:
            continue
        shared = spark.sparkContext.broadcast((held["query_id"].to_numpy(), np.stack(held["q"]).astype(np.float64)))

        def scan(batches, shared=shared):
            ids, q = shared.value
            for b in batches:
                for part in b.to_pylist():
                    n, own = part["n"], np.frombuffer(part["ids"], "<i8")
                    x = np.frombuffer(part["vectors"], "<f4").reshape(n, -1)
                    y, links = raised(x.astype(np.float64)), [np.frombuffer(z, "<i4").reshape(-1, DEGREE) for z in part["links"]]
                    for s in range(0, len(q), AT_ONCE):
                        some = q[s : s + AT_ONCE]
                        hand, count = walked(y, links, np.c_[some, np.zeros(len(some))].astype(np.float32), width)
                        r, c = np.nonzero(hand >= 0)
                        node = hand[r, c]
                        score = np.round(np.einsum("nd,nd->n", x[node].astype(np.float64), some[r]), digits)
                        if skip_self:
                            other = own[node] != ids[s + r]
                            r, node, score = r[other], node[other], score[other]
                        order = np.lexsort((own[node], -score, r))
                        r, node, score = r[order], node[order], score[order]
                        best = np.arange(len(r)) - np.searchsorted(r, r) < k
                        r, node, score = r[best], node[best], score[best]
                        vec = pa.concat_arrays([pa.array(own[node]), pa.nulls(len(some), pa.int64())])
                        yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids[s + r], ids[s : s + len(some)]]), vec, pa.array(np.r_[score, count.astype(float)])], names=["query_id", "vec_id", "score"])

        found = index.mapInArrow(scan, kind)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], kind) if out is None else out
