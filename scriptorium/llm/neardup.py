"""Embedding near-dedup: tiles of vectors in the order of their principal components, compared by growing leading parts.

1. Equal vectors make one class, which counts as often as it has rows. Classes are compared as unit vectors.
2. Principal axes come from the second moments of all classes. Space is cut by medians along the leading axes into cells
   (a bounded sample draws the cuts; any cut gives the same result), cells of many classes into tiles. Unit vectors of
   cosine t or more are no further apart than sqrt(2 - 2t), so a class visits only the cells within that distance.
3. A pair of tiles adds up products of the leading 8, 16, 32... components. What the rest can add is at most the product of
   the norms of both suffixes: pairs that can't reach t any more go at each step, and what is left in the end is
   decided by the cosine of the original vectors.

A pair of tiles gives for each class how many rows it links with, and one link from each class to the root of its links there.
The pairs themselves are not written; every link between different vectors counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .graphs import components
from .moments import finite, matrix, summed

LEAST = 0.95
#: Classes of a tile, tiles whose visitors meet one tile at once, cells at most.
TILE, TOGETHER, CELLS = 8192, 8, 1024
#: Bound of the sample that draws the cells, and the leading axes that are cut.
SAMPLE, AXES = 32_768, 16
#: Rows and columns of a block of products, and what rounding may hide.
STRIP, SLACK = (512, 4096), 1e-9
#: Below this share of pairs left, they are followed one by one.
SPARSE = 0.05


def units(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, very large and very small ones too."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(sample: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of number boxes that fill space, cut at medians of the widest axes."""
    width = sample.shape[1]
    boxes = [(np.arange(len(sample)), np.full(width, -np.inf), np.full(width, np.inf))]
    while len(boxes) < number:
        k = max(range(len(boxes)), key=lambda i: len(boxes[i][0]))
        own, low, high = boxes[k]
        if len(own) < 2:
            break
        axis = int(sample[own].var(axis=0).argmax())
        cut = float(np.median(sample[own, axis]))
        left = sample[own, axis] < cut
        if not left.any():
            break
        a, b = high.copy(), low.copy()
        a[axis] = b[axis] = cut
        boxes[k : k + 1] = [(own[left], low, a), (own[~left], b, high)]
    return np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])


def links(a: np.ndarray, b: np.ndarray, xa: np.ndarray, xb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of cosine least or more. a, b: unit vectors along principal axes; xa, xb: the same, unturned."""
    dim = a.shape[1]
    ends = [e for e in (8, 16, 32, 64, 128, 256, 512, 1024) if e < dim] + [dim]
    tails = lambda x: [np.sqrt(np.maximum(1 - np.cumsum(x * x, axis=1)[:, e - 1], 0)) for e in ends]
    ta, tb, found = tails(a), tails(b), []
    for s in range(0, len(a), STRIP[0]):
        for t in range(0, len(b), STRIP[1]):
            rows, cols = slice(s, s + STRIP[0]), slice(t, t + STRIP[1])
            so_far, i, start = None, None, 0
            for level, end in enumerate(ends):
                if i is None:
                    part = a[rows, start:end] @ b[cols, start:end].T
                    so_far = part if so_far is None else so_far + part
                    left = so_far + ta[level][rows, None] * tb[level][None, cols] >= least - SLACK
                    n = np.count_nonzero(left)
                    if n == 0:
                        break
                    if n < SPARSE * left.size or end == dim:
                        i, j = np.nonzero(left)
                        so_far = so_far[i, j]
                        i, j = i + s, j + t
                else:
                    so_far = so_far + np.einsum("nd,nd->n", a[i, start:end], b[j, start:end])
                    left = so_far + ta[level][i] * tb[level][j] >= least - SLACK
                    i, j, so_far = i[left], j[left], so_far[left]
                start = end
            else:
                for k in range(0, len(i), 100_000):
                    p, q = i[k : k + 100_000], j[k : k + 100_000]
                    exact = np.einsum("nd,nd->n", xa[p], xb[q]) >= least
                    found.append((p[exact], q[exact]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while (root[root] != root).any():
            root = root[root]
        i, j = i[root[i] != root[j]], j[root[i] != root[j]]
    return root


def linked(classes: DataFrame, least: float) -> DataFrame:
    """(u, v, n): for a class u how many rows of other classes link with it (v null), and links (n null) that join its component.

    classes: key, embedding (all of one length), m. Sums of n over u are complete.
    """
    n = classes.count()
    axes = np.linalg.eigh(summed(classes, "embedding", lambda x: units(x).T @ units(x), (dim := classes.select(F.size("embedding")).first()[0],) * 2))[1][:, ::-1]
    width, reach = min(dim, AXES), float(np.sqrt(max(2 - 2 * least, 0)) + SLACK)
    drawn = classes if n <= SAMPLE else classes.filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000)) < int(SAMPLE / n * 1_000_000) + 1)
    drawn = matrix(pa.array(drawn.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("embedding").toPandas()["embedding"]))
    low, high = cells(units(drawn) @ axes[:, :width], min(CELLS, -(-n // TILE)))

    def place(batches):
        for b in batches:
            if not len(b):
                continue
            y = units(matrix(b.column(1))) @ axes[:, :width]
            far = np.zeros((len(y), len(low)))
            for k in range(width):
                far += np.square(np.maximum(low[None, :, k] - y[:, k, None], 0) + np.maximum(y[:, k, None] - high[None, :, k], 0))
            inside = np.all((y[:, None] >= low[None]) & (y[:, None] < high[None]), axis=2) if len(low) <= 64 else far == 0
            near = far <= reach * reach
            visits = [np.flatnonzero(x).astype(np.int32) for x in near]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(inside.argmax(1), pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=["key", "embedding", "m", "cell", "visits"])

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = stored(classes.select("key", "embedding", "m").mapInArrow(place, f"key long, embedding {kind}, m long, cell int, visits array<int>"))
    number = {r["cell"]: -(-r["count"] // TILE) for r in placed.groupBy("cell").count().collect()}  # a row for each cell, so CELLS at most
    tiles = F.array(*(F.lit(number.get(k, 0)) for k in range(len(low))))
    first = F.array(*map(F.lit, np.cumsum([0] + [number.get(k, 0) for k in range(len(low))])[:-1].tolist()))
    own = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("key"), F.get(tiles, F.col("cell"))).cast("int")
    placed = placed.withColumn("tile", own)
    met = F.flatten(F.transform("visits", lambda c: F.when(F.get(tiles, c) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.get(first, c), F.get(first, c) + F.get(tiles, c) - 1))))
    # Of two tiles one visits the other, as often the larger as the smaller.
    goes = F.filter(met, lambda t: (t != F.col("tile")) & ((t > F.col("tile")) == ((t + F.col("tile")) % 2 == 1)))
    visitors = placed.select("key", "embedding", "m", F.explode(goes).alias("at"), F.floor(F.col("tile") / TOGETHER).cast("int").alias("part"), F.lit(False).alias("home"))
    # A row for each pair of a tile and a part that visits it, from a scan that needs no vectors.
    pairs = visitors.select("at", "part").distinct()
    homes = placed.select("key", "embedding", "m", F.col("tile").alias("at"))
    homes = homes.join(pairs, "at").unionByName(homes.withColumn("part", F.lit(-1))).withColumn("home", F.lit(True))

    def compare(got: pd.DataFrame) -> pd.DataFrame:
        """Links between the homes and the visitors of a tile, or among the homes."""
        home = got["home"].to_numpy()
        keys, m = got["key"].to_numpy(), got["m"].to_numpy()
        x = units(np.stack(got["embedding"]).astype(np.float64))
        y = x @ axes
        a = np.flatnonzero(home)
        if got["part"].iloc[0] < 0:
            i, j = links(y, y, x, x, least)
            i, j = i[i < j], j[i < j]
        else:
            b = np.flatnonzero(~home)
            i, j = links(y[a], y[b], x[a], x[b], least)
            i, j = a[i], b[j]
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, i, m[j])
        np.add.at(n, j, m[i])
        root = roots(len(keys), i, j)
        some, below = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(keys)))
        counts = pd.DataFrame({"u": keys[some], "v": pd.array([None] * len(some), "Int64"), "n": pd.array(n[some], "Int64")})
        return pd.concat([counts, pd.DataFrame({"u": keys[below], "v": pd.array(keys[root[below]], "Int64"), "n": pd.array([None] * len(below), "Int64")})])

    return homes.unionByName(visitors).groupBy("at", "part").applyInPandas(compare, "u long, v long, n long")


def same(embedding: Column) -> tuple[Column, Column]:
    """128 bits that stand for a vector."""
    return F.xxhash64(F.lit(1), embedding), F.xxhash64(F.lit(2), embedding)


def dedup(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row: how many other rows have a cosine of least or more, the smallest
    vec_id reachable over such links, and whether that is its own.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do rows without a vec_id (their
    component is null, and they are kept); vectors of different lengths don't link. Rows of one vec_id are rows like others: equal
    vectors link, and all rows of the smallest vec_id are kept. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    a, b = same(e)
    able = F.coalesce(finite(e) & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", able.alias("able"), a.alias("a"), b.alias("b"))
    classes = rows.filter("able").groupBy("a", "b").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes = stored(classes.withColumn("key", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], "u long, v long, n long")
    for (length,) in sorted(classes.select(F.size("embedding")).distinct().collect()):
        found = found.unionAll(linked(classes.filter(F.size("embedding") == length), least))
    found = stored(found)
    counts = found.filter("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    comps = components(found.filter("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "key")
    ids = classes.select("key", "least").join(comps, "key")
    ids = ids.join(ids.groupBy("root").agg(F.min("least").alias("id")), "root").select("key", "id")
    judged = classes.select("a", "b", "key", "m", "least").join(counts, "key", "left").join(ids, "key", "left")
    judged = judged.select("a", "b", F.lit(True).alias("able"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("id", "least").alias("id"))
    out = rows.drop("embedding").join(judged, ["a", "b", "able"], "left")
    own = F.coalesce("id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op11_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup() of the embeddings."""
    return dedup(table(spark, sf_dir, "embeddings"))


ORACLE = """WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), y AS (SELECT * FROM x WHERE v IS NOT NULL AND len(v) > 0
      AND len(list_filter(v, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
    l AS (SELECT p.vec_id AS u, q.vec_id AS v FROM y p JOIN y q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.95),
    r AS (SELECT vec_id AS u, vec_id AS v FROM x UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
    c AS (SELECT u, min(v) AS component_id FROM r GROUP BY 1), n AS (SELECT u, count(*) AS n FROM l GROUP BY 1)
    SELECT x.vec_id, coalesce(n, 0) AS n_links, component_id, x.vec_id = component_id AS kept FROM x JOIN c ON c.u = x.vec_id LEFT JOIN n ON n.u = x.vec_id"""
