"""Approximate nearest neighbours: score-aware (anisotropic) product quantisation, four-bit table scans, exact reranking.

Rows belong to cells (k-means of a bounded sample); what is left of a row beside its cell's centre, in units of the cell's
width, is quantised. With r a row's residual, -|q - x|^2 / 2 is (q - c) r less |q - c|^2 / 2 and |r|^2 / 2, so nearness is an inner
product but for known numbers. Codebooks of 16 words per subspace are trained by the anisotropic loss: the residual error's part
parallel to r weighs more than the orthogonal part, because it changes high inner products most. Every row is encoded once, with
the norms of its residual and of its error; the table of codes (four bits a subspace) is what the scans read. A scan adds one
looked-up value per subspace for each row. By its error each row has a bracket: all rows whose bracket reaches the k-th best one get
exact distances on the original vectors, few where codes tell rows apart and more where they don't, and RERANK at least.

Codes are dealt into blocks by row, and each block meets every block of queries (the stated query set against all rows). Of
copies of one vector only the k + 1 smallest ids are scanned: the others are as far and come later in every result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Bound of the training sample.
TRAIN_ROWS = 8000
WORDS, PER_SPACE, ETA, ROUNDS = 16, 1, 2.0, 8
#: Rows whose exact distance is computed for each query at least, cells, and half the width of a bracket in standard deviations.
RERANK, CELLS, WIDE = 32, 64, 3.5
#: Codes per block, queries per block, and both at once in a scan.
ROWS, QUERIES, AT_ONCE = 1 << 16, 1024, 32


class Codebook:
    """words: (spaces, 16, width) over vectors padded to spaces * width."""

    def __init__(self, words: np.ndarray, dim: int):
        self.words, self.dim = words, dim

    @staticmethod
    def raised(x: np.ndarray, spaces: int, width: int) -> np.ndarray:
        """x' of each row, cut into subspaces: (n, spaces, width)."""
        out = np.zeros((len(x), spaces * width))
        out[:, : x.shape[1]] = x
        out[:, x.shape[1]] = -0.5 * (x * x).sum(1)
        return out.reshape(len(x), spaces, width)

    @classmethod
    def train(cls, x: np.ndarray, per: int = PER_SPACE, eta: float = ETA, rounds: int = ROUNDS, seed: int = 3) -> Codebook:
        """Alternates anisotropic assignment (per subspace, given the others' residuals along x) and the closed-form update."""
        dim = x.shape[1]
        spaces = -(-(dim + 1) // per)
        r = cls.raised(x, spaces, per)
        rng = np.random.default_rng(seed)
        pick = rng.choice(len(x), WORDS, replace=len(x) < WORDS)
        book = cls(r[pick].transpose(1, 0, 2) + rng.normal(0, 1e-6, (spaces, WORDS, per)), dim)
        for _ in range(rounds):
            codes = book.encode_raised(r, eta)
            unit = r / np.maximum(np.linalg.norm(r.reshape(len(r), -1), axis=1), 1e-12)[:, None, None]
            got = book.words[np.arange(spaces), codes]
            along = ((r - got) * unit).sum((1, 2))
            for s in range(spaces):
                own = along - ((r[:, s] - got[:, s]) * unit[:, s]).sum(1)  # the residual along x of the other subspaces
                for w in range(WORDS):
                    at = np.flatnonzero(codes[:, s] == w)
                    if len(at):
                        u = unit[at, s]
                        left = len(at) * np.eye(per) + (eta - 1) * u.T @ u
                        right = r[at, s].sum(0) + (eta - 1) * (u * (own[at] + (u * r[at, s]).sum(1))[:, None]).sum(0)
                        book.words[s, w] = np.linalg.solve(left, right)
        return book

    def encode_raised(self, r: np.ndarray, eta: float = ETA) -> np.ndarray:
        n, spaces, _ = r.shape
        unit = r / np.maximum(np.linalg.norm(r.reshape(n, -1), axis=1), 1e-12)[:, None, None]
        codes, along = np.zeros((n, spaces), np.uint8), np.zeros(n)
        for s in range(spaces):
            d = r[:, s, None] - self.words[s][None]
            par = along[:, None] + (d * unit[:, s, None]).sum(2)
            loss = (d * d).sum(2) + (eta - 1) * par * par
            codes[:, s] = loss.argmin(1)
            along = par[np.arange(n), codes[:, s]]
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of four bits, two to a byte."""
        c = self.encode_raised(self.raised(x, *self.words.shape[::2]))
        if c.shape[1] % 2:
            c = np.pad(c, ((0, 0), (0, 1)))
        return c[:, ::2] | c[:, 1::2] << 4

    def scan(self, q: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """(queries, rows): approximate inner products of q' and x', by table lookups."""
        spaces, _, per = self.words.shape
        padded = np.zeros((len(q), spaces * per))
        padded[:, : q.shape[1]], padded[:, q.shape[1]] = q, 1
        tables = np.einsum("qsw,skw->sqk", padded.reshape(len(q), spaces, per), self.words).astype(np.float32)
        out = np.zeros((len(q), len(packed)), np.float32)
        for s in range(spaces):
            code = packed[:, s // 2] >> 4 if s % 2 else packed[:, s // 2] & 15
            out += tables[s].take(code, axis=1)
        return out


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has dim finite components, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = F.col("embedding")
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size(e) == dim)).filter(F.forall(e, finite) & F.exists(e, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<float>").alias("embedding"))


class Cells:
    """Centres of k-means cells over centred vectors, the width of each, and the codebook of what is left."""

    def __init__(self, x: np.ndarray, number: int = CELLS, rounds: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean = x.mean(0)
        x = x - self.mean
        centres = x[rng.integers(len(x))][None]
        far = np.full(len(x), np.inf)
        while len(centres) < min(number, len(x)):  # far from those before, by chance
            far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
            if not far.sum() > 0:
                break
            centres = np.r_[centres, x[rng.choice(len(x), p=far / far.sum())][None]]
        for _ in range(rounds):
            own = self._nearest(x, centres)
            centres = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        own = self._nearest(x, centres)
        left = x - centres[own]
        wide = np.sqrt((left * left).sum(1).mean()) or 1.0
        width = np.array([np.sqrt((left[own == c] ** 2).sum(1).mean()) if (own == c).sum() > 3 else wide for c in range(len(centres))])
        self.centres, self.width = centres, np.where(width > 0, width, wide)
        self.book = Codebook.train(left / self.width[own][:, None])

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells, packed codes, half squared norms of residuals and norms of their errors."""
        x = x - self.mean
        cell = self._nearest(x, self.centres)
        left, dim = x - self.centres[cell], x.shape[1]
        codes = self.book.encode(left / self.width[cell][:, None])
        plain = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(x), -1)[:, :dim] if len(x) else codes
        got = self.book.words[np.arange(self.book.words.shape[0]), np.pad(plain, ((0, 0), (0, self.book.words.shape[0] - plain.shape[1])))].reshape(len(x), -1)[:, :dim]
        error = left - got * self.width[cell][:, None]
        return cell, codes, 0.5 * (left * left).sum(1), np.sqrt((error * error).sum(1))

    def scan(self, q: np.ndarray, cell: np.ndarray, packed: np.ndarray, half: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rows): about -|q - x|^2 / 2, and half the width of its bracket, for rows in the order of their cells."""
        q, dim = q - self.mean, q.shape[1]
        words = self.book.words[:dim, :, 0]
        about, slack = np.zeros((len(q), len(cell))), np.zeros((len(q), len(cell)))
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
            c = cell[s]
            d = q - self.centres[c]
            tables = ((d * self.width[c])[:, :, None] * words).astype(np.float32)
            total = np.zeros((len(q), e - s), np.float32)
            for k in range(dim):
                code = packed[s:e, k // 2] >> 4 if k % 2 else packed[s:e, k // 2] & 15
                total += tables[:, k].take(code, axis=1)
            about[:, s:e] = total - (0.5 * (d * d).sum(1))[:, None] - half[None, s:e]
            slack[:, s:e] = (np.sqrt((d * d).sum(1)) * min(1.0, WIDE / dim**0.5))[:, None] * error[None, s:e]
        return about, slack * (1 + 1e-6) + 1e-9 * np.abs(about)


def code_table(rows: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(vec_id, cell, code, half, error, row): each row's code; of one vector's copies those of the k + 1 smallest ids."""

    def run(batches):
        for b in batches:
            if len(b):
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                cell, codes, half, error = cells.encode(x)
                codes = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), codes, pa.array(half), pa.array(error), b.column(2), b.column(3)], names=["vec_id", "cell", "code", "half", "error", "a", "b"])

    one, two = (F.xxhash64(F.lit(i), "embedding").alias(c) for i, c in enumerate("ab"))
    encoded = rows.select("vec_id", "embedding", one, two).mapInArrow(run, "vec_id long, cell int, code binary, half double, error double, a long, b long")
    once = encoded.groupBy("a", "b", "vec_id").agg(F.first(F.struct("cell", "code", "half", "error")).alias("x"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    return stored(once.withColumn("place", place).filter(F.col("place") <= k + 1).select("vec_id", "x.*", F.monotonically_increasing_id().alias("row")))


def chosen(ids: np.ndarray, about: np.ndarray, slack: np.ndarray, k: int, least: int, unique: bool) -> np.ndarray:
    """The least best rows, and all whose bracket reaches the k-th best lower end of different ids."""
    good = np.flatnonzero(np.isfinite(about))
    low = (about - slack)[good]
    if not unique:
        best = pd.Series(low).groupby(ids[good]).max().to_numpy()
    else:
        best = low
    reach = np.partition(best, len(best) - k)[len(best) - k] if len(best) > k else -np.inf
    floor = np.partition(about[good], len(good) - least)[len(good) - least] if len(good) > least else -np.inf
    return good[((about + slack)[good] >= reach) | (about[good] >= floor)]


def scanned(codes: DataFrame, queries: DataFrame, cells: Cells, k: int, least: int) -> DataFrame:
    """(query_id, vec_id): the rows that may be among the k nearest of each query, by their brackets, and the least best ones."""
    blocks, q_blocks = (max(1, -(-df.count() // size)) for df, size in ((codes, ROWS), (queries, QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = codes.select("vec_id", "cell", "code", "half", "error", F.pmod("row", F.lit(blocks)).alias("b")).withColumn("c", every(q_blocks))
    asked = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).alias("c")).withColumn("b", every(blocks))

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "about": np.zeros(0), "slack": np.zeros(0)})]
        if len(q) and len(d):
            d = d.sort_values("cell", kind="stable")
            ids, packed = d["vec_id"].to_numpy(), np.frombuffer(b"".join(d["code"]), np.uint8).reshape(len(d), -1)
            cell, half, error = (d[c].to_numpy() for c in ("cell", "half", "error"))
            qx, qi, unique = np.stack(q["embedding"]).astype(np.float64), q["vec_id"].to_numpy(), len(np.unique(ids)) == len(ids)
            for s in range(0, len(q), AT_ONCE):
                about, slack = cells.scan(qx[s : s + AT_ONCE], cell, packed, half, error)
                for i in range(len(about)):
                    about[i, ids == qi[s + i]] = -np.inf
                    some = chosen(ids, about[i], slack[i], k, least, unique)
                    out.append(pd.DataFrame({"query_id": qi[s + i], "vec_id": ids[some], "about": about[i, some], "slack": slack[i, some]}))
        return pd.concat(out)

    met = asked.groupBy("b", "c").cogroup(dealt.groupBy("b", "c")).applyInPandas(meet, "query_id long, vec_id long, about double, slack double")
    one = stored(met.groupBy("query_id", "vec_id").agg(F.max("about").alias("about"), F.max(F.col("about") - F.col("slack")).alias("low"), F.max(F.col("about") + F.col("slack")).alias("high")))
    if blocks == 1:
        return one.select("query_id", "vec_id")
    at = lambda by, name: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")).alias(name)
    reach = one.select("query_id", "low", at("low", "place")).filter(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).alias("reach"))
    floor = one.select("query_id", "about", at("about", "place")).filter(F.col("place") <= least).groupBy("query_id").agg(F.min("about").alias("floor"))
    met = one.join(reach, "query_id").join(floor, "query_id")
    return met.filter(F.col("reach").isNull() | (F.col("high") >= F.col("reach")) | (F.col("about") >= F.col("floor"))).select("query_id", "vec_id")


def distance(a: Column, b: Column) -> Column:
    """Euclidean, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def search(vectors: DataFrame, every: int = 100, k: int = 10, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by every.

    Vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part, nor do rows
    without a vec_id. Rows with one vec_id are one candidate, at its nearest, and one query, by its nearest row; a query's own
    vec_id is none. Ties go to smaller ids. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not common:
        return empty
    rows = usable(vectors, common["d"])
    n = rows.count()
    if not n:
        return empty
    share = min(1.0, 2 * TRAIN_ROWS / n)
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    x = np.array([r[0] for r in drawn.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(TRAIN_ROWS).select("embedding").collect()], float)
    cells = Cells(x)
    queries = rows.filter(F.col("vec_id") % every == 0)
    found = scanned(code_table(rows, cells, k), queries, cells, k, max(rerank, k))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scores = found.join(rows, "vec_id").join(asked, "query_id").select("query_id", "vec_id", distance(F.col("q"), F.col("embedding")).alias("score"))
    one = scores.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    return one.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() of the embeddings: every 100th row against all others."""
    return search(table(spark, sf_dir, "embeddings"))
