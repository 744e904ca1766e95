"""A stored text index: postings with block maxima, added to by batch, searched by BM25 with skipping.

A batch's documents are dealt into ranges of RANGE documents by a hash. A row of the postings is one term in one range: how many
documents hold it, its highest count, the shortest of these documents (the block maximum, good for any mean length), and
the documents themselves. A file holds whole ranges, sorted by term, so a search reads only the pages with asked terms.

A search reads the heads of the asked terms (not their documents) and adds up, for each query and range, the most that
a document there can score. The ranges that promise most are scored first, which gives the k-th best score so far; then
those whose bound reaches it. All others can't hold a document of the result, and their documents are never joined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.readers import exists
from ..sources.shared import written

#: Documents of a range on average, ranges that are scored first.
RANGE, FIRST = 512, 4
#: Up to so many asked terms are pushed down to the scan, and sent to all tasks (some tens of bytes each).
TERMS = 10_000
#: Rows of weights (32 bytes) and of ranges (24 bytes) that are sent to all tasks; more are joined by a shuffle.
WEIGHTS, WANTED = 200_000, 1_000_000
#: Tokens of the documents of a task on average, whatever the size of the table.
TASK_TOKENS = 2_000_000
POSTINGS = "term string, range int, n int, max_tf int, min_len int, docs array<struct<doc_id:bigint,tf:int,len:int>>, batch string"
BATCHES = "batch string, n_docs long, n_texts long, n_tokens long"


def add(docs: DataFrame, path: str) -> str:
    """Adds a batch of new documents (doc_id, text) and returns its name.

    Postings are written before the row that names the batch, and only named batches are searched: a writer that fails leaves
    nothing behind that counts, and several may write at once. Null texts count as documents without length.
    """
    batch = uuid.uuid4().hex
    n, known, total = docs.select(F.size(tokens(F.lower("text"))).alias("len")).agg(F.count("*"), F.count("len"), F.coalesce(F.sum("len"), F.lit(0))).first()
    ranges = max(1, -(-n // RANGE))
    # Texts are dealt by range once; counts by document and term, lists by term and files are then made where the texts are.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")).repartition(parts(docs.sparkSession, total, ranges), "range")
    texts = texts.select("range", "doc_id", tokens(F.lower("text")).alias("t")).withColumn("len", F.size("t"))
    tf = texts.select("range", "doc_id", "len", F.explode("t").alias("term")).groupBy("range", "doc_id", "len", "term").agg(F.count("*").cast("int").alias("tf"))
    both = F.col("tf").cast("long") * (1 << 32) + F.col("len")  # two numbers in one, as lists of structs take more than twice the room
    rows = tf.groupBy("range", "term").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.collect_list("doc_id").alias("ids"), F.collect_list(both).alias("counts"))
    docs_of = F.zip_with("ids", "counts", lambda i, c: F.struct(i.alias("doc_id"), F.shiftright(c, 32).cast("int").alias("tf"), c.bitwiseAND((1 << 32) - 1).cast("int").alias("len")))
    rows = rows.select("term", "range", "n", "max_tf", "min_len", F.array_sort(docs_of).alias("docs")).sortWithinPartitions("term", "range")
    rows.write.parquet(f"{path}/postings/batch={batch}")
    docs.sparkSession.createDataFrame([(batch, n, known, total)], BATCHES).write.mode("append").parquet(f"{path}/batches")
    return batch


def parts(spark: SparkSession, total: int, ranges: int) -> int:
    """Number of partitions for so many tokens in so many ranges."""
    return max(1, min(ranges, max(-(-total // TASK_TOKENS), spark.sparkContext.defaultParallelism)))


def sent(rows: DataFrame, most: int) -> DataFrame:
    """The rows, marked to be sent to all tasks if they are not more than most."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, list]:
    """(postings of named batches, batches)."""
    if not exists(spark, f"{path}/batches"):
        raise FileNotFoundError(f"no text index in {path}; build one with add()")
    batches = spark.read.schema(BATCHES).parquet(f"{path}/batches").collect()  # a row for each batch ever added
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("batch").isin([b["batch"] for b in batches])), batches


class Search:
    """One search: asked (query_id, text) for the k best documents of each query."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75):
        postings, batches = opened(spark, path)
        total = lambda name: sum(b[name] for b in batches)
        self.n, self.mean, self.k, self.k1, self.b = total("n_docs"), total("n_tokens") / max(total("n_texts"), 1), k, k1, b
        self.parts = parts(spark, total("n_tokens"), sum(max(1, -(-b["n_docs"] // RANGE)) for b in batches))
        asked = written(queries.select("query_id", F.explode(F.array_distinct(tokens(F.lower("text")))).alias("term")), "asked")
        terms = asked.select("term").distinct()
        some = [r["term"] for r in terms.limit(TERMS + 1).collect()]
        if len(some) <= TERMS:
            postings, terms = postings.filter(F.col("term").isin(some)), F.broadcast(terms)
        self.postings, self.asked, self.terms = postings, asked, terms

    def part(self, tf: Column, length: Column) -> Column:
        """What a term adds to a score, but for its weight."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def bounds(self) -> DataFrame:
        """(query_id, batch, range, most): no document of the range scores more."""
        heads = self.postings.select("term", "batch", "range", "n", "max_tf", "min_len").join(self.terms, "term", "left_semi")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.weights = sent(written(self.asked.join(df, "term").select("query_id", "term", idf.alias("idf")), "weights"), WEIGHTS)
        most = F.sum(F.col("idf") * self.part(F.col("max_tf"), F.col("min_len")))
        return heads.repartition(self.parts, "batch", "range").join(self.weights, "term").groupBy("batch", "range", "query_id").agg(most.alias("most")).select("query_id", "batch", "range", "most")

    def scored(self, ranges: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of all documents of ranges (query_id, batch, range) that hold an asked term.

        Postings are dealt by range once; all that a document scores is then added up where its range is.
        """
        posts = self.postings.select("batch", "range", "term", "docs").join(sent(ranges.select("batch", "range").distinct(), WANTED), ["batch", "range"], "left_semi").repartition(self.parts, "batch", "range")
        met = posts.join(self.weights, "term").join(sent(ranges, WANTED), ["query_id", "batch", "range"], "left_semi").select("batch", "range", "query_id", "idf", F.explode("docs").alias("x"))
        total = F.sum(F.col("idf") * self.part(F.col("x.tf"), F.col("x.len")))
        return met.groupBy("batch", "range", "query_id", F.col("x.doc_id").alias("doc_id")).agg(F.round(total, 6).alias("score")).select("query_id", "doc_id", "score")

    def run(self) -> DataFrame:
        """(query_id, rank, doc_id, score)."""
        promise = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "batch", "range"))
        self.ranges = written(self.bounds().withColumn("place", promise), "ranges")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        best = lambda scores: scores.withColumn("rank", rank).filter(F.col("rank") <= self.k)  # noqa: E731  limited within tasks first
        found = written(best(self.scored(self.ranges.filter(F.col("place") <= FIRST).select("query_id", "batch", "range"))), "scored")
        reached = found.filter(F.col("rank") == self.k).select("query_id", F.col("score").alias("reached"))
        rest = self.ranges.filter(F.col("place") > FIRST).join(reached, "query_id", "left")
        self.read = written(rest.filter(F.col("reached").isNull() | (F.col("most") >= F.col("reached") - 1e-6)).select("query_id", "batch", "range"), "ranges")
        every = found.drop("rank").unionByName(best(self.scored(self.read)).drop("rank"))
        return best(every).select("query_id", "rank", "doc_id", "score")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): the same rows as bm25() over all documents added so far. Ties go to smaller ids."""
    return Search(spark, path, queries, k, k1, b).run()
