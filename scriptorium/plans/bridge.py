"""Views that stand in for corpus tables over the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lines_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "raw"))
    tier = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    page = F.format_string("doc%d_p%04d", F.col("doc_id"), (F.floor(F.col("line_idx") / 10) + 1).cast("int"))
    rows = docs.withColumn("text", squeezed(F.col("raw"))).filter("text <> ''").withColumn("page_id", page)
    rows = rows.withColumn("chunk_id", F.format_string("%s_l%03d", "page_id", F.col("line_idx") % 10)).withColumn("conf", (50 + (F.col("doc_id") * 7 + F.col("line_idx") * 13) % 50) / 100)
    return rows.join(tier, "doc_id", "left").select("doc_id", "line_idx", "text", "page_id", "chunk_id", "conf", F.when(F.col("quality") == 1, "gold").otherwise("silver").alias("tier"))


LINES = r"""
    s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    x AS (SELECT doc_id, unnest(range(len(ls))) AS line_idx, unnest(ls) AS raw FROM s),
    q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
    y AS (SELECT *, trim(regexp_replace(raw, '[\s\p{Z}]+', ' ', 'g')) AS text, printf('doc%d_p%04d', doc_id, line_idx // 10 + 1) AS page_id FROM x),
    lines AS (SELECT y.doc_id, line_idx, text, page_id, printf('%s_l%03d', page_id, line_idx % 10) AS chunk_id, (50 + (y.doc_id * 7 + line_idx * 13) % 50) / 100.0 AS conf,
      CASE WHEN quality = 1 THEN 'gold' ELSE 'silver' END AS tier FROM y LEFT JOIN q USING (doc_id) WHERE text <> '')"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of all lines of each document, by arithmetic."""
    rows = lines(spark, sf_dir).select("doc_id", "page_id", "line_idx", F.posexplode(F.split("text", " ")).alias("i", "text"))
    n, odd = F.length("text"), (F.col("doc_id") + F.col("line_idx") + F.col("i")) % 17 == 0
    return rows.select(
        "page_id", "text", F.when(odd, -1).otherwise(40 + (n * 7) % 60).alias("conf"), (F.col("i") * 60).alias("left"), (F.col("line_idx") * 40 + (F.col("doc_id") + F.col("i")) % 3).alias("top"),
        (n * 8).alias("width"), (18 + n % 5).alias("height"), F.lit(1).alias("block_num"), F.floor(F.col("line_idx") / 5).alias("par_num"), F.col("line_idx").alias("line_num"), (F.col("line_idx").cast("long") * 1_000_000_000 + F.col("i")).alias("word_idx"),
    )


WORDS = LINES + r""",
    w0 AS (SELECT doc_id, page_id, line_idx, string_split(text, ' ') AS ws FROM lines),
    w1 AS (SELECT doc_id, page_id, line_idx, unnest(range(len(ws))) AS i, unnest(ws) AS text FROM w0),
    words AS (SELECT page_id, text, CASE WHEN (doc_id + line_idx + i) % 17 = 0 THEN -1 ELSE 40 + (length(text) * 7) % 60 END AS conf, i * 60 AS "left", line_idx * 40 + (doc_id + i) % 3 AS top,
      length(text) * 8 AS width, 18 + length(text) % 5 AS height, 1 AS block_num, line_idx // 5 AS par_num, line_idx AS line_num, line_idx::BIGINT * 1000000000 + i AS word_idx FROM w1)"""


def ref_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct line (hyp) with the next one (ref) of the same first 16 characters, by the order of their bytes."""
    rows = lines(spark, sf_dir).select("text").distinct()
    after = F.lead("text").over(Window.partitionBy(F.left("text", F.lit(16))).orderBy("text"))
    return rows.select(F.col("text").alias("hyp"), after.alias("ref")).filter("ref IS NOT NULL")


#: DuckDB's levenshtein counts bytes, so the characters beyond ASCII of a pair (28 different ones at most) become control ones.
_CONTROL = " || ".join(f"chr({k})" for k in range(1, 32) if k not in (9, 10, 13))
PAIRS = LINES + rf""",
    a0 AS (SELECT DISTINCT text FROM lines),
    a1 AS (SELECT text AS hyp, lead(text) OVER (PARTITION BY left(text, 16) ORDER BY text) AS ref FROM a0),
    a2 AS (SELECT hyp, ref, array_to_string(list_sort(list_distinct(regexp_extract_all(hyp || ref, '[^\x00-\x7F]'))), '') AS odd FROM a1 WHERE ref IS NOT NULL),
    pairs AS (SELECT hyp, ref, levenshtein(translate(hyp, odd, left({_CONTROL}, length(odd))), translate(ref, odd, left({_CONTROL}, length(odd)))) AS dist FROM a2)"""
