"""Line dedup by distinct-site spread.

Per line hash, HyperLogLog sketches of the sites are built and merged by aggregation. Lines whose estimate lies clearly
above the threshold are boilerplate; lines near it get exact distinct counts. Boilerplate stays once, at its first place
(smallest doc_id, then position), and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: A line on so many distinct sites is boilerplate.
SITES = 10
#: Estimates within this share of the threshold are counted exactly; at 2**12 registers the standard error is 1.6 %.
BAND = 0.3
LOG_REGISTERS = 12


def row_key(*columns: str) -> Column:
    """128 bits of the values of some columns, nulls told apart from values; rows equal in all of them share it."""
    known = F.array(*(F.col(c).isNull() for c in columns))
    return F.struct(F.xxhash64(known, *columns).alias("a"), F.xxhash64(F.lit(1), known, *columns).alias("b"))


def line_rows(docs: DataFrame, site: str) -> DataFrame:
    """(row, order, site, pos, hi, lo) of every line that is not blank; hi and lo are 128 bits of its trimmed text's hash."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    rows = docs.select(row_key("doc_id", site, "text").alias("row"), order.alias("order"), F.col(site).cast("string").alias("site"), "text")
    lines = rows.select("row", "order", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    return lines.filter(line != "").select("row", "order", "site", "pos", F.xxhash64(line).alias("hi"), F.xxhash64(F.lit(1), line).alias("lo"))


def boilerplate(lines: DataFrame, sites: int, band: float) -> DataFrame:
    """(hi, lo, first: struct order, pos, row) of lines on at least so many sites."""
    sketch = lines.groupBy("hi", "lo").agg(
        F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("order", "pos", "row")).alias("first")
    )
    spread = sketch.filter(F.col("n") >= sites).select("hi", "lo", "first", F.hll_sketch_estimate("sketch").alias("about")).filter(F.col("about") >= sites * (1 - band))
    near = spread.filter(F.col("about") <= sites * (1 + band))
    exact = lines.join(near.select("hi", "lo"), ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.countDistinct("site").alias("exact"))
    far = spread.filter(F.col("about") > sites * (1 + band)).select("hi", "lo", "first")
    return far.unionByName(near.join(exact.filter(F.col("exact") >= sites), ["hi", "lo"]).select("hi", "lo", "first"))


def marked(docs: DataFrame, site: str = "source", sites: int = SITES, band: float = BAND) -> DataFrame:
    """(row, gone: sorted positions of lines to remove) of the documents that lose lines."""
    lines = line_rows(docs, site)
    known = stored(boilerplate(lines, sites, band))  # a table of its own, so that a frequent line's rows can be split in the join
    hits = lines.join(known, ["hi", "lo"]).filter((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    return hits.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def without(lines: Column, gone: Column) -> Column:
    """The lines but for those at the sorted positions gone: the stretches between these, one after another."""
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
    end = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i))))


def dedup(docs: DataFrame, site: str = "source", sites: int = SITES, band: float = BAND) -> DataFrame:
    """docs with boilerplate lines removed from text, and n_lines and n_removed (which replace columns of these names).

    A line's key is its text without outer spaces; blank lines are no boilerplate and stay. A null text stays null, a null
    site counts for no site. The first place of a line is that of the smallest doc_id (null last), then position; rows that
    share a doc_id are told apart by their site and text, and rows equal in all three are treated alike. All columns of docs
    are kept; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*own).alias("doc"), row_key("doc_id", site, "text").alias("row"))
    found = rows.join(marked(docs, site, sites, band), "row", "left").select("doc", "gone")
    text, some = F.col("doc.text"), F.col("gone").isNotNull()
    lines = F.split(text, "\n")
    kept = F.when(some, F.array_join(without(lines, F.col("gone")), "\n")).otherwise(text)
    return found.select(
        *(kept.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in own),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(some, F.size("gone")).otherwise(0).cast("long").alias("n_removed"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of lines, how many went, and the SHA-256 of what stays (of the empty text for a null one)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
    WITH s AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY doc_id, source, text) AS k, doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT k, doc_id, source, unnest(range(len(ls))) AS pos, trim(unnest(ls), ' ') AS line FROM s),
    b AS (SELECT line, min((doc_id IS NULL, coalesce(doc_id, 0), pos, k)) AS first FROM l WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {SITES}),
    g AS (SELECT k, list(DISTINCT pos) AS gone FROM l JOIN b USING (line) WHERE (doc_id IS NULL, coalesce(doc_id, 0), pos, k) <> first GROUP BY 1)
    SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
      sha256(coalesce(array_to_string(list_transform(list_filter(range(len(ls)), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)), '')) AS kept_sha256
    FROM s LEFT JOIN g USING (k)"""
