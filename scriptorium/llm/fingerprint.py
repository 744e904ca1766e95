"""Canonical exact fingerprints: Unicode normal form C, case and white space folding, wide xxhash, byte comparison.

The fingerprint of a text is the 128-bit xxhash (two seeds) of its canonical form, followed by the text's place among the
different canonical texts of that hash, which is 0 unless two texts collide. To find collisions, canonical bytes are
compared inside every bucket that has two members or more; single-member buckets send no text anywhere.

All on the main path is SQL functions. Spark has no normalisation function of its own, so texts with characters beyond
ASCII go through its `java_method` to ICU, which Spark brings along: canonical decomposition, full case folding (ß as
ss, final sigma as sigma), then form C. Canonically equal texts thus have one canonical form, Hangul and marks in any
order included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Buckets with several members are sent to all tasks up to this number (8 bytes each), else joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Documents of neighbouring ids that are handled together.
NEIGHBOURS = 1000
#: Ranges of neighbours at most; beyond that they get longer (1.5 GB each for 100 TB), and their sorts spill.
RANGES = 1 << 16
#: Stands for a null doc_id in the order of documents.
LAST = (1 << 63) - 1


def icu(name: str, *args: Column) -> Column:
    """A static method of ICU; args are not null."""
    home, method = name.rsplit(".", 1)
    return F.java_method(F.lit(f"com.ibm.icu.{home}"), F.lit(method), *args)


def normal(text: Column) -> Column:
    """Form C of a text. No character under U+0300 combines or is replaced, which settles most texts by one quick test."""
    return F.when(text.rlike(r"[^\x00-\x{2FF}]"), icu("text.Normalizer.compose", text, F.lit(False))).otherwise(text)


def folded(text: Column) -> Column:
    """Form C of a text's case folding; canonically equal texts have one. ASCII alone folds as lower case."""
    parts = icu("text.Normalizer.decompose", text, F.lit(False))
    return F.when(text.rlike(r"[^\x00-\x7F]"), normal(icu("lang.UCharacter.foldCase", parts, F.lit(True)))).otherwise(F.lower(text))


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(folded(text), r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(F.lit(1), canon)), 16, "0")), F.lower(F.lpad(F.hex(F.xxhash64(F.lit(2), canon)), 16, "0")))


def collisions(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, canon, place > 0): canonical texts after the first of a hash. texts: hash, canon; hashes: hash of each."""
    several = hashes.groupBy("hash").count().filter(F.col("count") > 1).select("hash")
    if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    distinct = texts.join(several, "hash", "left_semi").groupBy("hash", "canon").count().select("hash", "canon")
    mixed = distinct.groupBy("hash").count().filter(F.col("count") > 1).select("hash")
    place = F.row_number().over(Window.partitionBy("hash").orderBy("canon")) - 1
    return distinct.join(mixed, "hash", "left_semi").withColumn("place", place).filter(F.col("place") > 0)


def fingerprints(texts: DataFrame, key: str = "doc_id", hash_of=wide_hash) -> DataFrame:
    """(key, fingerprint) per row of texts (key, text); a null text is empty, equal canonical texts have equal ones."""
    rows = texts.select(key, canonical(F.coalesce("text", F.lit(""))).alias("canon")).withColumn("hash", hash_of(F.col("canon")))
    found = collisions(rows.select("hash", "canon"), rows.select("hash"))
    joined = rows.join(found, ["hash", "canon"], "left") if not found.isEmpty() else rows.withColumn("place", F.lit(0))
    return joined.select(key, F.concat_ws("-", "hash", F.coalesce("place", F.lit(0)).cast("string")).alias("fingerprint"))


def numbered(docs: DataFrame, firsts: list[int]) -> DataFrame:
    """docs with part, the number of the last of the ascending firsts that is not above key, and that first; found in two steps."""
    width = max(1, math.isqrt(len(firsts)))
    groups = [firsts[k : k + width] for k in range(0, len(firsts), width)]
    edges = docs.sparkSession.createDataFrame([([g[0] for g in groups], groups)], "heads array<long>, groups array<array<long>>")
    below = lambda edge: F.size(F.filter(edge, lambda x: x <= F.col("key"))) - 1
    placed = docs.crossJoin(F.broadcast(edges)).withColumn("group", below(F.col("heads"))).withColumn("own", F.get("groups", F.col("group")))
    placed = placed.withColumn("place", below(F.col("own")))
    return placed.select(*docs.columns, (F.col("group") * width + F.col("place")).alias("part"), F.get("own", F.col("place")).alias("first"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) in ascending doc_id, null ones last; after the last comes the first.

    Documents are dealt into ranges of doc_id by percentiles, one number to the driver for each NEIGHBOURS documents (RANGES at
    most). The first document of a range goes to the range before it as well. Rows that share a doc_id follow by text.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n, low = docs.agg(F.count("*"), F.min("key")).first()
    parts = min(RANGES, max(1, -(-n // NEIGHBOURS)))
    bounds = docs.agg(F.percentile_approx("key", [k / parts for k in range(parts)], max(10_000, 4 * parts))).first()[0] if n else None
    firsts = sorted({low or 0, *map(int, bounds or [])})
    here = F.struct(F.col("part"), F.lit(0).alias("late"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(len(firsts))).alias("part"), F.lit(1).alias("late"))
    sent = numbered(docs, firsts).select("key", "text", F.explode(F.when(F.col("key") == F.col("first"), F.array(here, before)).otherwise(F.array(here))).alias("to"))
    near = Window.partitionBy("to.part").orderBy("to.late", "key", "text")
    return sent.withColumn("next_text", F.lead("text").over(near)).filter("to.late = 0").select(F.nullif("key", F.lit(LAST)).alias("doc_id"), "text", "next_text")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_likeness() of every whole text."""
    return edited_likeness(table(spark, sf_dir, "documents"))


def edited_likeness(docs: DataFrame, hash_of=wide_hash) -> DataFrame:
    """Fingerprints of each text and of its edited text, and whether they and the next document's are equal.

    Exact digests are alike (1.0) or not (0.0), by the canonical bytes. A null text is empty; a null doc_id stays null and comes
    last in the order; rows that share a doc_id follow by text, and each row stands for itself. Other columns are not read;
    an empty table gives no rows.
    """
    half = "cast(floor(length(text) / 2) as int)"
    edited = F.concat(F.expr(f"left(text, length(text) - {half})"), F.expr(f"left(next_text, {half})"))
    wide = with_next(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), canonical(F.col("text")).alias("canon"), canonical(F.col("next_text")).alias("next_canon"))
    wide = wide.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("near_edited", (F.col("canon") == F.col("edited_canon")).cast("double"))
    wide = wide.withColumn("near_next", (F.col("canon") == F.col("next_canon")).cast("double")).withColumn("edited_sha256", F.sha2("edited", 256))
    wide = wide.withColumn("hash", hash_of(F.col("canon"))).withColumn("edited_hash", hash_of(F.col("edited_canon"))).drop("edited", "next_canon")
    narrow = stored(wide.drop("canon", "edited_canon"))
    strays = narrow.filter("near_edited = 0").select(F.col("edited_hash").alias("hash"))
    hashes = narrow.select("hash").unionAll(strays)
    texts = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("canon")).select(hash_of(F.col("canon")).alias("hash"), "canon")
    several = strays.groupBy("hash").count().withColumnRenamed("count", "n")
    known = several.filter("n > 1").select("hash").unionAll(several.join(narrow.select("hash").distinct(), "hash", "left_semi").select("hash"))
    if not known.isEmpty():  # edited texts that share a hash with others are compared by their bytes too
        texts = texts.unionAll(wide.filter("near_edited = 0").select(F.col("edited_hash").alias("hash"), F.col("edited_canon").alias("canon")))
    found = collisions(texts, hashes)
    if found.isEmpty():
        return narrow.select("doc_id", "n_chars", "edited_sha256", *(F.concat(h, F.lit("-0")).alias(f) for h, f in (("hash", "fingerprint"), ("edited_hash", "edited_fingerprint"))), "near_edited", "near_next")
    first, second = found.withColumnRenamed("place", "p"), found.select(F.col("hash").alias("edited_hash"), F.col("canon").alias("edited_canon"), F.col("place").alias("q"))
    marked = wide.join(first, ["hash", "canon"], "left").join(second, ["edited_hash", "edited_canon"], "left")
    mark = lambda h, p: F.concat_ws("-", h, F.coalesce(p, F.lit(0)).cast("string"))
    return marked.select("doc_id", "n_chars", "edited_sha256", mark("hash", "p").alias("fingerprint"), mark("edited_hash", "q").alias("edited_fingerprint"), "near_edited", "near_next")
