"""A corpus from documents to training sequences, in five stages; each is written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import carry, jaccard, langid, linededup, packing, repeats
from scriptorium.llm.common import drop_since, fresh, mark, named, quoted, stored, table

#: Documents whose best language gets less than this are rejected, as are those without a language.
LEAST_SCORE = 0.3
#: Rows that go are sent to all tasks up to this number (8 bytes each), else joined by shuffle.
BROADCAST_ROWS = 2_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language.

    These hold no letters, or have no language at LEAST_SCORE, or their trigrams are not those of the learned languages (a
    bound calibrated on held-out documents and noise); all rows that may be learned from are. Where nothing was learned, only those without letters go. Rows are
    judged one by one, by their whole text: null and empty texts go, null and repeated doc_ids don't matter, repeated rows
    fare alike; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", "lang")
    words = stored(langid.vocabulary(rows))
    net, model = langid.learn(words), langid.acquaint(rows, words)
    if net is None or model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score, known = (fresh(docs, c) for c in ("_lang", "_score", "_known"))
    found = langid.predict(docs, net, lang, score, model, known)
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE) & F.col(known)).select(*named(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines but for their first places; documents left blank by that go.

    Rows that share a doc_id keep their own lines, rows equal in doc_id, source and text fare alike; a null text stays null, a
    null source counts for no site; an empty table stays empty.
    """
    own = {c: fresh(docs, f"_{c}") for c in ("n_lines", "n_removed") if c in docs.columns}
    found = linededup.dedup(docs.withColumnsRenamed(own))
    left = found.filter((F.col("n_removed") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*(F.col(quoted(own.get(c, c))).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest doc_id (null last), of several the first.

    Null and empty texts are no copies and stay; rows with a null or repeated doc_id are rows like others; an empty table
    stays empty.
    """
    row = fresh(docs, "_row")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = stored(jaccard.least_rows(keyed, row).filter("NOT kept").select(F.col("key").alias(row)))
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return keyed.join(gone, row, "left_anti").select(*named(docs))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated strings; characters that a removed run cuts through go too, and documents that are left empty.

    All other characters stay, U+FFFD included, and each row its own columns. A null text becomes the empty text and stays;
    rows of one doc_id don't remove each other's strings, a null doc_id is larger than any; an empty table stays empty.
    """
    others = docs.drop("doc_id", "text", "n_chars")
    rest = fresh(others, "_rest")
    removed = repeats.remove(docs.select("doc_id", "text", carry.packed(others).alias(rest)), rest=rest, whole=True)
    cut = removed.select("doc_id", F.col("kept").cast("string").alias("text"), F.size("starts").alias("runs"), rest)
    cut = cut.filter((F.col("runs") == 0) | (F.trim("text") != ""))
    return cut.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), *carry.unpacked(F.col(rest), others.schema)).select(*named(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences; a null text is empty, rows that share a doc_id are packed one by one."""
    return packing.digest(packing.pack(docs))


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_copies), ("suffix_dedup", repeated_strings), ("packing", sequences)]

#: Stages 1, 3, 4 and 5 are not expressible in SQL; tests hold each stage against its brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's tables go once its result is written."""
    docs, place = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        drop_since(spark, place)
    return docs
