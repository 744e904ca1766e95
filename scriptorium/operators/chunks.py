"""Overlapping token windows per document, with the provenance of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import tokens


def windows(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """lines: doc_id, line_idx, text, chunk_id, page_id, conf, tier. One row per window of each document.

    One shuffle by document: lines become an ordered array, each window a slice of its tokens, and the lines of a window
    are a slice too, since they follow one another. The last window ends with the document.
    """
    size, step = config.chunk_tokens, config.chunk_tokens - config.overlap
    if step <= 0:
        raise ValueError("overlap must be less than chunk_tokens")
    kept = lines.withColumn("tok", tokens(F.col("text"))).filter(F.size("tok") > 0)
    docs = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "chunk_id", "page_id", "conf", "tier", "tok"))).alias("ls"))
    docs = docs.select(
        "doc_id", F.transform("ls", lambda x: x.dropFields("tok")).alias("ls"), F.flatten(F.transform("ls", lambda x: x["tok"])).alias("tok"),
        F.flatten(F.transform("ls", lambda x, i: F.array_repeat(i, F.size(x["tok"])))).alias("ord"),
    )
    last = f"cast(ceil(greatest(size(tok) - {size}, 0) / {step}) as int)"
    window = f"struct(i, slice(tok, i * {step} + 1, {size}) AS tok, slice(ls, ord[i * {step}] + 1, ord[least(i * {step} + {size}, size(tok)) - 1] - ord[i * {step}] + 1) AS src)"
    docs = docs.select("doc_id", F.explode(F.expr(f"transform(sequence(0, {last}), i -> {window})")).alias("w")).select("doc_id", "w.*")
    return docs.select(
        F.format_string("%s_c%05d", F.col("doc_id").cast("string"), F.col("i")).alias("chunk_id"), "doc_id", F.array_join("tok", " ").alias("text"), F.size("tok").alias("n_tokens"),
        F.array_sort(F.array_distinct(F.transform("src", lambda x: x["page_id"]))).alias("page_ids"),
        F.array_sort(F.array_distinct(F.transform("src", lambda x: x["chunk_id"]))).alias("source_line_ids"),
        (F.aggregate("src", F.lit(0.0), lambda s, x: s + x["conf"]) / F.size("src")).alias("ocr_confidence"),
        F.when(F.forall("src", lambda x: x["tier"] == "gold"), "gold").otherwise("silver").alias("tier"),
    )


def whole(documents: DataFrame) -> DataFrame:
    """doc_id, text of documents: as they are where ids stand once; the rows of a repeated id become one, their lines in the order of windows()."""
    docs = documents.select("doc_id", "text")
    again = docs.groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id")
    if not again.limit(1).count():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    tok = docs.join(again, same, "left_semi").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "raw")).select("doc_id", "line_idx", tokens(F.col("raw")).alias("tok"))
    lines = tok.filter(F.size("tok") > 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "tok"))).alias("ls"))
    return docs.join(again, same, "left_anti").unionAll(lines.select("doc_id", F.array_join(F.flatten(F.transform("ls", lambda x: x["tok"])), " ").alias("text")))


def with_meta(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Chunk metadata by id (never by position); 0.0 and `silver` where it is missing."""
    return chunks.join(meta, "chunk_id", "left").withColumn("ocr_confidence", F.coalesce("ocr_confidence", F.lit(0.0))).withColumn("tier", F.coalesce("tier", F.lit("silver")))
