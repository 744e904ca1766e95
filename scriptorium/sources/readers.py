"""Sources and sinks: page files, JSON lines with last-wins keys, tolerant labels, reference texts, index tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import doc_of_path, last_number

SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """id, doc_id, page_num, path, content of every image under root, any case of suffix."""
    if not exists(spark, root):
        raise FileNotFoundError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    rel = F.regexp_replace(F.col("path"), r"^.*?\Q" + root.rstrip("/") + r"\E/", "")
    return with_ids(files.withColumn("rel", rel))


def with_ids(files: DataFrame) -> DataFrame:
    """doc_id, page_num and id from rel; a name without digits is an error."""
    stem = F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"\.[^.]*$", "")
    number = F.coalesce(last_number(stem), F.raise_error(F.concat(F.lit("no page number in "), F.col("rel"))).cast("int"))
    out = files.withColumn("doc_id", doc_of_path(F.col("rel"))).withColumn("page_num", number)
    return out.withColumn("id", F.format_string("%s_p%04d", "doc_id", "page_num"))


def json_last(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One row per key, the last in the file; a malformed line is an error, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return last_wins(rows.select("*", _place().alias("_n")), key, "_n")


def _place():
    """Where a row stands: file, block of the file, row of the task (whose blocks of one file are in order)."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    cols = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """page_id, text from one file or a folder of *.jsonl; comments, bad lines and placeholders are skipped, later files and lines win."""
    found = spark.read if path.endswith((".jsonl", ".json", ".txt")) else spark.read.option("pathGlobFilter", "*.jsonl")
    lines = found.text(path).select("value", _place().alias("o"))
    return last_wins(parse_gold(lines, "value").select("page_id", "text", "o"), "page_id", "o")


#: Fields of an evaluation task.
TASK = "id string, question string, verifiable boolean, judged boolean, gold string, gold_pages array<string>, needs_research boolean"


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation tasks of a JSON lines file; comments, blank and malformed lines are skipped."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return lines.select(F.from_json("value", TASK).alias("t")).select("t.*").filter("id IS NOT NULL")


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, path, filename of the files right inside each folder of root; contents are not read."""
    if not exists(spark, root):
        raise FileNotFoundError(root)
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*").select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("doc_id"), "path", F.element_at(parts, -1).alias("filename"))


def page_images(spark: SparkSession, root: str) -> DataFrame:
    """rel, width, height and gray pixels of every image under root, any case of suffix; one that can't be decoded is an error."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in SUFFIXES) + "}"
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("image.*")
    broken = F.raise_error(F.concat(F.lit("could not read image "), F.col("origin"))).cast("int")
    found = found.withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(broken))

    def gray(batches):
        for b in batches:
            out = []
            for data, w, h, n in zip(b["data"], b["width"], b["height"], b["nChannels"]):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.float64)  # blue, green, red
                out.append((x[:, :, 0] if n == 1 else np.rint(x[:, :, :3] @ [0.114, 0.587, 0.299])).astype(np.uint8).tobytes())
            yield pd.DataFrame({"rel": b["rel"], "width": b["width"], "height": b["height"], "pixels": out})

    rel = F.regexp_replace(F.col("origin"), r"^.*?\Q" + root.rstrip("/") + r"\E/", "")
    return found.select(rel.alias("rel"), "width", "height", "nChannels", "data").mapInPandas(gray, "rel string, width int, height int, pixels binary")


def write_pages(pages: DataFrame, path: str) -> None:
    """Cleaned pages, by document; their PNG bytes are in column png where images.png() made them."""
    pages.write.mode("overwrite").partitionBy("doc_id").parquet(path)


def parse_gold(lines: DataFrame, column: str) -> DataFrame:
    row = F.from_json(F.col(column), "page_id string, text string")
    out = lines.filter((F.trim(column) != "") & ~F.ltrim(column).startswith("#")).withColumn("_r", row)
    out = out.withColumn("page_id", F.trim("_r.page_id")).withColumn("text", F.col("_r.text")).drop("_r")
    return out.filter((F.col("page_id") != "") & (F.trim("text") != "") & ~F.ltrim("text").startswith("REPLACE ME"))


def reference_texts(spark: SparkSession, path: str) -> DataFrame:
    """page_id, text of <page_id>.ref.txt files; blank ones are null."""
    rows = spark.read.option("pathGlobFilter", "*.ref.txt").text(path, wholetext=True)
    text = F.when(F.col("value").rlike(r"(?U)\S"), F.col("value"))
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.ref\.txt$", "").alias("page_id"), text.alias("text"))


def write_index(chunks: DataFrame, path: str, kind: str = "exact", dim: int | None = None) -> None:
    """Chunks with their vectors by id. An unknown kind, a chunk without a vector, or vectors of different lengths are errors."""
    if kind not in ("exact", "cells"):
        raise ValueError(f"unsupported index kind {kind!r}: exact or cells")
    n, vectors, least, most = chunks.agg(F.count("*"), F.count("embedding"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n != vectors or least != most or (dim and n and least != dim):
        raise ValueError(f"{n} chunks but {vectors} vectors of {least} to {most} components")
    chunks.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"no index in {path}; build one with write_index()")
    return spark.read.parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
