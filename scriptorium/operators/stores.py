"""Append-only stores: review queue, model versions, runs, traces, notes and a keyed cache. Each is a folder of JSON rows.

Rows are only ever appended, so writers don't disturb each other; what holds now is derived from all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import append_log, exists
from .governance import pending
from .retrieval import bm25

#: Fields of a trace step.
TRACE = "run string, step int, tool string, args map<string,string>, top_score double, k int, n int, abstained boolean"


def item_id(*parts: Column, digits: int = 16) -> Column:
    """A stable id of some values, nulls told apart from empty texts."""
    return F.left(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts)), 256), F.lit(digits))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def enqueue(items: DataFrame, path: str) -> DataFrame:
    """Appends items for review, and returns them with their ids."""
    rows = items.withColumn("id", item_id(*(F.col(c) for c in items.columns)))
    append_log(rows.select("id", F.to_json(F.struct(*items.columns)).alias("item")), f"{path}/enqueued")
    return rows


def resolve(decisions: DataFrame, path: str) -> None:
    """Appends decisions: id, decision."""
    append_log(decisions.select("id", "decision"), f"{path}/resolved")


def waiting(spark: SparkSession, path: str) -> DataFrame:
    """(id, item) that nobody has decided on."""
    queued = read(spark, f"{path}/enqueued", "id string, item string").dropDuplicates(["id"])
    return pending(queued, read(spark, f"{path}/resolved", "id string, decision string"))


def versioned(rows: DataFrame) -> DataFrame:
    """component, path, metrics (any type that JSON can hold) with the version of each."""
    return rows.withColumn("version", item_id(F.col("component"), F.col("path"), F.to_json(F.struct("metrics")), digits=12))


def register(rows: DataFrame, path: str) -> DataFrame:
    """Appends model versions: component, path, metrics, ts."""
    out = versioned(rows)
    append_log(out, path)
    return out


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last; ties go to the greater text of the other columns."""
    rest = F.struct(*(c for c in rows.columns if c != key))
    return rows.groupBy(key).agg(F.max_by(rest, F.struct(F.col(order), F.to_json(rest))).alias("_r")).select(key, "_r.*")


def log(metrics: DataFrame, path: str) -> None:
    """Appends rows of a run's metrics or trace steps."""
    append_log(metrics, path)


def put(rows: DataFrame, path: str) -> None:
    """Appends key, value, ts to a cache."""
    append_log(rows.select("key", "value", "ts"), path)


def get(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys with their newest value, null where there is none."""
    held = latest(read(spark, path, "key string, value string, ts timestamp"), "key", "ts").select("key", "value")
    return keys.join(held, "key", "left")


def remember(notes: DataFrame, path: str) -> None:
    """Appends notes: note_id (a whole number), text."""
    append_log(notes.select("note_id", "text"), path)


def recall(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, note_id, text, score): the k notes that fit each query (query_id, text) best, by BM25."""
    notes = read(spark, path, "note_id long, text string").dropDuplicates(["note_id"])
    hits = bm25(notes.withColumnRenamed("note_id", "doc_id"), queries, k).withColumnRenamed("doc_id", "note_id")
    return hits.join(notes, "note_id").select("query_id", "rank", "note_id", "text", "score")
