"""Shared storage and plain helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir, or what the context was given); a temporary one only in one process, as in tests."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="scriptorium-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, dots and backticks in it included."""
    return "`" + name.replace("`", "``") + "`"


def named(df: DataFrame) -> list[str]:
    """The columns of df to select by name, whatever they are called."""
    return [quoted(c) for c in df.columns]


#: Folders of the tables written so far, oldest first.
_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which outlives lost executors. It stays until drop_since()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place among the tables written so far."""
    return len(_written)


def drop_since(spark: SparkSession, place: int, keep: int = 1) -> None:
    """Deletes the tables written since a mark() but for the last keep ones; nothing may still be read from them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written[place : len(_written) - keep]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _written[place : len(_written) - keep]
