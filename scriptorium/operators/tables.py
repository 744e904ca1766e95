"""Keyed tables with versions: safe for several writers, readable at any version, compacted now and then.

A version is a manifest, a small file that lists folders of rows. A writer puts its rows into a folder of its own and then
claims the next version with a manifest that nobody else can have made (a link, or a rename that does not replace). If another
writer was first, it adds its folder to that one's list and claims the version after. A reader takes one manifest and sees just its
folders, whatever happens meanwhile. Compaction writes the newest row of each key to one folder and swaps it for those it read.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Rows with a key and an order; the newest row of each key counts, ties go to the greater text of the other columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The newest version; 0 before the first write."""
        place = self._path("versions")
        if not self.fs.exists(place):
            return 0
        names = [f.getPath().getName() for f in self.fs.listStatus(place)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        stream = self.fs.open(self._path(f"versions/{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"]
        finally:
            stream.close()

    def _claim(self, version: int, folders: list[str]) -> bool:
        """Makes this version's manifest, whole at once; False if there is one."""
        draft, name = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{version:012d}.json")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps({"folders": folders}).encode()))
        stream.close()
        if self.fs.getUri().getScheme() == "file":  # rename replaces there, a link doesn't
            local = lambda p: urlparse(p.toString()).path
            try:
                os.link(local(draft), local(name))
                return True
            except FileExistsError:
                return False
            finally:
                self.fs.delete(draft, False)
        if not self.fs.exists(name) and self.fs.rename(draft, name):
            return True
        self.fs.delete(draft, False)
        return False

    def _write(self, rows: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def append(self, rows: DataFrame) -> int:
        """Adds rows, and returns the version that has them."""
        folder = self._write(self.spark.createDataFrame([], self.schema).unionByName(rows))
        while True:
            now = self.version()
            if self._claim(now + 1, [*self.folders(now), folder]):
                return now + 1

    def log(self, version: int | None = None) -> DataFrame:
        """All rows that a version holds."""
        now = self.version() if version is None else version
        places = [f"{self.path}/{f}" for f in self.folders(now)]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest row of each key at a version."""
        return self._newest(self.log(version))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = F.struct(*(c for c in rows.columns if c != self.key))
        newest = rows.groupBy(self.key).agg(F.max_by(rest, F.struct(F.col(self.order), F.to_json(rest))).alias("_r"))
        return newest.select(*(F.col(c) if c == self.key else F.col("_r").getField(c).alias(c) for c in rows.columns))

    def compact(self) -> int:
        """Puts the newest row of each key in place of all rows there are; rows that come meanwhile stay beside them.

        Older versions stay readable, as their folders stay. Returns the version, or the present one if another compaction was first.
        """
        base = self.folders(self.version())
        if len(base) < 2:
            return self.version()
        folder = self._write(self._newest(self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in base))))
        while True:
            now = self.version()
            held = self.folders(now)
            if not set(base) <= set(held):
                return now
            if self._claim(now + 1, [folder, *(f for f in held if f not in base)]):
                return now + 1
