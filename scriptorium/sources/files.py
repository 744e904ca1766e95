"""A data source of files: spark.read.format("files") and spark.readStream.format("files"), once register(spark) was called.

Options: path, content ("false" leaves contents out), most (files of a micro-batch). Files are dealt into partitions by size; filters on rel
(equal, in, begins with) are pushed down, so other files are neither listed into partitions nor read. A stream takes files in the
order of their time and name, and its offset is the last one taken: after a restart it goes on behind that.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .readers import SUFFIXES, last_wins, parse_gold, with_ids

SCHEMA = "rel string, path string, modified timestamp, length long, content binary"
#: Bytes and files of a partition.
BYTES, FILES = 64 << 20, 1000


@dataclass
class Part(InputPartition):
    files: list[tuple[str, str, int, int]]

    def __init__(self, files):
        self.files = files


def _listed(root: str) -> list[tuple[str, str, int, int]]:
    """(rel, path, nanoseconds, bytes) of every file under root, by time and name."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    files = [(f.path[len(base.rstrip("/")) + 1 :], f.path, f.mtime_ns, f.size) for f in found if f.is_file]
    hidden = lambda rel: any(p.startswith((".", "_")) for p in rel.split("/"))
    return sorted((f for f in files if not hidden(f[0])), key=lambda f: (f[2], f[0]))


def _parts(files: list[tuple[str, str, int, int]]) -> list[Part]:
    out, size = [], 0
    for f in files:
        if not out or size + f[3] > BYTES or len(out[-1].files) >= FILES:
            out.append(Part([]))
            size = 0
        out[-1].files.append(f)
        size += f[3]
    return out or [Part([])]


def _read(root: str, part: Part, content: bool) -> Iterator[tuple]:
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
    for rel, path, ns, size in part.files:
        data = None
        if content:
            with system.open_input_stream(path) as f:
                data = f.read()
        yield rel, path, datetime.datetime.fromtimestamp(ns / 1e9, datetime.timezone.utc), size, data


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.content, self.tests = options["path"], options.get("content", "true") != "false", []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and tuple(f.attribute) == ("rel",):
                self.tests.append(f)
            else:
                yield f

    def kept(self, rel: str) -> bool:
        def holds(f: Filter) -> bool:
            return rel == f.value if isinstance(f, EqualTo) else rel in f.value if isinstance(f, In) else rel.startswith(f.value)

        return all(map(holds, self.tests))

    def partitions(self) -> list[Part]:
        return _parts([f for f in _listed(self.root) if self.kept(f[0])])

    def read(self, partition: Part) -> Iterator[tuple]:
        return _read(self.root, partition, self.content)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.content, self.most = options["path"], options.get("content", "true") != "false", int(options.get("most", 10_000))
        self.at: dict | None = None  # where this run stands, once that is known

    def initialOffset(self) -> dict:
        self.at = self.at or {"ns": -1, "rel": ""}
        return {"ns": -1, "rel": ""}

    def _after(self, offset: dict) -> list[tuple[str, str, int, int]]:
        return [f for f in _listed(self.root) if (f[2], f[0]) > (offset["ns"], offset["rel"])]

    def latestOffset(self) -> dict:
        """The last of the next `most` files; of all that are there where a stream is started again, as its place is not told here."""
        ahead = self._after(self.at)[: self.most] if self.at else _listed(self.root)
        if ahead:
            self.at = {"ns": ahead[-1][2], "rel": ahead[-1][0]}
        return self.at or self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return _parts([f for f in self._after(start) if (f[2], f[0]) <= (end["ns"], end["rel"])])

    def read(self, partition: Part) -> Iterator[tuple]:
        return _read(self.root, partition, self.content)

    def commit(self, end: dict) -> None:
        pass


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def pages(files: DataFrame) -> DataFrame:
    """Image files with doc_id, page_num and id; of a table or a stream."""
    return with_ids(files.filter(F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).isin(*SUFFIXES)))


def texts(files: DataFrame) -> DataFrame:
    """(page_id, text) of <page_id>.ref.txt files; blank texts are null; of a table or a stream."""
    named = files.filter(F.col("rel").endswith(".ref.txt"))
    text = F.decode("content", "UTF-8")
    return named.select(F.regexp_extract("rel", r"([^/]+)\.ref\.txt$", 1).alias("page_id"), F.when(text.rlike(r"(?U)\S"), text).alias("text"))


def labels(files: DataFrame) -> DataFrame:
    """(page_id, text) of all *.jsonl files of a table; later files (by path) and lines win."""
    named = files.filter(F.col("rel").endswith(".jsonl"))
    lines = named.select("rel", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line", "value"))
    return last_wins(parse_gold(lines.withColumn("o", F.struct("rel", "line")), "value").select("page_id", "text", "o"), "page_id", "o")
