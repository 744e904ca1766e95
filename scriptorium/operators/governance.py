"""Corpus checks, snapshots, splits, review queue, agent tools and hook seams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import tokens, word_count
from ..sources.shared import written

#: Names of the seams, and of the features that attach there, in this order.
SEAMS = ("after_ingest", "after_ocr", "before_index", "after_retrieve", "on_step", "on_tool_call", "before_answer", "after_answer", "on_log")
WIRING = (("tracing", ("on_step", "on_tool_call", "after_answer")), ("pii", ("after_ocr", "before_answer", "on_log")), ("guardrails", ("on_tool_call",)), ("grounding", ("before_answer",)))
INJECTION = r"(?i)ignore (all|any|previous|the above)|disregard .{0,20}instructions|system prompt"


class Hooks:
    """Ordered DataFrame -> DataFrame functions per seam."""

    def __init__(self):
        self.handlers: dict[str, list[Callable[[DataFrame], DataFrame | None]]] = {s: [] for s in SEAMS}

    def register(self, seam: str, handler: Callable[[DataFrame], DataFrame | None]) -> None:
        if seam not in self.handlers:
            raise ValueError(f"unknown seam {seam}")
        self.handlers[seam].append(handler)

    def run(self, seam: str, df: DataFrame) -> DataFrame:
        for handler in self.handlers[seam]:
            df = handler(df) or df
        return df

    def clear(self) -> None:
        for x in self.handlers.values():
            x.clear()


def wire(features: dict[str, Callable[[DataFrame], DataFrame | None]], hooks: Hooks | None = None) -> Hooks:
    """Clears the hooks and attaches every feature of WIRING to its seams, in that order; one that is missing is an error."""
    hooks = hooks or Hooks()
    hooks.clear()
    for name, seams in WIRING:
        if name not in features:
            raise ValueError(f"no feature {name}")
        for seam in seams:
            hooks.register(seam, features[name])
    return hooks


class Tools:
    """Named functions over DataFrames; the names are those an agent may call."""

    #: Names of the tools.
    NAMES = ("retrieve", "rerank", "read_page", "enhance_page", "extract", "aggregate", "cite", "calculator", "escalate_to_human")

    def __init__(self):
        self.known: dict[str, Callable] = {}

    def add(self, name: str, function: Callable) -> None:
        if name not in self.NAMES:
            raise ValueError(f"unknown tool {name}")
        self.known[name] = function

    def call(self, name: str, *args, **named):
        if name not in self.known:
            raise ValueError(f"no tool {name}")
        return self.known[name](*args, **named)

    def missing(self) -> set[str]:
        return set(self.NAMES) - set(self.known)


#: Fields that extract() knows, by their patterns.
FIELDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "url": r"https?://[^\s<>]+", "number": r"[0-9]+(?:\.[0-9]+)?"}


def extract(field: str, text: Column) -> Column:
    """The first value of a known field in a text, or null."""
    if field not in FIELDS:
        raise ValueError(f"unknown field {field}")
    return F.nullif(F.regexp_extract(text, f"({FIELDS[field]})", 1), F.lit(""))


def read_page(lines: DataFrame) -> DataFrame:
    """(page_id, text, n_lines) of lines page_id, line_idx, text in their order."""
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "text"))).alias("l"), F.count("*").alias("n_lines"))
    return pages.select("page_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"), "n_lines")


def limits(steps: DataFrame, run: str, order: list[str], cost: str, config: Config = DEFAULT) -> DataFrame:
    """steps with the number of steps and the cost so far, and whether these pass the limits."""
    so_far = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("steps", F.count("*").over(so_far)).withColumn("spent", F.sum(cost).over(so_far))
    return out.withColumn("over_steps", F.col("steps") > config.max_steps).withColumn("over_budget", F.col("spent") > config.budget)


def format_answer(raw: Column, citations: Column, known: Column, refusal: str = "not found in the corpus") -> Column:
    """Struct of text, citations, grounded, confidence: without citations, or with unknown ones, the answer is a refusal.

    known: how many of the citations exist.
    """
    n = F.coalesce(F.size(citations), F.lit(0))
    grounded = (n > 0) & (known == n)
    share = F.coalesce(F.try_divide(known, n), F.lit(0.0)).cast("double")
    return F.struct(F.when(grounded, raw).otherwise(refusal).alias("text"), F.when(grounded, citations).otherwise(F.array().cast("array<string>")).alias("citations"), grounded.alias("grounded"), share.alias("confidence"))


def authorized(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Requests of known clients."""
    return requests.join(clients.select("client").distinct(), "client", "left_semi")


def rate_limited(requests: DataFrame, client: str, ts: str, most: int, per: str = "hour") -> DataFrame:
    """(client, start, n) where a client asked more than most times within a unit of time."""
    return requests.groupBy(client, F.date_trunc(per, ts).alias(per)).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def manifest(files: DataFrame) -> DataFrame:
    """files: path, content. path, sha256, size of each, one row a file."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def shared_tokens(docs: DataFrame, part: Column) -> DataFrame:
    """(n_tokens, n_shared): distinct tokens of a table, and those that stand in several of its parts."""
    spread = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"), part.alias("p")).groupBy("t").agg(F.countDistinct("p").alias("parts"))
    return spread.agg(F.count("*").alias("n_tokens"), F.count_if(F.col("parts") > 1).alias("n_shared"))


def estimated_words(docs: DataFrame, every: int = 10) -> DataFrame:
    """Words of all documents from the mean of those whose id is divisible by every; a sampling operator."""
    drawn = docs.filter(F.pmod("doc_id", F.lit(every)) == 0).agg(F.avg(word_count(F.col("text"))).alias("mean"), F.count("*").alias("drawn"))
    return drawn.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("drawn", "n", F.round(F.col("mean") * F.col("n"), 3).alias("words"))


def text_lines(spark, n: int, words: list[str], length: int = 6) -> DataFrame:
    """(id, text): made lines of length words, by arithmetic on the line and the place."""
    known = F.array(*map(F.lit, words))
    place = lambda j: (F.pmod(F.col("id") * 31 + j * 17 + F.col("id") * j, F.lit(len(words))) + 1).cast("int")
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.element_at(known, place(j))), " ").alias("text"))


def processed_path(root: str, doc_id: Column, page_id: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), doc_id, F.concat(page_id, F.lit(".png")))


def validate(docs: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    words = docs.agg(F.sum(word_count(F.col("text"))).alias("n_words"), F.countDistinct("doc_id").alias("n_docs"))
    n = pages.agg(F.count("*").alias("n_pages"))
    return words.crossJoin(F.broadcast(n)).select("n_docs", "n_pages", "n_words", (F.col("n_words") >= config.min_words).alias("words_ok"), (F.col("n_pages") >= config.min_pages).alias("pages_ok"), (F.col("n_docs") >= 1).alias("docs_ok"))


def snapshot(files: DataFrame) -> DataFrame:
    """files: path, content. Version: SHA-256 over the files' hex digests in the order of path parts, 16 digits; and how many they are.

    Contents are hashed where they are; paths and digests are sorted by ranges, and then pass one hash state in order. That last
    step is one task, as the definition hashes one text, but it holds a batch at a time: no row grows with the number of files.
    """
    rows = files.select(F.split("path", "/").alias("parts"), F.sha2("content", 256).alias("h"))

    def fold(batches):
        state, n, last = hashlib.sha256(), 0, None
        for b in batches:
            for parts, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                now = [p.encode() for p in parts]
                if last is not None and now < last:
                    raise AssertionError("files came out of order")
                last = now
                state.update(h.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()[:16]]), pa.array([n], pa.int64())], names=["version_id", "n_files"])

    one = rows.repartitionByRange("parts", "h").sortWithinPartitions("parts", "h").coalesce(1).mapInArrow(fold, "version_id string, n_files long")
    none = F.left(F.sha2(F.lit(""), 256), F.lit(16))  # without files there may be no task at all
    return one.agg(F.coalesce(F.max("version_id"), none).alias("version_id"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"))


def split(doc_id: Column, val: int = 20, test: int = 15) -> Column:
    """train, val or test by document, arithmetic and stable."""
    bucket = F.pmod(doc_id * 7919 + 104729, F.lit(100))
    return F.when(bucket < test, "test").when(bucket < test + val, "val").otherwise("train")


def running_sum(rows: DataFrame, order: str, value: str) -> DataFrame:
    """rows with `before`: the sum of value over all rows of smaller order (unique), by two passes and no global window.

    Rows are sorted into ranges and written with the number of theirs; the sums of the ranges, one row each, are added up; then
    each range runs on its own, from the sum of those before it.
    """
    dealt = written(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    starts, before = [], 0
    for r in dealt.groupBy("_range").agg(F.sum(value).alias("n")).orderBy("_range").collect():  # a row for each range
        starts.append((r["_range"], before))
        before += r["n"] or 0
    starts = rows.sparkSession.createDataFrame(starts, "_range int, _start long")
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(starts), "_range").withColumn("before", (within + F.col("_start")).cast("long")).select(*rows.columns, "before")


def placed(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with `place`: from 1 in each group, by order (unique there). No task gets a whole group, however large it is.

    Rows are sorted by group and order into ranges and written; a group that spans several ranges starts in each of them where
    the range before has stopped, which the counts by range and group tell.
    """
    dealt = written(rows.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range", group).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", F.col(group).alias("_group"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range", group).orderBy(order))
    met = dealt.withColumn("_place", within).join(starts, (dealt["_range"] == starts["_range"]) & dealt[group].eqNullSafe(F.col("_group")))
    return met.select(*(dealt[c] for c in rows.columns), (F.col("_place") + F.col("_before")).cast("long").alias("place"))


#: Shares of words of whole works for training, validation and test.
SHARES = (65, 22, 13)


def split_by_words(works: DataFrame, shares: tuple[int, int, int] = SHARES) -> DataFrame:
    """works (doc_id, n_words) with `before` and part: whole works, in the order of their ids, fill train, val and test up to their shares.

    A work belongs where its first word does; without words at all, everything is train.
    """
    total = works.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    share = F.col("before") * sum(shares)
    part = F.when(share < shares[0] * total, "train").when(share < (shares[0] + shares[1]) * total, "val").otherwise("test")
    return running_sum(works, "doc_id", "n_words").withColumn("part", F.lit("train") if not total else part)


def pending(enqueued: DataFrame, resolved: DataFrame) -> DataFrame:
    return enqueued.join(resolved, "id", "left_anti")


def calculate(expr: Column) -> Column:
    """a op b with + - * /; null for anything else or a division by zero."""
    m = r"^\s*(-?\d+(?:\.\d+)?)\s*([-+*/])\s*(-?\d+(?:\.\d+)?)\s*$"
    a, op, b = (F.regexp_extract(expr, m, k) for k in (1, 2, 3))
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(op == "+", x + y).when(op == "-", x - y).when(op == "*", x * y).when(op == "/", F.try_divide(x, y))


def cite(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def aggregate(op: str, value: Column) -> Column:
    known = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if op not in known:
        raise ValueError(f"unknown aggregate {op}")
    return known[op](value)


def assign_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Inner range join of page numbers (page_num) with inclusive ranges (start, end), through an interval index.

    A range of up to 2**L numbers lies in one or two bins of that width; it is filed there, at its level L, and a page looks up one bin of
    each level that there is (64 at most). Both sides meet by an equal join on level and bin, which Spark may broadcast or
    split like any other. Ranges that end before they start, and nulls, meet nothing.
    """
    size = F.col("end").cast("decimal(20,0)") - F.col("start").cast("decimal(20,0)") + 1
    level = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(63), lambda s, k: F.when((s == 63) & (size <= F.pow(F.lit(2.0), k).cast("decimal(20,0)")), k).otherwise(s))
    at = lambda x, k: F.call_function("shiftright", x.cast("long"), k)
    filed = ranges.filter("start <= end").withColumn("_level", level)
    levels = sorted(r["_level"] for r in filed.select("_level").distinct().collect())
    filed = filed.withColumn("_bin", F.explode(F.array_distinct(F.array(at(F.col("start"), F.col("_level")), at(F.col("end"), F.col("_level"))))))
    asked = pages.filter("page_num IS NOT NULL").withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", at(F.col("page_num"), F.col("_level")))
    return asked.join(filed, ["_level", "_bin"]).filter(F.col("page_num").between(F.col("start"), F.col("end"))).drop("_level", "_bin")


def grounded(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answers: answer_id, citations (array of chunk ids). Grounded: at least one citation, and all exist."""
    cited = answers.select("answer_id", F.explode_outer("citations").alias("chunk_id"))
    known = chunks.select("chunk_id").distinct().withColumn("_there", F.lit(1))
    per = cited.join(known, "chunk_id", "left").groupBy("answer_id").agg(F.count("chunk_id").alias("n_cited"), F.count("_there").alias("n_known"))
    return per.withColumn("grounded", (F.col("n_cited") > 0) & (F.col("n_cited") == F.col("n_known")))
