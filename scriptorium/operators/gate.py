"""Line alignment and the accept/reject gate of transcribed lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import bit_distance, normalized, page_doc, similarity, text_lines
from .layout import provenance


def align(n_hyp: int, n_ref: int, sim: np.ndarray | None, config: Config = DEFAULT) -> list[int | None] | None:
    """The definition that align_pages() follows, for one page. Reference line of each line; None if the counts differ too much. Equal counts pair by position.

    Otherwise the pairing of highest total similarity with free gaps; ties prefer a pair, then skipping a line, then
    skipping a reference line. Pairs below the least similarity are dropped. sim: (n_hyp, n_ref).
    """
    if n_hyp == n_ref:
        return list(range(n_hyp))
    if abs(n_hyp - n_ref) > config.max_line_diff:
        return None
    best = np.zeros((n_hyp + 1, n_ref + 1))
    for i in range(1, n_hyp + 1):
        for j in range(1, n_ref + 1):
            best[i, j] = max(best[i - 1, j - 1] + sim[i - 1, j - 1], best[i - 1, j], best[i, j - 1])
    out: list[int | None] = [None] * n_hyp
    i, j = n_hyp, n_ref
    while i and j:
        if best[i, j] == best[i - 1, j - 1] + sim[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out[i] = j if sim[i, j] >= config.min_line_similarity else None
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out


def _path(n: Column, m: Column, sim: Column, config: Config) -> Column:
    """For each of n lines its reference line or null, by align()'s rules, from sim (n arrays of m): a fold over anti-diagonals.

    A cell needs the two diagonals before its own only; each is an array by line, and a move (0 pair, 1 skip a line, 2 skip a
    reference line) of each cell is kept for the way back, a byte a cell.
    """
    start = F.struct(*(F.array_repeat(F.lit(0.0), n + 1).alias(c) for c in ("before", "last")), F.array().cast("array<array<tinyint>>").alias("moves"))

    def diagonal(s: Column, d: Column) -> Column:
        def cell(i: Column) -> Column:
            pair = F.get(s["before"], i - 1) + F.get(F.get(sim, i - 1), d - i - 1)
            skip, other = F.get(s["last"], i - 1), F.get(s["last"], i)
            best = F.greatest(pair, skip, other)
            move = F.when(pair == best, 0).when(skip == best, 1).otherwise(2)
            value = lambda x, k: F.struct(x.alias("x"), F.lit(k).cast("tinyint").alias("move"))
            return F.when((i < 1) | (d - i < 1) | (d - i > m), value(F.lit(0.0), 0)).otherwise(F.struct(best.alias("x"), move.cast("tinyint").alias("move")))

        # In a lambda, so that each cell is worked out once.
        cells = F.array(F.transform(F.sequence(F.lit(0), n), cell))
        return F.transform(cells, lambda c: F.struct(s["last"].alias("before"), F.transform(c, lambda x: x["x"]).alias("last"), F.concat(s["moves"], F.array(F.transform(c, lambda x: x["move"]))).alias("moves")))[0]

    def back(s: Column, _: Column) -> Column:
        move = F.get(F.get(s["moves"], s["i"] + s["j"] - 2), s["i"])
        paired = F.get(F.get(sim, s["i"] - 1), s["j"] - 1) >= config.min_line_similarity
        to = lambda i, j, out: F.struct(s["moves"].alias("moves"), i.alias("i"), j.alias("j"), out.alias("out"))
        more = lambda x: F.concat(F.array(x.cast("int")), s["out"])
        taken = F.when(move == 0, to(s["i"] - 1, s["j"] - 1, more(F.when(paired, s["j"] - 1)))).when(move == 1, to(s["i"] - 1, s["j"], more(F.lit(None)))).otherwise(to(s["i"], s["j"] - 1, s["out"]))
        return F.when((s["i"] > 0) & (s["j"] > 0), taken).otherwise(s)

    moves = F.aggregate(F.sequence(F.lit(2), n + m), start, diagonal, lambda s: s["moves"])
    end = F.struct(moves.alias("moves"), n.alias("i"), m.alias("j"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), n + m), end, back, lambda s: F.concat(F.array_repeat(F.lit(None).cast("int"), s["i"]), s["out"]))


def _exact(n: Column, m: Column, hyp: Column, ref: Column) -> Column:
    """align()'s pairing if the lines of the shorter side stand in the other as they are, in order; else null.

    Each of them pairs with an equal one then, which is the highest total there can be, so the way back from the end takes
    every equal pair: a fold over the longer side. No similarity is needed.
    """
    to = lambda left, out: F.struct(left.cast("int").alias("left"), out.alias("out"))
    more = lambda s, x: F.concat(F.array(x.cast("int")), s["out"])
    end = lambda s: F.when(s["left"] == 0, s["out"])
    fold = lambda size, left, step: F.aggregate(F.sequence(size, F.lit(1)), to(left, F.array().cast("array<int>")), step, end)
    skip = lambda s, i: F.when(F.get(hyp, i - 1) == F.get(ref, s["left"] - 1), to(s["left"] - 1, more(s, s["left"] - 1))).otherwise(to(s["left"], more(s, F.lit(None))))
    pass_ = lambda s, j: F.when(F.get(ref, j - 1) == F.get(hyp, s["left"] - 1), to(s["left"] - 1, more(s, j - 1))).otherwise(s)
    return F.when(n > m, fold(n, m, skip)).otherwise(fold(m, n, pass_))


def _paths(pages: DataFrame, config: Config) -> DataFrame:
    """page_id, ref, path (for each line its reference line or null) and aligned of pages (page_id, hyp, ref) that have lines."""
    n, m = F.size("hyp"), F.coalesce(F.size("ref"), F.lit(-1))
    near = (m >= 0) & (F.abs(n - m) <= config.max_line_diff)
    rows = pages.select("page_id", "hyp", "ref", n.alias("n"), m.alias("m"), near.alias("aligned")).filter("n > 0")
    n, m, hyp, ref = (F.col(c) for c in ("n", "m", "hyp", "ref"))
    sims = F.transform(hyp, lambda h: F.transform(ref, lambda r: similarity(h, r)))
    # In lambdas, so that the way and similarities are worked out once, and only where they decide.
    by_sims = F.transform(F.array(sims), lambda sim: _path(n, m, sim, config))[0]
    traced = F.transform(F.array(_exact(n, m, hyp, ref)), lambda x: F.when(x.isNotNull(), x).otherwise(by_sims))[0]
    other = F.array_repeat(F.lit(None).cast("int"), n)
    path = F.when(n == m, F.sequence(F.lit(0), n - 1)).when(F.col("aligned") & (m > 0), traced).otherwise(other)
    return rows.select("page_id", "ref", path.alias("path"), "aligned")


def align_pages(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pages: page_id, hyp, ref (arrays of lines). (page_id, idx, ref_idx, aligned); a page is one unit of work.

    Equal counts pair by position, counts too far apart pair nothing. Of the pages between, those with one side's lines all in
    the other pair by equality; the rest are aligned by similarity: n * m edit distances and as many bytes for the way back.
    """
    return _paths(pages, config).select("page_id", F.posexplode("path").alias("idx", "ref_idx"), "aligned")


def aligned_lines(pages: DataFrame, texts: DataFrame, name: str, config: Config = DEFAULT) -> DataFrame:
    """(page_id, idx, name): the normalised line of a page's text that is aligned with each of its lines (hyp). texts: page_id, text."""
    lines = texts.select("page_id", text_lines(F.col("text")).alias("ref"))
    found = _paths(pages.join(lines, "page_id", "left"), config).filter("aligned")
    index = found.select("page_id", F.posexplode(F.transform("path", lambda j: F.get("ref", j))).alias("idx", "line")).filter("line IS NOT NULL")
    return index.select("page_id", "idx", F.nullif(normalized(F.col("line")), F.lit("")).alias(name))


def audit(regions: DataFrame, layout: DataFrame | None = None, gold: DataFrame | None = None, refs: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row per transcribed region with its tier, reason and error rate. regions: page_id, idx, text, conf, bbox.

    layout: region_id, bbox of what was detected (empty or none: not checked). gold, refs: page_id, text of whole pages; their lines
    are aligned with the page's regions. idx counts the regions of a page from 0.
    """
    pages = regions.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("hyp"))
    rows = regions.withColumn("region_id", F.format_string("%s_r%03d", "page_id", "idx")).withColumn("norm", normalized(F.coalesce("text", F.lit(""))))
    for name, texts in (("gold", gold), ("ref", refs)):
        rows = rows.withColumn(name, F.lit(None).cast("string")) if texts is None else rows.join(aligned_lines(pages, texts, name, config), ["page_id", "idx"], "left")
    rows = rows.withColumn("ok", F.lit(True)) if layout is None else provenance(rows, layout)
    rows = rows.withColumn("g", decide(F.col("norm"), F.col("gold"), F.col("ref"), F.col("ref").isNotNull(), F.col("ok"), config))
    shown = F.when(F.col("g.tier") == "gold", F.col("gold")).when(F.col("g.cer").isNotNull(), F.col("ref"))
    return rows.select(
        "region_id", F.format_string("%s_l%03d", "page_id", "idx").alias("chunk_id"), "page_id", "idx", F.col("conf").alias("ocr_confidence"), "g.cer", F.lit(config.max_cer).alias("cer_threshold"),
        F.lit(ocr_config(config)).alias("ocr_config"), F.col("text").alias("ocr_text_raw"), F.col("norm").alias("ocr_text_normalized"), shown.alias("reference_text_normalized"),
        F.col("g.tier").alias("evidence_tier"), "g.accepted", F.col("g.reason").alias("reject_reason"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    """The line chunks of accepted rows of audit(): id, doc_id, text, page_ids."""
    kept = rows.filter("accepted")
    return kept.select(F.col("chunk_id").alias("id"), page_doc(F.col("page_id")).alias("doc_id"), F.col("ocr_text_normalized").alias("text"), F.array("page_id").alias("page_ids"))


# Tiers and the reasons of rejection, as written to the audit table.
RAW, SILVER, GOLD = "raw", "silver", "gold"
MISPLACED, SHORT, UNALIGNED, ABOVE = "layout_provenance_mismatch", "REJECT_TOO_SHORT", "reference_alignment_failed", "cer_above_threshold"


def decide(norm: Column, gold: Column, ref: Column, aligned: Column, known: Column, config: Config = DEFAULT) -> Column:
    """First match wins: provenance, too short, equal to gold, no aligned reference, error rate."""
    row = lambda tier, ok, why, value=None: F.struct(F.lit(tier).alias("tier"), F.lit(ok).alias("accepted"), F.lit(why).cast("string").alias("reason"), (F.lit(value) if value is None or isinstance(value, float) else value).cast("double").alias("cer"))
    short, same = F.length(norm) < config.min_line_chars, F.coalesce(gold == norm, F.lit(False))
    needed = known & ~short & ~same & aligned & ref.isNotNull() & (F.length(ref) > 0)
    decided = lambda rate: (
        F.when(~known, row(RAW, False, MISPLACED))
        .when(short, row(RAW, False, SHORT))
        .when(same, row(GOLD, True, None, 0.0))
        .when(~aligned | rate.isNull(), row(RAW, False, UNALIGNED))
        .when(rate <= config.max_cer, row(SILVER, True, None, rate))
        .otherwise(row(RAW, False, ABOVE, rate))
    )
    # In a lambda, so that the rate is worked out once, and only where it decides.
    return F.transform(F.array(bit_distance(F.when(needed, norm), ref) / F.when(needed, F.length(ref))), decided)[0]


def ocr_config(config: Config = DEFAULT) -> str:
    return f"--oem {config.ocr_oem} --psm {config.line_psm} -l {config.ocr_lang}"


def page_config(config: Config = DEFAULT) -> str:
    return f"--psm {config.page_psm} -l {config.ocr_lang}"


def transcribed(lines: DataFrame, reader) -> DataFrame:
    """lines with text and conf from reader(crop, width, height) -> (text, conf); an empty crop gives no text and 0.0. lines: crop (binary), w, h."""

    @F.pandas_udf("struct<text string, conf double>")
    def read(crop: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        found = [reader(c, x, y) if c is not None and len(c) and x > 0 and y > 0 else ("", 0.0) for c, x, y in zip(crop, w, h)]
        return pd.DataFrame(found, columns=["text", "conf"])

    return lines.withColumn("_read", read("crop", "w", "h")).select(*lines.columns, "_read.text", "_read.conf")
