"""Word boxes to text lines in reading order, and region provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

LINE = ["page_id", "block_num", "par_num", "line_num"]


def to_lines(words: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Boxes and mean confidence (0 to 1) of each line; blank words count for nothing, conf -1 has no confidence."""
    rows = words.filter(F.trim("text") != "")
    lines = rows.groupBy(*LINE).agg(
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
        F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100, F.lit(0.0)).alias("mean_conf"), F.min("word_idx").alias("first_seen"),
    )
    lines = lines.withColumn("h", F.col("y1") - F.col("y0")).withColumn("w", F.col("x1") - F.col("x0"))
    return lines.filter((F.col("mean_conf") >= config.score_thr) & (F.col("h") >= config.min_line_height) & (F.col("h") * F.col("w") >= config.min_line_area))


def upper_median(values: Column) -> Column:
    ordered = F.sort_array(values)
    return F.try_element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def tolerance(heights: Column, fixed: float | None = None) -> Column:
    """Vertical tolerance of a page: max(5, 0.4 * upper median height), 5 without lines."""
    return F.lit(float(fixed)) if fixed is not None else F.greatest(F.lit(5.0), 0.4 * F.coalesce(upper_median(heights), F.lit(0)))


def reading_order(lines: DataFrame, fixed: float | None = None) -> DataFrame:
    """region_idx and region_id per page: bands from the top, a band's first line is its anchor; in a band from the left."""
    middle = (F.col("y0") + F.col("y1")) / 2
    pages = lines.withColumn("cy", middle).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("cy", "first_seen", "x0", "y0", "x1", "y1", "mean_conf", "block_num", "par_num", "line_num"))).alias("ls"), F.collect_list("h").alias("hs")
    )
    pages = pages.withColumn("tol", tolerance(F.col("hs"), fixed))
    bands = F.expr(
        "aggregate(ls, named_struct('ref', cast(null as double), 'band', -1, 'out', cast(array() as array<int>)), (a, x) -> "
        "IF(a.ref IS NULL OR abs(x.cy - a.ref) > tol, named_struct('ref', x.cy, 'band', a.band + 1, 'out', array_append(a.out, a.band + 1)), "
        "named_struct('ref', a.ref, 'band', a.band, 'out', array_append(a.out, a.band))), a -> a.out)"
    )
    rows = pages.withColumn("bands", bands).select("page_id", F.explode(F.arrays_zip("ls", "bands")).alias("z")).select("page_id", "z.ls.*", F.col("z.bands").alias("band"))
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("band", "x0", "cy", "first_seen")) - 1
    rows = rows.withColumn("region_idx", order)
    return rows.withColumn("region_id", F.format_string("%s_r%03d", "page_id", "region_idx"))


def provenance(regions: DataFrame, known: DataFrame) -> DataFrame:
    """ok per region: false where the sidecar lacks it or has another box; an empty sidecar checks nothing."""
    any_known = F.broadcast(known.agg((F.count("*") > 0).alias("_any")))
    have = known.select("region_id", F.col("bbox").alias("_bbox"), F.lit(True).alias("_there"))
    out = regions.join(have, "region_id", "left").crossJoin(any_known)
    return out.withColumn("ok", ~F.col("_any") | (F.coalesce("_there", F.lit(False)) & F.coalesce(F.col("_bbox") == F.col("bbox"), F.lit(False)))).drop("_bbox", "_there", "_any")


def crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: int = 4) -> list[Column]:
    return [F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad), F.least(width, x + w + pad), F.least(height, y + h + pad)]
