"""Evaluation and monitoring metrics."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens


def recall_at_k(found: Column, gold: Column, k: int) -> Column:
    return F.try_divide(F.size(F.array_intersect(F.slice(found, 1, k), gold)), F.size(gold))


def token_f1(hyp: Column, ref: Column) -> Column:
    """F1 of token multisets."""
    h, r = tokens(hyp), tokens(ref)
    number = lambda a, x: F.size(a) - F.size(F.array_remove(a, x))
    common = F.aggregate(F.transform(F.array_intersect(h, r), lambda x: F.least(number(h, x), number(r, x))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(2 * common, F.size(h) + F.size(r)), F.lit(0.0))


def f1_of_pairs(pairs: DataFrame, key: str = "pair", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(key, f1) of token multisets, for texts of any length: tokens are counted by a shuffle. Texts without tokens give 0."""
    side = lambda c, n: pairs.select(key, F.explode_outer(tokens(F.col(c))).alias("tok"), F.lit(n).alias("side"))
    counts = side(hyp, 0).unionAll(side(ref, 1)).groupBy(key, "tok").agg(F.count_if((F.col("side") == 0) & F.col("tok").isNotNull()).alias("h"), F.count_if((F.col("side") == 1) & F.col("tok").isNotNull()).alias("r"))
    return counts.groupBy(key).agg(F.coalesce(F.try_divide(2 * F.sum(F.least("h", "r")), F.sum("h") + F.sum("r")), F.lit(0.0)).alias("f1"))


@F.pandas_udf(T.LongType())
def _common(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or r is None else (Counter(h) & Counter(r)).total() for h, r in zip(hyp, ref)], dtype="Int64")


def f1(hyp: Column, ref: Column) -> Column:
    """As f1_of_pairs() for the texts of one row, without a shuffle."""
    h, r = F.coalesce(tokens(hyp), F.array().cast("array<string>")), F.coalesce(tokens(ref), F.array().cast("array<string>"))
    return F.coalesce(F.try_divide(2 * _common(h, r), F.size(h) + F.size(r)), F.lit(0.0))


def exact_percentile(df: DataFrame, group: str, value: str, share: float, band: float = 0.001) -> DataFrame:
    """(group, p): the interpolated percentile. A sketch brackets it, values below are counted, and only those inside are sorted."""
    known = df.filter(F.col(value).isNotNull())
    bracket = known.groupBy(group).agg(F.count("*").alias("n"), F.percentile_approx(value, [0.0, max(share - band, 0.0), min(share + band, 1.0), 1.0], int(4 / band)).alias("b"))
    few = F.col("n") * band < 4  # all of a small group are sorted
    low, high = F.when(few, F.col("b")[0]).otherwise(F.col("b")[1]), F.when(few, F.col("b")[3]).otherwise(F.col("b")[2])
    placed = known.select(group, F.col(value).alias("v")).join(bracket, group)
    below = placed.groupBy(group).agg(F.count_if(F.col("v") < low).alias("below"))
    inside = placed.filter(F.col("v").between(low, high)).join(below, group)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("v")) + F.col("below") - 1
    at = (F.col("n") - 1) * F.lit(share)
    ranked = inside.withColumn("rank", rank).withColumn("at", at)
    ends = ranked.groupBy(group).agg(F.max("at").alias("at"), F.max(F.when(F.col("rank") == F.floor("at"), F.col("v"))).alias("x"), F.max(F.when(F.col("rank") == F.ceil("at"), F.col("v"))).alias("y"))
    return ends.select(group, (F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.floor("at"))).alias("p"))


def robustness(df: DataFrame, value: str, inside: Column) -> DataFrame:
    """The metric inside and outside of the domain, and the relative drop."""
    m = df.agg(F.avg(F.when(inside, F.col(value))).alias("inside"), F.avg(F.when(~inside, F.col(value))).alias("outside"))
    return m.select(F.round("inside", 9).alias("inside"), F.round("outside", 9).alias("outside"), F.round(F.try_divide(F.col("inside") - F.col("outside"), F.col("inside")), 9).alias("drop"))


def retrain(psi: Column, latency_ok: Column, most: float = 0.2) -> Column:
    """Whether drift or a missed latency target asks for training anew."""
    return F.coalesce(psi > most, F.lit(False)) | ~F.coalesce(latency_ok, F.lit(True))


def citation_accuracy(cited: Column, gold: Column) -> Column:
    """Share of distinct citations that are among the gold ones; null without citations."""
    return F.try_divide(F.size(F.array_intersect(cited, gold)), F.size(F.array_distinct(cited)))


def judge(answer: Column, gold: Column) -> Column:
    """A rubric score of 0 to 1 without a model: the share of the gold answer's distinct tokens that the answer holds."""
    words = lambda t: F.array_distinct(tokens(F.lower(t)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(gold), words(answer))), F.size(words(gold))), F.lit(0.0))


def check(verifiable: Column, answer: Column, gold: Column, least: float = 0.5) -> Column:
    """Verifiable tasks need the gold answer, others a judged score of least."""
    return F.when(verifiable, reward(answer, gold) == 1).otherwise(judge(answer, gold) >= least)


def ece(df: DataFrame, conf: str, correct: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1))
    per = df.filter(F.col(conf).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 9).alias("ece"), F.sum("n").alias("n"))


def temperature(df: DataFrame, conf: str, correct: str, steps: int = 20) -> DataFrame:
    """The T of a grid (0.25 to steps / 4) with the least negative log likelihood of sigmoid(logit / T)."""
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: i / 4.0)).alias("t")
    p = F.greatest(F.least(F.col(conf), F.lit(0.999999)), F.lit(0.000001))
    rows = df.select(F.log(p / (1 - p)).alias("z"), F.col(correct).cast("double").alias("y"), grid)
    s = 1 / (1 + F.exp(-F.col("z") / F.col("t")))
    nll = rows.groupBy("t").agg(F.round(F.avg(-(F.col("y") * F.log(s) + (1 - F.col("y")) * F.log(1 - s))), 9).alias("nll"))
    return nll.agg(F.min(F.struct("nll", "t")).alias("b")).select(F.col("b.t").alias("temperature"), F.col("b.nll").alias("nll"))


def subgroup_gap(df: DataFrame, group: str, value: str) -> DataFrame:
    means = df.groupBy(group).agg(F.avg(value).alias("m"))
    return means.agg(F.round(F.max("m") - F.min("m"), 9).alias("gap"), F.count("*").alias("groups"))


def psi(df: DataFrame, value: str, period: Column, low: float, high: float, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index between the two values (0, 1) of period, over equal-width bins."""
    b = F.greatest(F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)), F.lit(0))
    per = df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count_if(period == 0).alias("a"), F.count_if(period == 1).alias("b"))
    total = per.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    x = per.crossJoin(F.broadcast(total)).select(F.greatest(F.col("a") / F.col("ta"), F.lit(floor)).alias("p"), F.greatest(F.col("b") / F.col("tb"), F.lit(floor)).alias("q"))
    return x.agg(F.round(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))), 9).alias("psi"))


def reward(pred: Column, gold: Column) -> Column:
    same = lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    return F.coalesce(same(pred) == same(gold), F.lit(False)).cast("int")


def drop_against(df: DataFrame, variant: str, value: str, base: str) -> DataFrame:
    """Metric per variant and its difference to the base variant."""
    means = df.groupBy(variant).agg(F.avg(value).alias("metric"))
    ref = means.filter(F.col(variant) == base).select(F.col("metric").alias("_base"))
    return means.crossJoin(F.broadcast(ref)).select(variant, F.round("metric", 9).alias("metric"), F.round(F.col("metric") - F.col("_base"), 9).alias("delta"))
