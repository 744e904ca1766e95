"""The Python functions of this package for SQL text: `register(spark)`, then SELECT redact(t), * FROM pii_spans(t)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import pii


@F.udtf(returnType="start int, end int, type string")
class Spans:
    """One row for each piece of personal data in a text; none for a null text."""

    def eval(self, text: str):
        yield from pii.spans(text or "")


@F.pandas_udf("string")
def form_c(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf("string")
def redact(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else pii.redacted(t))


def register(spark: SparkSession) -> list[str]:
    """Names of the functions that SQL text may use from now on."""
    spark.udtf.register("pii_spans", Spans)
    spark.udf.register("form_c", form_c)
    spark.udf.register("redact", redact)
    return ["pii_spans", "form_c", "redact"]
