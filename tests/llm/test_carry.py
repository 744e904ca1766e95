import datetime
import decimal
import math

import corpus_pipeline
from scriptorium.llm import carry

SCHEMA = """doc_id long, text string, lang string, source string, n_chars long, `a.b` timestamp, m map<int,timestamp>, d decimal(30,10), bin binary, day date, x double, f float, l timestamp_ntz,
    s struct<t:timestamp,`p q`:array<struct<k:map<string,decimal(5,2)>,b:binary>>>, n array<array<int>>, flag boolean"""


def rows():
    t = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    full = (1, "one long enough text " * 5, "en", "s", 100, t, {1: t, 2: None}, decimal.Decimal("12345678901234567890.0123456789"), b"\x00\xff", datetime.date(1600, 2, 29), math.inf, 0.1, datetime.datetime(1, 1, 1, 0, 0, 0, 1),
            (t, [({"a": decimal.Decimal("1.20")}, b""), None]), [[1, None], None, []], True)
    return [full, (2, "two", *[None] * 14), (3, None, *[None] * 14), (None, "four", "", "", 0, t, {}, decimal.Decimal(0), b"", None, -0.0, math.nan, None, (None, None), [], False)]


def test_columns_come_back_equal(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    back = df.select(carry.packed(df).alias("t")).select(*carry.unpacked(carry.F.col("t"), df.schema))
    assert back.dtypes == df.dtypes
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_repeated_strings_leave_other_columns_alone(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = corpus_pipeline.repeated_strings(spark, df, "")
    assert out.dtypes == df.dtypes
    plain = lambda f: sorted(repr(r.asDict() | {"text": None, "n_chars": None}) for r in f.collect())
    assert plain(out) == plain(df) and {r.text for r in out.collect()} == {rows()[0][1], "two", "", "four"}
