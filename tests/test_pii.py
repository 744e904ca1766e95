import datetime
import random
import re

from pyspark.sql import functions as F

from scriptorium.functions import pii


def definition(text):
    """All matches, earliest first, then longest, then by rule; what overlaps a kept one goes."""
    every = sorted((m.start(), -m.end(), k, name) for k, (name, p) in enumerate(pii.RULES.items()) for m in re.finditer(p, text))
    out, free = [], 0
    for start, minus, _, name in every:
        if start >= free:
            out.append((start, -minus, name))
            free = -minus
    return out


def made(seed):
    rng = random.Random(seed)
    pieces = ["1", "23", "4567", "89012345", "১২", "٣", "+", "-", " ", "\t", "\n", "\x1c", "\x1f", "\x0b", "\x85", "\xa0", " ", "​", "a", "x.y", "@", "b.com", ".", "_", "é", "字", "😀", "00", ","]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))


def test_spans_and_redaction_equal_the_definition_on_random_texts(spark):
    texts = [made(k) for k in range(6000)] + ["", None, "tel 1234\x1c5678 end", "12345678@x.com", "12 34567890a.b@x.com", "a@b.com.x@y.org", "id 123456789 0", "a@b.co@c.de", "১২৩৪৫৬৭৮৯০"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.detect("t").alias("s"), pii.redact("t").alias("r"))
    seen = 0
    for row in df.collect():
        t = texts[row.i]
        want = definition(t or "")
        assert [tuple(x) for x in row.s] == want == list(pii.spans(t or "")), repr(t)
        out, at = "", 0
        for start, end, kind in want:
            out, at = out + t[at:start] + f"[REDACTED_{kind}]", end
        assert row.r == (None if t is None else out + t[at:]), repr(t)
        seen += len(want)
    assert seen > 1000


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 1_000_000, "x@" * 300_000, "1 " * 200_000, "mail a@b.com or 12345678 " * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(pii.detect("t")).alias("n"), F.length(pii.redact("t")).alias("l"))
    got = [(r.n, r.l) for r in df.collect()]
    assert got[0] == (0, 1_000_000) and got[1] == (0, 600_000) and got[3] == (4000, 2000 * len("mail [REDACTED_EMAIL] or [REDACTED_PHONE] "))


def test_nested_texts_with_line_ends_and_controls(spark):
    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    schema = "id string, s struct<a:string,when:timestamp,n:array<struct<t:string,k:bigint>>>, m map<int,array<string>>, x array<int>"
    rows = [("doc123456789_p0001", ("tel 1234\n5678", when, [("tel 12\t345678", 123456789), None]), {7: ["a@b.com", None, "1234\x1c5678"]}, [123456789]), ("b", None, None, None)]
    got = {r.id: r for r in pii.scrub(spark.createDataFrame(rows, schema), "s", "m", "x").collect()}
    a = got["doc123456789_p0001"]
    assert a.s.a == "tel [REDACTED_PHONE]" and a.s.when == when and a.s.n[0].t == "tel [REDACTED_PHONE]" and a.s.n[0].k == 123456789 and a.s.n[1] is None
    assert a.m == {7: ["[REDACTED_EMAIL]", None, "[REDACTED_PHONE]"]} and a.x == [123456789]
    assert got["b"].s is None and got["b"].m is None and got["b"].x is None
    plan = pii.scrub(spark.createDataFrame(rows, schema), "s", "m")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
