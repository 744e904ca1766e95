"""Personal data: spans, redaction and counts. Earliest start wins, then the longest, then the order of rules.

All of it runs in the JVM. A rule's matches and what stands between them come from one extraction and one split of the text;
lengths added up in turn are the offsets. Candidates of all rules, sorted, are folded into spans that don't overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns that decide what counts as personal data.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(?:\+?\d{1,3}[-\s]?)?(?:\d[-\s]?){7,12}\d(?!\d)"
ID_NUMBER = r"(?<!\d)\d{9,16}(?!\d)"
RULES = {"EMAIL": EMAIL, "PHONE": PHONE, "ID_NUMBER": ID_NUMBER}
_COMPILED = {k: re.compile(v) for k, v in RULES.items()}

#: White space as Python's patterns have it, inside of a class: U+001C to U+001F are no white space to Java.
_SPACE = r"\s\x1c-\x1f"
#: The local part of an address is tried from its first character only (or where a match ended): from any later one it ends alike.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
#: A digit and what may follow it. Counted groups are written out: Java remembers where a group failed, but not at which count.
_DIGIT = rf"\d[-{_SPACE}]?"
_PHONE = rf"(?U)(?<!\d)(?:\+?\d{{1,3}}[-{_SPACE}]?)?{_DIGIT * 7}{f'(?:{_DIGIT}' * 5}{')?' * 5}\d(?!\d)"
_JAVA = {"EMAIL": EMAIL.replace("[A-Za-z0-9._%+-]+", _LOCAL, 1), "PHONE": _PHONE, "ID_NUMBER": "(?U)" + ID_NUMBER}
#: What any of the patterns needs somewhere in a text.
HIT = rf"(?U)@|{_DIGIT * 7}\d"


def spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of one text, for SQL functions in Python: the rules' next matches compete, those inside of the winner are passed over."""
    ahead = {kind: p.finditer(text) for kind, p in _COMPILED.items()}
    first = {kind: next(found, None) for kind, found in ahead.items()}
    while any(first.values()):
        kind = min((k for k in first if first[k]), key=lambda k: (first[k].start(), -first[k].end()))
        won = first[kind]
        yield won.start(), won.end(), kind
        for k, found in ahead.items():
            while first[k] and first[k].start() < won.end():
                first[k] = next(found, None)


def redacted(text: str) -> str:
    for start, end, kind in reversed(list(spans(text))):
        text = f"{text[:start]}[REDACTED_{kind}]{text[end:]}"
    return text


def _column(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


_SPAN = "array<struct<start:int,end:int,type:string>>"


def _candidates(text: Column, kind: str) -> Column:
    """All matches of one rule, in order."""
    pattern = _JAVA[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.transform(hits, lambda x: F.length(x)).alias("hit"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        return F.struct((start + x["hit"]).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), (start + x["hit"]).alias("end"), F.lit(kind).alias("type")))).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), none, step, lambda s: s["out"])


def _found(text: Column) -> Column:
    """Spans of a text that may hold some."""
    order = lambda rule: lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), F.lit(rule).alias("rule"), x["type"].alias("type"))
    every = F.concat(*(F.transform(_candidates(text, kind), order(k)) for k, kind in enumerate(RULES)))

    def step(s: Column, x: Column) -> Column:
        span = F.struct(x["start"].alias("start"), (-x["minus"]).alias("end"), x["type"].alias("type"))
        return F.when(x["start"] >= s["free"], F.struct((-x["minus"]).alias("free"), F.concat(s["out"], F.array(span)).alias("out"))).otherwise(s)

    none = F.struct(F.lit(0).alias("free"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(F.array_sort(every), none, step, lambda s: s["out"])


def detect(text) -> Column:
    """Spans (start, end, type) of a text column; none for a null text."""
    t = _column(text)
    return F.when(t.rlike(HIT), _found(t)).otherwise(F.array().cast(_SPAN))


def redact(text) -> Column:
    """The text with [REDACTED_<type>] in place of each span; null stays null."""
    t = _column(text)

    def cut(found: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(found, i - 1)["end"])
        piece = lambda x, i: F.concat(t.substr(before(i) + 1, x["start"] - before(i)), F.lit("[REDACTED_"), x["type"], F.lit("]"))
        last = F.when(F.size(found) == 0, 0).otherwise(F.element_at(found, -1)["end"])
        return F.concat(F.array_join(F.transform(found, piece), ""), t.substr(last + 1, F.length(t)))

    return F.when(t.rlike(HIT), F.transform(F.array(_found(t)), cut)[0]).otherwise(t)  # in a lambda, so that spans are found once


def redact_email(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]")


def phone_like(text: Column) -> Column:
    """Digits of maximal phone-like runs of 8 to 16 digits, JVM side."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)(\+?\d(?:[-\s]?\d)*)"), F.lit(1))
    return F.filter(F.transform(runs, lambda r: F.regexp_replace(r, r"(?U)\D", "")), lambda r: (F.length(r) >= 8) & (F.length(r) <= 16))


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    return _holds_text(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def _deep(value: Column, kind: T.DataType) -> Column:
    """The same value with every text in it redacted; names of fields and keys of maps stay."""
    if not _holds_text(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_deep(value.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _deep(x, kind.elementType))
    return F.transform_values(value, lambda _, x: _deep(x, kind.valueType)) if isinstance(kind, T.MapType) else redact(value)


def scrub(df: DataFrame, *columns: str) -> DataFrame:
    """Redacts the named columns: texts, and texts anywhere inside arrays, structs and maps. Other columns, ids above all, are not touched."""
    return df.withColumns({c: _deep(F.col(c), df.schema[c].dataType) for c in columns})
