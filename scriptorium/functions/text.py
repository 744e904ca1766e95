"""Text expressions: normalisation, tokens, edit distances, ids. All are built-in functions except form C and edit distances."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Fixed value: marks that stick to the word before.
CLOSING = r"""[।,;:.!?…—\-"'“”‘’)\]]"""


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode form C. There is no built-in for it; only texts with characters from U+0300 on can change, and only they leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x{2FF}]"), text)), text)


def squeezed(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalized(text: Column) -> Column:
    return squeezed(nfc(text))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(tokens(text))).cast("long")


def text_lines(text: Column) -> Column:
    """Trimmed lines without blank ones."""
    return F.filter(F.transform(F.split(text, r"\R|[\x1c-\x1e]"), lambda x: F.trim(x)), lambda x: x != "")


def wer_tokens(text: Column) -> Column:
    """Tokens with white space before closing punctuation removed."""
    return tokens(F.regexp_replace(text, r"(?U)\s+(?=" + CLOSING + ")", ""))


def distance(a: str, b: str) -> int:
    """Edit distance over code points. Common ends are left out; of the rest, a column of the table is two whole numbers, with a bit for each rise and fall (Myers, Hyyrö)."""
    if a == b:
        return 0

    def common(least: int, part) -> int:
        low = 0
        while low < least:
            mid = (low + least + 1) // 2
            low, least = (mid, least) if part(a, low, mid) == part(b, low, mid) else (low, mid - 1)
        return low

    head = common(min(len(a), len(b)), lambda t, i, j: t[i:j])
    a, b = a[head:], b[head:]
    tail = common(min(len(a), len(b)), lambda t, i, j: t[len(t) - j : len(t) - i])
    a, b = sorted((a[: len(a) - tail], b[: len(b) - tail]), key=len)
    if not a:
        return len(b)
    full, places = (1 << len(b)) - 1, {}
    if len(b) < 4096:
        for i, c in enumerate(b):
            places[c] = places.get(c, 0) | 1 << i
    else:
        codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
        places = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    rise, fall = full, 0
    for c in a:
        equal = places.get(c, 0)
        x = ((((equal & rise) + rise) ^ rise) | equal) & full
        up = ((fall | (full ^ (x | rise))) << 1 | 1) & full
        y = equal | fall
        rise, fall = ((rise & x) << 1) & full | (full ^ (y | up)), up & y
    return len(a) + rise.bit_count() - fall.bit_count()


@F.pandas_udf(T.IntegerType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def bit_distance(a: Column, b: Column) -> Column:
    """As edit_distance(), by bit vectors: for texts that are long or unlike, but not inside of lambdas."""
    return _distances(a, b)


#: Distances up to this are found in a band around the diagonal; only larger ones take the whole table.
BAND = 32


def edit_distance(a: Column, b: Column) -> Column:
    """Over code points; as levenshtein, but in time of BAND times the length where texts are alike, and none where they are equal."""
    return F.when(a == b, 0).otherwise(F.coalesce(F.nullif(F.levenshtein(a, b, BAND), F.lit(-1)), F.levenshtein(a, b)))


def cer(hyp: Column, ref: Column) -> Column:
    """Edit distance over the reference's length; an empty reference is an error."""
    return F.when(F.length(ref) == 0, F.raise_error(F.lit("empty reference")).cast("double")).otherwise(bit_distance(hyp, ref) / F.length(ref))


def similarity(a: Column, b: Column) -> Column:
    return 1 - edit_distance(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over tokens: every distinct token of both becomes one character (surrogates left out), then levenshtein.

    More distinct tokens than characters, over a million in two texts, are an error.
    """

    def distance(both: Column) -> Column:
        code = lambda t: F.array_position(both, t) + F.when(F.array_position(both, t) >= 0xD800, 0x800).otherwise(0)
        coded = lambda x: F.array_join(F.transform(x, lambda t: F.decode(F.unhex(F.lpad(F.hex(code(t)), 8, "0")), "UTF-32")), "")
        return F.when(F.size(both) > 0x10F000, F.raise_error(F.lit("too many distinct tokens")).cast("int")).otherwise(F.levenshtein(coded(a), coded(b)))

    return F.transform(F.array(F.array_distinct(F.concat(a, b))), distance)[0]  # in a lambda, so that the table is made once


def page_doc(page_id: Column) -> Column:
    """What stands before the last _p; the whole id where there is none."""
    return F.when(page_id.contains("_p"), F.regexp_extract(page_id, "(?s)^(.*)_p", 1)).otherwise(page_id)


def last_number(stem: Column) -> Column:
    """The last run of digits, or null."""
    return F.nullif(F.regexp_extract(F.translate(stem, "০১২৩৪৫৬৭৮৯", "0123456789"), r"(\d+)\D*$", 1), F.lit("")).try_cast("int")


def doc_of_path(rel: Column) -> Column:
    """Top folder; else the name before _p<digits>; else `corpus`."""
    parts = F.split(rel, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    named = F.regexp_extract(stem, r"^(.+?)_p\d+$", 1)
    return F.when(F.size(parts) >= 2, parts[0]).when(named != "", named).otherwise(F.lit("corpus"))


def passage(text: Column, model: str) -> Column:
    return F.concat(F.lit("passage: "), text) if "e5" in model.lower() else text


def query(text: Column, model: str) -> Column:
    return F.concat(F.lit("query: "), text) if "e5" in model.lower() else text


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x / norm).cast("float")))
