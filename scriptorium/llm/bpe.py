"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before white space that follows other characters: no match of the pattern spans such a place. A part
that still is long holds a run without such a place (white space alone, or none at all); the library's pattern engine
overflows its stack on these, so the matches of such a part are found here and each is encoded by itself.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Longer texts are cut between a non-space and a white space character, where no match of the pattern can span.
LONG_TEXT = 50_000
_SAFE = regex.compile(r"(?<=\S)(?=\s)")  # white space as the library sees it; re also counts U+001C to U+001F


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, longest: int = LONG_TEXT) -> Iterator[str]:
    """Cuts a text at safe boundaries into parts of about longest characters; a run without a safe boundary stays whole."""
    at = 0
    while len(text) - at > longest:
        cut = _SAFE.search(text, at + longest)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=4)
def matcher(pattern: str):
    return regex.compile(pattern)


def encode_text(text: str, enc, longest: int = LONG_TEXT, pattern: str | None = None) -> np.ndarray:
    """Token ids of a text, as unsigned 32-bit integers."""
    if len(text) <= longest:
        return np.asarray(enc.encode_ordinary(text), dtype="<u4")
    found: list[np.ndarray] = []
    for part in pieces(text, longest):
        if len(part) <= 2 * longest:
            found.append(np.asarray(enc.encode_ordinary(part), dtype="<u4"))
        else:
            found += [np.asarray(enc._encode_single_piece(m.group().encode()), dtype="<u4") for m in matcher(pattern or enc._pat_str).finditer(part)]
    return np.concatenate(found)


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, ids (binary, little-endian unsigned 32-bit) and decoded (binary, the bytes of those ids).

    A null text counts as empty (no ids). Rows are independent: repeated rows and ids give repeated rows, other columns
    are not read, an empty table gives no rows.
    """
    import public_tokenizers

    ranks, pattern = ranks or default_ranks(), pattern or public_tokenizers.PATTERN
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column(1).to_pylist():
                found = encode_text(text or "", enc)
                ids.append(found.tobytes())
                decoded.append(enc.decode_bytes(found.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=[key, "ids", "decoded"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, ids binary, decoded binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
