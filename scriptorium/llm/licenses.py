"""License scan: license phrases at word places, and an exact set-similarity join of text blocks with license notices.

Blocks are windows over a document's words, line ends or not: for a notice of n words, windows of 2 n words that start at
every n-th word, so any n words in a row stand in one block. A block matches a notice when it holds at least THRESHOLD of the
notice's distinct words (containment); with up to nine words that means all of them.

Tokens of all notices have one global order, rarest in the corpus first. A notice of size words needs alpha =
ceil(THRESHOLD * size) of them, so the first common token stands among its first size - alpha + 1 (prefix filter). Only these
places of a document are looked up. The block needs alpha words (length filter), and after the first common token both sides
must have alpha - 1 tokens left (positional filter); what remains is counted exactly. One pass reads the texts and keeps the
places of notice words; all else reads these. Everything is SQL functions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices (label, text).
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0"),
    ("mit", "released under the mit license"),
    ("mit-text", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-text", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-text", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/"),
    ("as-is", "the software is provided as is, without warranty of any kind, express or implied"),
)
THRESHOLD = 0.9
#: Places of notice words that are looked through at once.
STRETCH = 1024
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """A-Z lower-cased, every run of other characters one space, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " ")), F.lit(" "))


def spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def phrase_columns(norm: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase, its first and last start (words from 0; null if none)."""
    size, key = len(phrase.split()), f" {phrase} "
    there = norm.contains(key)
    count = F.when(there, F.regexp_count(norm, F.lit(f" {phrase}(?= )"))).otherwise(F.lit(0)).cast("long")
    first = F.when(there, spaces(F.substring_index(norm, key, 1)))
    rest = F.substring_index(norm, key, -1)
    last = F.when(there, n_words - spaces(rest) - size)
    return count, first, last


def words_of(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower()) if w]


def alpha(size: int, threshold: float) -> int:
    return math.ceil(size * threshold - 1e-9)


def places(docs: DataFrame, phrases: dict[str, str], vocabulary: list[str]) -> DataFrame:
    """Per row of docs: row, doc_id, the columns of the phrases, and held: (pos, tok) of its words that are in the vocabulary."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", spaced(F.col("text")).alias("norm"))
    base = base.withColumn("n_words", F.when(F.col("norm") == "  ", F.lit(0)).otherwise(spaces(F.col("norm")) - 1).cast("long"))
    found = {p: phrase_columns(F.col("norm"), F.col("n_words"), p) for p in phrases}
    held = F.array_compact(F.transform(F.split(F.trim("norm"), " "), lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("tok")))))
    return base.select(
        "row", "doc_id", "n_words",
        sum((c for c, _, _ in found.values()), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(f for _, f, _ in found.values()), F.lit(None).cast("long")).alias("first_word"),
        F.greatest(*(x for _, _, x in found.values()), F.lit(None).cast("long")).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(c > 0, F.lit(phrases[p])) for p, (c, _, _) in found.items()))))).alias("base"),
        held.alias("held"),
    )


def global_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary (bounded by the notices), rarest in the corpus first."""
    seen = {r.tok: r["count"] for r in rows.select(F.explode("held.tok").alias("tok")).groupBy("tok").count().collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def candidates(rows: DataFrame, order: list[str], notices, threshold: float) -> DataFrame:
    """Blocks that meet a notice at their first common token: row, notice, label, size, alpha, ranks (of the block), own (of the notice), at, place.

    at is the place (from 1) of that token in the notice's tokens, place the one in the block's, both in global order.
    """
    rank = {w: k for k, w in enumerate(order, 1)}
    index, span = [], 2 * max(len(words_of(t)) for _, t in notices)
    for k, (label, text) in enumerate(notices):
        words = words_of(text)
        own = sorted({rank[w] for w in words})
        least = alpha(len(own), threshold)
        index += [(order[r - 1], k, label, len(own), least, len(words), own, at, r) for at, r in enumerate(own[: len(own) - least + 1], 1)]
    prefix = sorted({x[0] for x in index})
    table = rows.sparkSession.createDataFrame(index, "tok string, notice int, label string, size int, alpha int, step int, own array<int>, at int, rank int")
    last = F.ceil(F.size("held") / STRETCH).cast("int") - 1
    stretch = lambda c: F.struct(F.least(c * STRETCH, F.lit(span)).alias("lead"), F.slice("held", F.greatest(c * STRETCH - span, F.lit(0)) + 1, F.least(c * STRETCH, F.lit(span)) + STRETCH + span).alias("near"))
    parts = rows.filter(F.size("held") > 0).select("row", "n_words", F.explode(F.transform(F.sequence(F.lit(0), last), stretch)).alias("s")).select("row", "n_words", "s.lead", "s.near")
    hit = lambda h, k: F.when((k >= F.col("lead")) & (k < F.col("lead") + STRETCH) & h["tok"].isin(prefix), F.struct(h["pos"].alias("pos"), h["tok"].alias("tok"), F.slice("near", F.greatest(k - span + 2, F.lit(1)), 2 * span).alias("near")))
    hits = parts.select("row", "n_words", F.explode(F.array_compact(F.transform("near", hit))).alias("h")).select("row", "n_words", "h.*")
    met = hits.join(F.broadcast(table), "tok")
    cell = F.floor(F.col("pos") / F.col("step"))
    met = met.withColumn("start", F.explode(F.array((cell - 1) * F.col("step"), cell * F.col("step")))).filter("start >= 0")
    met = met.filter(F.least(2 * F.col("step"), F.col("n_words") - F.col("start")) >= F.col("alpha"))
    ordered = F.array(*map(F.lit, order))
    inside = F.filter("near", lambda x: (x["pos"] >= F.col("start")) & (x["pos"] < F.col("start") + 2 * F.col("step")))
    met = met.withColumn("ranks", F.array_sort(F.array_distinct(F.transform(inside, lambda x: F.array_position(ordered, x["tok"]).cast("int")))))
    met = met.withColumn("place", F.array_position("ranks", F.col("rank")).cast("int"))
    first = F.size(F.array_intersect(F.slice("ranks", F.lit(1), F.col("place") - 1), "own")) == 0
    return met.filter(first).select("row", "notice", "label", "size", "alpha", "start", "ranks", "own", "at", "place")


def possible() -> Column:
    """The positional filter on candidates(): the tokens after the first common one suffice on both sides."""
    return 1 + F.least(F.col("size") - F.col("at"), F.size("ranks") - F.col("place")) >= F.col("alpha")


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices=None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty. score is the highest containment of a notice that a block matches, or 1 where a phrase stands. Each
    row stands for itself, so null and repeated doc_ids have labels of their own; other columns are not read; an empty
    table gives no rows.
    """
    phrases, notices = phrases or PHRASES, notices or NOTICES
    vocabulary = sorted({w for _, t in notices for w in words_of(t)})
    rows = stored(places(docs, phrases, vocabulary))
    met = candidates(rows, global_order(rows, vocabulary), notices, threshold).filter(possible())
    hits = met.select("row", "label", "size", "alpha", F.size(F.array_intersect("ranks", "own")).alias("overlap")).filter(F.col("overlap") >= F.col("alpha"))
    labels = hits.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("overlap") / F.col("size")).alias("best"))
    return rows.drop("held").join(labels, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of every whole text with the phrases and notices above."""
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    place = lambda p: "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")"
    base = ", ".join(f"{place(p)} AS p{k}" for k, p in enumerate(PHRASES))
    every = "list_concat(" + ", ".join(f"p{k}" for k in range(len(PHRASES))) + ")"
    tags = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{v}' END" for k, v in enumerate(PHRASES.values())) + "], lambda x: x IS NOT NULL)"
    sets = ", ".join(f"('{label}', {sorted(set(words_of(t)))!r}, {len(words_of(t))})" for label, t in NOTICES)
    return f"""
    WITH t(label, ws, step) AS (VALUES {sets}),
    d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
    j AS (SELECT k, label, ws, step, w, unnest(range(CAST(ceil(len(w) / step) AS BIGINT))) AS j FROM d, t),
    b AS (SELECT k, label, len(list_intersect(list_distinct(w[j * step + 1 : j * step + 2 * step]), ws)) / len(ws) AS c, ceil({THRESHOLD} * len(ws) - 1e-9) / len(ws) AS least FROM j),
    g AS (SELECT k, list(DISTINCT label) AS found, max(c) AS best FROM b WHERE c >= least GROUP BY 1),
    e AS (SELECT k, doc_id, len(w) AS n_words, {base} FROM d),
    f AS (SELECT *, {every} AS places, list_sort({tags}) AS tags FROM e)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
      array_to_string(tags, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(tags, coalesce(found, [])))), ',') AS labels,
      CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
    FROM f LEFT JOIN g USING (k)"""


ORACLE = _oracle()
