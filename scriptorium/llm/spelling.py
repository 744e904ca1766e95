"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter, and the form that each variant has.

1. Words are counted over all texts by built-in functions; those of LENGTH code points and LEAST occurrences make the vocabulary.
2. One edit destroys at most Q of a word's Q-grams, so of its Q + 1 rarest one stands in each near word, Q-gram and place
   alike: at the same place for words of one length, at the same or the next one in a word that is longer by one. Words are dealt by
   these Q + 1 grams, with length and place; words under a very common key are dealt in chunks that meet every other.
3. A group indexes its words by gram and place. For each word the shortest of its posting lists are merged by a heap, the
   others are looked up, and words that share fewer grams than one edit leaves (count filter) go. What is left is verified.
4. A variant's form is its most frequent near word. Forms of forms are followed by doubling.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LETTERS = r"[A-Za-zÀ-ÿ]"
#: One run in so many loses a code point; least code points and occurrences of a word; a form is so many times as frequent.
EVERY, LENGTH, LEAST, TIMES = 199, 6, 5, 5
Q = 2
#: Words of a chunk of one key, and rows of a bucket of keys.
CHUNK, BUCKET = 2048, 20_000


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, one in EVERY without one code point."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{LENGTH},}})"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    runs = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    place = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)


def posts(words: DataFrame, q: int = Q) -> DataFrame:
    """(gram, length, place, home, word, n): each word under its q + 1 rarest grams, at its own length (home) and, as a visitor, at the next."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - q + 1), lambda i: F.col("word").substr(i, F.lit(q))))
    # Grams of LETTERS, lower-cased: 90 ** q rows at most.
    common = {r["gram"]: r["count"] for r in words.select(gram.alias("gram")).groupBy("gram").count().collect()}
    rank = {g: k for k, g in enumerate(sorted(common, key=lambda g: (common[g], g)))}

    def run(batches):
        for b in batches:
            out = defaultdict(list)
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size = len(word)
                for g, p in sorted((rank[word[i : i + q]], i) for i in range(size - q + 1))[: q + 1]:
                    for length, place, home in ((size, p, True), (size + 1, p, False), (size + 1, p + 1, False)):
                        for c, v in zip(("gram", "length", "place", "home", "word", "n"), (g, length, place, home, word, n)):
                            out[c].append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(("gram", "length", "place", "home", "word", "n"), kinds)], names=["gram", "length", "place", "home", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "gram int, length int, place int, home boolean, word string, n long")


def one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or longer by one, differs by exactly one code point replaced or inserted."""
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] and a != b if len(a) == len(b) else a[k:] == b[k + 1 :]


class Index:
    """Positional q-grams of words of one length, with sorted posting lists of their numbers."""

    def __init__(self, words: list[str], q: int = Q):
        self.words, self.q, self.lists, self.either = words, q, defaultdict(list), {}
        for k, w in enumerate(words):
            for i in range(len(w) - q + 1):
                self.lists[w[i : i + q], i].append(k)

    def postings(self, gram: str, place: int, longer: bool) -> list[int]:
        """Words with the gram at the place, or the next one too where they are longer than the word that asks."""
        own = self.lists.get((gram, place), [])
        if not longer:
            return own
        if (gram, place) not in self.either:
            self.either[gram, place] = list(heapq.merge(own, self.lists.get((gram, place + 1), [])))
        return self.either[gram, place]

    def near(self, word: str, longer: bool, above: int = -1) -> list[int]:
        """Numbers over above of the words one edit from word; these are longer by one, or as long."""
        q = self.q
        found = sorted((self.postings(word[i : i + q], i, longer) for i in range(len(word) - q + 1)), key=len)
        least = len(word) + longer - q + 1 - q  # grams that one edit leaves of the longer word
        few = max(len(found) - least + 1, 1)
        short, rest = found[:few], found[few:]
        out, last, count = [], -1, 0
        for k in [*heapq.merge(*short), len(self.words)]:
            if k == last:
                count += 1
                continue
            if last > above and count:
                for own in rest:
                    at = bisect_left(own, last)
                    count += at < len(own) and own[at] == last
                if count >= least and one_edit(word, self.words[last]):
                    out.append(last)
            last, count = k, 1
        return out


def _group(got: pd.DataFrame) -> pd.DataFrame:
    """Near words within each key of a bucket, both ways."""
    got = got.sort_values(["gram", "length", "place", "chunk", "home"], ascending=[True, True, True, True, False], kind="stable")
    keys = got[["gram", "length", "place", "chunk"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, int)
    homes, words, ns, own = got["home"].to_numpy(), got["word"].tolist(), got["n"].tolist(), got["own"].to_numpy()
    out = []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(got)]):
        length, chunk = keys[s, 1], keys[s, 3]
        inside = [k for k in range(s, e) if homes[k] and own[k] == chunk]
        if e - s < 2 or not inside:
            continue
        index = Index([words[k] for k in inside])
        at = {k: i for i, k in enumerate(inside)}
        for k in range(s, e):
            if homes[k] and own[k] < chunk:
                continue  # it meets this chunk's words in its own chunk
            for j in index.near(words[k], len(words[k]) < length, at.get(k, -1)):
                j = inside[j]
                out += [(words[k], words[j], ns[j]), (words[j], words[k], ns[k])]
    return pd.DataFrame(out, columns=["word", "near", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n): words one edit apart, both ways, with the near word's n; a pair may come several times."""
    posted = stored(posts(words))
    key = ["gram", "length", "place"]
    hot = posted.filter("home").groupBy(*key).count().filter(F.col("count") > CHUNK)
    hot = hot.select(*key, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    buckets = max(1, -(-posted.count() // BUCKET))
    dealt = posted.join(hot, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(*key, "chunk"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(_group, "word string, near string, n long")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms (word, form) that follow one another from each word."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        now, last = stored(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))), now
        if now.filter("moved").isEmpty():
            return last.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of the vocabulary.

    Null and empty texts hold no words; a null doc_id counts as the empty text, rows that repeat count as often as they stand;
    texts are read whole. Among near words of equal n the smallest in code-point order is the form. Other columns are not
    read; an empty table gives no rows.
    """
    words = stored(vocabulary(docs))
    near = near_words(words).groupBy("word").agg(F.size(F.collect_set("near")).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    judged = words.join(near, "word", "left")
    form_n = -F.col("best.n")
    fits = form_n >= F.col("n") * TIMES
    judged = stored(judged.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, form_n).alias("form_n")))
    roots = followed(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variants() of the documents."""
    return variants(table(spark, sf_dir, "documents"))
