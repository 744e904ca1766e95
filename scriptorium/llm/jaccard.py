"""Exact n-gram Jaccard join by grouped prefixes, and its connected components.

1. Shingle counts: each batch of documents sends its distinct shingle tokens (48 bits of a hash) to buckets, with the
   document where only one of the batch has it; a bucket knows how many documents hold a token and answers with those held by
   two or more. A document whose shared tokens are fewer than 80 % of its set links with nothing and is done. Two shingles
   of one token only make it look more common, so nothing is lost by that.
2. Documents with equal sets become one class. Tokens are ordered rarest first; unshared ones come first and take up places.
   With J >= 0.8 two sets share one of their first n - ceil(0.8 n) + 1 tokens (prefix).
3. Classes with identical prefix and size become one group, which is posted once under its prefix tokens. Group pairs are
   filtered first to those with a hub, of all groups of a token the one whose tokens are most common: the members of a group meet
   the best hub of its tokens, or its representative where there is none. The links found make components.
4. What is left are tokens under which several components stand. Their classes are expanded in chunks of CHUNK (of one
   component, or of one hub), and pairs of chunks that pass the length and positional filters are verified unless both lie
   in one component. A large cluster of near copies thus costs a comparison a member, not a pair.

Every link is verified on the words of both texts. Candidates are hashes and ids; texts of classes that may link travel only
to be verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import stored, table
from .graphs import components

WIDTH, SHARE = 5, 80
#: Bytes of text for each bucket of tokens; they grow with the root of the corpus beyond 64 GB, up to the second number.
BUCKET_BYTES, BUCKET_MOST = 16 << 20, 256 << 20
#: Bytes of text of a batch, least and most; it grows with the number of buckets, so that parts don't get too small.
BATCH_BYTES, BATCH_MOST = 4 << 20, 64 << 20
#: Classes of a chunk.
CHUNK = 64
#: Classes whose texts are asked for by all tasks up to this number (24 bytes each), else by a join with a shuffle.
BROADCAST_ROWS = 2_000_000
BITS = 48
_TOKEN = np.dtype([("t", "<u8"), ("d", "<u2"), ("n", "<u4")])
SEVERAL = 0xFFFF


def need(n: int, share: int = SHARE) -> int:
    """The least intersection of a set of n with any set it links with."""
    return -(-share * n // 100)


def sizes(text_bytes: int) -> tuple[int, int]:
    """Number of buckets and bytes of a batch for so many bytes of text."""
    bucket = min(BUCKET_MOST, BUCKET_BYTES * max(1.0, (text_bytes / (64 << 30)) ** 0.5))
    buckets = max(64, int(text_bytes / bucket) + 1)
    return buckets, min(BATCH_MOST, max(BATCH_BYTES, buckets * 4096))


def _packed(rows: np.ndarray) -> bytes:
    """Rows of _TOKEN for a shuffle: differences of the hashes by byte planes, then the other columns; compressed."""
    with np.errstate(over="ignore"):
        step = np.diff(rows["t"], prepend=np.uint64(0))
    planes = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes() + rows["d"].tobytes() + rows["n"].tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    flat = zstandard.decompress(blob)
    n = len(flat) // _TOKEN.itemsize
    rows = np.empty(n, _TOKEN)
    with np.errstate(over="ignore"):
        rows["t"] = np.cumsum(np.ascontiguousarray(np.frombuffer(flat, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    rows["d"], rows["n"] = np.frombuffer(flat, "<u2", n, 8 * n), np.frombuffer(flat, "<u4", n, 10 * n)
    return rows


def _bucketed(rows: np.ndarray, buckets: int):
    """(bucket, part) for rows sorted by token: buckets are ranges of the hash."""
    edges = np.searchsorted(rows["t"], np.array([(k << BITS) // buckets for k in range(1, buckets)], np.uint64))
    for k, part in enumerate(np.split(rows, edges)):
        if len(part):
            yield k, part


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a whole text."""
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def shingle_rows(docs: DataFrame, buckets: int, batch_bytes: int, width: int, key: str | None = None) -> DataFrame:
    """(dest, batch, blob): tokens by bucket (dest >= 0), and per batch its documents with their keys (dest < 0)."""

    def run(batches):
        base, count = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            ids, nulls = whole.column(0).fill_null(0).to_numpy(zero_copy_only=False), whole.column(0).is_null().to_numpy(zero_copy_only=False)
            keys, ka, kb = (whole.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 4))
            texts = whole.column(2).cast(pa.binary())
            at = 0
            while at < len(ids):
                part, size = [], 0
                while at + len(part) < len(ids) and len(part) < SEVERAL and (not part or size < batch_bytes):
                    part.append(texts[at + len(part)].as_py() or b"")
                    size += len(part[-1])
                end, sets = at + len(part), []
                with np.errstate(over="ignore"):
                    for k in range(0, len(part), 100):
                        data, bounds = hashing.joined(part[k : k + 100])
                        sets += hashing.shingles(*hashing.words(data, bounds), width)
                short = [np.unique(s >> np.uint64(64 - BITS)) for s in sets]
                lengths = np.array([len(s) for s in short])
                tokens, owner = np.concatenate(short), np.repeat(np.arange(len(sets)), lengths)
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                first = np.ones(len(tokens), bool)
                first[1:] = tokens[1:] != tokens[:-1]
                n = np.diff(np.append(np.flatnonzero(first), len(tokens)))
                rows = np.zeros(len(n), _TOKEN)
                rows["t"], rows["n"], rows["d"] = tokens[first], n, np.where(n == 1, owner[first], SEVERAL)
                batch, dest, blobs = base + count, [-1 - count], []
                count += 1
                own = np.repeat(n, n) > 1
                head = np.stack([ids[at:end], keys[at:end], nulls[at:end], [len(s) for s in sets], lengths, ka[at:end], kb[at:end]]).astype("<i8")
                mine = np.zeros(int(own.sum()), _TOKEN)
                mine["t"], mine["d"] = tokens[own], owner[own]
                digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
                blobs.append(np.int64(len(sets)).tobytes() + head.tobytes() + digests + _packed(mine))
                for k, x in _bucketed(rows, buckets):
                    dest.append(k)
                    blobs.append(_packed(x))
                yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array([batch] * len(dest), pa.int64()), pa.array(blobs, pa.binary())], names=["dest", "batch", "blob"])
                at = end

    own = F.col(key).cast("long") if key else F.lit(0).cast("long")
    a, b = text_key(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("key"), "text", a.alias("a"), b.alias("b")).mapInArrow(run, "dest long, batch long, blob binary")


def _count(got: pd.DataFrame) -> pd.DataFrame:
    """Answers each batch with its shingles that two documents or more hold."""
    if got["dest"].iloc[0] < 0:
        return got[["dest", "batch", "blob"]]
    parts = [_unpacked(b) for b in got["blob"]]
    t = np.concatenate([p["t"] for p in parts])
    _, inverse = np.unique(t, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([p["n"] for p in parts]))[inverse]
    out, at = [], 0
    for batch, p in zip(got["batch"], parts):
        n = total[at : at + len(p)]
        at += len(p)
        keep = p[n > 1].copy()
        if len(keep):
            keep["n"] = np.minimum(n[n > 1], 0xFFFFFFFF)
            out.append((got["dest"].iloc[0], batch, _packed(keep)))
    return pd.DataFrame(out, columns=["dest", "batch", "blob"])


def _answer(share: int):
    def run(got: pd.DataFrame) -> pd.DataFrame:
        """Per document its size, digest, text key, and, if it may link, how common its tokens are (mean logarithm of their counts) and its prefix, rarest first."""
        head, rest = None, []
        for dest, blob in zip(got["dest"], got["blob"]):
            if dest < 0:
                head = blob
            else:
                rest.append(_unpacked(blob))
        n = int(np.frombuffer(head, "<i8", 1)[0])
        ids, keys, nulls, size, short, a, b = np.frombuffer(head, "<i8", 7 * n, 8).reshape(7, n)
        digests = [head[8 + 56 * n + 16 * i : 24 + 56 * n + 16 * i] for i in range(n)]
        mine = _unpacked(head[8 + 72 * n :])
        known = np.sort(np.concatenate(rest or [np.zeros(0, _TOKEN)]), order="t")
        own = mine.copy()
        if len(own):
            own["n"] = known["n"][np.searchsorted(known["t"], own["t"])]
        every = np.concatenate([known[known["d"] != SEVERAL], own])
        every = every[np.lexsort((every["t"], every["n"], every["d"]))]
        bounds = np.searchsorted(every["d"], np.arange(n + 1))
        prefix = []
        for s, e, full, some in zip(bounds[:-1].tolist(), bounds[1:].tolist(), size.tolist(), short.tolist()):
            least = max(need(full, share) - (full - some), 1)  # fewer where two of its shingles have one token
            prefix.append(every["t"][s : e - least + 1].astype(np.int64) if full and e - s >= least else None)
        centre = np.bincount(every["d"], np.log2(every["n"]), n)[:n] / np.maximum(size, 1)
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64").mask(nulls > 0), "key": keys, "n": size, "digest": digests, "a": a, "b": b, "centre": centre, "prefix": prefix})

    return run


def word_shingles(text: str | None, width: int) -> set[bytes]:
    """The definition: A-Z lower-cased, words split at ASCII white space; the whole sequence where there are fewer than width words."""
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def linked(a: set, b: set, share: int) -> bool:
    if not a or not b or 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= share * (len(a) + len(b) - both)


def near(a: Column, b: Column, share: int) -> Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(a, b) >= share * F.greatest(a, b)


def verified(pairs: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """Of pairs (u, v) those that link, by the words of their texts (cid, text)."""
    one = texts.select(F.col("cid").alias("u"), F.col("text").alias("x"))
    two = texts.select(F.col("cid").alias("v"), F.col("text").alias("y"))

    def run(batches):
        last, held = None, set()
        for b in batches:
            keep = []
            for v, x, y in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                if v != last:
                    last, held = v, word_shingles(y.as_py(), width)
                keep.append(linked(word_shingles(x.as_py(), width), held, share))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _block(width: int, share: int):
    def run(got: pd.DataFrame) -> pd.DataFrame:
        """Links between members of different components of one or two chunks, as a spanning forest."""
        sets = [word_shingles(t, width) for t in got["text"]]
        side, parent = got["chunk"].tolist(), {c: c for c in got["comp"]}
        comp, cid = got["comp"].tolist(), got["cid"].tolist()
        left = [i for i, s in enumerate(side) if s == got["a"].iloc[0]]
        right = [i for i, s in enumerate(side) if s == got["b"].iloc[0]]

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        for i in left:
            for j in right:
                a, b = root(comp[i]), root(comp[j])
                if a != b and linked(sets[i], sets[j], share):
                    parent[max(a, b)] = min(a, b)
                    out.append((cid[i], cid[j]))
        return pd.DataFrame(out, columns=["u", "v"])

    return run


def class_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, text) of each class."""
    wanted = classes.select("a", "b", "cid")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    a, b = text_key(F.col("text"))
    return stored(docs.select("text", a.alias("a"), b.alias("b")).join(wanted, ["a", "b"]).groupBy("cid").agg(F.first("text").alias("text")))


def hub_pairs(classes: DataFrame, share: int) -> DataFrame:
    """(u, v): each member of a group with the best hub of the group's prefix tokens, or with the group's representative."""
    groups = stored(classes.groupBy("n", "prefix").agg(F.min("cid").alias("g"), F.max("centre").alias("centre")))
    posts = groups.select("g", "n", "centre", F.explode("prefix").alias("t"))
    hubs = posts.groupBy("t").agg(F.max(F.struct("centre", "n", "g")).alias("hub"), F.count("*").alias("c")).filter("c > 1").select("t", F.col("hub.g").alias("v"), F.col("hub.n").alias("hub_n"), F.col("hub.centre").alias("hub_centre"))
    met = posts.join(hubs, "t").filter((F.col("g") != F.col("v")) & near(F.col("n"), F.col("hub_n"), share))
    votes = met.groupBy("g", "v", "hub_centre").agg(F.count("*").alias("votes")).groupBy("g").agg(F.max(F.struct("hub_centre", "votes", "v")).alias("best"))
    named = groups.select("n", "prefix", "g").join(votes.select("g", F.col("best.v").alias("v")), "g", "left")
    members = classes.select("cid", "n", "prefix").join(named, ["n", "prefix"])
    return members.select(F.col("cid").alias("u"), F.coalesce("v", "g").alias("v")).filter("u <> v")


def open_links(classes: DataFrame, comps: DataFrame, hubs: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """Links (u, v) between classes of different components that share a prefix token.

    Chunks hold classes of one component, or classes alone in theirs that met one hub. Under a token at place at of n sets,
    no more than min(at) + min(tokens after it) can be common, which a link's intersection must not pass (positional filter).
    """
    rest = F.size("prefix") + F.ceil(F.col("n") * share / 100) - 1
    posts = classes.select("cid", "n", rest.alias("shared"), F.posexplode("prefix").alias("at", "t")).join(comps, "cid")
    several = posts.groupBy("t").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("t")
    live = stored(posts.join(several, "t", "left_semi"))
    own = live.select("cid", "comp").distinct()
    alone = own.groupBy("comp").agg((F.count("*") == 1).alias("alone"))
    own = own.join(alone, "comp").join(hubs.select(F.col("u").alias("cid"), F.col("v").alias("hub")), "cid", "left")
    own = stored(own.select("cid", "comp", "alone", F.when(F.col("alone"), F.coalesce("hub", "cid")).otherwise(F.col("comp")).alias("k")))
    count = own.groupBy("alone", "k").agg(F.count("*").alias("c"))
    chunk = F.xxhash64("alone", "k", F.pmod(F.xxhash64("cid"), F.ceil(F.col("c") / CHUNK)))
    own = stored(own.join(count, ["alone", "k"]).select("cid", "comp", chunk.alias("chunk")))
    ends = [F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("at") + 1).alias("upto"), F.max(F.col("shared") - F.col("at") - 1).alias("after")]
    posted = live.select("cid", "n", "shared", "at", "t").join(own, "cid").groupBy("t", "chunk").agg(*ends)
    mixed = F.col("low") != F.col("high")
    posted = stored(posted.withColumn("label", F.struct(mixed.alias("mixed"), F.when(mixed, F.col("chunk")).otherwise(F.col("low")).alias("of"))))
    labels = posted.select("t", "label").distinct()
    met = labels.withColumnRenamed("label", "one").join(labels.withColumnRenamed("label", "two"), "t").filter("one < two")
    side = lambda name: posted.select("t", F.col("label").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("chunk", "least", "most", "upto", "after")))
    met = met.join(side("one"), ["t", "one"]).join(side("two"), ["t", "two"])
    sizes_fit = (100 * F.col("most_one") >= share * F.col("least_two")) & (100 * F.col("most_two") >= share * F.col("least_one"))
    common = F.least("upto_one", "upto_two") + F.least("after_one", "after_two")
    met = met.filter(sizes_fit & ((100 + share) * common >= share * (F.col("least_one") + F.col("least_two"))))
    pairs = met.select(F.least("chunk_one", "chunk_two").alias("a"), F.greatest("chunk_one", "chunk_two").alias("b"))
    pairs = pairs.unionAll(posted.filter("label.mixed").select(F.col("chunk").alias("a"), F.col("chunk").alias("b"))).distinct()
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk")).join(own.select("chunk", "cid", "comp"), "chunk")
    return sides.join(texts, "cid").groupBy("a", "b").applyInPandas(_block(width, share), "u long, v long")


def linked_rows(docs: DataFrame, width: int = WIDTH, share: int = SHARE, key: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, key (a column of whole numbers without nulls), n, and root, the same for all rows of a component, null for rows without links."""
    buckets, batch_bytes = sizes(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sent = shingle_rows(docs, buckets, batch_bytes, width, key)
    answered = sent.groupBy("dest", F.when(F.col("dest") < 0, F.col("batch")).alias("own")).applyInPandas(lambda x: _count(x), "dest long, batch long, blob binary")
    rows = stored(answered.groupBy("batch").applyInPandas(_answer(share), "doc_id long, key long, n long, digest binary, a long, b long, centre double, prefix array<long>"))
    able = rows.filter("prefix IS NOT NULL")
    classes = able.groupBy("digest").agg(F.min(F.struct("a", "b")).alias("x"), F.first("n").alias("n"), F.max("centre").alias("centre"), F.first("prefix").alias("prefix"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "digest", "x.a", "x.b", "n", "centre", "prefix"))
    texts = class_texts(docs, classes)
    comps = F.coalesce("root", "cid").alias("comp")
    hubs = stored(hub_pairs(classes, share))
    found = components(verified(hubs, texts, width, share)).withColumnRenamed("node", "cid")
    first = stored(classes.select("cid").join(found, "cid", "left").select("cid", comps))
    of = lambda old, new: first.select(F.col("cid").alias(old), F.col("comp").alias(new))
    rest = open_links(classes, first, hubs, texts, width, share).join(of("u", "x"), "u").join(of("v", "y"), "v")
    more = components(rest.select(F.col("x").alias("u"), F.col("y").alias("v")))
    roots = first.join(more.withColumnRenamed("node", "comp"), "comp", "left").select("cid", F.coalesce("root", "comp").alias("root"))
    by_digest = stored(classes.select("cid", "digest").join(roots, "cid").select("digest", "root"))
    placed = able.select("doc_id", "key", "n", "digest").join(by_digest, "digest").select("doc_id", "key", "n", "root")
    return stored(placed.unionAll(rows.filter("prefix IS NULL").select("doc_id", "key", "n", F.lit(None).cast("long").alias("root"))))


def join(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Words are split at ASCII white space, A-Z in lower case. Null and empty texts have empty sets and link with nothing;
    with fewer than width words the whole sequence is the one shingle. Rows that share a doc_id count one by one. A null
    doc_id stays null and counts as larger than any: component_id is null only where all doc_ids of the component are.
    Other columns are not read; an empty table gives no rows. Links are verified on words; n_shingles counts by 64-bit hashes,
    and equal sets or texts are those of equal 128-bit hashes.
    """
    placed = linked_rows(docs, width, share)
    some = placed.filter("root IS NOT NULL")
    least = stored(some.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # so that a large component can be split in the join
    found = some.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionAll(placed.filter("root IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def least_rows(docs: DataFrame, key: str, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """(key, kept) per row of docs: kept is true for one row of each component, that of the smallest doc_id (null last), then key."""
    placed = linked_rows(docs, width, share, key)
    some = placed.filter("root IS NOT NULL")
    first = stored(some.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("least")))
    kept = some.join(first, "root").select("key", (F.col("key") == F.col("least")).alias("kept"))
    return kept.unionAll(placed.filter("root IS NULL").select("key", F.lit(True).alias("kept")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join() of every whole text."""
    return join(table(spark, sf_dir, "documents"))
