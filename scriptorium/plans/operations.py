"""Queries over sources, the whole gate, stores, answers, monitors and page images, with DuckDB SQL for the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import pii, text
from ..operators import gate, governance, images, metrics, retrieval, stores
from ..sources import readers
from ..streaming import streams
from .bridge import LINES, PAIRS, lines, ref_pairs, table
from .registry import query

_NAMES = """rel AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN printf('work%d', page_id % 7) WHEN 1 THEN printf('vol%d', page_id % 5) ELSE 'corpus' END AS doc_id FROM pages)"""


def _named(s, d) -> DataFrame:
    """Pages with file names of all three kinds: in a folder, with the document in the name, with neither."""
    n = F.col("page_id")
    rel = F.when(n % 3 == 0, F.format_string("work%d/scan_%d.png", n % 7, n)).when(n % 3 == 1, F.format_string("vol%d_p%04d.PNG", n % 5, n)).otherwise(F.format_string("scan%d.tif", n))
    return readers.with_ids(table(s, d, "pages").select("page_id", rel.alias("rel")))


@query(f"WITH {_NAMES} SELECT page_id, doc_id, page_id::INTEGER AS page_num, printf('%s_p%04d', doc_id, page_id) AS id FROM rel")
def page_paths(s, d):
    return _named(s, d).select("page_id", "doc_id", "page_num", "id")


@query(f"WITH {_NAMES} SELECT page_id, row_number() OVER (PARTITION BY doc_id ORDER BY printf('%s_p%04d', doc_id, page_id)) AS place FROM rel")
def page_order(s, d):
    """The place of each page in its document, by the order of id texts."""
    return governance.placed(_named(s, d).select("page_id", "doc_id", "id"), "doc_id", "id").select("page_id", "place")


@query(f"WITH {_NAMES} SELECT page_id, printf('out/%s/%s_p%04d.png', doc_id, doc_id, page_id) AS path FROM rel")
def processed_paths(s, d):
    return _named(s, d).select("page_id", governance.processed_path("out/", F.col("doc_id"), F.col("id")).alias("path"))


_AUDIT = LINES + r""",
    g0 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_idx) - 1 AS idx FROM lines),
    g1 AS (SELECT doc_id, page_id, idx, nfc_normalize(text) AS text, conf, (doc_id + idx) % 13 <> 0 AND (doc_id + idx) % 17 <> 0 AS known, doc_id % 5 AS kind, CASE idx % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 20 END AS dist FROM g0),
    audit AS (SELECT doc_id, page_id, idx, text, kind, dist, CASE WHEN NOT known THEN 'raw' WHEN kind = 0 AND idx % 4 <> 1 THEN 'gold' WHEN kind > 2 THEN 'raw' WHEN dist / (length(text) + dist) <= 0.15 THEN 'silver' ELSE 'raw' END AS tier,
      CASE WHEN NOT known THEN 'layout_provenance_mismatch' WHEN kind = 0 AND idx % 4 <> 1 THEN 'none' WHEN kind > 2 THEN 'reference_alignment_failed' WHEN dist / (length(text) + dist) <= 0.15 THEN 'none' ELSE 'cer_above_threshold' END AS reason,
      CASE WHEN NOT known OR kind > 2 THEN NULL WHEN kind = 0 AND idx % 4 <> 1 THEN 0.0 ELSE round(dist / (length(text) + dist), 9) END AS cer FROM g1)"""


def _regions(s, d) -> DataFrame:
    """Lines as transcribed regions, numbered on each page."""
    idx = F.row_number().over(Window.partitionBy("page_id").orderBy("line_idx")) - 1
    return lines(s, d).select("doc_id", "page_id", idx.alias("idx"), "text", "conf", F.array(F.lit(0), F.col("line_idx"), F.length("text"), F.lit(20)).alias("bbox"))


def _page_texts(regions: DataFrame, line: Column) -> DataFrame:
    pages = regions.select("doc_id", "page_id", "idx", line.alias("line")).groupBy("doc_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
    return pages.select("doc_id", "page_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def _audit(s, d) -> DataFrame:
    """The gate over all pages: some regions unknown or moved; gold texts with wrong lines, references with errors, too many lines, or none."""
    rows = _regions(s, d)
    odd = F.col("doc_id") + F.col("idx")
    layout = rows.filter(odd % 13 != 0).select(F.format_string("%s_r%03d", "page_id", "idx").alias("region_id"), F.when(odd % 17 == 0, F.array(F.lit(9999), F.lit(9999), F.lit(5), F.lit(5))).otherwise(F.col("bbox")).alias("bbox"))
    gold = _page_texts(rows.filter("doc_id % 5 = 0"), F.when(F.col("idx") % 4 == 1, F.concat("text", F.lit(" wrong"))).otherwise(F.col("text")))
    error = F.when(F.col("idx") % 3 == 0, "").when(F.col("idx") % 3 == 1, "x").otherwise("x" * 20)
    refs = _page_texts(rows.filter("doc_id % 5 < 4"), F.concat("text", error))
    refs = refs.withColumn("text", F.when(F.col("doc_id") % 5 == 3, F.concat("text", F.lit("\n" + "\n".join(f"extra {k}" for k in range(6))))).otherwise(F.col("text")))
    return gate.audit(rows, layout, gold.select("page_id", "text"), refs.select("page_id", "text"))


@query(f"WITH {_AUDIT} SELECT page_id, idx::BIGINT AS idx, tier, reason, cer FROM audit")
def gate_audit(s, d):
    return _audit(s, d).select("page_id", F.col("idx").cast("long").alias("idx"), F.col("evidence_tier").alias("tier"), F.coalesce("reject_reason", F.lit("none")).alias("reason"), F.round("cer", 9).alias("cer"))


@query(f"WITH {_AUDIT} SELECT printf('%s_l%03d', page_id, idx) AS id, regexp_extract(page_id, '^(.*)_p', 1) AS doc_id, md5(text) AS text_md5, page_id FROM audit WHERE tier <> 'raw'")
def accepted_chunks(s, d):
    return gate.accepted(_audit(s, d)).select("id", "doc_id", F.md5("text").alias("text_md5"), F.col("page_ids")[0].alias("page_id"))


@query(f"WITH {_AUDIT} SELECT count(*) AS n, count(*) FILTER (WHERE tier <> 'raw') AS n_accepted, count(DISTINCT page_id) FILTER (WHERE tier <> 'raw') AS n_pages, count(DISTINCT doc_id) FILTER (WHERE tier <> 'raw') AS n_docs, round(avg(cer), 9) AS mean_cer FROM audit")
def gate_summary(s, d):
    a = _audit(s, d).withColumn("doc_id", text.page_doc(F.col("page_id")))
    ok = F.col("accepted")
    return a.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_accepted"), F.countDistinct(F.when(ok, F.col("page_id"))).alias("n_pages"), F.countDistinct(F.when(ok, F.col("doc_id"))).alias("n_docs"), F.round(F.avg(F.round("cer", 9)), 9).alias("mean_cer"))


_GLUED = r"""list_filter(string_split_regex(regexp_replace(text, '\s+([।,;:.!?…—\-"''“”‘’)\]])', '\1', 'g'), '[\s\p{Z}]+'), lambda x: x <> '')"""


@query(f"WITH {_AUDIT}, w AS (SELECT page_id, idx, dist, len({_GLUED}) AS n FROM audit WHERE kind < 3) SELECT page_id, idx::BIGINT AS idx, round(CASE WHEN dist = 0 THEN 0 ELSE 1 END / n, 9)::DOUBLE AS wer FROM w")
def line_wer(s, d):
    """Word error rates of the lines whose page has a reference with as many lines."""
    rows = _regions(s, d).filter("doc_id % 5 < 3")
    error = F.when(F.col("idx") % 3 == 0, "").when(F.col("idx") % 3 == 1, "x").otherwise("x" * 20)
    h, r = text.wer_tokens(F.col("text")), text.wer_tokens(F.concat("text", error))
    return rows.select("page_id", F.col("idx").cast("long").alias("idx"), F.round(text.word_distance(h, r) / F.size(r), 9).alias("wer"))


_WORST = "SELECT md5(hyp) AS hyp, md5(ref) AS ref, round(cer, 9) AS cer, '{0}' AS kind FROM (SELECT hyp, ref, dist / length(ref) AS cer FROM pairs WHERE len(string_split(ref, ' ')) {1} ORDER BY cer DESC, hyp, ref LIMIT 5)"


@query(f"WITH {PAIRS} {_WORST.format('short', '<= 3')} UNION ALL {_WORST.format('long', '>= 5')}")
def worst_by_length(s, d):
    """The five worst error rates against references of up to three words, and of five and more; a top-k report."""
    p = ref_pairs(s, d).withColumn("cer", text.cer(F.col("hyp"), F.col("ref"))).withColumn("n", F.size(text.tokens(F.col("ref"))))
    worst = lambda kind, some: p.filter(some).orderBy(F.desc("cer"), "hyp", "ref").limit(5).select(F.md5("hyp").alias("hyp"), F.md5("ref").alias("ref"), F.round("cer", 9).alias("cer"), F.lit(kind).alias("kind"))
    return worst("short", F.col("n") <= 3).unionAll(worst("long", F.col("n") >= 5))


@query(f"WITH {LINES} SELECT DISTINCT page_id FROM lines WHERE doc_id IN (SELECT doc_id FROM labels)")
def gold_pages(s, d):
    return lines(s, d).join(table(s, d, "labels"), "doc_id", "left_semi").select("page_id").distinct()


@query("""SELECT doc_id, 'call [REDACTED_PHONE] or [REDACTED_EMAIL], no ' || lpad((doc_id % 10000000)::VARCHAR, 7, '0') || CASE doc_id % 3 WHEN 0 THEN ' id [REDACTED_PHONE]' WHEN 1 THEN ' +1 [REDACTED_EMAIL]' ELSE '' END AS text FROM documents""")
def pii_redact(s, d):
    """E-mail addresses, phone numbers and id numbers in a made text of each document; seven digits alone are none."""
    n = F.col("doc_id")
    made = F.concat(F.format_string("call +88 %010d or user%d@example%d.org, no %07d", n, n, n % 10, n % 10_000_000), F.when(n % 3 == 0, F.format_string(" id %09d", n)).when(n % 3 == 1, F.format_string(" +1 a.b+%d@x.yz", n)).otherwise(""))
    return table(s, d, "documents").select("doc_id", made.alias("text")).withColumn("text", pii.redact("text"))


@query("SELECT doc_id, printf('doc%09d_p0001', doc_id) AS id, 'ask [REDACTED_EMAIL]' AS query, 'see [REDACTED_PHONE]' AS seen, '[REDACTED_EMAIL]' AS note FROM documents")
def pii_nested(s, d):
    """Texts inside structs, arrays and maps are redacted, ids stay as they are."""
    n = F.col("doc_id")
    rows = table(s, d, "documents").select(
        "doc_id", F.format_string("doc%09d_p0001", n).alias("id"),
        F.struct(F.format_string("ask q%d@example.com", n).alias("query"), F.array(F.struct(F.format_string("see %010d", n).alias("text"))).alias("obs")).alias("step"),
        F.create_map(F.lit("note"), F.format_string("m%d@example.org", n)).alias("notes"),
    )
    out = pii.scrub(rows, "step", "notes")
    return out.select("doc_id", "id", "step.query", F.col("step.obs")[0]["text"].alias("seen"), F.col("notes")["note"].alias("note"))


@query("SELECT conv_id, turn, count(*) OVER w AS steps, sum(length(text)) OVER w AS spent, count(*) OVER w > 3 AS over_steps, sum(length(text)) OVER w > 400 AS over_budget FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)")
def trace_limits(s, d):
    steps = table(s, d, "conversations").withColumn("cost", F.length("text").cast("decimal(38,0)"))
    out = governance.limits(steps, "conv_id", ["turn", "role", "text"], "cost", replace(DEFAULT, max_steps=3, budget=400))
    return out.select("conv_id", "turn", "steps", F.col("spent").cast("long").alias("spent"), "over_steps", "over_budget")


@query(f"""WITH {LINES}, a AS (SELECT DISTINCT doc_id AS answer_id FROM documents), c AS (SELECT answer_id, 'doc' || answer_id || '_p0001_l00' || j AS c FROM a, range(3) r(j)),
    k AS (SELECT answer_id, count(*) AS n, count(lines.chunk_id) AS known FROM c LEFT JOIN lines ON c = chunk_id GROUP BY 1)
    SELECT answer_id, CASE WHEN n = known THEN 'answer ' || answer_id ELSE 'not found in the corpus' END AS text, CASE WHEN n = known THEN n ELSE 0 END AS n_citations, n = known AS grounded, round(known / n, 9) AS confidence FROM k""")
def answers(s, d):
    ids = table(s, d, "documents").select(F.col("doc_id").alias("answer_id")).distinct()
    ids = ids.withColumn("citations", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.concat(F.lit("doc"), F.col("answer_id"), F.lit("_p0001_l00"), j.cast("string"))))
    known = governance.grounded(ids, lines(s, d).select("chunk_id")).select("answer_id", "n_known")
    made = ids.join(known, "answer_id").withColumn("a", governance.format_answer(F.concat(F.lit("answer "), F.col("answer_id")), F.col("citations"), F.col("n_known")))
    return made.select("answer_id", "a.text", F.size("a.citations").cast("long").alias("n_citations"), "a.grounded", F.round("a.confidence", 9).alias("confidence"))


@query("SELECT doc_id, round(len(list_intersect(c, g)) / len(list_distinct(c)), 9) AS accuracy FROM (SELECT doc_id, [doc_id % 5, doc_id % 7, 3] AS c, [doc_id % 5, 3] AS g FROM documents)")
def citation_accuracy(s, d):
    n = F.col("doc_id")
    cited, gold = F.array(n % 5, n % 7, F.lit(3).cast("long")), F.array(n % 5, F.lit(3).cast("long"))
    return table(s, d, "documents").select("doc_id", F.round(metrics.citation_accuracy(cited, gold), 9).alias("accuracy"))


_TOKENS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[\s\p{{Z}}]+'), lambda x: x <> ''))"


@query(f"""WITH a AS (SELECT item_id, text AS gold, CASE WHEN item_id % 4 < 2 THEN text ELSE left(text, length(text) // 3) END AS answer FROM benchmark),
    j AS (SELECT *, len(list_intersect({_TOKENS.format('gold')}, {_TOKENS.format('answer')})) / len({_TOKENS.format('gold')}) AS score FROM a)
    SELECT item_id, round(score, 9) AS score, CASE WHEN item_id % 2 = 0 THEN item_id % 4 < 2 ELSE score >= 0.5 END AS passed FROM j""")
def task_check(s, d):
    """Verifiable tasks by the exact answer, the others by a judged score."""
    answer = F.when(F.col("item_id") % 4 < 2, F.col("text")).otherwise(F.expr("left(text, length(text) div 3)"))
    rows = table(s, d, "benchmark").select("item_id", "text", answer.alias("answer"))
    return rows.select("item_id", F.round(metrics.judge(F.col("answer"), F.col("text")), 9).alias("score"), metrics.check(F.col("item_id") % 2 == 0, F.col("answer"), F.col("text")).alias("passed"))


@query("""WITH b AS (SELECT greatest(least(floor(value / 100 * 10), 9), 0) AS bin, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM events WHERE value IS NOT NULL GROUP BY 1),
    t AS (SELECT greatest(a / (SELECT sum(a) FROM b), 1e-6) AS p, greatest(b / (SELECT sum(b) FROM b), 1e-6) AS q FROM b), x AS (SELECT round(sum((q - p) * ln(q / p)), 9) AS psi FROM t),
    y AS (SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1) SELECT event_type, psi, p95, psi > 0.2 OR p95 > 300 AS retrain FROM x, y""")
def retrain_trigger(s, d):
    e = table(s, d, "events")
    drift = metrics.psi(e, "value", F.col("event_id") % 2, 0.0, 100.0)
    slow = metrics.exact_percentile(e, "event_type", "value", 0.95).select("event_type", F.round("p", 6).alias("p95"))
    return slow.crossJoin(F.broadcast(drift)).select("event_type", "psi", "p95", metrics.retrain(F.col("psi"), F.col("p95") <= 300).alias("retrain"))


@query("WITH m AS (SELECT avg(quality) FILTER (WHERE lang = 'en') AS i, avg(quality) FILTER (WHERE lang <> 'en') AS o FROM labels JOIN documents USING (doc_id)) SELECT round(i, 9) AS inside, round(o, 9) AS outside, round((i - o) / i, 9) AS \"drop\" FROM m")
def robustness_drop(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.robustness(rows, "quality", F.col("lang") == "en")


@query(r"WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda x: x <> '')) AS n FROM documents) SELECT count(*) FILTER (WHERE doc_id % 10 = 0) AS drawn, count(*) AS n, round(avg(n) FILTER (WHERE doc_id % 10 = 0) * count(*), 3) AS words FROM w")
def estimated_words(s, d):
    return governance.estimated_words(table(s, d, "documents"))


_PART = "CASE WHEN (doc_id * 7919 + 104729) % 100 < 15 THEN 'test' WHEN (doc_id * 7919 + 104729) % 100 < 35 THEN 'val' ELSE 'train' END"


@query(rf"WITH t AS (SELECT DISTINCT {_PART} AS part, unnest(list_filter(string_split_regex(text, '[\s\p{{Z}}]+'), lambda x: x <> '')) AS t FROM documents), n AS (SELECT t, count(*) AS parts FROM t GROUP BY 1) SELECT count(*) AS n_tokens, count(*) FILTER (WHERE parts > 1) AS n_shared FROM n")
def shared_tokens(s, d):
    return governance.shared_tokens(table(s, d, "documents"), governance.split(F.col("doc_id")))


@query("WITH a AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 1) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b")
def set_difference(s, d):
    """How many rows of two multisets the other one lacks."""
    e = table(s, d, "events")
    a, b = (e.filter(F.col("event_id") % 2 == k).select("user_id", "event_type") for k in (0, 1))
    only = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return only(a, b, "only_a").crossJoin(F.broadcast(only(b, a, "only_b")))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def file_manifest(s, d):
    files = table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return governance.manifest(files).select(F.col("path").cast("long").alias("doc_id"), "sha256", "size")


_VERSION = "left(sha256(event_type || '|' || 'm/' || (user_id % 3) || '|' || '{\"metrics\":{\"score\":' || (event_id % 10) || '}}'), 12)"


@query(f"SELECT component, version, ts FROM (SELECT event_type AS component, {_VERSION} AS version, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def model_versions(s, d):
    """The newest registered version of each component."""
    rows = table(s, d, "events").select(F.col("event_type").alias("component"), F.concat(F.lit("m/"), F.col("user_id") % 3).alias("path"), F.struct((F.col("event_id") % 10).alias("score")).alias("metrics"), "ts", "event_id")
    newest = stores.latest(stores.versioned(rows).withColumn("o", F.struct("ts", "event_id")).select("component", "version", "ts", "o"), "component", "o")
    return newest.select("component", "version", "ts")


@query("SELECT user_id AS key, value FROM (SELECT user_id, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def cache_latest(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("o"), F.col("event_type").alias("value"))
    return stores.latest(rows, "key", "o").select("key", "value")


@query("SELECT user_id AS client, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2 HAVING count(*) > 1")
def authorized_rates(s, d):
    """Known clients that ask more than once an hour."""
    e = table(s, d, "events").select(F.col("user_id").alias("client"), "ts")
    return governance.rate_limited(governance.authorized(e, e.filter("client % 3 = 0").select("client")), "client", "ts", 1)


_LEXICON = ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove")


@query(f"WITH w AS (SELECT {list(_LEXICON)!r} AS w) SELECT id, array_to_string(list_transform(range(6), lambda j: w[((id * 31 + j * 17 + id * j) % {len(_LEXICON)} + 1)::INTEGER]), ' ') AS text FROM range(1000) r(id), w")
def synthetic_lines(s, d):
    return governance.text_lines(s, 1000, list(_LEXICON))


@query("WITH p AS (SELECT page_id, ((page_id * 7) % 20) / 3072.0 AS ink_ratio FROM pages) SELECT page_id, round(ink_ratio, 9)::DOUBLE AS ink_ratio FROM p WHERE ink_ratio >= 0.002")
def ink_filter(s, d):
    """Pages of 64 by 48 pixels with 0 to 19 black ones; blank ones go."""
    k = (F.col("page_id") * 7 % 20).cast("int")
    pages = table(s, d, "pages").select("page_id", F.lit(64).alias("width"), F.lit(48).alias("height"), F.unhex(F.concat(F.repeat(F.lit("00"), k), F.repeat(F.lit("FF"), 3072 - k))).alias("pixels"))
    return images.not_blank(images.ink(pages)).select("page_id", F.round("ink_ratio", 9).alias("ink_ratio"))


def _gray(s, d) -> DataFrame:
    """Pages of 64 by 48 pixels, by arithmetic on page and place."""
    pixel = lambda j: F.pmod(F.col("page_id") * 31 + j * 17 + F.pmod(j * j, F.col("page_id") % 7 + 2) * 40, F.lit(256))
    pixels = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3071).cast("long")), lambda j: F.lpad(F.hex(pixel(j)), 2, "0")), "")
    return table(s, d, "pages").select("page_id", F.lit(64).alias("width"), F.lit(48).alias("height"), F.unhex(pixels).alias("pixels"))


def _at(x: str, y: str) -> str:
    j = f"(({y}) * 64 + ({x}))"
    return f"(page_id * 31 + {j} * 17 + ({j} * {j}) % (page_id % 7 + 2) * 40) % 256"


_LEFT, _RIGHT, _UP, _DOWN = "abs(x - 1)", "CASE WHEN x = 63 THEN 62 ELSE x + 1 END", "abs(y - 1)", "CASE WHEN y = 47 THEN 46 ELSE y + 1 END"
_PIXELS = f"""px AS (SELECT page_id, j % 64 AS x, j // 64 AS y FROM pages, range(3072) r(j)),
    near AS (SELECT page_id, {_at('x', 'y')} AS v, {_at(_LEFT, 'y')} + {_at(_RIGHT, 'y')} + {_at('x', _UP)} + {_at('x', _DOWN)} AS around FROM px),
    stats AS (SELECT page_id, avg(v) AS brightness, stddev_pop(v) AS contrast, var_pop(around - 4 * v) AS edge_variance FROM near GROUP BY 1),
    h AS (SELECT page_id, v, count(*) AS n FROM near GROUP BY 1, 2), c AS (SELECT page_id, v, (sum(n) OVER w)::DOUBLE AS lo, (sum(n * v) OVER w)::DOUBLE AS m, (sum(n * v) OVER (PARTITION BY page_id))::DOUBLE AS mt FROM h WINDOW w AS (PARTITION BY page_id ORDER BY v)),
    o AS (SELECT page_id, v, CASE WHEN lo = 3072 THEN 0 ELSE lo * (3072 - lo) * pow(m / lo - (mt - m) / (3072 - lo), 2) END AS between_classes FROM c), t AS (SELECT page_id, arg_max(v, (between_classes, -v)) AS threshold FROM o GROUP BY 1)"""


@query(f"WITH {_PIXELS} SELECT page_id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(edge_variance, 4) AS edge_variance, edge_variance > 500 AS noisy, threshold::BIGINT AS threshold FROM stats JOIN t USING (page_id)")
def image_quality(s, d):
    """Brightness, contrast, edges, noise and the threshold of greatest between-class variance of every page."""
    q = images.quality(_gray(s, d))
    return q.select("page_id", F.round("brightness", 6).alias("brightness"), F.round("contrast", 6).alias("contrast"), F.round("edge_variance", 4).alias("edge_variance"), "noisy", F.col("threshold").cast("long").alias("threshold"))


_BYTES = """b AS (SELECT page_id, hex(encode(html)) AS h, strlen(html) AS n, (strlen(html) + 63) // 64 AS n_rows FROM pages WHERE strlen(html) > 64),
    bj AS (SELECT *, unnest(range(64 * n_rows)) AS j FROM b), px AS (SELECT page_id, j, CASE WHEN j < n THEN ('0x' || substr(h, 2 * j + 1, 2))::INTEGER ELSE 255 END AS v FROM bj),
    nb AS (SELECT page_id, j, v, lag(v) OVER w AS l, lead(v) OVER w AS r, lag(v, 64) OVER w AS u, lead(v, 64) OVER w AS d FROM px WINDOW w AS (PARTITION BY page_id ORDER BY j)),
    near AS (SELECT page_id, v, CASE WHEN j % 64 = 0 THEN r ELSE l END + CASE WHEN j % 64 = 63 THEN l ELSE r END + coalesce(u, d) + coalesce(d, u) AS around FROM nb),
    stats AS (SELECT page_id, avg(v) AS brightness, stddev_pop(v) AS contrast, var_pop(around - 4 * v) AS edge_variance FROM near GROUP BY 1),
    h AS (SELECT page_id, v, count(*) AS n FROM near GROUP BY 1, 2), c AS (SELECT page_id, v, (sum(n) OVER w)::DOUBLE AS lo, (sum(n * v) OVER w)::DOUBLE AS m, (sum(n) OVER (PARTITION BY page_id))::DOUBLE AS nt, (sum(n * v) OVER (PARTITION BY page_id))::DOUBLE AS mt FROM h WINDOW w AS (PARTITION BY page_id ORDER BY v)),
    o AS (SELECT page_id, v, CASE WHEN lo = nt THEN 0 ELSE lo * (nt - lo) * pow(m / lo - (mt - m) / (nt - lo), 2) END AS between_classes FROM c), t AS (SELECT page_id, arg_max(v, (between_classes, -v)) AS threshold FROM o GROUP BY 1)"""


@query(f"WITH {_BYTES} SELECT page_id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(edge_variance + 1e-7, 4) AS edge_variance, edge_variance > 500 AS noisy, threshold::BIGINT AS threshold FROM stats JOIN t USING (page_id)")
def page_bytes_quality(s, d):
    """The same figures of every raw page: its bytes as gray pixels, 64 to a row, the last row filled up with white (1e-7 keeps halves from rounding either way)."""
    raw = table(s, d, "pages").filter(F.octet_length("html") > 64).select("page_id", F.col("html").cast("binary").alias("raw"))
    rows = F.ceil(F.octet_length("raw") / 64).cast("int")
    white = F.unhex(F.repeat(F.lit("FF"), F.pmod(-F.octet_length("raw"), F.lit(64))))
    q = images.quality(raw.select("page_id", F.lit(64).alias("width"), rows.alias("height"), F.concat("raw", white).alias("pixels")))
    return q.select("page_id", F.round("brightness", 6).alias("brightness"), F.round("contrast", 6).alias("contrast"), F.round(F.col("edge_variance") + 1e-7, 4).alias("edge_variance"), "noisy", F.col("threshold").cast("long").alias("threshold"))


@query()
def cleaned_pages(s, d):
    """Made pages with lines of text through the whole image stage: deskewed, denoised, binarised, blank ones dropped."""
    drawn = bytes(10 + j % 3 if j // 64 % 8 < 3 and 4 <= j % 64 <= 59 else 245 for j in range(3072))
    pixels = F.when(F.col("page_id") % 4 == 0, F.lit(bytes([245] * 3072))).otherwise(F.lit(drawn))
    pages = table(s, d, "pages").select("page_id", F.lit(64).alias("width"), F.lit(48).alias("height"), pixels.alias("pixels"))
    return images.cleaned(pages).select("page_id", F.round("ink_ratio", 6).alias("ink_ratio"), F.sha2("png", 256).alias("png_sha256"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def user_sessions(s, d):
    return streams.sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("""SELECT make_timestamp((epoch_us(ts) // 21600000000 - k) * 21600000000) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events, range(4) r(k) GROUP BY 1, 2""")
def sliding_monitor(s, d):
    return streams.sliding(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
