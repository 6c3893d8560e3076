"""Queries of samples, reviews, diagnostics, filing texts and sample contracts, each beside the SQL for the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import enrich, events, filing_text, items, lexicon, links, market, regress, review, sampling, scores
from ..scratch import scratch_path
from ..sources import readers
from .composite_queries import _feeds
from .registry import query, rounded, table, text_date
from .suite_queries import _PANEL, _panel

# Samples


@query("""
WITH c AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT *, 200.0 * n / sum(n) OVER () AS x FROM c),
r AS (SELECT *, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, n DESC, p) <= 200 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM t)
SELECT o.o_orderpriority AS p, o.o_orderkey AS k, o.rk AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('11|' || o_orderkey)) AS rk FROM orders) o JOIN r ON o.o_orderpriority = r.p WHERE o.rk <= r.quota
""")
def proportional_sample(spark, sf):
    """A sample of 200 orders shared over strata by size (the sample is the feature)."""
    o = table(spark, sf, "orders")
    out = sampling.quota_sample(o, ["o_orderpriority"], sampling.allocate(o, ["o_orderpriority"], 200), 11, ["o_orderkey"])
    return out.select(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("k"), F.col("stratum_rank").cast("long").alias("place"))


@query("SELECT p, k, rk AS place FROM (SELECT o_orderpriority AS p, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('11|' || o_orderkey)) AS rk FROM orders) WHERE rk <= 12")
def balanced_nested_sample(spark, sf):
    """Equal quotas, and the nested part of a larger sample."""
    o = table(spark, sf, "orders")
    large = sampling.quota_sample(o, ["o_orderpriority"], sampling.allocate(o, ["o_orderpriority"], 200, balanced=True), 11, ["o_orderkey"])
    quotas = o.select("o_orderpriority").distinct().withColumn("quota", F.lit(12))
    out = sampling.nested_sample(large, ["o_orderpriority"], quotas)
    return out.select(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("k"), F.col("stratum_rank").cast("long").alias("place"))


@query("""
WITH q AS (SELECT o_orderkey AS k, floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 4 / count(*) OVER ()) + 1 AS quartile FROM orders)
SELECT CAST(quartile AS BIGINT) AS quartile, k FROM (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY sha256('3|' || k)) AS rk FROM q) WHERE rk <= 25
""")
def quartile_sample(spark, sf):
    """25 orders from each quarter by price."""
    out = sampling.quartile_sample(table(spark, sf, "orders"), "o_totalprice", ["o_orderkey"], 25, 3)
    return out.select(F.col("quartile").cast("long").alias("quartile"), F.col("o_orderkey").alias("k"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY sha256('5|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(l_quantity AS BIGINT)) LIMIT 100")
def uniform_sample(spark, sf):
    """Exactly 100 rows, the same on every run."""
    x = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return sampling.uniform_sample(x, 100, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q"], 5).select("l_orderkey", "l_linenumber", "l_partkey")


@query("WITH c AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS scopes FROM orders GROUP BY 1) SELECT k, scopes, row_number() OVER (ORDER BY scopes DESC, sha256('9|' || k)) AS place FROM c ORDER BY scopes DESC, sha256('9|' || k) LIMIT 40")
def covering_sample(spark, sf):
    """The 40 customers that cover most priorities."""
    out = sampling.covering_sample(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 40, 9)
    return out.select(F.col("o_custkey").alias("k"), "scopes", F.col("place").cast("long").alias("place"))


@query("SELECT event_type, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sha256('4|' || event_id)) AS place FROM events WHERE value >= 120) WHERE place <= 15")
def example_pack(spark, sf):
    """High-scoring examples of each kind by a stable key."""
    out = sampling.example_pack(table(spark, sf, "events"), ["event_type"], "value", 120, 15, ["event_id"], 4)
    return out.select("event_type", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def first_n_per_group(spark, sf):
    """Two largest orders of each customer and year."""
    out = sampling.first_n(table(spark, sf, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey", "y"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2)
    return out.select("o_custkey", "o_orderkey")


@query("SELECT conv_id, turn, length(text) AS chars FROM conversations ORDER BY length(text) DESC, conv_id, turn LIMIT 20")
def longest_texts(spark, sf):
    """The 20 longest turns."""
    c = table(spark, sf, "conversations").withColumn("chars", F.length("text").cast("long"))
    return c.orderBy(F.desc("chars"), "conv_id", "turn").limit(20).select("conv_id", "turn", "chars")


# Reviews


@query(r"""
WITH s AS (SELECT conv_id, role, text FROM conversations WHERE text IS NOT NULL), f AS (SELECT role, length(text) < 10 AS a, length(text) > 1500 AS b, regexp_matches(text, '^[a-z,;:)\]]') AS c, NOT regexp_matches(text, '\p{L}') AS d, len(regexp_extract_all(text, '[0-9]')) * 2 > length(text) AS e,
regexp_matches(text, '^[(\[]?(see|cf|id|note|item|section|part)\b.{0,25}$', 'i') AS g FROM s)
SELECT role, count(*) AS sentences, count(*) FILTER (WHERE a) AS very_short, count(*) FILTER (WHERE b) AS very_long, count(*) FILTER (WHERE c) AS starts_low, count(*) FILTER (WHERE d) AS no_letters, round(count(*) FILTER (WHERE a OR b OR c OR d OR e OR g) / count(*), 8) AS flagged_share FROM f GROUP BY 1
""")
def split_quality(spark, sf):
    """Flags of turns, as if a splitter had given them, by role."""
    out = review.split_quality(table(spark, sf, "conversations").filter("text is not null"), ["role"], "text")
    return out.select("role", "sentences", "very_short", "very_long", "starts_low", "no_letters", rounded("flagged_share", 8).alias("flagged_share"))


@query("""
SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 4) AS p50, round(quantile_cont(length(text), 0.9), 4) AS p90, max(length(text)) AS longest, round(count(*) FILTER (WHERE length(text) > 128) / count(*), 8) AS over_128, round(count(*) FILTER (WHERE length(text) > 512) / count(*), 8) AS over_512 FROM conversations GROUP BY 1
""")
def length_summary(spark, sf):
    """Lengths of turns by role, and the share over model limits."""
    out = review.length_summary(table(spark, sf, "conversations").withColumn("n_chars", F.length("text").cast("long")), ["role"], "n_chars")
    return out.select("role", "n", rounded("mean").alias("mean"), rounded("p50", 4).alias("p50"), rounded("p90", 4).alias("p90"), "longest", rounded("over_128", 8).alias("over_128"), rounded("over_512", 8).alias("over_512"))


@query("""
WITH w AS (SELECT count(*) FILTER (WHERE length(text) <= 128) / count(*) AS a, count(*) FILTER (WHERE length(text) <= 256) / count(*) AS b, count(*) FILTER (WHERE length(text) <= 512) / count(*) AS c, count(*) FILTER (WHERE length(text) <= 1024) / count(*) AS d FROM conversations)
SELECT CASE WHEN a >= 0.8 THEN 128 WHEN b >= 0.8 THEN 256 WHEN c >= 0.8 THEN 512 ELSE 1024 END::BIGINT AS recommended, round(a, 8) AS within_128, round(c, 8) AS within_512 FROM w
""")
def recommended_limit(spark, sf):
    """The least limit that holds four fifths of the turns."""
    out = review.recommend_limit(table(spark, sf, "conversations").withColumn("n_chars", F.length("text")), "n_chars", (128, 256, 512, 1024), 0.8)
    return out.select("recommended", rounded("within_128", 8).alias("within_128"), rounded("within_512", 8).alias("within_512"))


_GOLD = "WITH x AS (SELECT quality AS g, CASE WHEN length(text) > 400 THEN 1 ELSE 0 END AS p, 1.0 + d.doc_id % 3 AS w FROM documents d LEFT JOIN labels l USING (doc_id))"


def _gold(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select(F.col("quality").alias("g"), F.when(F.length("text") > 400, 1).otherwise(0).alias("p"), (1.0 + F.col("doc_id") % 3).alias("w"))


@query(_GOLD + """, y AS (SELECT CAST(g AS VARCHAR) AS g, CAST(p AS VARCHAR) AS p, w FROM x WHERE g IS NOT NULL), l AS (SELECT DISTINCT unnest([g, p]) AS label FROM y), s AS (SELECT label, sum(CASE WHEN g = label AND p = label THEN w ELSE 0 END) AS tp, sum(CASE WHEN g = label THEN w ELSE 0 END) AS support, sum(CASE WHEN p = label THEN w ELSE 0 END) AS named FROM l, y GROUP BY 1)
SELECT label, CAST(support AS DOUBLE) AS support, round(CASE WHEN named > 0 THEN tp / named END, 8) AS "precision", round(CASE WHEN support > 0 THEN tp / support END, 8) AS recall, round(2 * tp / (support + named), 8) AS f1 FROM s""")
def confusion_review(spark, sf):
    """Weighted precision and recall of a length rule against gold labels."""
    out = review.confusion(_gold(spark, sf).filter("g is not null"), "g", "p", "w")
    return out.select("label", "support", rounded("precision", 8).alias("precision"), rounded("recall", 8).alias("recall"), rounded("f1", 8).alias("f1"))


@query(_GOLD + " SELECT count(*) AS rows, count(g) AS labelled, round(count(*) FILTER (WHERE g = p) / count(g), 8) AS accuracy, round(count(*) FILTER (WHERE g = p) / count(*), 8) AS lower, round((count(*) FILTER (WHERE g = p) + count(*) - count(g)) / count(*), 8) AS upper FROM x")
def accuracy_bounds(spark, sf):
    """Accuracy over labelled documents and what it could be over all."""
    out = review.accuracy_bounds(_gold(spark, sf), "g", "p")
    return out.select("rows", "labelled", *[rounded(c, 8).alias(c) for c in ("accuracy", "lower", "upper")])


@query("""
WITH t AS (SELECT conv_id, turn, length(text) // 4 AS n FROM conversations), u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM t)
SELECT conv_id, count(*) AS sentences, count(*) FILTER (WHERE upto <= 126) AS visible_sentences, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(greatest(0, least(n, 126 - (upto - n)))) AS BIGINT) AS visible_tokens, sum(greatest(0, least(n, 126 - (upto - n)))) < sum(n) AS truncated FROM u GROUP BY 1
""")
def visible_prefix(spark, sf):
    """What a model of 128 tokens sees of each conversation."""
    c = table(spark, sf, "conversations").withColumn("n", F.floor(F.length("text") / 4).cast("long"))
    out = review.visible_prefix(c, ["conv_id"], "turn", "n", 128)
    return out.select("conv_id", "sentences", "visible_sentences", "tokens", F.col("visible_tokens").cast("long").alias("visible_tokens"), "truncated")


@query("WITH t AS (SELECT n_chars AS n FROM documents), f(floor) AS (VALUES (100), (500), (2000)) SELECT floor, count(*) FILTER (WHERE n >= floor) AS kept, round(count(*) FILTER (WHERE n >= floor) / count(*), 8) AS share, CAST(sum(CASE WHEN n >= floor THEN n ELSE 0 END) AS BIGINT) AS tokens FROM t, f GROUP BY 1")
def floor_sweep(spark, sf):
    """Documents kept under several least lengths."""
    out = review.floor_sweep(table(spark, sf, "documents"), "n_chars", (100, 500, 2000))
    return out.select("floor", "kept", rounded("share", 8).alias("share"), "tokens")


@query("""
WITH s AS (SELECT doc_id AS k, 'documents' AS s FROM documents UNION SELECT doc_id, 'labels' FROM labels UNION SELECT page_id, 'pages' FROM pages), h AS (SELECT k, list(s) AS s FROM s GROUP BY 1),
p(a, b) AS (VALUES ('documents', 'labels'), ('documents', 'pages'), ('labels', 'pages')) SELECT a, b, count(*) FILTER (WHERE list_contains(s, a) AND list_contains(s, b)) AS both, count(*) FILTER (WHERE list_contains(s, a) AND NOT list_contains(s, b)) AS only_a, count(*) FILTER (WHERE NOT list_contains(s, a) AND list_contains(s, b)) AS only_b FROM h, p GROUP BY 1, 2
""")
def surface_audit(spark, sf):
    """Keys that tables share and lack, pair by pair."""
    return review.surface_audit({"documents": table(spark, sf, "documents").select("doc_id"), "labels": table(spark, sf, "labels").select("doc_id"), "pages": table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))}, "doc_id")


@query("""
WITH p AS (SELECT l_returnflag AS f, l_suppkey, count(*) AS n, avg(l_quantity) AS q, avg(CASE WHEN l_suppkey % 3 > 0 THEN l_tax END) AS t FROM lineitem GROUP BY 1, 2)
SELECT coalesce(f, 'TOTAL') AS f, CAST(sum(n) AS BIGINT) AS n, round(sum(q * n) / sum(n), 8) AS q, round(sum(t * n) / sum(CASE WHEN t IS NOT NULL THEN n END), 8) AS t FROM p GROUP BY ROLLUP (f)
""")
def recombined_means(spark, sf):
    """Means of parts put together by their counts, with a total."""
    p = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("f"), "l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"), F.avg(F.when(F.col("l_suppkey") % 3 > 0, F.col("l_tax"))).alias("t"))
    out = review.recombined_means(p, "f", "n", ["q", "t"])
    return out.select("f", "n", rounded("q", 8).alias("q"), rounded("t", 8).alias("t"))


@query("""
WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'A' || (o_custkey % 3) END AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'A' || (o_custkey % 2) END AS b FROM orders)
SELECT k, len(list_distinct(list_filter([nullif(trim(a), ''), nullif(trim(b), '')], lambda v: v IS NOT NULL))) AS successes, nullif(trim(a), '') = nullif(trim(b), '') AS same FROM x
""")
def lookup_successes(spark, sf):
    """Unlike successful look-ups of each row, and whether they agree."""
    x = _lookups(spark, sf)
    return x.select("k", review.distinct_successes("a", "b").cast("long").alias("successes"), review.same_value("a", "b").alias("same"))


def _lookups(spark, sf):
    k = F.col("o_orderkey")
    a = F.when(k % 3 == 0, None).when(k % 5 == 0, " ").otherwise(F.concat(F.lit("A"), F.col("o_custkey") % 3))
    return table(spark, sf, "orders").select(k.alias("k"), a.alias("a"), F.when(k % 2 == 0, F.concat(F.lit("A"), F.col("o_custkey") % 2)).alias("b"), F.col("o_orderpriority").alias("p"))


_LOOK = "WITH x AS (SELECT o_orderpriority AS p, nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'A' || (o_custkey % 3) END), '') AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'A' || (o_custkey % 2) END AS b FROM orders)"


@query(_LOOK + " SELECT p, count(*) AS rows, count(a) AS a_found, count(b) AS b_found, count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS failed, count(*) FILTER (WHERE coalesce(a, b) IS NOT NULL AND coalesce(a = b, true)) AS agreed, count(*) FILTER (WHERE a <> b) AS differ FROM x GROUP BY 1")
def lookup_diagnostics(spark, sf):
    """Successes and agreement of look-ups by group."""
    return enrich.lookup_diagnostics(_lookups(spark, sf), ["a", "b"], ["p"])


@query(_LOOK + " SELECT 'a' AS a, 'b' AS b, count(*) FILTER (WHERE x.a IS NOT NULL AND x.b IS NOT NULL) AS both, count(*) FILTER (WHERE x.a = x.b) AS agree FROM x")
def pairwise_lookups(spark, sf):
    return enrich.pairwise_comparison(_lookups(spark, sf), ["a", "b"])


@query("SELECT 'orders' AS t, count(DISTINCT o_custkey) + max(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) * 0 AS plain, count(DISTINCT CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END) + 1 AS with_null FROM orders")
def distinct_counts(spark, sf):
    """Distinct values with null counting as one."""
    o = table(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")))
    return o.agg(F.lit("orders").alias("t"), review.distinct_with_null("o_custkey").alias("plain"), review.distinct_with_null("p").alias("with_null"))


# Sections, scopes and boundaries

_ITEMS = """
WITH i AS (SELECT doc_id, ['1', '1A', '7', '9'][CAST(doc_id % 4 AS INTEGER) + 1] AS item, CASE WHEN doc_id % 5 = 0 THEN 'reserved' ELSE 'active' END AS st, CASE WHEN doc_id % 7 > 0 THEN doc_id % 6 > 0 END AS ex, ['10-K', '10-Q', '10-K'][CAST(doc_id % 3 AS INTEGER) + 1] AS form, text, source FROM documents)
"""


def _items(spark, sf):
    k = F.col("doc_id")
    of = lambda v, names: F.element_at(F.array(*[F.lit(x) for x in names]), (v + 1).cast("int"))
    return table(spark, sf, "documents").select(
        k.alias("doc_id"), of(k % 4, ("1", "1A", "7", "9")).alias("item_id"), F.when(k % 5 == 0, "reserved").otherwise("active").alias("item_status"), F.when(k % 7 > 0, k % 6 > 0).alias("exists_by_regime"), of(k % 3, ("10-K", "10-Q", "10-K")).alias("form"),
        F.col("text").alias("full_text"), "source",
    )


@query(_ITEMS + "SELECT doc_id, item, length(text) AS n_chars FROM i WHERE st = 'active' AND ex AND form = '10-K' AND item IN ('1', '1A', '7') AND length(text) >= 250")
def section_universe(spark, sf):
    """Sections that may be scored: active, in force, of the form and long enough."""
    out = review.section_universe(_items(spark, sf), ["10-K"], ["1", "1A", "7"], 250)
    return out.select("doc_id", F.col("item_id").alias("item"), F.col("n_chars").cast("long").alias("n_chars"))


@query(_ITEMS + r""", f AS (SELECT item, length(coalesce(text, '')) < 200 AS a, length(coalesce(text, '')) > 0 AND NOT regexp_matches(rtrim(coalesce(text, ''), ' '), '[.!?:;")\]]$') AS b, regexp_matches(coalesce(text, ''), '^\s*[a-z]') AS c FROM i)
SELECT item, count(*) AS items, count(*) FILTER (WHERE a) AS short, count(*) FILTER (WHERE b) AS ends_open, count(*) FILTER (WHERE c) AS starts_low FROM f GROUP BY 1""")
def boundary_diagnostics(spark, sf):
    """Items whose bounds look wrong, by item."""
    out = review.boundary_diagnostics(_items(spark, sf), ["item_id"])
    return out.select(F.col("item_id").alias("item"), "items", "short", "ends_open", "starts_low")


@query(_ITEMS + """, c AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS cleaned, doc_id % 11 = 0 AS stub, (doc_id % 10) / 10.0 AS removed, CASE WHEN doc_id % 13 = 0 THEN 'approved' WHEN doc_id % 13 = 1 THEN 'rejected' END AS review, ['trusted', 'unknown', 'review_needed', 'trusted', NULL][CAST(doc_id % 5 AS INTEGER) + 1] AS boundary FROM i),
d AS (SELECT *, CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'empty_input' WHEN length(cleaned) = 0 THEN 'empty_after_cleaning' WHEN stub THEN 'stub' END AS reason FROM c), a AS (SELECT *, reason IS NULL AND (length(cleaned) < 500 OR removed >= 0.4) AS cand FROM d),
s AS (SELECT *, CASE WHEN review IN ('approved', 'rejected') THEN review WHEN cand OR boundary IS NULL OR boundary IN ('unknown', 'review_needed') THEN 'required' ELSE 'not_required' END AS status FROM a)
SELECT item, count(*) AS rows, count(*) FILTER (WHERE reason = 'empty_input') AS empty_input, count(*) FILTER (WHERE reason = 'empty_after_cleaning') AS empty_after_cleaning, count(*) FILTER (WHERE reason = 'stub') AS stub, count(*) FILTER (WHERE cand) AS candidates, count(*) FILTER (WHERE reason IS NULL AND status IN ('not_required', 'approved')) AS eligible FROM s GROUP BY 1""")
def scope_audit(spark, sf):
    """Cleaned scopes with drop reasons, review status and eligibility, counted by item."""
    k = F.col("doc_id")
    of = lambda v, names: F.element_at(F.array(*[F.lit(x) for x in names]), (v + 1).cast("int"))
    c = _items(spark, sf).withColumn("cleaned", F.when(k % 9 == 0, "").otherwise(F.col("full_text"))).withColumn("stub", k % 11 == 0).withColumn("removed_share", k % 10 / 10.0)
    c = c.withColumn("review", F.when(k % 13 == 0, "approved").when(k % 13 == 1, "rejected")).withColumn("boundary", of(k % 5, ("trusted", "unknown", "review_needed", "trusted", None)))
    return review.scope_report(review.audit_scopes(c), ["item_id"]).withColumnRenamed("item_id", "item")


@query(_ITEMS + "SELECT doc_id, CASE WHEN ex IS NULL THEN 'unknown' WHEN ex AND doc_id % 2 = 0 THEN 'trusted' ELSE 'review_needed' END AS authority FROM i")
def boundary_authority(spark, sf):
    """Whether an item's bounds can be trusted."""
    return _items(spark, sf).select("doc_id", items.boundary_authority(F.col("exists_by_regime"), F.col("doc_id") % 2 == 0).alias("authority"))


# Filing texts


@query(r"""
WITH f AS (SELECT doc_id, '<SEC-HEADER>x ' || doc_id || chr(10) || 'y</SEC-HEADER>' || chr(10) || '<TYPE>10-K' || chr(10) || 'Item' || chr(10) || ' ' || (doc_id % 15 + 1) || chr(10) || coalesce(text, '') || chr(10) || '</TEXT>' || chr(10) AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<(?:SEC-HEADER|IMS-HEADER)>.*?</(?:SEC-HEADER|IMS-HEADER)>', '', 'g'), '(?im)^[ \t]*</?(?:SEC-DOCUMENT|IMS-DOCUMENT|DOCUMENT|TEXT|TYPE|SEQUENCE|FILENAME|DESCRIPTION|PAGE)>[^\n]*$\n?', '', 'g'), '(?im)^([ \t]*(?:ITEM|PART))[ \t]*\n\s*(\d{1,2}[A-C]?\b|[IVX]{1,4}\b)', '\1 \2', 'g')) AS digest FROM f
""")
def strip_archive(spark, sf):
    """Texts without archive markup, wrapped headings joined."""
    d = table(spark, sf, "documents")
    line = F.lit("\n")
    t = F.concat(F.lit("<SEC-HEADER>x "), "doc_id", line, F.lit("y</SEC-HEADER>\n<TYPE>10-K\nItem\n "), F.col("doc_id") % 15 + 1, line, F.coalesce("text", F.lit("")), F.lit("\n</TEXT>\n"))
    return d.select("doc_id", F.md5(filing_text.join_wrapped_headings(filing_text.strip_archive(t)).cast("binary")).alias("digest"))


@query("""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 3 AS h FROM documents), f AS (SELECT doc_id, h, repeat(t || chr(10), 4) AS a, CASE h WHEN 0 THEN 'EXHIBIT INDEX' || chr(10) || 'x' || chr(10) WHEN 1 THEN 'Exhibit 10.1 x' || chr(10) || 'Exhibit 10.2 y' || chr(10) ELSE t END AS z FROM b),
g AS (SELECT *, h < 2 AND length(a) >= floor(length(a || z) * 0.6) AS cut FROM f)
SELECT doc_id, CASE WHEN cut THEN length(a) END AS tail_start, length(rtrim(CASE WHEN cut THEN a ELSE a || z END, chr(10) || ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS n_chars FROM g
""")
def exhibit_tails(spark, sf):
    """Filings cut where their exhibits begin: at an index, or at a cluster of exhibit lines."""
    t, h = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    body = F.repeat(F.concat(t, F.lit("\n")), 4)
    tail = F.when(h == 0, F.lit("EXHIBIT INDEX\nx\n")).when(h == 1, F.lit("Exhibit 10.1 x\nExhibit 10.2 y\n")).otherwise(t)
    out = filing_text.clean_documents(table(spark, sf, "documents").select("doc_id", F.concat(body, tail).alias("text")))
    trimmed = F.regexp_replace("cleaned", r"[ \n\t\r\x0B\f]+$", "")
    return out.select("doc_id", "tail_start", F.length(trimmed).cast("long").alias("n_chars"))


@query("""
WITH x AS (SELECT o_orderkey AS k, ['1', '2', '1A', '3', '4', '6'][o_orderkey % 6 + 1] AS i, ['Financial Statements', 'Legal  Proceedings', 'Management''s Discussion', 'Unregistered Sales of Equity', 'Defaults upon Senior Securities', 'Controls', 'Other'][o_orderkey % 7 + 1] AS t FROM orders), y AS (SELECT *, lower(regexp_replace(t, '\\s+', ' ', 'g')) AS l FROM x)
SELECT k, CASE WHEN i IN ('1A', '5', '6') THEN 'II' WHEN i = '1' AND l = 'financial statements' THEN 'I' WHEN i = '1' AND l = 'legal proceedings' THEN 'II' WHEN i = '2' AND l LIKE '%management%' THEN 'I' WHEN i = '2' AND l LIKE '%unregistered sales%' THEN 'II' WHEN i = '3' AND l LIKE '%defaults%' THEN 'II' WHEN i = '4' AND l LIKE '%controls%' THEN 'I' END AS part FROM y
""")
def quarterly_parts(spark, sf):
    """Parts of quarterly items from their numbers and titles."""
    k = F.col("o_orderkey")
    of = lambda v, names: F.element_at(F.array(*[F.lit(x) for x in names]), (v + 1).cast("int"))
    i = of(k % 6, ("1", "2", "1A", "3", "4", "6"))
    t = of(k % 7, ("Financial Statements", "Legal  Proceedings", "Management's Discussion", "Unregistered Sales of Equity", "Defaults upon Senior Securities", "Controls", "Other"))
    return table(spark, sf, "orders").select(k.alias("k"), filing_text.quarterly_part(i, t).alias("part"))


@query(r"""
WITH x AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 4 < 2 THEN chr(10) || 'Item ' || (5 + doc_id % 4) || '. Next' || chr(10) || 'more' ELSE '' END AS t, 4 + doc_id % 3 AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 AND 5 + doc_id % 4 > n THEN length(t) - length(regexp_extract(t, '(?is)\nItem [0-9]+\. Next\nmore$')) + 2 ELSE 0 END AS at FROM x
""")
def embedded_headings(spark, sf):
    """Where a later item's heading stands inside an item's text."""
    k = F.col("doc_id")
    t = F.concat(F.coalesce("text", F.lit("")), F.when(k % 4 < 2, F.concat(F.lit("\nItem "), 5 + k % 4, F.lit(". Next\nmore"))).otherwise(""))
    return table(spark, sf, "documents").select("doc_id", filing_text.embedded_heading(t, 4 + k % 3).alias("at"))


@query("""
WITH r(p, i, c, a, b) AS (VALUES ('I', '3', 'MARKET_RISK', DATE '1997-06-15', NULL), ('II', '2', 'CHANGES_IN_SECURITIES', NULL, DATE '1996-11-17'), ('II', '2', 'CHANGES_IN_SECURITIES_WITH_UNREGISTERED_SALES', DATE '1996-11-17', DATE '2004-08-23'), ('II', '6', 'EXHIBITS_AND_REPORTS', NULL, DATE '2004-08-23')),
x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ['I', 'II', 'II', 'II'][o_orderkey % 4 + 1] AS p, ['3', '2', '6', '9'][o_orderkey % 4 + 1] AS i FROM orders)
SELECT o_orderkey, r.c AS canonical, CASE WHEN r.c IS NOT NULL THEN true WHEN x.i <> '9' THEN false END AS exists_by_regime FROM x LEFT JOIN r ON x.p = r.p AND x.i = r.i AND (a IS NULL OR a <= d) AND (b IS NULL OR d < b)
""")
def quarterly_regimes(spark, sf):
    """Quarterly items against the validity intervals of their meaning."""
    k = F.col("o_orderkey") % 4
    x = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("filing_date"), F.when(k == 0, "I").otherwise("II").alias("item_part"), F.when(k == 0, "3").when(k == 1, "2").when(k == 2, "6").otherwise("9").alias("item_id"))
    return items.annotate_regime(x, items.regime_frame(spark, "10-Q")).select("o_orderkey", "canonical", "exists_by_regime")


# Enrichment


@query("""
SELECT o_orderkey AS k, coalesce(i, c) AS id, CASE WHEN i IS NOT NULL THEN 'ISIN' ELSE 'CUSIP' END AS kind FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'I' || o_orderkey END AS i, CASE WHEN o_orderkey % 2 = 0 THEN 'C' || o_orderkey END AS c FROM orders)
WHERE coalesce(i, c) IS NOT NULL AND o_orderkey % 4 IN (0, 1) AND o_custkey % 5 > 0 AND o_custkey % 10 IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 15)
""")
def lookup_handoff(spark, sf):
    """Rows to look up under a strict filter profile."""
    k = F.col("o_orderkey")
    b = table(spark, sf, "orders").select(k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("I"), k)).alias("ISIN"), F.when(k % 2 == 0, F.concat(F.lit("C"), k)).alias("CUSIP"), F.lit(None).cast("string").alias("TICKER"), (10 + k % 4).alias("SHRCD"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("KYGVKEY"), (F.col("o_custkey") % 10).alias("KYPERMNO"))
    allowed = table(spark, sf, "supplier").filter("s_nationkey < 15").select(F.col("s_suppkey").alias("KYPERMNO"))
    out = enrich.lookup_handoff(b, common_only=True, need_company=True, allowed=allowed)
    return out.select("k", F.col("preferred_lookup_id").alias("id"), F.col("preferred_lookup_type").alias("kind"))


@query("""
WITH i AS (SELECT s_suppkey AS r, CASE s_suppkey % 3 WHEN 0 THEN 'Ordinary Share' WHEN 1 THEN 'Unit' ELSE 'ordinary share' END AS t, CASE WHEN s_suppkey % 4 = 0 THEN 'EUR' ELSE 'USD' END AS c FROM supplier WHERE s_suppkey % 5 > 0),
o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey % 12 END AS r FROM orders)
SELECT k, CASE WHEN o.r IS NULL THEN 'NO_IDENTIFIER' WHEN t IS NULL THEN 'NO_INSTRUMENT' WHEN lower(t) <> 'ordinary share' THEN 'NOT_COMMON' WHEN c <> 'USD' THEN 'FOREIGN_CURRENCY' END AS reason FROM o LEFT JOIN i ON o.r = i.r
""")
def instrument_authority(spark, sf):
    """Resolved identifiers with the reason they can't be used."""
    s, k = F.col("s_suppkey"), F.col("o_orderkey")
    inst = table(spark, sf, "supplier").filter("s_suppkey % 5 > 0").select(s.cast("long").alias("ric"), F.when(s % 3 == 0, "Ordinary Share").when(s % 3 == 1, "Unit").otherwise("ordinary share").alias("instrument_type"), F.when(s % 4 == 0, "EUR").otherwise("USD").alias("currency"))
    o = table(spark, sf, "orders").select(k.alias("k"), F.when(k % 6 > 0, F.col("o_custkey") % 12).cast("long").alias("effective_ric"))
    return enrich.instrument_authority(o, inst).select("k", F.col("ineligible_reason").alias("reason"))


_AUTH = """
WITH o AS (SELECT o_custkey % 300 AS k, 'R' || (o_custkey // 300 % 4) AS ric, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS c FROM orders WHERE o_orderstatus = 'F' AND (o_custkey % 300 % 3 > 0 OR year(o_orderdate) - 1995 BETWEEN 2 * (o_custkey // 300 % 4) AND 2 * (o_custkey // 300 % 4) + 1)),
m AS (SELECT k, ric, count(DISTINCT d) AS dates, min(d) AS a, max(d) AS b FROM o GROUP BY 1, 2), g AS (SELECT *, dates >= 2 AS sup FROM m), r AS (SELECT *, max(b) OVER (PARTITION BY k, sup ORDER BY a, b, ric ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
s AS (SELECT k, count(*) FILTER (WHERE sup) AS n, max(CASE WHEN sup AND a <= reach THEN 1 ELSE 0 END) AS ov FROM r GROUP BY 1), e AS (SELECT r.*, CASE WHEN n = 0 THEN 'NO_SUPPORT' WHEN n = 1 THEN 'SINGLE' WHEN ov = 1 THEN 'OVERLAP' ELSE 'SEQUENTIAL' END AS decision FROM r JOIN s USING (k))
"""


def _decisions(spark, sf):
    c = F.col("o_custkey")
    ric = F.floor(c / 300) % 4
    ok = (c % 300 % 3 > 0) | (F.year("o_orderdate") - 1995).between(2 * ric, 2 * ric + 1)
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").filter(ok).select((c % 300).alias("KYPERMNO"), F.concat(F.lit("R"), ric).alias("ric"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("category"))
    m = enrich.candidate_metrics(o)
    return enrich.authority_decisions(m, m.select("KYPERMNO", "ric", F.col("ric").alias("canonical_ric")), min_dates=2)


@query(_AUTH + "SELECT k, ric, dates, decision FROM e")
def authority_decisions(spark, sf):
    """What can be said about each security's identifiers over time."""
    return _decisions(spark, sf).select(F.col("KYPERMNO").alias("k"), F.col("canonical_ric").alias("ric"), "dates", "decision")


@query(_AUTH + "SELECT k, ric, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day FROM e WHERE sup AND decision IN ('SINGLE', 'SEQUENTIAL')")
def authority_panel(spark, sf):
    """Windows of the identifiers of decided securities."""
    p = enrich.authority_panel(_decisions(spark, sf))
    return p.select(F.col("KYPERMNO").alias("k"), "ric", text_date("window_start").alias("first_day"), text_date("window_end").alias("last_day"))


@query(_AUTH + "SELECT k, decision, count(*) AS candidates FROM e WHERE decision IN ('NO_SUPPORT', 'OVERLAP') GROUP BY 1, 2")
def authority_exceptions(spark, sf):
    return enrich.authority_exceptions(_decisions(spark, sf)).withColumnRenamed("KYPERMNO", "k")


@query("WITH u AS (SELECT DISTINCT c_custkey AS k FROM customer), f AS (SELECT DISTINCT o_custkey + 20 AS k FROM orders) SELECT count(u.k) AS universe, count(f.k) AS found, count(*) FILTER (WHERE u.k = f.k) AS both, round(count(*) FILTER (WHERE u.k = f.k) / count(u.k), 8) AS coverage, count(*) FILTER (WHERE u.k IS NULL) AS unexpected FROM u FULL JOIN f ON u.k = f.k")
def universe_diagnostics(spark, sf):
    """How much of a universe was found, and what was not expected."""
    out = enrich.universe_diagnostics(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select((F.col("o_custkey") + 20).alias("k")), ["k"])
    return out.withColumn("coverage", rounded("coverage", 8))


# Columns


@query("""
SELECT l_orderkey, l_linenumber, strftime(greatest(CAST(l_shipdate AS DATE), DATE '1996-01-01'), '%Y-%m-%d') AS start_day, strftime(CASE WHEN l_linenumber > 1 THEN least(CAST(l_shipdate AS DATE) + 90, DATE '2000-12-31') END, '%Y-%m-%d') AS end_day,
round(l_discount - l_tax, 8) AS net, round(CASE WHEN l_discount + l_tax > 0 THEN (l_discount - l_tax) / (l_discount + l_tax) END, 8) AS net_share, round(greatest(l_discount, l_quantity / 100, l_tax), 8) AS dominant,
CASE lower(trim(['Item 7', 'MD&A ', 'risk factors', 'x1'][l_linenumber % 4 + 1])) WHEN 'item 7' THEN '7' WHEN 'md&a' THEN '7' WHEN 'risk factors' THEN '1A' ELSE 'X1' END AS scope,
CASE greatest(l_linenumber % 3 + 1, CASE WHEN l_quantity * 10 <= 128 THEN 1 WHEN l_quantity * 10 <= 256 THEN 2 ELSE 3 END) WHEN 1 THEN 'short' WHEN 2 THEN 'medium' ELSE 'long' END AS bucket FROM lineitem
""")
def scalar_spans_and_scales(spark, sf):
    """Spans cut to bounds, scale variants of class shares, scope names, wider buckets."""
    n = F.col("l_linenumber")
    of = lambda v, names: F.element_at(F.array(*[F.lit(x) for x in names]), (v + 1).cast("int"))
    day = F.col("l_shipdate").cast("date")
    a, b = X.clip_span(day, F.when(n > 1, F.date_add(day, 90)), F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("2000-12-31")))
    s = X.scale_variants(F.col("l_discount"), F.col("l_quantity") / 100, F.col("l_tax"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text_date(a).alias("start_day"), text_date(b).alias("end_day"), rounded(s["net_negative"], 8).alias("net"), rounded(s["net_share"], 8).alias("net_share"), rounded(s["dominant"], 8).alias("dominant"),
        X.text_scope(of(n % 4, ("Item 7", "MD&A ", "risk factors", "x1"))).alias("scope"), X.wider_bucket(of(n % 3, ("short", "medium", "long")), F.col("l_quantity") * 10).alias("bucket"),
    )


@query("SELECT l_suppkey AS permno, strftime(l_shipdate, '%Y-%m-%d') AS day, round(max(l_tax), 6) AS final_ret, NULL::DOUBLE AS cap, 0 AS n_filings FROM lineitem GROUP BY 1, 2")
def panel_surfaces(spark, sf):
    """Stable surfaces of a panel that lacks some of their columns."""
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("KYPERMNO"), F.col("l_shipdate").cast("date").alias("CALDT")).agg(F.max("l_tax").alias("FINAL_RET"))
    a, b = market.surface(p, "daily"), market.surface(p, "bridge")
    out = a.join(b.select("KYPERMNO", "CALDT", "n_filings"), ["KYPERMNO", "CALDT"])
    return out.select(F.col("KYPERMNO").cast("long").alias("permno"), text_date("CALDT").alias("day"), rounded("FINAL_RET").alias("final_ret"), F.col("TCAP").alias("cap"), F.col("n_filings"))


# Sample contracts

_CONTRACT = "WITH x AS (SELECT event_id AS k, CASE WHEN event_id % 3 > 0 THEN value END AS a, CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS b FROM events)"


@query(_CONTRACT + " SELECT 'raw' AS sample, count(*) AS n FROM x WHERE a IS NOT NULL OR b IS NOT NULL UNION ALL SELECT 'regression', count(*) FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(b) UNION ALL SELECT 'common', count(*) FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(b)")
def sample_contracts(spark, sf):
    """Rows that each kind of table may draw on."""
    k = F.col("event_id")
    x = table(spark, sf, "events").select(k.alias("k"), F.when(k % 3 > 0, F.col("value")).alias("a"), F.when(k % 5 == 0, float("nan")).when(k % 7 != 0, F.col("value")).alias("b"))
    raw, fit = review.raw_available(x, ["a", "b"]), review.regression_eligible(x, ["a", "b"])
    frames = {"raw": raw, "regression": fit, "common": review.common_rows([raw, fit], ["k"])}
    out = [df.agg(F.lit(n).alias("sample"), F.count("*").alias("n")) for n, df in frames.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT conv_id, turn, length(text) AS chars FROM conversations")
def sentence_chunks(spark, sf):
    """Turns put together again from chunks of at most 200 characters."""
    c = table(spark, sf, "conversations")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([scores.chunks(t or "", 200) for t in texts])

    whole = F.array_join(cut("text"), "")
    kept = F.when(whole == F.coalesce("text", F.lit("")), F.length("text"))
    return c.select("conv_id", "turn", kept.cast("long").alias("chars"))



# Status tables, regression tables, scopes


def _premerge(spark, sf):
    from .market_queries import _filings, _links

    daily = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") + 1).cast("int").alias("KYPERMNO"), F.col("l_shipdate").cast("date").alias("CALDT")).agg(F.sum("l_quantity").alias("VOL"))
    return links.premerge_artifacts(_filings(spark, sf), links.align_to(_links(spark, sf), links._schema(spark)), daily, links.join_spec("filing_date_or_next"), counted=_links(spark, sf, counted=True))


def _premerge_sql() -> str:
    from .market_queries import _LINK_SQL

    return _LINK_SQL + """,
cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), dl AS (SELECT DISTINCT l_suppkey + 1 AS permno, CAST(l_shipdate AS DATE) AS dd FROM lineitem), b AS (SELECT permno, min(dd) AS lo, max(dd) AS hi FROM dl GROUP BY 1),
al AS (SELECT x.*, cal.day AS ad FROM (SELECT *, CASE WHEN reason = 'OK' THEN permno END AS pm FROM res) x ASOF LEFT JOIN cal ON x.fd <= cal.day), j AS (SELECT al.*, dl.dd FROM al ASOF LEFT JOIN dl ON al.pm = dl.permno AND al.ad <= dl.dd),
st AS (SELECT j.*, CASE WHEN reason <> 'OK' THEN reason WHEN ad IS NULL OR lo IS NULL OR ad < lo OR ad > hi THEN 'OUT_OF_CCM_COVERAGE' WHEN dd IS NULL OR datediff('day', ad, dd) > 14 THEN 'NO_CCM_ROW_FOR_DATE' ELSE 'OK' END AS code FROM j LEFT JOIN b ON j.pm = b.permno)
"""


@query(_premerge_sql() + "SELECT doc_id, code, strftime(ad, '%Y-%m-%d') AS aligned, CAST(datediff('day', fd, ad) AS BIGINT) AS align_lag, CAST(cands AS BIGINT) AS candidates, code = 'OK' AS matched FROM st")
def match_status_table(spark, sf):
    """The fixed status table of the whole path, one row a document."""
    s = _premerge(spark, sf)["status"]
    return s.select("doc_id", F.col("match_reason_code").alias("code"), text_date("aligned_caldt").alias("aligned"), F.col("alignment_lag_days").cast("long").alias("align_lag"), F.col("link_candidate_count").alias("candidates"), F.col("match_flag").alias("matched"))


@query(_premerge_sql() + ", k AS (SELECT cik, count(*) AS n, count(DISTINCT CASE WHEN permno > 0 THEN permno END) AS s FROM (SELECT DISTINCT * FROM l) GROUP BY 1) SELECT doc_id, code, coalesce(k.n, 0) AS link_rows, coalesce(k.s, 0) AS securities FROM st LEFT JOIN k USING (cik) WHERE code <> 'OK'")
def unmatched_documents(spark, sf):
    """Documents without a match, with their filer's links."""
    u = _premerge(spark, sf)["unmatched"]
    return u.select("doc_id", F.col("match_reason_code").alias("code"), "link_rows", F.col("link_securities").alias("securities"))


def _slopes(where: str, name: str, signal: str) -> str:
    return f"""SELECT '{name}' AS tab, '{signal}' AS sig, q, sum(n) AS n, sum(xy) / sum(xx) AS b FROM (SELECT q, ind, count(*) AS n, covar_pop({signal}, y) * count(*) AS xy, var_pop({signal}) * count(*) AS xx FROM o WHERE {where} GROUP BY 1, 2) GROUP BY q HAVING sum(n) > count(*) + 1 AND sum(xx) > 0"""


@query(_PANEL + ", f AS (" + " UNION ALL ".join(_slopes(w, n, s) for n, w in (("all", "true"), ("owned", "h > 2")) for s in ("s", "c")) + """),
w AS (SELECT *, n / sum(n) OVER (PARTITION BY tab, sig) AS w FROM f), p AS (SELECT *, w * (b - m) AS psi FROM (SELECT *, sum(w * b) OVER (PARTITION BY tab, sig) AS m FROM w)), g AS (SELECT *, lag(psi) OVER (PARTITION BY tab, sig ORDER BY q) AS l1 FROM p)
SELECT tab AS "table", 'y' AS outcome, sig AS signal_name, round(max(m), 6) AS estimate, round(sqrt(greatest(sum(psi * psi) + sum(psi * l1), 0)), 6) AS se, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def regression_tables(spark, sf):
    """Two tables of regressions, one of them on a part of the rows, as one long result."""
    tables = {"all": {"outcomes": ["y"], "signals": ["s", "c"]}, "owned": {"outcomes": ["y"], "signals": ["s", "c"], "where": F.col("h") > 2}}
    out = regress.regression_tables(_panel(spark, sf).drop("k"), tables, "d", "ind")
    return out.select("table", "outcome", "signal_name", rounded("estimate").alias("estimate"), rounded("se").alias("se"), "n")


def _scored(k: int) -> str:
    return f"""SELECT {k} AS buckets, q, ind, y, (least(greatest(ceil(pct * {k}), 1), {k}) - 1) / ({k} - 1.0) AS x FROM (SELECT q, ind, y, (rank() OVER (PARTITION BY q ORDER BY s) + (count(*) OVER (PARTITION BY q, s) - 1) / 2.0) / count(s) OVER (PARTITION BY q) AS pct FROM o)"""


@query(_PANEL + ", z AS (" + " UNION ALL ".join(map(_scored, (4, 5, 10))) + """), i AS (SELECT buckets, q, ind, count(*) AS n, covar_pop(x, y) * count(*) AS xy, var_pop(x) * count(*) AS xx FROM z GROUP BY 1, 2, 3), f AS (SELECT buckets, q, sum(n) AS n, sum(xy) / sum(xx) AS b FROM i GROUP BY 1, 2 HAVING sum(n) > count(*) + 1 AND sum(xx) > 0),
w AS (SELECT *, n / sum(n) OVER (PARTITION BY buckets) AS w FROM f), p AS (SELECT *, w * (b - m) AS psi FROM (SELECT *, sum(w * b) OVER (PARTITION BY buckets) AS m FROM w)), g AS (SELECT *, lag(psi) OVER (PARTITION BY buckets ORDER BY q) AS l1 FROM p)
SELECT buckets, round(max(m), 6) AS estimate, round(sqrt(greatest(sum(psi * psi) + sum(psi * l1), 0)), 6) AS se, count(*) AS n FROM g GROUP BY 1""")
def quantile_suite(spark, sf):
    """The regression with quantile scores of the signal, for quartiles, quintiles and deciles."""
    out = regress.quantile_suite(_panel(spark, sf).drop("h", "k"), "y", "s", "d", (4, 5, 10), "ind")
    return out.select("buckets", rounded("estimate").alias("estimate"), rounded("se").alias("se"), "n")


@query("""
WITH i AS (SELECT doc_id, 'A' AS scope, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'B', text FROM documents WHERE doc_id % 3 = 0), x AS (SELECT * FROM i UNION ALL SELECT a.doc_id, 'A+B', a.text || chr(10) || chr(10) || b.text FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.scope = 'A' AND b.scope = 'B' WHERE a.text IS NOT NULL),
t AS (SELECT scope, doc_id, lower(unnest(TOK)) AS token FROM x), c AS (SELECT scope, doc_id, token, count(*) AS tf FROM t WHERE token IN ('the', 'and', 'of') GROUP BY 1, 2, 3), n AS (SELECT scope, doc_id, CAST(len(TOK) AS BIGINT) AS l FROM x), u AS (SELECT scope, count(*) AS n FROM n GROUP BY 1), d AS (SELECT scope, token, count(*) AS df FROM c GROUP BY 1, 2),
w AS (SELECT c.scope, c.doc_id, sum(tf) AS tf, sum((1 + ln(tf)) / (1 + ln(l)) * ln(u.n / df)) AS w FROM c JOIN d USING (scope, token) JOIN n USING (scope, doc_id) JOIN u USING (scope) GROUP BY 1, 2)
SELECT n.scope, n.doc_id, l AS total_tokens, round(CASE WHEN l > 0 THEN coalesce(tf, 0) / l END, 8) AS tone_prop, round(CASE WHEN l > 0 THEN coalesce(w, 0) END, 6) AS tone_tfidf FROM n LEFT JOIN w USING (scope, doc_id)
""".replace("TOK", r"regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '([A-Za-z])-\s*\n\s*([A-Za-z])', '\1\2', 'g'), '[A-Za-z]{2,}(?:[-''][A-Za-z]+)*')"))
def scope_signals(spark, sf):
    """Dictionary signals by text scope, each with its own universe, and of two scopes put together."""
    d = table(spark, sf, "documents")
    part = lambda n, m: d.filter(F.col("doc_id") % m == 0).select("doc_id", F.lit(n).alias("item_id"), F.col("text").alias("full_text"), F.lit("1").alias("cik_10"), F.to_date(F.lit("2000-01-01")).alias("filing_date"))
    both = part("A", 2).unionByName(part("B", 3))
    every = both.unionByName(lexicon.combined_scope(both, "A", "B", "A+B").select(both.columns))
    out = lexicon.signals(every, lexicon.lexicon_frame(spark, {"tone": ["the", "and", "of"]}), ["tone"], "doc_id", "full_text", by=["item_id"])
    return out.select(F.col("item_id").alias("scope"), "doc_id", "total_tokens", *[rounded(c, n).alias(c) for c, n in zip(regress.signal_columns(out), (8, 6), strict=True)])


@query("SELECT k, TRY_CAST(CASE WHEN regexp_full_match(trim(c), '[0-9]{1,4}') THEN trim(c) END AS BIGINT) AS sic FROM (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN ' ' || (o_custkey % 9999) || ' ' WHEN 1 THEN 'x1' WHEN 2 THEN NULL WHEN 3 THEN '12345' ELSE CAST(o_custkey % 100 AS VARCHAR) END AS c FROM orders)")
def industry_codes(spark, sf):
    """Industry codes from text, guarded."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = F.when(k % 5 == 0, F.concat(F.lit(" "), c % 9999, F.lit(" "))).when(k % 5 == 1, "x1").when(k % 5 == 3, "12345").when(k % 5 == 4, (c % 100).cast("string"))
    return table(spark, sf, "orders").select(k.alias("k"), X.sic_code(t).cast("long").alias("sic"))


# Sources: tables written to the shared folder and read again


def _batches(spark, sf):
    """Documents as yearly batch files below a scratch folder."""
    root = scratch_path(spark, "batches")
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("full_text"), F.col("source").alias("cik_10"))
    for year in (2001, 2002, 2003):
        for part in (1, 2):
            keep = (F.col("doc_id") % 3 == year - 2001) & (F.col("doc_id") % 2 == part - 1) | (F.col("doc_id") == 0)
            d.filter(keep).write.parquet(f"{root}/{year}_batch_{part}.parquet")
    return root


@query("SELECT y AS year, count(*) FILTER (WHERE doc_id % 3 = y - 2001 OR doc_id = 0) + max(CASE WHEN doc_id = 0 THEN 1 ELSE 0 END) AS n, CAST(count(text) FILTER (WHERE doc_id % 3 = y - 2001 OR doc_id = 0) + max(CASE WHEN doc_id = 0 AND text IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_text FROM documents, (VALUES (2001), (2002), (2003)) v(y) GROUP BY 1")
def yearly_batches(spark, sf):
    """Batch files merged into one table a year, verified against what was read."""
    root, out = _batches(spark, sf), scratch_path(spark, "merged")
    years = sorted(readers.merge_batches(spark, root, out))
    parts = [spark.read.parquet(f"{out}/{y}.parquet").agg(F.lit(int(y)).alias("year"), F.count("*").alias("n"), F.count("full_text").alias("with_text")) for y in years]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id, CASE WHEN doc_id = 0 THEN '2001' ELSE CAST(2001 + doc_id % 3 AS VARCHAR) END AS year, length(text) AS n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filing_texts(spark, sf):
    """Texts of the wanted documents, the first of several."""
    out = readers.filing_texts(spark, _batches(spark, sf), table(spark, sf, "labels"))
    return out.select("doc_id", F.col("source_year").alias("year"), F.length("full_text").cast("long").alias("n_chars"))


@query("SELECT l_suppkey AS permno, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, count(DISTINCT CAST(l_shipdate AS DATE)) AS again FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' GROUP BY 1")
def daily_stage(spark, sf):
    """The daily panel's stage written with its surfaces, then read again without a rebuild."""
    prices, bids, delist, names, header = _feeds(spark, sf)
    path = scratch_path(spark, "stage")
    built = market.daily_stage(spark, {"prices": prices, "bid_ask": bids, "delist": delist, "names": names, "header": header}, path, "1995-06-01")
    again = market.daily_stage(spark, {}, path, "1995-06-01", "REUSE")
    a = built["bridge"].groupBy("KYPERMNO").agg(F.count("*").alias("days"))
    b = again["core"].groupBy("KYPERMNO").agg(F.count("*").alias("again"))
    return a.join(b, "KYPERMNO").select(F.col("KYPERMNO").cast("long").alias("permno"), "days", "again")


@query("SELECT o_orderkey AS k, strftime(last_day(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH), '%Y-%m-%d') AS month_end, round(arg_max(l.v, l.d), 4) AS price FROM orders LEFT JOIN (SELECT l_suppkey % 4 AS p, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) l ON o_custkey % 4 = l.p AND l.d <= date_trunc('month', o_orderdate)::DATE - 1 AND l.d >= date_trunc('month', o_orderdate)::DATE - 32 GROUP BY o_orderkey, o_orderdate")
def month_end_price(spark, sf):
    """The last price at or before the end of the month before each filing, not older than 31 days."""
    m = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("KYPERMNO"), F.col("l_shipdate").cast("date").alias("CALDT")).agg(F.max("l_extendedprice").alias("PRC"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 4).alias("KYPERMNO"), F.col("o_orderdate").cast("date").alias("filing_date"))
    out = events.month_end_price(o, m)
    return out.select("k", text_date(X.month_end_before(F.col("filing_date"))).alias("month_end"), rounded("prior_month_price", 4).alias("price"))
