"""Queries of text signals, sentence scores, samples, reports and reshaping over the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import text as T
from ..operators import items, lexicon, reports, sampling, scores
from ..scratch import scratch_path
from .registry import query, rounded, table

WORDS = {"negative": ["loss", "the", "and"], "positive": ["gain", "of", "to"], "uncertainty": ["may", "is"], "litigious": ["der", "die"]}

_TOKENS = r"""regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '([A-Za-z])-\s*\n\s*([A-Za-z])', '\1\2', 'g'), '[A-Za-z]{2,}(?:[-''][A-Za-z]+)*')"""
_COUNTS = f"WITH t AS (SELECT doc_id, lower(unnest({_TOKENS})) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS l FROM documents)"


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens FROM documents")
def tokenize_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.n_tokens(F.col("text")).alias("n_tokens"))


@query(_COUNTS + " SELECT token, count(*) AS df FROM c GROUP BY 1")
def doc_frequency(spark, sf):
    return lexicon.document_frequency(lexicon.token_counts(table(spark, sf, "documents"), "doc_id", "text"))


@query(_COUNTS + """, x(category, token) AS (VALUES ('negative', 'loss'), ('negative', 'the'), ('negative', 'and'), ('positive', 'gain'), ('positive', 'of'), ('positive', 'to'), ('uncertainty', 'may'), ('uncertainty', 'is'), ('litigious', 'der'), ('litigious', 'die')),
d AS (SELECT token, count(*) AS df FROM c GROUP BY 1), w AS (SELECT c.doc_id, x.category, c.tf, (1 + ln(c.tf)) / (1 + ln(n.l)) * ln((SELECT count(*) FROM documents) / d.df) AS w FROM c JOIN x USING (token) JOIN d USING (token) JOIN n USING (doc_id)),
s AS (SELECT doc_id, coalesce(sum(tf) FILTER (WHERE category = 'negative'), 0) AS nt, coalesce(sum(w) FILTER (WHERE category = 'negative'), 0) AS nw, coalesce(sum(tf) FILTER (WHERE category = 'positive'), 0) AS pt, coalesce(sum(w) FILTER (WHERE category = 'positive'), 0) AS pw, coalesce(sum(w) FILTER (WHERE category = 'litigious'), 0) AS lw FROM w GROUP BY 1)
SELECT n.doc_id, n.l AS total_tokens, round(CASE WHEN l > 0 THEN coalesce(nt, 0) / l END, 8) AS negative_prop, round(CASE WHEN l > 0 THEN coalesce(nw, 0) END, 6) AS negative_tfidf, round(CASE WHEN l > 0 THEN coalesce(pt, 0) / l END, 8) AS positive_prop,
round(CASE WHEN l > 0 THEN coalesce(pw, 0) END, 6) AS positive_tfidf, round(CASE WHEN l > 0 THEN coalesce(lw, 0) END, 6) AS litigious_tfidf FROM n LEFT JOIN s USING (doc_id)""")
def tfidf_signals(spark, sf):
    """Dictionary proportions and tf-idf sums over the whole universe of documents."""
    lex = lexicon.lexicon_frame(spark, WORDS)
    s = lexicon.signals(table(spark, sf, "documents"), lex, list(WORDS))
    names = {"negative_prop": 8, "negative_tfidf": 6, "positive_prop": 8, "positive_tfidf": 6, "litigious_tfidf": 6}
    return s.select("doc_id", "total_tokens", *[rounded(c, d).alias(c) for c, d in names.items()])


@query(_COUNTS + ", b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{2,}(?:[-''][A-Za-z]+)*'))) AS token FROM benchmark) SELECT n.doc_id, coalesce(CAST(sum(c.tf) AS BIGINT), 0) AS recognised FROM n LEFT JOIN (SELECT * FROM c WHERE token IN (SELECT token FROM b)) c USING (doc_id) GROUP BY 1")
def recognised_words(spark, sf):
    """Tokens that a master list (here the words of the benchmark passages) knows."""
    docs = table(spark, sf, "documents")
    master = table(spark, sf, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    counts = lexicon.token_counts(docs, "doc_id", "text").join(master, "token", "left_semi").groupBy("doc_id").agg(F.sum("tf").alias("recognised"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("recognised", F.lit(0)).alias("recognised"))


def _scores(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", "event_type", F.when(F.col("event_id") % 17 != 0, F.least(F.lit(1.0), F.col("value") / 150)).alias("p"), (F.col("event_id") % 9).alias("w"), "event_id")


_SCORES = "WITH s AS (SELECT user_id, event_type, CASE WHEN event_id % 17 <> 0 THEN least(1.0, value / 150) END AS p, event_id % 9 AS w, event_id FROM events)"


@query(_SCORES + " SELECT user_id, event_type, count(*) AS sentence_count, CAST(sum(w) AS BIGINT) AS token_count, round(sum(p * w) FILTER (WHERE p IS NOT NULL) / nullif(sum(w) FILTER (WHERE p IS NOT NULL), 0), 8) AS p_w_mean FROM s GROUP BY 1, 2")
def sentence_weighted_agg(spark, sf):
    out = scores.item_features(_scores(spark, sf), ["user_id", "event_type"], ["p"], "w")
    return out.withColumn("p_w_mean", rounded("p_w_mean", 8))


@query(_SCORES + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC NULLS LAST, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, sum(w * p) OVER (PARTITION BY user_id) / nullif(sum(w) OVER (PARTITION BY user_id), 0) AS m FROM s)
SELECT user_id, round(coalesce(sum(w * p) FILTER (WHERE p >= 0.6), 0) / nullif(sum(w), 0), 8) AS exposure_60, round(coalesce(sum(w * p) FILTER (WHERE p >= 0.8), 0) / nullif(sum(w), 0), 8) AS exposure_80, round(coalesce(sum(w) FILTER (WHERE p >= 0.7), 0) / nullif(sum(w), 0), 8) AS share_70,
round(sum(w * p) FILTER (WHERE k <= greatest(1, ceil(n * 0.1))) / nullif(sum(w) FILTER (WHERE k <= greatest(1, ceil(n * 0.1))), 0), 8) AS top_10_mean, round(sqrt(sum(w * (p - m) * (p - m)) / nullif(sum(w), 0)), 8) AS dispersion FROM r GROUP BY 1""")
def tail_exposure(spark, sf):
    """Thresholded exposures, top-decile mean and weighted dispersion of sentence scores."""
    out = scores.tail_surface(_scores(spark, sf), ["user_id"], "p", "w", ["event_id"])
    return out.select("user_id", *[rounded(c, 8).alias(c) for c in ("exposure_60", "exposure_80", "share_70", "top_10_mean", "dispersion")])


@query("SELECT source, count(*) AS docs, count(l.doc_id) AS scored, round(count(l.doc_id) / count(*), 8) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def coverage_report(spark, sf):
    out = scores.coverage_report(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", ["source"])
    return out.withColumn("coverage", rounded("coverage", 8))


@query("SELECT user_id, round(max(value) FILTER (WHERE event_type = 'view'), 6) AS view_top, round(max(value) FILTER (WHERE event_type = 'click'), 6) AS click_top FROM events GROUP BY 1")
def pivot_items(spark, sf):
    tops = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    out = scores.pivot_items(tops, "user_id", "event_type", ["view", "click"], ["top"])
    return out.select("user_id", rounded("view_top").alias("view_top"), rounded("click_top").alias("click_top"))


@query("SELECT l_orderkey, l_linenumber, signal, round(value, 6) AS value FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR signal IN (l_discount, l_tax))")
def unpivot_signals(spark, sf):
    out = table(spark, sf, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "signal", "value")
    return out.select("l_orderkey", "l_linenumber", "signal", rounded("value").alias("value"))


@query("SELECT p_type, p_partkey, stratum_rank FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY sha256('42|' || p_partkey)) AS stratum_rank FROM part) WHERE stratum_rank <= CASE p_type WHEN 'ECONOMY' THEN 7 ELSE 3 END")
def hash_ranked_sample(spark, sf):
    """Quota sample per stratum by SHA-256 rank."""
    part = table(spark, sf, "part")
    quotas = part.select("p_type").distinct().withColumn("quota", F.when(F.col("p_type") == "ECONOMY", 7).otherwise(3))
    return sampling.quota_sample(part, ["p_type"], quotas, 42, ["p_partkey"]).select("p_type", "p_partkey", F.col("stratum_rank").cast("long").alias("stratum_rank"))


@query("WITH e AS (SELECT DISTINCT o_custkey FROM orders), k AS (SELECT o_custkey FROM e ORDER BY sha256('7|' || o_custkey), o_custkey LIMIT (SELECT greatest(1, (count(*) + 9) // 10) FROM e)) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM k)")
def exact_entity_sample(spark, sf):
    """All rows of an exact tenth of the firms (the sample is the feature)."""
    return sampling.exact_entity_sample(table(spark, sf, "orders"), "o_custkey", 0.1, 7).select("o_orderkey", "o_custkey")


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k % 100 = 5")
def sample_at_ordinals(spark, sf):
    o = table(spark, sf, "orders")
    most = o.groupBy("o_orderpriority").count()
    targets = most.select("o_orderpriority", F.explode(F.sequence(F.lit(5), F.col("count") + 5, F.lit(100))).alias("ordinal"))
    return sampling.at_ordinals(o, ["o_orderpriority"], ["o_orderkey"], targets).select("o_orderpriority", "o_orderkey")


@query("""
SELECT variable, count(*) AS n, count(v) AS non_null, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75
FROM (SELECT 'l_quantity' AS variable, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1
""")
def describe_stats(spark, sf):
    out = reports.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("variable", "n", "non_null", *[rounded(c, 4).alias(c) for c in ("mean", "sd", "p25", "p50", "p75")])


@query("""
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS corr, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8), count(*) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8), count(*) FROM lineitem
""")
def corr_matrix(spark, sf):
    out = reports.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("corr", rounded("corr", 8))


@query("SELECT coalesce(source, 'TOTAL') AS source, count(*) AS filings, count(*) FILTER (WHERE doc_id % 3 = 0) AS without_items FROM documents GROUP BY ROLLUP (source)")
def no_item_stats_with_total(spark, sf):
    """Filings whose text gives no item, per group and in total."""
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Item 1. Business\n"), F.coalesce("text", F.lit(""))))
    return items.no_item_report(d, items.extract_items(d.select("doc_id", text.alias("text"))), "source")


@query("""
WITH a AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4),
n AS (SELECT l_suppkey, l_returnflag, sum(d) AS d FROM (SELECT *, 1 AS d FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2) SELECT CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(d) AS BIGINT) AS surplus, l_suppkey, l_returnflag FROM n WHERE d <> 0
""")
def multiset_diff(spark, sf):
    x = table(spark, sf, "lineitem")
    pick = lambda c: x.filter(c).select("l_suppkey", "l_returnflag")
    return reports.multiset_diff(pick("l_linenumber <= 3"), pick("l_linenumber between 2 and 4"))


@query("""
WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS k, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS c, o_orderstatus AS s FROM orders WHERE o_orderkey % 11 <> 0),
j AS (SELECT a.k AS ak, b.k AS bk, a.c AS ac, b.c AS bc, a.s AS s1, b.s AS s2 FROM a FULL JOIN b ON a.k = b.k), t AS (SELECT count(*) FILTER (WHERE bk IS NULL) AS l, count(*) FILTER (WHERE ak IS NULL) AS r, count(*) FILTER (WHERE ac IS DISTINCT FROM bc AND ak IS NOT NULL AND bk IS NOT NULL) AS c, count(*) FILTER (WHERE s1 IS DISTINCT FROM s2 AND ak IS NOT NULL AND bk IS NOT NULL) AS s FROM j)
SELECT 'c' AS "column", c AS mismatches, l AS left_only, r AS right_only FROM t UNION ALL SELECT 's', s, l, r FROM t
""")
def keyed_diff(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    b = o.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("c"), F.col("o_orderstatus").alias("s"))
    return reports.keyed_diff(a, b, ["k"])


@query("""
WITH r(p, i, c, a, b) AS (VALUES ('I', '4', 'SUBMISSION_OF_MATTERS', NULL, DATE '2010-02-28'), ('II', '7A', 'MARKET_RISK', DATE '1997-06-15', NULL), ('I', '1A', 'RISK_FACTORS', DATE '2005-12-01', NULL)),
x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE 'III' END AS p, CASE o_orderkey % 4 WHEN 0 THEN '4' WHEN 1 THEN '7A' WHEN 2 THEN '1A' ELSE '10' END AS i FROM orders)
SELECT o_orderkey, r.c AS canonical, CASE WHEN r.c IS NOT NULL THEN true WHEN x.i <> '10' THEN false END AS exists_by_regime, CASE WHEN r.c IS NOT NULL THEN 'active' ELSE 'unknown' END AS regime_status FROM x LEFT JOIN r ON x.p = r.p AND x.i = r.i AND (a IS NULL OR a <= d) AND (b IS NULL OR d < b)
""")
def regime_interval_annotation(spark, sf):
    """Items against the validity intervals of their meaning."""
    k = F.col("o_orderkey") % 4
    x = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("filing_date"), F.when(k == 1, "II").when(k == 3, "III").otherwise("I").alias("item_part"),
        F.when(k == 0, "4").when(k == 1, "7A").when(k == 2, "1A").otherwise("10").alias("item_id"),
    )
    return items.annotate_regime(x, items.regime_frame(spark)).select("o_orderkey", "canonical", "exists_by_regime", "regime_status")


def _filing_texts(spark, sf):
    """Documents dressed as filings: each document's whole text in three items."""
    d = table(spark, sf, "documents")
    body = F.coalesce("text", F.lit(""))
    text = F.concat(F.lit("PART I\nItem 1. Business\n"), body, F.lit("\nItem 1A. Risk Factors\n"), body, F.lit("\nPART II\nItem 7. Management's Discussion\n"), body, F.lit("\nSIGNATURES\n"))
    return d.select("doc_id", text.alias("text"))


@query()
def item_segmentation(spark, sf):
    """Item rows of filings, with their offsets."""
    out = items.extract_items(_filing_texts(spark, sf))
    return out.select("doc_id", "item_part", "item_id", "heading_start", "text_end", F.length("full_text").alias("n_chars"), "item_status")


@query()
def clean_item_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("full_text"))
    out = items.clean_items(d)
    return out.select("doc_id", F.length("cleaned").alias("n_chars"), "toc_removed", "tail_removed", "stub", "large_removal")


@query()
def sentence_split(spark, sf):
    """Sentences of every document and their token buckets."""
    s = scores.sentence_frame(table(spark, sf, "documents"), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max("n_chars").alias("longest"))


def length_scorer(texts):
    """A stand-in scorer that needs no model: punctuation and length decide."""
    out = []
    for t in texts:
        words = max(1, len(t.split()))
        negative = min(1.0, len(re.findall(r"[!#*$%&]", t)) / words)
        neutral = (1 - negative) * min(1.0, words / 20)
        out.append((negative, neutral, 1 - negative - neutral))
    return out


@query()
def sentence_scores(spark, sf):
    """Sentence scores by a pluggable model, averaged by document with token weights."""
    s = scores.sentence_frame(table(spark, sf, "documents"), "doc_id", "text")
    scored = scores.score_sentences(s.withColumn("tokens", F.size(F.split("sentence", r"\s+"))), length_scorer)
    out = scores.item_features(scored, ["doc_id"], ["negative_prob", "positive_prob"], "tokens")
    return out.select("doc_id", "sentence_count", rounded("negative_prob_w_mean").alias("negative"), rounded("positive_prob_w_mean").alias("positive"))


@query("SELECT year(o_orderdate) AS year, count(*) AS n, round(avg(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END), 8) AS large_share FROM orders GROUP BY 1")
def share_by_year(spark, sf):
    out = reports.share_by_year(table(spark, sf, "orders").withColumn("large", F.col("o_totalprice") > 200000), "o_orderdate", ["large"])
    return out.select(F.col("year").cast("long").alias("year"), "n", rounded("large_share", 8).alias("large_share"))


@query("""
SELECT conv_id, turn, length(text) AS chars, lag(length(text)) OVER w AS before, lead(length(text)) OVER w AS after, CASE WHEN length(text) <= 128 THEN 'short' WHEN length(text) <= 256 THEN 'medium' ELSE 'long' END AS bucket FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def sentence_context(spark, sf):
    """Neighbouring lengths and length bucket of each turn."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("chars", F.length("text").cast("long"))
    bucket = X.token_bucket(F.least(F.col("chars"), F.lit(512)))
    return c.select("conv_id", "turn", "chars", F.lag("chars").over(w).alias("before"), F.lead("chars").over(w).alias("after"), bucket.alias("bucket"))


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Event-time windows of an incremental run over all files there are."""
    from ..streaming import files

    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    root = scratch_path(spark, "stream")
    stream = files.arrivals(spark, path if path.endswith("/") else f"{sf}/events*.parquet", schema, "*.parquet")
    out = files.windowed(stream, "ts", "6 hours", "1 day", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    files.run_available(out, f"{root}/state", lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/out/batch={i}"), mode="complete")
    got = spark.read.parquet(f"{root}/out")
    last = got.agg(F.max("batch").alias("b"))
    got = got.join(F.broadcast(last), got["batch"] == last["b"])
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "event_type", "n", rounded("total", 4).alias("total"))
