"""Queries of whole operators that combine several steps: panels, links, accounting, enrichment, contracts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts
from ..functions import exprs as X
from ..operators import accounting, enrich, links, market
from .registry import query, rounded, table, text_date


def _day(first: str, n):
    return F.date_add(F.to_date(F.lit(first)), n.cast("int"))


def _feeds(spark, sf):
    """Prices, bids, delistings, names and headers of securities, drawn from lineitem and supplier."""
    x = table(spark, sf, "lineitem").withColumn("KYPERMNO", F.col("l_suppkey").cast("int")).withColumn("CALDT", F.col("l_shipdate").cast("date"))
    prices = x.filter("l_linenumber <= 4").groupBy("KYPERMNO", "CALDT").agg(
        (F.max("l_extendedprice") / 10000).alias("PRC"), F.max(F.when(F.col("l_tax") > 0.01, F.col("l_discount"))).alias("RET"), F.max("l_tax").alias("RETX"), F.sum("l_extendedprice").alias("TCAP"), F.sum("l_quantity").alias("VOL"),
    )
    bids = x.filter("l_linenumber >= 3").groupBy("KYPERMNO", "CALDT").agg(F.min("l_extendedprice").alias("BIDLO"), F.max("l_extendedprice").alias("ASKHI"))
    s = table(spark, sf, "supplier").withColumn("KYPERMNO", F.col("s_suppkey").cast("int"))
    k = F.col("KYPERMNO")
    names = s.withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(4)]))).select(
        "KYPERMNO", _day("1995-03-01", k % 50 + F.col("j") * 500).alias("NAMEDT"), F.when(k % 7 != 0, _day("1996-05-01", k % 50 + F.col("j") * 500)).alias("NAMEENDDT"), F.concat(F.lit("T"), k, F.col("j")).alias("TICKER"),
        (10 + (k + F.col("j")) % 4).cast("int").alias("SHRCD"), ((k + F.col("j")) % 5).cast("int").alias("EXCHCD"), F.lit("N").alias("PRIMEXCH"), F.lit("A").alias("TRDSTAT"), F.lit("R").alias("SECSTAT"),
    )
    header = s.select(
        "KYPERMNO", _day("1995-01-01", k * 0).alias("BEGDT"), F.when(k % 3 > 0, _day("2000-01-01", k)).alias("ENDDT"), F.lit(11).alias("HSHRCD"), (k % 4).cast("int").alias("HEXCD"),
        F.lit("Q").alias("HPRIMEXCH"), F.lit("H").alias("HTRDSTAT"), F.lit("I").alias("HSECSTAT"),
    )
    delist = s.filter("s_suppkey % 4 = 0").select(
        "KYPERMNO", _day("2000-06-01", k * 3).alias("DLSTDT"), (500 + k).cast("int").alias("DLSTCD"), F.lit(2.5).alias("DLPRC"), F.lit(0.0).alias("DLAMT"), F.lit(-0.3).alias("DLRET"), F.when(k % 8 == 0, -0.2).alias("DLRETX"),
    )
    return prices, bids, delist, names, header


_PANEL = """
WITH x AS (SELECT *, l_suppkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem),
pr AS (SELECT k, d, max(l_extendedprice) / 10000 AS prc, max(CASE WHEN l_tax > 0.01 THEN l_discount END) AS ret, max(l_tax) AS retx, sum(l_extendedprice) AS cap, sum(l_quantity) AS vol FROM x WHERE l_linenumber <= 4 AND d >= DATE '1995-06-01' GROUP BY 1, 2),
bi AS (SELECT k, d, min(l_extendedprice) AS bid FROM x WHERE l_linenumber >= 3 AND d >= DATE '1995-06-01' GROUP BY 1, 2),
p0 AS (SELECT * FROM pr FULL JOIN bi USING (k, d)),
nm AS (SELECT s_suppkey AS nk, DATE '1995-03-01' + CAST(s_suppkey % 50 + j * 500 AS INTEGER) AS nd, CASE WHEN s_suppkey % 7 <> 0 THEN DATE '1996-05-01' + CAST(s_suppkey % 50 + j * 500 AS INTEGER) END AS ne, 'T' || s_suppkey || j AS ticker, 10 + (s_suppkey + j) % 4 AS sh, (s_suppkey + j) % 5 AS ex FROM supplier, range(4) t(j)),
p1 AS (SELECT p0.*, CASE WHEN p0.d <= coalesce(ne, nd) THEN ticker END AS ticker, CASE WHEN p0.d <= coalesce(ne, nd) THEN sh END AS nsh, CASE WHEN p0.d <= coalesce(ne, nd) THEN ex END AS nex, coalesce(p0.d <= coalesce(ne, nd), false) AS nv FROM p0 ASOF LEFT JOIN nm ON p0.k = nk AND p0.d >= nd),
p2 AS (SELECT p1.*, p1.d <= CASE WHEN k % 3 > 0 THEN DATE '2000-01-01' + CAST(k AS INTEGER) ELSE DATE '1995-01-01' END AS hv FROM p1),
p3 AS (SELECT *, coalesce(nsh, CASE WHEN hv THEN 11 END) AS sh, coalesce(nex, CASE WHEN hv THEN k % 4 END) AS ex FROM p2),
de AS (SELECT s_suppkey AS k, DATE '2000-06-01' + CAST(s_suppkey * 3 AS INTEGER) AS dd FROM supplier WHERE s_suppkey % 4 = 0),
dl AS (SELECT de.k, CASE WHEN EXISTS (SELECT 1 FROM p3 WHERE p3.k = de.k AND p3.d = de.dd) THEN dd ELSE (SELECT max(d) FROM p3 WHERE p3.k = de.k) END AS d, dd FROM de),
f AS (SELECT p3.*, dl.dd, CASE WHEN dl.dd IS NOT NULL THEN -0.3 END AS dr, CASE WHEN dl.dd IS NOT NULL AND p3.k % 8 = 0 THEN -0.2 END AS drx FROM p3 LEFT JOIN dl ON p3.k = dl.k AND p3.d = dl.d),
b AS (SELECT *, coalesce(abs(prc) >= 1, false) AS c1, coalesce(sh IN (10, 11), false) AS c2, coalesce(ex IN (1, 2, 3), false) AS c3, coalesce(vol > 0, false) AS c4, coalesce(cap >= 50000, false) AS c5 FROM f),
panel AS (SELECT *, CASE WHEN ret IS NOT NULL AND dr IS NOT NULL THEN (1 + ret) * (1 + dr) - 1 ELSE coalesce(dr, ret) END AS fr, CASE WHEN dd IS NOT NULL THEN 2.5 ELSE abs(prc) END AS fp,
(ret IS NOT NULL)::BIGINT + 2 * (bid IS NOT NULL)::BIGINT + 8 * (dd IS NOT NULL)::BIGINT + 16 * nv::BIGINT + 32 * hv::BIGINT + 64 * c1::BIGINT + 128 * c2::BIGINT + 256 * c3::BIGINT + 512 * c4::BIGINT + 1024 * c5::BIGINT + 2048 * (c1 AND c2 AND c3 AND c4 AND c5)::BIGINT
+ 4096 * (ret IS NOT NULL AND dr IS NOT NULL)::BIGINT + 8192 * (ret IS NULL AND dr IS NOT NULL)::BIGINT + 16384 * (ret IS NOT NULL AND dr IS NULL)::BIGINT + 32768 * (retx IS NOT NULL AND drx IS NOT NULL)::BIGINT + 65536 * (retx IS NULL AND drx IS NOT NULL)::BIGINT + 131072 * (retx IS NOT NULL AND drx IS NULL)::BIGINT AS st FROM b)
"""


def _panel(spark, sf):
    prices, bids, delist, names, header = _feeds(spark, sf)
    return market.final_returns(market.price_panel(bids, prices, delist, names, header, "1995-06-01"))


@query(_PANEL + "SELECT k AS permno, strftime(d, '%Y-%m-%d') AS day, round(prc, 6) AS prc, round(bid, 4) AS bid, ticker, CAST(sh AS BIGINT) AS shrcd, CAST(ex AS BIGINT) AS exchcd, strftime(dd, '%Y-%m-%d') AS delisted, round(fr, 8) AS final_ret, round(fp, 6) AS final_prc, st AS status FROM panel")
def price_panel(spark, sf):
    """Daily panel from five feeds: outer merge, names and headers valid on the day, delistings on the last day traded, final returns, provenance bits."""
    p = _panel(spark, sf)
    return p.select(
        F.col("KYPERMNO").cast("long").alias("permno"), text_date("CALDT").alias("day"), rounded("PRC").alias("prc"), rounded("BIDLO", 4).alias("bid"), F.col("TICKER").alias("ticker"), F.col("SHRCD").cast("long").alias("shrcd"),
        F.col("EXCHCD").cast("long").alias("exchcd"), text_date("DLSTDT").alias("delisted"), rounded("FINAL_RET", 8).alias("final_ret"), rounded("FINAL_PRC").alias("final_prc"), F.col("data_status").alias("status"),
    )


@query(_PANEL + "SELECT k AS permno, count(*) AS days, round(sum(fr), 6) AS total FROM panel WHERE c2 AND c3 GROUP BY 1")
def common_major_panel(spark, sf):
    """The panel cut to common stock on a major exchange."""
    kept = market.common_major(_panel(spark, sf))
    return kept.groupBy(F.col("KYPERMNO").cast("long").alias("permno")).agg(F.count("*").alias("days"), rounded(F.sum("FINAL_RET")).alias("total"))


def _filings(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    form = F.when(k % 5 == 0, "10-K").when(k % 5 == 1, " 10k-a").when(k % 5 == 2, "10-Q").when(k % 5 == 3, "8-K").otherwise("10-K405")
    clock = F.when(k % 3 == 0, F.format_string("%02d:%02d:00", (k % 24).cast("int"), (k % 60).cast("int"))).when(k % 3 == 1, "late")
    return o.select(k.alias("id"), (F.col("o_custkey") % 10).cast("int").alias("LPERMNO"), form.alias("SRCTYPE"), F.col("o_orderdate").cast("date").alias("FILEDATE"), clock.alias("FILEDATETIME"))


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem), cal AS (SELECT DISTINCT d FROM p),
f AS (SELECT o_custkey % 10 AS k, CAST(o_orderdate AS DATE) AS fd, CASE o_orderkey % 5 WHEN 0 THEN '10K' WHEN 1 THEN '10K/A' WHEN 2 THEN '10Q' WHEN 3 THEN '8K' ELSE '10K405' END AS form,
CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN CAST((o_orderkey % 24) * 60 + o_orderkey % 60 AS INTEGER) ELSE 0 END * INTERVAL 1 MINUTE AS t FROM orders),
a AS (SELECT f.*, cal.d FROM f ASOF LEFT JOIN cal ON f.fd <= cal.d WHERE f.fd >= (SELECT min(d) FROM cal) AND form <> '8K'),
b AS (SELECT k, d, count(*) AS n, string_agg(strftime(t, '%Y-%m-%d %H:%M') || '=' || form, ',' ORDER BY t, form) AS bag FROM a GROUP BY 1, 2)
SELECT k AS permno, strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n_filings, coalesce(bag, '') AS bag, n IS NOT NULL AS has_filing FROM p LEFT JOIN b USING (k, d)
""")
def attach_filings(spark, sf):
    """Filings on the next trading day of the panel, kept as arrays in order of time."""
    panel = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("int").alias("KYPERMNO"), F.col("l_shipdate").cast("date").alias("CALDT")).distinct()
    out = market.attach_filings(panel, _filings(spark, sf), ("10K", "10K/A", "10Q", "10K405"))
    bag = F.array_join(F.zip_with(F.coalesce("filing_times", F.array().cast("array<timestamp>")), F.coalesce("filing_forms", F.array().cast("array<string>")), lambda t, f: F.concat_ws("=", F.date_format(t, "yyyy-MM-dd HH:mm"), f)), ",")
    return out.select(F.col("KYPERMNO").cast("long").alias("permno"), text_date("CALDT").alias("day"), F.col("n_filings").cast("long").alias("n_filings"), bag.alias("bag"), X.has_all(F.col("data_status"), market.FLAGS["HAS_FILING"]).alias("has_filing"))


_DAYLINKS = """
WITH l AS (SELECT s_suppkey AS k, CAST(n_nationkey AS VARCHAR) AS gvkey, CASE WHEN h % 5 > 0 THEN DATE '1995-01-01' + CAST(h * 20 AS INTEGER) END AS vs, CASE WHEN h % 4 > 0 THEN DATE '1996-01-01' + CAST(h * 25 AS INTEGER) END AS ve,
10 + 10 * (h % 3) AS tier, h % 2 AS pr, h % 7 AS rk, CAST(h % 5 AS DOUBLE) AS q, h % 6 = 0 AS sparse FROM (SELECT *, (s_suppkey * 17 + n_nationkey * 29) % 100 AS h FROM supplier, nation WHERE (s_suppkey + n_nationkey) % 6 = 0)),
p AS (SELECT DISTINCT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem),
v AS (SELECT p.k, p.d, l.* EXCLUDE (k), row_number() OVER (PARTITION BY p.k, p.d ORDER BY sparse, tier, pr, rk, q DESC, coalesce(vs, DATE '0001-01-01') DESC, coalesce(ve, DATE '9999-12-31'), gvkey) AS n FROM p JOIN l USING (k) WHERE (vs IS NULL OR vs <= p.d) AND (ve IS NULL OR p.d <= ve)),
dl AS (SELECT p.k, p.d, v.gvkey, v.sparse, v.rk, v.q FROM p LEFT JOIN (SELECT * FROM v WHERE n = 1) v USING (k, d))
"""


def _day_links(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    h = F.col("h")
    x = s.join(n, (F.col("s_suppkey") + F.col("n_nationkey")) % 6 == 0).withColumn("h", (F.col("s_suppkey") * 17 + F.col("n_nationkey") * 29) % 100)
    return x.select(
        F.col("s_suppkey").cast("int").alias("kypermno"), F.col("n_nationkey").cast("string").alias("gvkey"), F.lit("01").alias("liid"), F.lit("LC").alias("linktype"), F.when(h % 5 > 0, _day("1995-01-01", h * 20)).alias("valid_start"),
        F.when(h % 4 > 0, _day("1996-01-01", h * 25)).alias("valid_end"), (10 + 10 * (h % 3)).cast("int").alias("row_quality_tier"), (h % 2).cast("int").alias("source_priority"), (h % 7).cast("int").alias("link_rank_effective"),
        (h % 5).cast("double").alias("link_quality"), (h % 6 != 0).alias("has_window"), (h % 6 == 0).alias("is_sparse_fallback"),
    )


def _linked_panel(spark, sf):
    panel = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("int").alias("KYPERMNO"), F.col("l_shipdate").cast("date").alias("CALDT")).distinct()
    return market.attach_links(panel, _day_links(spark, sf).filter("kypermno >= 0").withColumn("kypermno", F.col("kypermno")))


@query(_DAYLINKS + "SELECT k AS permno, strftime(d, '%Y-%m-%d') AS day, CASE WHEN k > 0 THEN gvkey END AS gvkey, CASE WHEN gvkey IS NULL OR k = 0 THEN 'no_link' WHEN sparse THEN 'sparse' WHEN q >= 4 THEN 'primary' WHEN q >= 2 THEN 'secondary' ELSE 'weak' END AS quality, CAST(CASE WHEN k > 0 THEN coalesce(rk, 9) ELSE 9 END AS BIGINT) AS link_rank FROM dl")
def attach_links(spark, sf):
    """Each security and day with its best valid company link; sparse ones only where no other is valid."""
    out = _linked_panel(spark, sf)
    return out.select(F.col("KYPERMNO").cast("long").alias("permno"), text_date("CALDT").alias("day"), "gvkey", F.col("link_quality_flag").alias("quality"), F.col("link_rank").cast("long").alias("link_rank"))


@query(_DAYLINKS + """,
sh AS (SELECT n_nationkey AS g, DATE '1995-02-01' + CAST(j * 600 + n_nationkey AS INTEGER) AS a, CASE WHEN n_nationkey % 4 > 0 THEN DATE '1996-02-01' + CAST(j * 600 + n_nationkey AS INTEGER) END AS b, CASE WHEN j <> 1 THEN 'C' || n_nationkey || j END AS cusip FROM nation, range(3) t(j)),
ch AS (SELECT n_nationkey AS g, DATE '1995-05-01' + CAST(j * 700 AS INTEGER) AS a, CASE WHEN j < 2 THEN DATE '1996-11-01' + CAST(j * 700 AS INTEGER) END AS b, 100 * n_nationkey + j AS sic FROM nation, range(3) t(j)),
x AS (SELECT *, CASE WHEN k > 0 THEN TRY_CAST(gvkey AS BIGINT) END AS g FROM dl),
s1 AS (SELECT x.*, sh.a AS sa, sh.a IS NOT NULL AND (sh.b IS NULL OR x.d <= sh.b) AS sok, sh.cusip FROM x ASOF LEFT JOIN sh ON x.g = sh.g AND x.d >= sh.a),
c1 AS (SELECT s1.*, ch.a AS ca, ch.a IS NOT NULL AND (ch.b IS NULL OR s1.d <= ch.b) AS cok, ch.sic FROM s1 ASOF LEFT JOIN ch ON s1.g = ch.g AND s1.d >= ch.a)
SELECT k AS permno, strftime(d, '%Y-%m-%d') AS day, coalesce(CASE WHEN sok THEN cusip END, CASE WHEN g IS NOT NULL THEN 'H' || g END) AS cusip, CASE WHEN cok THEN sic END AS sic,
4194304 * sok::BIGINT + 8388608 * (sa IS NOT NULL AND NOT sok)::BIGINT + 16777216 * (g IS NOT NULL AND (NOT sok OR cusip IS NULL))::BIGINT + 33554432 * cok::BIGINT + 67108864 * (ca IS NOT NULL AND NOT cok)::BIGINT + 134217728 * (g IS NULL)::BIGINT AS status FROM c1""")
def merge_histories(spark, sf):
    """Security and company attributes of the day; stale ones blank, the header fills identifiers, no row is dropped."""
    g = F.col("n_nationkey")
    n = table(spark, sf, "nation").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    security = n.select(
        g.alias("KYGVKEY"), F.lit("01").alias("KYIID"), _day("1995-02-01", F.col("j") * 600 + g).alias("HSCHGDT"), F.when(g % 4 > 0, _day("1996-02-01", F.col("j") * 600 + g)).alias("HSCHGENDDT"),
        F.when(F.col("j") != 1, F.concat(F.lit("C"), g, F.col("j"))).alias("HSCUSIP"),
    )
    header = table(spark, sf, "nation").select(g.alias("KYGVKEY"), F.lit("01").alias("KYIID"), _day("1995-01-01", g * 0).alias("SBEGDT"), F.concat(F.lit("H"), g).alias("SCUSIP"))
    company = n.select(g.alias("KYGVKEY"), _day("1995-05-01", F.col("j") * 700).alias("HCHGDT"), F.when(F.col("j") < 2, _day("1996-11-01", F.col("j") * 700)).alias("HCHGENDDT"), (100 * g + F.col("j")).alias("HSIC"))
    out = market.merge_histories(_linked_panel(spark, sf).drop("data_status"), security, header, company)
    return out.select(F.col("KYPERMNO").cast("long").alias("permno"), text_date("CALDT").alias("day"), F.col("HSCUSIP").alias("cusip"), F.col("HSIC").cast("long").alias("sic"), F.col("data_status").alias("status"))


@query(_DAYLINKS + """, m AS (SELECT c_nationkey AS g, c_custkey % 7 AS v, count(*) AS n FROM customer GROUP BY 1, 2), d AS (SELECT g, v FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, lpad(CAST(v AS VARCHAR), 10, '0')) AS r FROM m) WHERE r = 1)
SELECT k AS permno, strftime(dl.d, '%Y-%m-%d') AS day, lpad(CAST(m.v AS VARCHAR), 10, '0') AS cik FROM dl LEFT JOIN d m ON m.g = CASE WHEN k > 0 THEN TRY_CAST(gvkey AS BIGINT) END""")
def attach_company_description(spark, sf):
    """Filer identifiers from the description's most frequent value."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("KYGVKEY"), (F.col("c_custkey") % 7).cast("string").alias("CIK"))
    out = market.attach_company_description(_linked_panel(spark, sf), c)
    return out.select(F.col("KYPERMNO").cast("long").alias("permno"), text_date("CALDT").alias("day"), F.col("CIK").alias("cik"))


_CANON = """
WITH h AS (SELECT CAST(c_nationkey AS VARCHAR) AS g, CAST(c_custkey AS INTEGER) AS p, '01' AS iid, CASE WHEN c_custkey % 9 > 0 THEN DATE '1995-01-01' + CAST(c_custkey % 300 AS INTEGER) END AS ls, CASE WHEN c_custkey % 9 > 1 THEN DATE '1998-01-01' + CAST(c_custkey % 400 AS INTEGER) END AS le,
CASE WHEN c_custkey % 9 > 0 THEN ['LC', 'LU', 'LX', 'zz'][c_custkey % 4 + 1] END AS t, CASE WHEN c_custkey % 9 > 0 THEN ['P', 'C', 'N'][c_custkey % 3 + 1] END AS pm, CASE WHEN c_custkey % 9 > 0 AND c_custkey % 10 = 3 THEN 5 END AS raw, 'linkhistory' AS src, 1 AS pr FROM customer),
f AS (SELECT CAST(s_nationkey AS VARCHAR) AS g, CAST(s_suppkey AS INTEGER) AS p, '02' AS iid, NULL::DATE AS ls, DATE '1999-06-30' AS le, 'LC' AS t, 'P' AS pm, NULL AS raw, 'linkfiscal' AS src, 2 AS pr FROM supplier),
l AS (SELECT DISTINCT * FROM (SELECT * FROM h UNION ALL SELECT * FROM f)),
w AS (SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS g, lpad(CAST(n_nationkey * 3 + j AS VARCHAR), 10, '0') AS cik, DATE '1995-06-01' + CAST(j * 900 AS INTEGER) AS cs, CASE WHEN j = 0 THEN DATE '1997-11-16' END AS ce FROM nation, range(2) t(j) WHERE n_nationkey % 3 > 0),
w2 AS (SELECT g, cik, CASE WHEN cs > min(cs) OVER (PARTITION BY g) THEN cs END AS cs, ce FROM w UNION ALL SELECT CAST(n_nationkey AS VARCHAR), lpad(CAST(500 + n_nationkey AS VARCHAR), 10, '0'), NULL, NULL FROM nation WHERE n_nationkey % 3 = 0),
j AS (SELECT l.*, w2.cik, w2.cs, w2.ce, greatest(ls, cs) AS vs, least(le, ce) AS ve, t IS NULL AND pm IS NULL AND ls IS NULL AND le IS NULL AND raw IS NULL AS sparse FROM l LEFT JOIN w2 USING (g)),
c AS (SELECT *, CASE WHEN raw >= 1 THEN raw ELSE 90 + CASE t WHEN 'LC' THEN 0 WHEN 'LU' THEN 1 WHEN 'LX' THEN 3 ELSE 9 END + CASE pm WHEN 'P' THEN 0 WHEN 'C' THEN 1 WHEN 'N' THEN 3 ELSE 9 END END AS rk,
CASE WHEN sparse THEN 0.1 WHEN t = 'LC' AND pm IN ('P', 'C') THEN 4.0 WHEN t = 'LC' THEN 3.0 WHEN t = 'LU' THEN 2.0 ELSE 1.0 END AS q, CASE WHEN sparse THEN 90 WHEN (ls IS NOT NULL OR le IS NOT NULL) AND pr = 1 THEN 10 WHEN ls IS NOT NULL OR le IS NOT NULL THEN 20 ELSE 40 END AS tier FROM j WHERE vs IS NULL OR ve IS NULL OR vs <= ve)
"""


def _canonical(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    of = lambda v, names: F.element_at(F.array(*[F.lit(x) for x in names]), (v + 1).cast("int"))
    history = c.select(
        F.col("c_nationkey").cast("string").alias("KYGVKEY"), k.alias("LPERMNO"), F.lit("01").alias("LIID"), F.when(k % 9 > 0, _day("1995-01-01", k % 300)).alias("LINKDT"), F.when(k % 9 > 1, _day("1998-01-01", k % 400)).alias("LINKENDDT"),
        F.when(k % 9 > 0, of(k % 4, ("LC", "LU", "LX", "zz"))).alias("LINKTYPE"), F.when(k % 9 > 0, of(k % 3, ("P", "C", "N"))).alias("LINKPRIM"), F.when((k % 9 > 0) & (k % 10 == 3), 5).alias("LINKRANK"),
    )
    fiscal = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("KYGVKEY"), F.col("s_suppkey").alias("LPERMNO"), F.lit("02").alias("LIID"), F.lit(None).cast("date").alias("LINKDT"), F.to_date(F.lit("1999-06-30")).alias("LINKENDDT"), F.lit("LC").alias("LINKTYPE"), F.lit("P").alias("LINKPRIM"))
    n, g = table(spark, sf, "nation"), F.col("n_nationkey")
    windows_ = n.filter("n_nationkey % 3 > 0").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    company = windows_.select(g.alias("KYGVKEY"), (g * 3 + F.col("j")).cast("string").alias("HCIK"), _day("1995-06-01", F.col("j") * 900).alias("HCHGDT"), F.when(F.col("j") == 0, F.to_date(F.lit("1997-11-16"))).alias("HCHGENDDT"))
    description = n.select(g.alias("KYGVKEY"), (500 + g).cast("string").alias("CIK"))
    return links.canonical_links(history, fiscal, company, description)


@query(_CANON + "SELECT DISTINCT cik AS cik_10, g AS gvkey, p AS kypermno, strftime(vs, '%Y-%m-%d') AS valid_start, strftime(ve, '%Y-%m-%d') AS valid_end, CAST(rk AS BIGINT) AS link_rank, CAST(q AS DOUBLE) AS quality, CAST(tier AS BIGINT) AS tier, src AS link_source, sparse FROM c")
def canonical_links(spark, sf):
    """Two link feeds with their filers' identifiers and the common part of both windows, ranked and graded."""
    out = _canonical(spark, sf)
    return out.select("cik_10", "gvkey", F.col("kypermno").cast("int").alias("kypermno"), text_date("valid_start").alias("valid_start"), text_date("valid_end").alias("valid_end"), F.col("link_rank_effective").cast("long").alias("link_rank"), F.col("link_quality").alias("quality"), F.col("row_quality_tier").cast("long").alias("tier"), "link_source", F.col("is_sparse_fallback").alias("sparse"))


@query(_CANON + """, u AS (SELECT DISTINCT cik, g, p, iid, vs, ve, ls, le, cs, ce, t, pm, raw, rk, q, src, tier, sparse FROM c)
SELECT count(*) AS rows, count(DISTINCT cik) AS filers, count(DISTINCT g) AS companies, count(DISTINCT p) AS securities, round(avg(CASE WHEN ls IS NOT NULL OR le IS NOT NULL THEN 1.0 ELSE 0 END), 8) AS with_window, round(avg(CASE WHEN sparse THEN 1.0 ELSE 0 END), 8) AS sparse FROM u WHERE length(cik) = 10""")
def link_coverage(spark, sf):
    """Coverage of the normalised link table, in one row."""
    out = links.link_coverage(links.normalize_links(_canonical(spark, sf), strict=True))
    return out.select("rows", "filers", "companies", "securities", rounded("with_window", 8).alias("with_window"), rounded("sparse", 8).alias("sparse"))


@query("""
WITH x AS (SELECT c_custkey AS k, ['LC', 'lu', 'LS', 'LX', 'LD', 'LN', 'NR'][c_custkey % 7 + 1] AS t, ['P', 'c', 'J', 'N', 'Q'][c_custkey % 5 + 1] AS p FROM customer)
SELECT k, CASE upper(t) WHEN 'LC' THEN 0 WHEN 'LU' THEN 1 WHEN 'LS' THEN 2 WHEN 'LX' THEN 3 WHEN 'LD' THEN 4 WHEN 'LN' THEN 5 ELSE 9 END AS type_rank, CASE upper(p) WHEN 'P' THEN 0 WHEN 'C' THEN 1 WHEN 'J' THEN 2 WHEN 'N' THEN 3 ELSE 9 END AS prim_rank FROM x
""")
def link_code_ranks(spark, sf):
    """Ranks of link types and primary markers."""
    k = F.col("c_custkey")
    of = lambda v, names: F.element_at(F.array(*[F.lit(x) for x in names]), (v + 1).cast("int"))
    x = table(spark, sf, "customer").select(k.alias("k"), of(k % 7, ("LC", "lu", "LS", "LX", "LD", "LN", "NR")).alias("t"), of(k % 5, ("P", "c", "J", "N", "Q")).alias("p"))
    return x.select("k", links.type_rank(F.col("t")).alias("type_rank"), links.prim_rank(F.col("p")).alias("prim_rank"))


_ANNUAL = """
WITH a AS (SELECT c_custkey AS k, 1995 + j AS y, 1 + (c_custkey + j) % 12 AS m, c_acctbal AS v, c_custkey + j AS h FROM customer, range(5) t(j) WHERE (c_custkey + j) % 6 > 0),
b AS (SELECT k, y, CASE WHEN h % 8 <> 7 THEN make_date(y, CAST(m AS INTEGER), 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY ELSE DATE '1994-12-31' + CAST(365 * (y - 1994) + h % 20 AS INTEGER) END::DATE AS pe, v * 3 AS ta, v AS lt,
coalesce(CASE WHEN h % 5 > 0 THEN v * 2 END, CASE WHEN h % 5 = 0 AND h % 10 > 0 THEN v END + h % 7, v * 3 - v) - coalesce(CASE WHEN h % 4 = 1 THEN 7.0 END, CASE WHEN h % 4 = 2 THEN 8.0 END, CAST(h % 7 AS DOUBLE), 0) + coalesce(CASE WHEN h % 3 > 0 THEN 5.0 END, 0) AS be,
v / 10 + 2.0 + coalesce(CASE WHEN h % 2 = 0 THEN 1.5 END, 0) AS e, v / 10 - 1.0 + coalesce(CASE WHEN h % 2 = 0 THEN 1.5 END, 0) AS cf, CASE WHEN h % 9 > 0 THEN CASE WHEN h % 3 = 1 THEN NULL ELSE v * 4 END END AS mv, CASE WHEN h % 9 > 0 THEN abs(-v / 100) * 50 END AS alt FROM a)
"""


def _annual(spark, sf):
    c = table(spark, sf, "customer").withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(5)]))).filter("(c_custkey + j) % 6 > 0")
    h, v = F.col("c_custkey") + F.col("j"), F.col("c_acctbal")
    c = c.withColumn("KYGVKEY", F.col("c_custkey")).withColumn("KEYSET", F.lit("STD")).withColumn("FYYYY", 1995 + F.col("j")).withColumn("fyra", F.lit(12))
    keys = ["KYGVKEY", "KEYSET", "FYYYY", "fyra"]
    balance = c.select(
        *keys, F.when(h % 5 > 0, v * 2).alias("SEQ"), F.when((h % 5 == 0) & (h % 10 > 0), v).alias("CEQ"), (v * 3).alias("AT"), v.alias("LT"), F.when(h % 3 > 0, 5.0).alias("TXDITC"), F.when(h % 4 == 1, 7.0).alias("PSTKL"), F.when(h % 4 == 2, 8.0).alias("PSTKRV"), (h % 7).cast("double").alias("PSTK"),
    )
    income = c.select(*keys, (v / 10).alias("IB"), F.lit(2.0).alias("XINT"), F.when(h % 2 == 0, 1.5).alias("TXDI"), F.lit(1.0).alias("DVP"))
    odd_end = _day("1994-12-31", 365 * (F.col("FYYYY") - 1994) + h % 20)
    period = c.select(*keys, F.col("FYYYY").alias("FYEAR"), (1 + h % 12).cast("int").alias("FYR"), F.when(h % 8 == 7, odd_end).alias("APDEDATE"))
    end = F.coalesce(F.when(h % 8 == 7, odd_end), X.fiscal_year_end(F.col("FYYYY"), (1 + h % 12).cast("int")))
    market_rows = c.filter((F.col("c_custkey") + F.col("j")) % 9 > 0).select("KYGVKEY", end.alias("DATADATE"), F.when(h % 3 != 1, v * 4).alias("MKVALT"), (-v / 100).alias("PRCC"), F.lit(50.0).alias("CSHO"))
    return accounting.annual_panel(balance, income, period, market_rows)


@query(_ANNUAL + "SELECT k, CAST(y AS BIGINT) AS y, strftime(pe, '%Y-%m-%d') AS period_end, round(be, 4) AS book_equity, round(e, 4) AS earnings, round(cf, 4) AS cash_flow, round(ta - be + coalesce(mv, alt), 4) AS firm_value FROM b")
def annual_panel(spark, sf):
    """Book equity, earnings, cash flow and firm value a company and year, from four tables."""
    p = _annual(spark, sf)
    return p.select(F.col("KYGVKEY").alias("k"), F.col("FYYYY").cast("long").alias("y"), text_date("accounting_period_end").alias("period_end"), rounded("book_equity_be", 4).alias("book_equity"), rounded("earnings_e", 4).alias("earnings"), rounded("cash_flow_y", 4).alias("cash_flow"), rounded("firm_value_v", 4).alias("firm_value"))


@query(_ANNUAL + """, u AS (SELECT k, pe, max(be) AS be FROM b GROUP BY 1, 2), o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS fd FROM orders)
SELECT o_orderkey, CASE WHEN datediff('day', pe, fd) <= 365 THEN strftime(pe, '%Y-%m-%d') END AS period_end, round(CASE WHEN datediff('day', pe, fd) <= 365 THEN be END, 4) AS book_equity FROM o ASOF LEFT JOIN u ON o_custkey = u.k AND fd >= pe""")
def attach_annual(spark, sf):
    """The latest annual row at or before each filing; one over a year old is blank."""
    annual = _annual(spark, sf).groupBy("gvkey_int", "accounting_period_end").agg(F.max("book_equity_be").alias("book_equity_be"))
    f = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("gvkey_int"), F.col("o_orderdate").cast("date").alias("filing_date"))
    out = accounting.attach_latest_annual(f, annual, ["book_equity_be"])
    return out.select("o_orderkey", text_date("asof_accounting_period_end").alias("period_end"), rounded("book_equity_be", 4).alias("book_equity"))


@query("""
WITH q AS (SELECT c_custkey AS k, j, DATE '1995-01-31' + CAST(j * 91 + c_custkey % 30 AS INTEGER) AS pe, c_custkey + j AS h, c_acctbal AS v FROM customer, range(26) t(j) WHERE (c_custkey + j) % 5 > 0),
r AS (SELECT k, v + j AS seq, CASE WHEN h % 3 = 0 THEN pe + 20 WHEN h % 3 = 1 AND h % 4 > 0 THEN pe + 35 WHEN h % 3 = 1 THEN pe ELSE pe END AS rd FROM q),
u AS (SELECT k, rd, max(seq) AS seq FROM r GROUP BY 1, 2), o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS fd FROM orders)
SELECT o_orderkey, CASE WHEN datediff('day', fd, rd) <= 90 THEN strftime(rd, '%Y-%m-%d') END AS report_date, round(CASE WHEN datediff('day', fd, rd) <= 90 THEN seq END, 4) AS seq FROM o ASOF LEFT JOIN u ON o_custkey = u.k AND fd < rd
""")
def attach_quarterly(spark, sf):
    """Quarterly rows by report date (announcement, filing or period end); the first one strictly after a filing, within 90 days."""
    c = table(spark, sf, "customer").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(25)))).filter("(c_custkey + j) % 5 > 0")
    h = F.col("c_custkey") + F.col("j")
    end = _day("1995-01-31", F.col("j") * 91 + F.col("c_custkey") % 30)
    c = c.withColumn("KYGVKEY", F.col("c_custkey")).withColumn("KEYSET", F.lit("STD")).withColumn("FYYYYQ", F.col("j")).withColumn("fyrq", F.lit(12)).withColumn("pe", end)
    keys = ["KYGVKEY", "KEYSET", "FYYYYQ", "fyrq"]
    announced = F.when(h % 3 == 0, F.date_format(F.date_add("pe", 20), "yyyyMMdd").cast("int")).otherwise(F.when(h % 3 == 1, 20201399))
    period = c.select(*keys, announced.alias("RDQ"), F.when((h % 3 == 1) & (h % 4 > 0), F.date_add("pe", 35)).alias("FDATEQ"), F.col("pe").alias("APDEDATEQ"))
    q = accounting.quarterly_panel(c.select(*keys, (F.col("c_acctbal") + F.col("j")).alias("SEQQ")), c.select(*keys, F.lit(1.0).alias("IBQ")), period)
    q = q.groupBy("gvkey_int", "quarter_report_date").agg(F.max("SEQQ").alias("SEQQ"))
    f = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("gvkey_int"), F.col("o_orderdate").cast("date").alias("filing_date"))
    out = accounting.attach_next_quarter(f, q, ["SEQQ"])
    return out.select("o_orderkey", text_date("asof_quarter_report_date").alias("report_date"), rounded("SEQQ", 4).alias("seq"))


_BACKBONE = """
WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc, o_custkey AS cik, CAST(o_orderdate AS DATE) AS fd, o_orderkey % 6 AS f FROM orders),
w AS (SELECT * FROM d WHERE fd BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'), k AS (SELECT * FROM w WHERE f IN (0, 1)),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, year(fd) ORDER BY fd, doc) AS n FROM k) WHERE n = 1),
s AS (SELECT * FROM (SELECT *, lag(fd) OVER (PARTITION BY cik ORDER BY fd, doc) AS p FROM y) WHERE p IS NULL OR datediff('day', p, fd) >= 180)
"""


@query(_BACKBONE + "SELECT 'distinct' AS stage, count(*) AS n FROM d UNION ALL SELECT 'window', count(*) FROM w UNION ALL SELECT 'form', count(*) FROM k UNION ALL SELECT 'first_of_year', count(*) FROM y UNION ALL SELECT 'spaced', count(*) FROM s")
def sample_backbone(spark, sf):
    """Rows left at every stage of the filing sample."""
    stages = _backbone(spark, sf)
    return contracts.union_relaxed([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()])


@query(_BACKBONE + "SELECT doc, cik, strftime(fd, '%Y-%m-%d') AS day, '10-K' AS form FROM s")
def sample_backbone_rows(spark, sf):
    out = _backbone(spark, sf)["spaced"]
    return out.select(F.col("doc_id").alias("doc"), F.col("cik_10").alias("cik"), text_date("filing_date").alias("day"), F.col("normalized_form").alias("form"))


def _backbone(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey") % 6
    form = F.element_at(F.array(*[F.lit(x) for x in ("10-K", "10K405", "10-K/A", "10-Q", "10-KT", "8-K")]), (k + 1).cast("int"))
    f = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("string").alias("accession"), F.col("o_custkey").alias("cik_10"), F.col("o_orderdate").cast("date").alias("filing_date"), form.alias("form"))
    return accounting.sample_backbone(f.unionByName(f.filter("cik_10 % 3 = 0")), "1996-01-01", "2000-06-30")  # some documents come twice


@query("""
SELECT k, CASE WHEN f IS NULL THEN NULL ELSE coalesce(CASE upper(replace(replace(trim(f), '-', ''), ' ', '')) WHEN '10K' THEN '10-K' WHEN '10K405' THEN '10-K' WHEN '10KT' THEN '10-K' WHEN '10KA' THEN '10-K/A' WHEN '10K/A' THEN '10-K/A' WHEN '10K405/A' THEN '10-K/A' WHEN '10QT' THEN '10-Q' WHEN '20F/A' THEN '20-F/A' WHEN '40F' THEN '40-F' END, 'Other') END AS form
FROM (SELECT o_orderkey AS k, ['10-K', ' 10k405', '10-KT', '10-K-A', '10-K/A', '10-K405/A', '10-QT', '20-F/A', '40F', 'NT 10-K', NULL][o_orderkey % 11 + 1] AS f FROM orders)
""")
def canonical_forms(spark, sf):
    """Form types in their canonical names; nulls stay null."""
    names = ("10-K", " 10k405", "10-KT", "10-K-A", "10-K/A", "10-K405/A", "10-QT", "20-F/A", "40F", "NT 10-K", None)
    f = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 11 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), accounting.normalized_form(f).alias("form"))


@query("""
WITH x AS (SELECT p_partkey AS k, CAST([10, 11, 12, 18, 23, 31, 48, 71, 99, 14][p_partkey % 10 + 1] AS INTEGER) AS s, p_partkey % 7 AS e FROM part)
SELECT k, CASE WHEN s // 10 IN (1, 2, 3, 4, 7) AND s % 10 IN (0, 1, 2, 3, 4, 5, 8) THEN CASE s // 10 WHEN 1 THEN 'Ordinary Common' WHEN 2 THEN 'Certificates' WHEN 3 THEN 'ADR' WHEN 4 THEN 'Shares of Beneficial Interest' ELSE 'Units' END || ' / ' ||
CASE s % 10 WHEN 0 THEN 'Not Further Defined' WHEN 1 THEN 'Not Needing Further Definition' WHEN 2 THEN 'Non-US Incorporated' WHEN 3 THEN 'Americus Trust' WHEN 4 THEN 'Closed-End Fund' WHEN 5 THEN 'Closed-End Fund Non-US' ELSE 'REIT' END END AS share_name,
CASE e WHEN 1 THEN 'NYSE' WHEN 2 THEN 'AMEX' WHEN 3 THEN 'NASDAQ' WHEN 4 THEN 'ARCA' WHEN 5 THEN 'BATS' END AS exchange FROM x
""")
def code_names(spark, sf):
    """Names of share and exchange codes."""
    k = F.col("p_partkey")
    s = F.element_at(F.array(*[F.lit(x) for x in (10, 11, 12, 18, 23, 31, 48, 71, 99, 14)]), (k % 10 + 1).cast("int"))
    return table(spark, sf, "part").select(k.alias("k"), X.share_code_name(s).alias("share_name"), X.exchange_name(k % 7).alias("exchange"))


@query("""
SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END, abs(-l_tax) * l_quantity) / 1000, 8) AS equity, round(CASE WHEN l_discount > 0 THEN l_quantity / (l_discount * 1000) END, 8) AS turnover,
round(CASE WHEN l_tax > 0 THEN ln(l_tax) END, 8) AS log_tax, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS finite, CASE WHEN l_discount > 0.5 THEN 'negative' WHEN l_quantity / 50 > 0.5 THEN 'neutral' WHEN l_tax * 10 > 0.5 THEN 'positive' ELSE 'no_majority' END AS majority,
round(ln(greatest(l_discount, 1e-6) / (1 - greatest(l_discount, 1e-6))), 6) AS logit, strftime(date_trunc('month', l_shipdate)::DATE - 1, '%Y-%m-%d') AS month_before FROM lineitem
""")
def scalar_measures(spark, sf):
    """Units of equity and turnover, logarithms where positive, infinities to null, majority class, clipped logit, the month before."""
    q, d, t, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(X.market_equity_millions(F.when(n % 2 == 0, F.col("l_extendedprice")), -t, q), 8).alias("equity"), rounded(X.turnover_ratio(q, d), 8).alias("turnover"), rounded(X.log_positive(t), 8).alias("log_tax"),
        X.finite_or_null(F.when(n == 3, float("inf")).otherwise(q)).alias("finite"), X.majority_bucket(d, q / 50, t * 10).alias("majority"), rounded(X.clipped_logit(d)).alias("logit"), text_date(X.month_end_before(F.col("l_shipdate").cast("date"))).alias("month_before"),
    )


@query("""
WITH x AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' US' || c_custkey WHEN 2 THEN NULL ELSE 'I' || c_custkey || ' ' END AS i, CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'C' || c_custkey END AS c, CASE c_custkey % 5 WHEN 0 THEN NULL ELSE 'T' || c_custkey END AS t FROM customer)
SELECT k, coalesce(nullif(trim(i), ''), nullif(trim(c), ''), nullif(trim(t), '')) AS value, CASE WHEN nullif(trim(i), '') IS NOT NULL THEN 'ISIN' WHEN nullif(trim(c), '') IS NOT NULL THEN 'CUSIP' WHEN t IS NOT NULL THEN 'TICKER' END AS kind FROM x
""")
def preferred_identifiers(spark, sf):
    """The best identifier of each row and its kind; blanks count as missing."""
    k = F.col("c_custkey")
    i = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit(" US"), k)).when(k % 4 == 3, F.concat(F.lit("I"), k, F.lit(" ")))
    value, kind = X.preferred_identifier(i, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("C"), k)), F.when(k % 5 != 0, F.concat(F.lit("T"), k)))
    return table(spark, sf, "customer").select(k.alias("k"), value.alias("value"), kind.alias("kind"))


@query("""
WITH a AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS s FROM customer), b AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier)
SELECT 'relaxed' AS kind, count(*) AS n, count(s) AS with_s, round(sum(v), 2) AS total FROM (SELECT k, v, s FROM a UNION ALL SELECT k, v, NULL FROM b)
UNION ALL SELECT 'aligned', count(*), count(s), round(sum(v), 2) FROM (SELECT k, v, s FROM a UNION ALL SELECT k, v, 'none' FROM b)
UNION ALL SELECT 'keys', count(*), 0, NULL FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'both', count(*), 0, NULL FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left', count(*), 0, NULL FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
""")
def unions(spark, sf):
    """Unions of tables with unlike columns, aligned to a schema, and of keys; intersection and difference."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), F.col("s_acctbal").cast("string").alias("v"))
    contracts.require_columns(a, ("k", "v", "s"), "customers")
    relaxed = contracts.union_relaxed([a, contracts.project_with_defaults(b, {"k": "bigint", "v": "double"})])
    aligned = contracts.align_to(a, a.schema).union(contracts.project_with_defaults(b, {"k": "bigint", "v": "double", "s": "string"}, {"s": "none"}))
    one = lambda name, df: df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.count("s").alias("with_s"), rounded(F.sum("v"), 2).alias("total"))
    keys = [a.select("k").union(b.select("k")).distinct(), a.select("k").intersect(b.select(F.col("k").cast("long"))), a.select("k").exceptAll(b.select(F.col("k").cast("long"))).distinct()]
    rest = [df.agg(F.lit(n).alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("with_s"), F.lit(None).cast("double").alias("total")) for n, df in zip(("keys", "both", "left"), keys, strict=True)]
    return contracts.union_relaxed([one("relaxed", relaxed), one("aligned", aligned), *rest])


@query("""
WITH p AS (SELECT o_custkey % 50 AS k, '01' AS l, CASE WHEN o_orderkey % 3 > 0 THEN 'C' || (o_custkey % 3) END AS c, 'I' || (o_custkey % 2) AS i, CASE WHEN o_orderkey % 4 > 0 THEN 'T' END AS t, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS n, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey END AS a FROM orders)
SELECT k || ':01:' || coalesce(c, '-') || ':' || i || ':' || coalesce(t, '-') AS row_id, i AS lookup, strftime(min(d), '%Y-%m-%d') AS first_seen, strftime(max(d), '%Y-%m-%d') AS last_seen, count(DISTINCT d) AS days, count(*) FILTER (WHERE n > 0) AS filing_days,
arg_max(d, d) FILTER (WHERE a IS NOT NULL) IS NOT NULL AS has_attribute FROM p GROUP BY k, c, i, t
""")
def bridge_spans(spark, sf):
    """One row per security and identifiers with spans, days and a key."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    p = o.select(
        (F.col("o_custkey") % 50).alias("KYPERMNO"), F.lit("01").alias("LIID"), F.when(k % 3 > 0, F.concat(F.lit("C"), F.col("o_custkey") % 3)).alias("CUSIP"), F.concat(F.lit("I"), F.col("o_custkey") % 2).alias("ISIN"), F.when(k % 4 > 0, "T").alias("TICKER"),
        F.col("o_orderdate").cast("date").alias("CALDT"), (k % 5).alias("n_filings"), F.when(k % 7 > 0, k).alias("attribute"),
    )
    out = enrich.bridge_universe(p)
    return out.select(F.col("bridge_row_id").alias("row_id"), F.col("preferred_lookup_id").alias("lookup"), text_date("first_seen_caldt").alias("first_seen"), text_date("last_seen_caldt").alias("last_seen"), "days", "filing_days", F.col("attribute").isNotNull().alias("has_attribute"))


@query("""
WITH b AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'R' || (o_custkey % 4) WHEN o_orderkey % 7 = 1 THEN ' ' END AS i, CASE WHEN o_orderkey % 5 = 0 THEN 'R' || (o_orderkey % 2) END AS c FROM orders),
e AS (SELECT *, CASE WHEN nullif(trim(i), '') <> c THEN NULL ELSE coalesce(nullif(trim(i), ''), c) END AS acc, coalesce(nullif(trim(i), '') <> c, false) AS conflict FROM b),
w AS (SELECT *, lag(acc) OVER (PARTITION BY k ORDER BY d, id) AS p, lead(acc) OVER (PARTITION BY k ORDER BY d, id) AS n FROM e),
s AS (SELECT *, CASE WHEN acc IS NOT NULL THEN 'ACCEPTED' WHEN conflict THEN 'CONFLICT' WHEN p <> n THEN 'NEIGHBOURS_DISAGREE' WHEN coalesce(p, n) IS NOT NULL THEN 'EXTENDED' ELSE 'UNRESOLVED' END AS status FROM w)
SELECT id, status, CASE status WHEN 'ACCEPTED' THEN acc WHEN 'EXTENDED' THEN coalesce(p, n) END AS ric FROM s
""")
def resolve_identifiers(spark, sf):
    """Look-ups that agree are accepted; open spans take what their accepted neighbours agree on."""
    k = F.col("o_orderkey")
    b = table(spark, sf, "orders").select(
        k.alias("bridge_row_id"), F.col("o_custkey").alias("KYPERMNO"), F.lit("01").alias("LIID"), F.col("o_orderdate").cast("date").alias("first_seen_caldt"), F.col("o_orderdate").cast("date").alias("last_seen_caldt"),
        F.when(k % 3 == 0, F.concat(F.lit("R"), F.col("o_custkey") % 4)).when(k % 7 == 1, " ").alias("isin_ric"), F.when(k % 5 == 0, F.concat(F.lit("R"), k % 2)).alias("cusip_ric"),
    )
    return enrich.resolve_identifiers(b).select(F.col("bridge_row_id").alias("id"), F.col("resolution_status").alias("status"), F.col("effective_ric").alias("ric"))


@query("""
WITH o AS (SELECT l_suppkey AS k, l_linenumber % 4 AS r, CAST(l_shipdate AS DATE) AS d, l_returnflag AS c, min(l_tax) AS v FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2, 3, 4),
n AS (SELECT k, r, count(*) AS n FROM o GROUP BY 1, 2), p AS (SELECT a.k, a.r AS a, b.r AS b, count(*) AS shared, count(*) FILTER (WHERE abs(a.v - b.v) <= 0.05) AS same, count(DISTINCT a.d) AS dates, count(DISTINCT a.c) AS cats FROM o a JOIN o b ON a.k = b.k AND a.d = b.d AND a.c = b.c AND a.r < b.r GROUP BY 1, 2, 3)
SELECT p.k, 'R' || a AS a, 'R' || b AS b FROM p JOIN n x ON x.k = p.k AND x.r = a JOIN n y ON y.k = p.k AND y.r = b WHERE same >= 1 AND same = shared AND dates >= 1 AND cats >= 1 AND shared >= 0.0005 * least(x.n, y.n)
""")
def alias_pairs(spark, sf):
    """Identifiers of one security whose reported values agree on every date and category that both have."""
    o = table(spark, sf, "lineitem").filter("l_orderkey % 2 = 0").groupBy(F.col("l_suppkey").alias("KYPERMNO"), F.concat(F.lit("R"), F.col("l_linenumber") % 4).alias("ric"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("category")).agg(F.min("l_tax").alias("value"))
    out = enrich.alias_pairs(o, tolerance=0.05, min_pairs=1, min_dates=1, min_categories=1, min_overlap=0.0005)
    return out.select(F.col("KYPERMNO").alias("k"), "a", "b")


@query("""
WITH w AS (SELECT c_custkey AS k, j, 'R' || (c_custkey % 20) AS ric, DATE '1995-01-01' + CAST(j * 900 AS INTEGER) AS a, CASE WHEN c_custkey % 5 > 0 THEN DATE '1995-01-01' + CAST(j * 900 + 800 AS INTEGER) END AS b FROM customer, range(2) t(j) WHERE c_custkey % 7 > 0),
d AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS k, CAST(o_orderdate AS DATE) AS fd, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS te FROM orders),
h AS (SELECT doc, count(*) AS n, min(ric) AS ric FROM d JOIN w USING (k) WHERE te + 1 >= a AND (b IS NULL OR te + 1 <= b) GROUP BY 1),
q AS (SELECT d.*, CASE WHEN d.k IS NULL THEN 'NO_SECURITY' WHEN h.n IS NULL THEN 'NO_AUTHORITY_WINDOW' WHEN h.n > 1 THEN 'AMBIGUOUS_AUTHORITY_WINDOW' END AS reason, h.ric FROM d LEFT JOIN h USING (doc)),
v AS (SELECT DISTINCT 'R' || (l_suppkey % 20) AS ric, CASE WHEN l_linenumber % 2 = 0 THEN CAST(date_trunc('quarter', l_shipdate) AS DATE) - 1 ELSE CAST(l_shipdate AS DATE) END AS rd, CASE l_partkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 45.0 ELSE 100.0 END AS v FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey % 50 = 0),
x AS (SELECT doc, count(DISTINCT v) AS n, min(v) AS v FROM q JOIN v ON q.ric = v.ric AND v.rd = te WHERE reason IS NULL GROUP BY 1),
l AS (SELECT doc, v.rd, count(DISTINCT v) AS n, min(v) AS v FROM q JOIN v ON q.ric = v.ric AND v.rd BETWEEN te + 1 AND least(fd, te + 45) WHERE reason IS NULL GROUP BY 1, 2), m AS (SELECT doc, arg_max(n, rd) AS n, arg_max(v, rd) AS v FROM l GROUP BY 1)
SELECT q.doc, reason, CASE WHEN x.n = 1 THEN 'EXACT' WHEN x.n > 1 THEN 'EXACT_CONFLICT' WHEN m.n = 1 THEN 'FALLBACK' WHEN m.n > 1 THEN 'FALLBACK_CONFLICT' ELSE 'NO_MATCH' END AS status, CASE WHEN x.n = 1 THEN x.v WHEN x.n IS NULL AND m.n = 1 THEN m.v END AS pct FROM q LEFT JOIN x USING (doc) LEFT JOIN m USING (doc)
""")
def document_ownership(spark, sf):
    """Ownership of each document: its identifier window, the exact quarter end, else a unique later value."""
    k = F.col("c_custkey")
    w = table(spark, sf, "customer").filter("c_custkey % 7 > 0").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    w = w.select(k.alias("KYPERMNO"), F.concat(F.lit("R"), k % 20).alias("ric"), _day("1995-01-01", F.col("j") * 900).alias("window_start"), F.when(k % 5 > 0, _day("1995-01-01", F.col("j") * 900 + 800)).alias("window_end"))
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_custkey")).alias("KYPERMNO"), F.col("o_orderdate").cast("date").alias("filing_date"))
    x = table(spark, sf, "lineitem").filter("l_linenumber <= 4 and l_orderkey % 50 = 0")
    day = F.when(F.col("l_linenumber") % 2 == 0, X.quarter_end_before(F.col("l_shipdate").cast("date"))).otherwise(F.col("l_shipdate").cast("date"))
    r = x.select(F.concat(F.lit("R"), F.col("l_suppkey") % 20).alias("ric"), day.alias("date"), F.lit(" Holdings by Institutions").alias("category"), (F.col("l_partkey") % 3 * 60).cast("double").alias("value"))
    r = r.withColumn("value", F.when(F.col("value") == 60, 45.0).otherwise(F.col("value")))
    out = enrich.select_ownership(enrich.ownership_requests(d, w), r)
    return out.select(F.col("doc_id").alias("doc"), F.col("exclusion_reason").alias("reason"), F.col("ownership_status").alias("status"), F.col("institutional_ownership_pct").alias("pct"))


@query("""
WITH g AS (SELECT o_custkey % 40 AS k, 'R' || (o_custkey % 3) AS ric, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_custkey % 9 > 0)
SELECT k, ric, count(*) AS bridge_rows, strftime(min(d) - 31, '%Y-%m-%d') AS actuals_start, strftime(max(d) + 120, '%Y-%m-%d') AS actuals_end, strftime(min(d) - 270, '%Y-%m-%d') AS estimates_start, strftime(max(d) + 31, '%Y-%m-%d') AS estimates_end FROM g GROUP BY 1, 2
""")
def analyst_groups(spark, sf):
    """Request windows per company and identifier."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    b = o.select((F.col("o_custkey") % 40).alias("gvkey_int"), F.when(F.col("o_custkey") % 9 > 0, F.concat(F.lit("R"), F.col("o_custkey") % 3)).alias("ric"), day.alias("first_seen_caldt"), day.alias("last_seen_caldt"))
    out = enrich.analyst_groups(b)
    return out.select(F.col("gvkey_int").alias("k"), "ric", "bridge_rows", *[text_date(c).alias(c) for c in ("actuals_start", "actuals_end", "estimates_start", "estimates_end")])


@query("""
WITH a0 AS (SELECT o_custkey % 60 AS k, CAST(o_orderdate AS DATE) AS ad, CASE WHEN o_orderkey % 4 > 0 THEN CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 END AS fe, count(DISTINCT o_totalprice) FILTER (WHERE o_orderkey % 13 > 0) AS na, min(o_totalprice) FILTER (WHERE o_orderkey % 13 > 0) AS eps FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3),
e AS (SELECT o_custkey % 60 AS k, CAST(date_trunc('quarter', o_orderdate + INTERVAL 20 DAY) AS DATE) - 1 AS fe, CAST(o_orderdate AS DATE) AS cd, count(DISTINCT round(o_totalprice)) AS n, min(round(o_totalprice)) AS m, min(CAST(o_orderkey % 10 AS DOUBLE)) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2, 3),
l AS (SELECT k, cd, count(DISTINCT fe) AS ends, min(fe) AS fe1 FROM e GROUP BY 1, 2),
a AS (SELECT a0.* REPLACE (coalesce(a0.fe, CASE WHEN ends = 1 THEN fe1 END) AS fe) FROM a0 ASOF LEFT JOIN l ON a0.k = l.k AND a0.ad >= l.cd),
p AS (SELECT a.*, e.cd AS sd, e.m, e.s, e.n AS ns FROM a ASOF LEFT JOIN e ON a.k = e.k AND a.fe = e.fe AND a.ad >= e.cd),
p4 AS (SELECT p.*, last_day(sd - INTERVAL 4 MONTH) AS t4 FROM p), r AS (SELECT p4.*, e.m AS bm, e.n AS bn FROM p4 ASOF LEFT JOIN e ON p4.k = e.k AND p4.fe = e.fe AND p4.t4 >= e.cd)
SELECT k, strftime(ad, '%Y-%m-%d') AS announced, strftime(fe, '%Y-%m-%d') AS period_end, round(m, 4) AS consensus, round(s, 4) AS dispersion, round(CASE WHEN bn = 1 THEN m - bm END, 4) AS revision,
CASE WHEN na > 1 THEN 'CONFLICTING_ACTUALS' WHEN eps IS NULL THEN 'MISSING_ACTUAL' WHEN fe IS NULL THEN 'NO_FISCAL_PERIOD' WHEN sd IS NULL THEN 'NO_SNAPSHOT' WHEN ns > 1 THEN 'CONFLICTING_SNAPSHOT' WHEN bn > 1 THEN 'CONFLICTING_BASE' END AS code FROM r
""")
def analyst_panel(spark, sf):
    """Announced earnings with the latest snapshot, a four-month revision and the reason a row is refused."""
    o, day = table(spark, sf, "orders"), F.col("o_orderdate").cast("date")
    k = (F.col("o_custkey") % 60).alias("gvkey_int")
    a = o.filter("o_orderstatus = 'F'").select(k, day.alias("announcement_date"), F.when(F.col("o_orderkey") % 4 > 0, X.quarter_end_before(day)).alias("fiscal_period_end"), F.when(F.col("o_orderkey") % 13 > 0, F.col("o_totalprice")).alias("actual_eps"))
    e = o.filter("o_orderstatus <> 'F'").select(k, X.quarter_end_before(F.date_add(day, 20)).alias("fiscal_period_end"), day.alias("calc_date"), F.round("o_totalprice").alias("mean"), (F.col("o_orderkey") % 10).cast("double").alias("dispersion"))
    out = enrich.analyst_panel(a, e, (4,))
    return out.select(F.col("gvkey_int").alias("k"), text_date("announcement_date").alias("announced"), text_date("fiscal_period_end").alias("period_end"), rounded("forecast_consensus_mean", 4).alias("consensus"), rounded("forecast_dispersion", 4).alias("dispersion"), rounded("forecast_revision_4m", 4).alias("revision"), F.col("rejection_code").alias("code"))
