"""Queries of event screens, filing samples, portfolios and regression suites, each beside the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting, asof, events, regress, windows
from .composite_queries import _ANNUAL, _annual
from .registry import query, rounded, table, text_date

REACH = 80

_MARKET = """
WITH d AS (SELECT l_suppkey % 4 AS p, CAST(l_shipdate AS DATE) AS day, avg(l_discount) - 0.05 AS r, sum(l_quantity) AS v, max(l_extendedprice) / 10000 AS prc, CASE WHEN sum(l_linenumber) % 2 = 0 THEN sum(l_extendedprice) / 50 END AS cap, 100.0 + l_suppkey % 4 AS shr, 10 + l_suppkey % 4 % 3 AS sc, 1 + l_suppkey % 4 % 4 AS ex FROM lineitem GROUP BY l_suppkey % 4, 2),
cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM d)),
fac AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_discount END) - 0.05 AS x1, avg(l_tax) - 0.04 AS x2, avg(l_quantity) / 1000 - 0.0255 AS x3, 0.0001 AS rf FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS doc, o_custkey AS g, o_custkey % 4 AS p, CAST(o_orderdate AS DATE) AS fd, o_totalprice AS v FROM orders),
o1 AS (SELECT o.*, cal.day AS td FROM o ASOF LEFT JOIN cal ON o.fd <= cal.day), e AS (SELECT o1.*, cal.day AS pd FROM o1 ASOF LEFT JOIN cal ON o1.fd > cal.day)
"""


def _daily(spark, sf):
    x, k = table(spark, sf, "lineitem"), F.col("l_suppkey") % 4
    return x.groupBy(k.alias("KYPERMNO"), F.col("l_shipdate").cast("date").alias("CALDT")).agg(
        (F.avg("l_discount") - 0.05).alias("RET"), F.sum("l_quantity").alias("VOL"), (F.max("l_extendedprice") / 10000).alias("PRC"), F.when(F.sum("l_linenumber") % 2 == 0, F.sum("l_extendedprice") / 50).alias("TCAP"),
    ).withColumn("SHROUT", 100.0 + F.col("KYPERMNO")).withColumn("SHRCD", 10 + F.col("KYPERMNO") % 3).withColumn("EXCHCD", 1 + F.col("KYPERMNO") % 4)


def _factors(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("trading_date"))
    return x.agg((F.avg(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount"))) - 0.05).alias("mkt_rf"), (F.avg("l_tax") - 0.04).alias("smb"), (F.avg("l_quantity") / 1000 - 0.0255).alias("hml"), F.lit(0.0001).alias("rf"))


def _filings(spark, sf, calendar):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("int").alias("gvkey_int"), (F.col("o_custkey") % 4).alias("KYPERMNO"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_totalprice").alias("v"))
    return accounting.trade_anchors(o, calendar)


@query(_MARKET + "SELECT doc, strftime(td, '%Y-%m-%d') AS trade_day, strftime(pd, '%Y-%m-%d') AS day_before FROM e")
def trade_anchors(spark, sf):
    """First trading day at or after each filing and the last one before it."""
    f = _filings(spark, sf, asof.trading_calendar(_daily(spark, sf), "CALDT"))
    return f.select(F.col("doc_id").alias("doc"), text_date("filing_trade_date").alias("trade_day"), text_date("pre_filing_trade_date").alias("day_before"))


def three_factor_sql(rows: str, group: str, y: str) -> str:
    """SQL of a three-factor fit a group by Cramer's rule on the correlation matrix: ``n, alpha, rmse, singular``."""
    full = f"x1 + x2 + x3 + {y} IS NOT NULL"
    return f"""SELECT {group}, n, CASE WHEN n > 4 AND NOT singular THEN my - b1 * m1 - b2 * m2 - b3 * m3 END AS alpha, CASE WHEN n > 4 AND NOT singular THEN sqrt(greatest(vy - b1 * s1 - b2 * s2 - b3 * s3, 0) * n / (n - 4)) END AS rmse, singular FROM (
SELECT *, n > 4 AND coalesce(det, 0) < 1e-9 AS singular, (u1 * (1 - c * c) + u2 * (b * c - a) + u3 * (a * c - b)) / det / d1 AS b1, (u1 * (b * c - a) + u2 * (1 - b * b) + u3 * (a * b - c)) / det / d2 AS b2, (u1 * (a * c - b) + u2 * (a * b - c) + u3 * (1 - a * a)) / det / d3 AS b3 FROM (
SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM (SELECT *, s12 / nullif(d1 * d2, 0) AS a, s13 / nullif(d1 * d3, 0) AS b, s23 / nullif(d2 * d3, 0) AS c, s1 / nullif(d1, 0) AS u1, s2 / nullif(d2, 0) AS u2, s3 / nullif(d3, 0) AS u3 FROM (
SELECT {group}, count(*) FILTER (WHERE {full}) AS n, avg({y}) FILTER (WHERE {full}) AS my, avg(x1) FILTER (WHERE {full}) AS m1, avg(x2) FILTER (WHERE {full}) AS m2, avg(x3) FILTER (WHERE {full}) AS m3, stddev_pop(x1) FILTER (WHERE {full}) AS d1, stddev_pop(x2) FILTER (WHERE {full}) AS d2, stddev_pop(x3) FILTER (WHERE {full}) AS d3,
var_pop({y}) FILTER (WHERE {full}) AS vy, covar_pop(x1, x2) FILTER (WHERE {full}) AS s12, covar_pop(x1, x3) FILTER (WHERE {full}) AS s13, covar_pop(x2, x3) FILTER (WHERE {full}) AS s23, covar_pop(x1, {y}) FILTER (WHERE {full}) AS s1, covar_pop(x2, {y}) FILTER (WHERE {full}) AS s2, covar_pop(x3, {y}) FILTER (WHERE {full}) AS s3 FROM {rows} GROUP BY 1))))"""


_SCREEN = _MARKET + f""",
w AS (SELECT e.doc, c2.i - c1.i AS k, d.*, x1, x2, x3, r - fac.rf AS y, x1 + fac.rf AS mk FROM e JOIN cal c1 ON e.td = c1.day JOIN d ON d.p = e.p JOIN cal c2 ON d.day = c2.day LEFT JOIN fac ON d.day = fac.day WHERE c2.i - c1.i BETWEEN -{REACH} AND {REACH}),
wb AS (SELECT doc, CASE WHEN k <= -6 THEN x1 END AS x1, x2, x3, y FROM w), wa AS (SELECT doc, CASE WHEN k >= 6 THEN x1 END AS x1, x2, x3, y FROM w),
pre AS ({three_factor_sql("wb", "doc", "y")}), post AS ({three_factor_sql("wa", "doc", "y")}),
m AS (SELECT doc, coalesce(product(1 + r) FILTER (WHERE k BETWEEN 0 AND 3), 1) - coalesce(product(1 + mk) FILTER (WHERE k BETWEEN 0 AND 3), 1) AS excess, sum(v) FILTER (WHERE k <= -6) / (max(shr) FILTER (WHERE k = 0) * 1000) AS turnover,
CASE WHEN stddev_samp(v) FILTER (WHERE k BETWEEN -65 AND -6) > 0 THEN (avg(v) FILTER (WHERE k BETWEEN 0 AND 3) - avg(v) FILTER (WHERE k BETWEEN -65 AND -6)) / stddev_samp(v) FILTER (WHERE k BETWEEN -65 AND -6) END AS abnormal,
count(r) FILTER (WHERE k BETWEEN 0 AND 3) AS rdays, count(v) FILTER (WHERE k BETWEEN 0 AND 3) AS vdays, count(*) FILTER (WHERE k <= -6) AS tobs, count(*) FILTER (WHERE k BETWEEN -65 AND -6) AS aobs, max(sc) FILTER (WHERE k = 0) AS sc0, max(ex) FILTER (WHERE k = 0) AS ex0 FROM w GROUP BY 1),
scr AS (SELECT m.*, pre.alpha, pre.n AS pobs, post.rmse, post.n AS qobs FROM m JOIN pre USING (doc) JOIN post USING (doc))
"""


def _screen(spark, sf):
    daily = _daily(spark, sf)
    calendar = asof.trading_calendar(daily, "CALDT")
    return events.event_screen(_filings(spark, sf, calendar), daily, _factors(spark, sf), calendar, reach=REACH)


@query(_SCREEN + "SELECT doc, round(excess, 8) AS excess, round(turnover, 8) AS turnover, round(abnormal, 6) AS abnormal, round(alpha, 6) AS alpha, pobs AS pre_obs, round(rmse, 6) AS volatility, qobs AS post_obs, rdays AS return_days, CASE WHEN ex0 = 3 THEN 1 ELSE 0 END AS nasdaq FROM scr")
def event_screen(spark, sf):
    """Excess return, turnover, abnormal volume, alpha before and volatility after each filing."""
    s = _screen(spark, sf)
    return s.select(
        F.col("doc_id").alias("doc"), rounded("filing_period_excess_return", 8).alias("excess"), rounded("share_turnover", 8).alias("turnover"), rounded("abnormal_volume").alias("abnormal"), rounded("pre_ffalpha").alias("alpha"), "pre_obs",
        rounded("postevent_return_volatility").alias("volatility"), "post_obs", F.col("event_return_days").alias("return_days"), F.col("nasdaq_dummy").cast("int").alias("nasdaq"),
    )


_BASE = ", ann AS (SELECT * FROM (" + _ANNUAL.strip() + """ SELECT k, pe, max(be) AS be FROM b GROUP BY 1, 2)),
b1 AS (SELECT e.*, CASE WHEN datediff('day', pe, fd) <= 365 THEN be END AS be FROM e ASOF LEFT JOIN ann ON e.g = ann.k AND e.fd >= pe),
base AS (SELECT b1.*, abs(prc) AS price, coalesce(cap, abs(prc) * shr) / 1000 AS me, be / nullif(coalesce(cap, abs(prc) * shr) / 1000, 0) AS bm, doc % 5000 AS tokens FROM b1 LEFT JOIN d ON b1.p = d.p AND b1.pd = d.day)
"""


def _base(spark, sf):
    daily = _daily(spark, sf)
    annual = _annual(spark, sf).groupBy("gvkey_int", "accounting_period_end").agg(F.max("book_equity_be").alias("book_equity_be"))
    o = table(spark, sf, "orders")
    filings = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("int").alias("gvkey_int"), (F.col("o_custkey") % 4).alias("KYPERMNO"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_totalprice").alias("v"))
    tokens = o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 5000).alias("token_count"))
    return events.table_base(filings, asof.trading_calendar(daily, "CALDT"), annual, daily, tokens)


@query(_MARKET + _BASE + "SELECT doc, round(price, 6) AS price, round(me * 1000, 6) AS size, round(be, 4) AS book_equity, round(bm, 6) AS book_to_market, tokens FROM base")
def table_base(spark, sf):
    """Filings with anchors, annual row, market data of the day before and token counts."""
    b = _base(spark, sf)
    return b.select(F.col("doc_id").alias("doc"), rounded("pre_filing_price").alias("price"), rounded(F.col("size_event") * 1000, 6).alias("size"), rounded("book_equity_be", 4).alias("book_equity"), rounded("bm_event").alias("book_to_market"), F.col("token_count").alias("tokens"))


_STEPS = ["sc0 IN (10, 11)", "me > 0", "price >= 3", "rdays = 4 AND vdays = 4", "ex0 IN (1, 2, 3)", "least(tobs, aobs, pobs, qobs) >= 60", "be > 0 AND bm > 0", "tokens >= 2000"]
_NAMES = ["common_stock", "market_equity", "price", "event_days", "exchange", "history", "book_to_market", "tokens"]
_PASS = lambda i: " AND ".join(f"coalesce({s}, false)" for s in _STEPS[:i]) or "true"
_SCREENED = _SCREEN + _BASE + ", all_rows AS (SELECT scr.*, base.* EXCLUDE (doc, p, v) FROM base JOIN scr USING (doc))"


@query(_SCREENED + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS name, count(*) FILTER (WHERE {_PASS(i)}) AS kept, count(*) FILTER (WHERE {_PASS(max(i - 1, 0))}) - count(*) FILTER (WHERE {_PASS(i)}) AS removed FROM all_rows" for i, n in enumerate(["start", *_NAMES])) + ")")
def sample_ladder(spark, sf):
    """Filings left after each filter of the market ladder."""
    return events.sample_ladder(_base(spark, sf).join(_screen(spark, sf), "doc_id"))


@query(_SCREENED + f""", k AS (SELECT * FROM all_rows WHERE {_PASS(8)}), r AS (SELECT bm, row_number() OVER (ORDER BY bm) - 1 AS i, count(*) OVER () AS n FROM k WHERE bm IS NOT NULL), q AS (SELECT max(bm) FILTER (WHERE i = floor(0.01 * (n - 1) + 0.5)) AS lo, max(bm) FILTER (WHERE i = floor(0.99 * (n - 1) + 0.5)) AS hi FROM r)
SELECT doc, round(least(greatest(bm, lo), hi), 6) AS book_to_market, round(ln(me), 6) AS log_size, round(CASE WHEN turnover > 0 THEN ln(turnover) END, 6) AS log_turnover, round(abnormal, 6) AS abnormal FROM k, q WHERE abnormal IS NOT NULL""")
def event_panel(spark, sf):
    """Filings that pass the ladder, winsorised and with logarithms."""
    p = events.regression_transforms(events.event_panel(_base(spark, sf).join(_screen(spark, sf), "doc_id")))
    return p.select(F.col("doc_id").alias("doc"), rounded("bm_event").alias("book_to_market"), rounded("log_size").alias("log_size"), rounded("log_share_turnover").alias("log_turnover"), rounded("abnormal_volume").alias("abnormal"))


@query(_MARKET + """, w AS (SELECT e.doc, c2.i - c1.i AS k, d.r, x1 + fac.rf AS mk FROM e JOIN cal c1 ON e.td = c1.day JOIN d ON d.p = e.p JOIN cal c2 ON d.day = c2.day LEFT JOIN fac ON d.day = fac.day),
s AS (""" + " UNION ALL ".join(f"SELECT doc, {n} AS days, product(1 + r) - product(1 + mk) AS x FROM w WHERE k BETWEEN 0 AND {n - 1} GROUP BY 1 HAVING count(r) = {n} AND count(mk) = {n}" for n in (6, 12, 18)) + ") SELECT days, count(*) AS docs, round(avg(x), 8) AS mean_excess, round(stddev_samp(x), 8) AS sd FROM s GROUP BY 1")
def event_window_sensitivity(spark, sf):
    """Excess returns over 6, 12 and 18 days, of filings with all days."""
    daily = _daily(spark, sf)
    calendar = asof.trading_calendar(daily, "CALDT")
    docs, factors = _filings(spark, sf, calendar), _factors(spark, sf)
    panels = [events.return_panel(docs, daily, factors, calendar, n) for n in (6, 12, 18)]
    both = panels[0].unionByName(panels[1]).unionByName(panels[2])
    return both.groupBy("days").agg(F.count("*").alias("docs"), rounded(F.avg("excess_return"), 8).alias("mean_excess"), rounded(F.stddev_samp("excess_return"), 8).alias("sd"))


_TRIM = "least(greatest({0}, (SELECT max(v) FILTER (WHERE i = floor(0.01 * (n - 1) + 0.5)) FROM {1})), (SELECT max(v) FILTER (WHERE i = floor(0.99 * (n - 1) + 0.5)) FROM {1}))"


@query(_MARKET + """, mp AS (SELECT p, day, prc FROM d WHERE prc IS NOT NULL), b1 AS (SELECT e.*, abs(d.prc) AS price FROM e LEFT JOIN d ON e.p = d.p AND e.pd = d.day), b2 AS (SELECT b1.*, CAST(date_trunc('month', fd) AS DATE) - 1 AS me FROM b1),
b3 AS (SELECT b2.*, CASE WHEN datediff('day', mp.day, me) <= 31 THEN abs(mp.prc) END AS pm FROM b2 ASOF LEFT JOIN mp ON b2.p = mp.p AND b2.me >= mp.day),
x AS (SELECT doc, (v / 1e5 - CASE WHEN doc % 9 > 0 THEN 1.4 END) / nullif(price, 0) AS a, (doc % 7 / 10.0) / nullif(price, 0) AS b, (doc % 5 - 2.0) / nullif(pm, 0) AS c FROM b3), y AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
ra AS (SELECT a AS v, row_number() OVER (ORDER BY a) - 1 AS i, count(*) OVER () AS n FROM y), rb AS (SELECT b AS v, row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS n FROM y), rc AS (SELECT c AS v, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM y)
SELECT doc, round(""" + _TRIM.format("a", "ra") + ", 6) AS surprise, round(" + _TRIM.format("b", "rb") + ", 6) AS dispersion, round(" + _TRIM.format("c", "rc") + ", 6) AS revision FROM y")
def surprise_panel(spark, sf):
    """Earnings surprise, dispersion and revision scaled by prices of the day and the month before."""
    daily, k = _daily(spark, sf), F.col("doc_id")
    f = accounting.attach_pre_filing_market(_filings(spark, sf, asof.trading_calendar(daily, "CALDT")), daily)
    f = events.month_end_price(f, daily)
    f = f.withColumn("actual_eps", F.col("v") / 1e5).withColumn("forecast_consensus_mean", F.when(k % 9 > 0, 1.4)).withColumn("forecast_dispersion", k % 7 / 10.0).withColumn("forecast_revision_4m", k % 5 - 2.0)
    p = events.surprise_panel(f)
    return p.select(k.alias("doc"), rounded("sue").alias("surprise"), rounded("analyst_dispersion").alias("dispersion"), rounded("analyst_revisions").alias("revision"))


_MONTHLY = """
WITH m AS (SELECT l_suppkey % 20 AS p, last_day(CAST(l_shipdate AS DATE)) AS me, avg(l_discount) - 0.05 AS r, sum(l_extendedprice) AS cap FROM lineitem GROUP BY 1, 2),
d AS (SELECT o_orderkey AS doc, o_custkey % 20 AS p, CAST(o_orderdate AS DATE) AS fd, o_totalprice AS sa, CAST(o_orderkey % 101 AS DOUBLE) AS sb FROM orders),
y AS (SELECT *, CASE WHEN month(fd) >= 7 THEN year(fd) + 1 ELSE year(fd) END AS sy FROM d),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p, sy ORDER BY fd DESC, doc DESC) AS n FROM y WHERE sy BETWEEN 1997 AND 2001) WHERE n = 1),
u AS (SELECT doc, p, sy, 'sa' AS signal, sa AS v FROM k UNION ALL SELECT doc, p, sy, 'sb', sb FROM k),
q AS (SELECT p, sy, signal, floor((row_number() OVER (PARTITION BY sy, signal ORDER BY v, doc) - 1) * 5 / count(*) OVER (PARTITION BY sy, signal)) + 1 AS qt FROM u),
mm AS (SELECT *, CASE WHEN month(me) >= 7 THEN year(me) ELSE year(me) - 1 END AS sy FROM m),
l AS (SELECT signal, me, qt, avg(r) AS r FROM q JOIN mm USING (p, sy) WHERE qt IN (1, 5) GROUP BY 1, 2, 3),
ls AS (SELECT a.signal, a.me, a.r - b.r AS r FROM l a JOIN l b ON a.signal = b.signal AND a.me = b.me AND a.qt = 5 AND b.qt = 1 WHERE a.me BETWEEN DATE '1997-07-31' AND DATE '2001-06-30'),
f AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS me, avg(l_tax) - 0.04 AS x1, avg(l_quantity) / 1000 AS x2 FROM lineitem GROUP BY 1)
"""


def _strategy(spark, sf):
    m = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("KYPERMNO"), F.last_day(F.col("l_shipdate").cast("date")).alias("MCALDT")).agg((F.avg("l_discount") - 0.05).alias("MRET"), F.sum("l_extendedprice").alias("MTCAP"))
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 20).alias("KYPERMNO"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_totalprice").alias("sa"), (F.col("o_orderkey") % 101).cast("double").alias("sb"))
    return regress.trading_strategy(d, ["sa", "sb"], m, first_year=1997, last_year=2001, last_month="2001-06-30")


@query(_MONTHLY + "SELECT signal, strftime(me, '%Y-%m-%d') AS month_end, round(r, 8) AS ret FROM ls")
def trading_strategy(spark, sf):
    """Monthly long-short returns of two signals over a span of months."""
    return _strategy(spark, sf).select("signal", text_date("month_end").alias("month_end"), rounded("long_short_return", 8).alias("ret"))


@query(_MONTHLY + """, c AS (SELECT signal, count(*) AS n, avg(r) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(r) AS vy, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS s, covar_pop(x1, r) AS c1, covar_pop(x2, r) AS c2 FROM ls JOIN f USING (me) GROUP BY 1),
b AS (SELECT *, (c1 * v2 - c2 * s) / (v1 * v2 - s * s) AS b1, (c2 * v1 - c1 * s) / (v1 * v2 - s * s) AS b2 FROM c), g AS (SELECT *, vy - b1 * c1 - b2 * c2 AS rss, my - b1 * m1 - b2 * m2 AS a FROM b)
SELECT signal, 'alpha' AS term, round(a, 7) AS estimate, n, round(1 - rss / vy, 6) AS r2 FROM g UNION ALL SELECT signal, 'x1', round(b1, 5), n, round(1 - rss / vy, 6) FROM g UNION ALL SELECT signal, 'x2', round(b2, 5), n, round(1 - rss / vy, 6) FROM g""")
def strategy_summary(spark, sf):
    """Factor model of the strategy's returns, months checked."""
    f = table(spark, sf, "lineitem").groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("month_end")).agg((F.avg("l_tax") - 0.04).alias("x1"), (F.avg("l_quantity") / 1000).alias("x2"))
    out = regress.strategy_summary(_strategy(spark, sf), f, ["x1", "x2"])
    return out.select("signal", "term", F.when(F.col("term") == "alpha", rounded("estimate", 7)).otherwise(rounded("estimate", 5)).alias("estimate"), "n", rounded("r2").alias("r2"))


_PANEL = """
WITH o AS (SELECT o_orderkey AS k, date_trunc('quarter', o_orderdate) AS q, o_orderpriority AS ind, o_totalprice / 1e5 AS y, CAST(o_orderkey * 37 % 1009 AS DOUBLE) / 1000 AS s, CAST(o_custkey * 91 % 997 AS DOUBLE) / 1000 AS c, o_orderkey % 10 AS h FROM orders)
"""


def _panel(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderpriority").alias("ind"), (F.col("o_totalprice") / 1e5).alias("y"), ((k * 37 % 1009).cast("double") / 1000).alias("s"), ((F.col("o_custkey") * 91 % 997).cast("double") / 1000).alias("c"), (k % 10).alias("h"),
    )


@query(_PANEL + """, i AS (SELECT q, ind, count(*) AS n, var_pop(s) * count(*) AS ss, var_pop(c) * count(*) AS cc, covar_pop(s, c) * count(*) AS sc, covar_pop(s, y) * count(*) AS sy, covar_pop(c, y) * count(*) AS cy FROM o GROUP BY 1, 2),
f0 AS (SELECT q, 'C0' AS controls, sum(n) AS n, sum(sy) / sum(ss) AS b FROM i GROUP BY 1 HAVING sum(n) > count(*) + 1 AND sum(ss) > 0), f1 AS (SELECT q, 'C1' AS controls, sum(n) AS n, (sum(sy) * sum(cc) - sum(cy) * sum(sc)) / (sum(ss) * sum(cc) - sum(sc) * sum(sc)) AS b FROM i GROUP BY 1 HAVING sum(n) > count(*) + 2 AND sum(ss) * sum(cc) > sum(sc) * sum(sc)),
w AS (SELECT *, n / sum(n) OVER (PARTITION BY controls) AS w FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1)), p AS (SELECT *, w * (b - m) AS psi FROM (SELECT *, sum(w * b) OVER (PARTITION BY controls) AS m FROM w)),
r AS (SELECT controls, max(m) AS estimate, sqrt(greatest(sum(psi * psi) + sum(psi * l1), 0)) AS se, count(*) AS n FROM (SELECT *, lag(psi) OVER (PARTITION BY controls ORDER BY q) AS l1 FROM p) GROUP BY 1)
SELECT controls, round(estimate, 6) AS estimate, round(se, 6) AS se, n, CASE WHEN n >= 5 THEN 'estimated' ELSE 'insufficient_sample' END AS status FROM r""")
def control_ladder(spark, sf):
    """The same regression under growing sets of controls, with industry dummies and a status."""
    out = regress.control_ladder(_panel(spark, sf).drop("h", "k"), ["y"], ["s"], "d", "ind", {"C0": [], "C1": ["c"]}, min_quarters=5)
    return out.select("controls", rounded("estimate").alias("estimate"), rounded("se").alias("se"), "n", "status")


@query(_PANEL + """, f AS (SELECT q, count(*) AS n, regr_slope(y, s) AS b FROM o GROUP BY 1 HAVING count(*) > 2 AND var_pop(s) > 0), w AS (SELECT *, n / sum(n) OVER () AS w FROM f), p AS (SELECT *, w * (b - m) AS psi FROM (SELECT *, sum(w * b) OVER () AS m FROM w)),
g AS (SELECT *, lag(psi) OVER z AS l1, lag(psi, 2) OVER z AS l2, lag(psi, 3) OVER z AS l3 FROM p WINDOW z AS (ORDER BY q)), t AS (SELECT max(m) AS m, sum(psi * psi) AS v0, coalesce(sum(psi * l1), 0) AS v1, coalesce(sum(psi * l2), 0) AS v2, coalesce(sum(psi * l3), 0) AS v3, count(*) AS n FROM g)
SELECT 1 AS lags, round(m, 6) AS estimate, round(sqrt(greatest(v0 + v1, 0)), 6) AS se, n FROM t UNION ALL SELECT 2, round(m, 6), round(sqrt(greatest(v0 + 2 * (2 / 3.0) * v1 + 2 * (1 / 3.0) * v2, 0)), 6), n FROM t UNION ALL SELECT 3, round(m, 6), round(sqrt(greatest(v0 + 1.5 * v1 + v2 + 0.5 * v3, 0)), 6), n FROM t""")
def lag_sensitivity(spark, sf):
    """Errors of the mean slope under one to three lags."""
    out = regress.lag_sensitivity(_panel(spark, sf), "y", ["s"], "d", (1, 2, 3))
    return out.select("lags", rounded("estimate").alias("estimate"), rounded("se").alias("se"), "n")


@query(_PANEL + """, u AS (SELECT * FROM o), c1 AS (SELECT q, count(*) AS n, var_pop(y) AS vy, var_pop(s) AS vs, var_pop(c) AS vc, covar_pop(s, c) AS sc, covar_pop(s, y) AS sy, covar_pop(c, y) AS cy FROM u GROUP BY 1 HAVING count(*) > 3),
r AS (SELECT q, n, sy * sy / vs / vy AS r1, ((sy * vc - cy * sc) * sy + (cy * vs - sy * sc) * cy) / (vs * vc - sc * sc) / vy AS r2 FROM c1 WHERE vs * vc > sc * sc), a AS (SELECT q, n, (1 - (1 - r2) * (n - 1) / (n - 3)) - (1 - (1 - r1) * (n - 1) / (n - 2)) AS g FROM r),
w AS (SELECT *, n / sum(n) OVER () AS w FROM a), p AS (SELECT *, w * (g - m) AS psi FROM (SELECT *, sum(w * g) OVER () AS m FROM w)), z AS (SELECT *, lag(psi) OVER (ORDER BY q) AS l1 FROM p)
SELECT 'wide' AS spec, round(max(m), 7) AS gain, round(sqrt(greatest(sum(psi * psi) + sum(psi * l1), 0)), 7) AS se, count(*) AS n FROM z""")
def fit_comparison(spark, sf):
    """Gain in adjusted fit of a wider specification on common rows and quarters."""
    out = regress.fit_comparison(_panel(spark, sf), "y", {"narrow": ["s"], "wide": ["s", "c"]}, "d", "narrow")
    return out.select("spec", rounded("estimate", 7).alias("gain"), rounded("se", 7).alias("se"), "n")


@query(_PANEL + """, x AS (SELECT year(q) AS year, CASE WHEN h < 7 THEN y END AS y, CASE WHEN h > 1 THEN s END AS s, CASE WHEN h <> 5 THEN c END AS c FROM o)
SELECT CAST(year AS BIGINT) AS year, need, count(*) AS rows, count(*) FILTER (WHERE ok) AS available, count(*) - count(*) FILTER (WHERE ok) AS lost FROM (SELECT year, 'outcome' AS need, y IS NOT NULL AS ok FROM x UNION ALL SELECT year, 'signal', y IS NOT NULL AND s IS NOT NULL FROM x UNION ALL SELECT year, 'controls', y IS NOT NULL AND s IS NOT NULL AND c IS NOT NULL FROM x) GROUP BY 1, 2""")
def sample_loss(spark, sf):
    """Rows that each further requirement costs, by year."""
    h = F.col("h")
    p = _panel(spark, sf).select(F.year("d").cast("long").alias("year"), F.when(h < 7, F.col("y")).alias("y"), F.when(h > 1, F.col("s")).alias("s"), F.when(h != 5, F.col("c")).alias("c"))
    return regress.sample_loss(p, ["year"], {"outcome": ["y"], "signal": ["y", "s"], "controls": ["y", "s", "c"]})


@query(_PANEL + """, e AS (SELECT ind AS signal, regr_slope(y, s) AS b FROM o GROUP BY 1), x AS (SELECT ind AS signal, quantile_cont(s, 0.75) - quantile_cont(s, 0.25) AS iqr FROM o WHERE year(q) <> 1996 GROUP BY 1)
SELECT signal, round(iqr, 8) AS iqr, round(b * iqr, 7) AS effect FROM e JOIN x USING (signal)""")
def effect_summary(spark, sf):
    """Effects of a move over the interquartile range, skipped quarters left out."""
    p = _panel(spark, sf).withColumn("quarter", F.trunc("d", "quarter")).withColumnRenamed("ind", "signal")
    est = p.groupBy("signal").agg(F.regr_slope("y", "s").alias("estimate"))
    skipped = p.filter(F.year("d") == 1996).select("quarter").distinct()
    out = regress.effect_summary(est, p, "signal", "s", skipped)
    return out.select("signal", rounded("iqr", 8).alias("iqr"), rounded("effect", 7).alias("effect"))


@query(_PANEL + """, e AS (SELECT k, q, y, s FROM o), g AS (SELECT k, CASE WHEN k % 3 > 0 THEN k % 48 END AS industry FROM o)
SELECT e.k AS doc, strftime(e.q, '%Y-%m-%d') AS quarter, industry, round(CASE WHEN s > 0 THEN ln(s) END, 7) AS log_size, CASE WHEN k % 4 = 0 THEN NULL ELSE round(y, 8) END AS outcome FROM e JOIN g USING (k) WHERE e.k % 5 > 0""")
def regression_panel(spark, sf):
    """Event rows with signals and industries, logarithms where positive, infinities as nulls, rows with ownership."""
    p, k = _panel(spark, sf), F.col("k")
    ev = p.select(k.alias("doc_id"), F.trunc("d", "quarter").alias("filing_date"), F.col("s").alias("size_event"), F.lit(1.0).alias("bm_event"), F.lit(1.0).alias("share_turnover"), F.when(k % 4 == 0, float("inf")).otherwise(F.col("y")).alias("outcome"), F.when(k % 5 > 0, 1.0).alias("institutional_ownership"))
    ind = p.filter(k % 3 > 0).select(k.alias("doc_id"), (k % 48).alias("industry_id"))
    out = regress.regression_panel(ev, p.select(k.alias("doc_id"), F.col("c").alias("sig")), ind, ["log_size", "outcome"], ownership=True)
    return out.select(F.col("doc_id").alias("doc"), text_date("filing_date").alias("quarter"), F.col("industry_id").alias("industry"), rounded("log_size", 7).alias("log_size"), rounded("outcome", 8).alias("outcome"))


@query(_PANEL + """, t AS (SELECT *, year(q) AS year FROM o), z AS (SELECT year, h, y, s, k, floor((row_number() OVER (ORDER BY s, k) - 1) * 5 / count(*) OVER ()) + 1 AS bin FROM t) SELECT CAST(bin AS BIGINT) AS bin, round(avg(s), 8) AS s_mean, round(avg(y), 6) AS y_mean, count(*) AS n FROM z GROUP BY 1""")
def ordinal_bin_means(spark, sf):
    """Means in five bins of equal count by ordinal rank."""
    ranked = windows.rank_bucket(_panel(spark, sf).withColumn("one", F.lit(1)), ["one"], [F.col("s"), F.col("k")], 5, "bin")
    return ranked.groupBy(F.col("bin").cast("long").alias("bin")).agg(rounded(F.avg("s"), 8).alias("s_mean"), rounded(F.avg("y")).alias("y_mean"), F.count("*").alias("n"))
