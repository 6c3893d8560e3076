"""Queries of joins, calendars, windows and interval operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import asof, enrich, windows
from .registry import query, rounded, table, text_date


def _events(spark, sf, kind, names):
    e = table(spark, sf, "events").filter(F.col("event_type") == kind)
    return e.select(*[F.col(a).alias(b) for a, b in names.items()])


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'),
r AS (SELECT user_id AS u, ts AS rts, max_by(value, event_id) AS rv FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT l.event_id, l.user_id, round(r.rv, 6) AS value_at, r.rts IS NOT NULL AS matched FROM l ASOF LEFT JOIN r ON l.user_id = r.u AND l.ts >= r.rts
""")
def asof_backward(spark, sf):
    """Latest purchase at or before each signup of the same user."""
    left = _events(spark, sf, "signup", {"event_id": "event_id", "user_id": "user_id", "ts": "ts"})
    right = _events(spark, sf, "purchase", {"user_id": "user_id", "ts": "rts", "value": "rv", "event_id": "rid"})
    out = asof.asof_join(left, right, ["user_id"], "ts", "rts", ["rv"], tiebreak=["rid"])
    return out.select("event_id", "user_id", rounded("rv").alias("value_at"), "matched")


@query("""
WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
f AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS fd FROM orders),
a AS (SELECT f.*, cal.d AS ad FROM f ASOF LEFT JOIN cal ON f.fd <= cal.d),
daily AS (SELECT l_suppkey AS sk, CAST(l_shipdate AS DATE) AS sd, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
b AS (SELECT a.*, daily.sd, daily.q FROM a ASOF LEFT JOIN daily ON a.o_custkey % 100 = daily.sk AND a.ad <= daily.sd)
SELECT o_orderkey, strftime(ad, '%Y-%m-%d') AS aligned_day, CAST(datediff('day', fd, ad) AS BIGINT) AS align_lag, CAST(datediff('day', ad, sd) AS BIGINT) AS daily_lag,
CASE WHEN ad IS NULL THEN 'OUT_OF_COVERAGE' WHEN sd IS NULL THEN 'NO_ROW_FOR_DATE' WHEN datediff('day', ad, sd) > 3 THEN 'NO_ROW_FOR_DATE' ELSE 'OK' END AS reason,
CASE WHEN datediff('day', ad, sd) <= 3 THEN q END AS quantity FROM b
""")
def asof_forward_lag_gate(spark, sf):
    """Orders to the next trading day, then to the first daily row of a security at or after it; late rows stay but are refused."""
    lines = table(spark, sf, "lineitem")
    calendar = asof.trading_calendar(lines, "l_shipdate")
    filings = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("sk"), F.col("o_orderdate").cast("date").alias("fd"))
    aligned = asof.align_to_calendar(filings, "fd", calendar)
    daily = lines.groupBy(F.col("l_suppkey").alias("sk"), F.col("l_shipdate").cast("date").alias("sd")).agg(F.sum("l_quantity").alias("q"))
    out = asof.asof_join(aligned, daily, ["sk"], "aligned_day", "sd", ["q"], direction="forward")
    lag = F.datediff("asof_sd", "aligned_day").cast("long")
    reason = F.when(F.col("aligned_day").isNull(), "OUT_OF_COVERAGE").when(F.col("asof_sd").isNull() | (lag > 3), "NO_ROW_FOR_DATE").otherwise("OK")
    return out.select(
        "o_orderkey",
        text_date("aligned_day").alias("aligned_day"),
        F.datediff("aligned_day", "fd").cast("long").alias("align_lag"),
        lag.alias("daily_lag"),
        reason.alias("reason"),
        F.when(lag <= 3, F.col("q")).alias("quantity"),
    )


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
r AS (SELECT user_id AS u, ts AS rts, value AS rv, CAST(ts + INTERVAL 2 DAY AS DATE) AS until FROM events WHERE event_type = 'view')
SELECT l.event_id, CASE WHEN CAST(l.ts AS DATE) <= r.until THEN round(r.rv, 6) END AS value_at, coalesce(CAST(l.ts AS DATE) <= r.until, false) AS matched
FROM l ASOF LEFT JOIN r ON l.user_id = r.u AND l.ts >= r.rts
""")
def asof_validity_masked(spark, sf):
    """A stale nearest row blanks its payload; an older valid row never takes its place."""
    left = _events(spark, sf, "click", {"event_id": "event_id", "user_id": "user_id", "ts": "ts"})
    right = _events(spark, sf, "view", {"user_id": "user_id", "ts": "rts", "value": "rv", "event_id": "rid"})
    right = right.withColumn("until", F.date_add(F.col("rts").cast("date"), 2))
    out = asof.asof_join(left, right, ["user_id"], "ts", "rts", ["rv"], valid_until="until", tiebreak=["rid"])
    return out.select("event_id", rounded("rv").alias("value_at"), "matched")


@query("""
WITH l AS (SELECT event_id, event_type, ts FROM events WHERE event_type = 'error'),
r AS (SELECT ts AS rts, value AS rv FROM events WHERE event_type = 'purchase')
SELECT l.event_id, round(r.rv, 6) AS value_at FROM l ASOF LEFT JOIN r ON l.ts > r.rts
""")
def asof_strict_hot_key(spark, sf):
    """One key holds all rows, so time ranges (days) are dealt out and seeded by the ranges before them."""
    left = _events(spark, sf, "error", {"event_id": "event_id", "ts": "ts"}).withColumn("one", F.lit(1))
    right = _events(spark, sf, "purchase", {"ts": "rts", "value": "rv", "event_id": "rid"}).withColumn("one", F.lit(1))
    out = asof.asof_join(left, right, ["one"], "ts", "rts", ["rv"], strict=True, tiebreak=["rid"], period=lambda t: F.to_date(t))
    return out.select("event_id", rounded("rv").alias("value_at"))


@query("""
WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS fd FROM orders)
SELECT strftime(fd, '%Y-%m-%d') AS day, strftime((SELECT min(d) FROM cal WHERE d > fd), '%Y-%m-%d') AS next_day, strftime((SELECT max(d) FROM cal WHERE d < fd), '%Y-%m-%d') AS prev_day FROM o
""")
def next_prev_trading_day(spark, sf):
    """Strictly next and strictly previous trading day."""
    calendar = asof.trading_calendar(table(spark, sf, "lineitem"), "l_shipdate")
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("fd")).distinct()
    after = asof.align_to_calendar(days, "fd", calendar, "strict_next").withColumnRenamed("aligned_day", "n")
    both = asof.align_to_calendar(after, "fd", calendar, "strict_previous")
    return both.select(text_date("fd").alias("day"), text_date("n").alias("next_day"), text_date("aligned_day").alias("prev_day"))


@query("SELECT strftime(d, '%Y-%m-%d') AS day, CAST(row_number() OVER (ORDER BY d) - 1 AS BIGINT) AS trade_index FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)")
def calendar_index(spark, sf):
    c = asof.trading_calendar(table(spark, sf, "lineitem"), "l_shipdate")
    return c.select(text_date("day").alias("day"), F.col("trade_index").cast("long").alias("trade_index"))


@query("""
SELECT coalesce(a.k, b.k) AS k, round(a.v, 4) AS price, round(b.v, 4) AS quantity, a.k IS NOT NULL AS has_price, b.k IS NOT NULL AS has_quantity
FROM (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
FULL JOIN (SELECT l_suppkey * 7 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1) b ON a.k = b.k
""")
def full_outer_coalesce(spark, sf):
    """Full outer join with one key column and presence flags."""
    a = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("price"), F.lit(True).alias("has_price"))
    b = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") * 7).alias("k")).agg(F.sum("l_quantity").alias("quantity"), F.lit(True).alias("has_quantity"))
    out = a.join(b, "k", "full")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("k", rounded("price", 4).alias("price"), rounded("quantity", 4).alias("quantity"), flag("has_price"), flag("has_quantity"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_gate(spark, sf):
    allowed = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(allowed, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_gap(spark, sf):
    seen = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey")


@query("""
WITH d AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p, max(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2, 3),
f AS (SELECT o_custkey, year(day) AS y, count(*) AS n, max(v) AS v FROM c GROUP BY 1, 2)
SELECT d.o_orderkey, CASE WHEN c.v IS NOT NULL THEN 'EXACT' WHEN f.n = 1 THEN 'FALLBACK' WHEN f.n > 1 THEN 'AMBIGUOUS_FALLBACK_REJECTED' ELSE 'NO_MATCH' END AS status,
round(CASE WHEN c.v IS NOT NULL THEN c.v WHEN f.n = 1 THEN f.v END, 4) AS value
FROM d LEFT JOIN c ON d.o_custkey = c.o_custkey AND d.day = c.day AND d.p = c.p LEFT JOIN f ON d.o_custkey = f.o_custkey AND year(d.day) = f.y
""")
def exact_then_unique_fallback(spark, sf):
    """Exact match on three keys; misses fall back to two where that is unique."""
    o = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("y", F.year("day"))
    docs = o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "day", "y", F.col("o_orderpriority").alias("p"))
    candidates = o.filter("o_orderstatus <> 'F'").groupBy("o_custkey", "day", "y", F.col("o_orderpriority").alias("p")).agg(F.max("o_totalprice").alias("value"))
    out = enrich.exact_or_unique(docs, candidates, ["o_custkey", "day", "p"], ["o_custkey", "y"], ["value"])
    return out.select("o_orderkey", F.col("match_status").alias("status"), rounded("value", 4).alias("value"))


@query("""
WITH x AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY d, o_orderkey) AS n FROM x) WHERE n = 1),
s AS (SELECT *, lag(d) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS p FROM f)
SELECT o_custkey, o_orderkey, strftime(d, '%Y-%m-%d') AS day FROM s WHERE p IS NULL OR datediff('day', p, d) >= 180
""")
def first_per_year_spaced(spark, sf):
    """First filing of each firm and year, then at least 180 days after the one before."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d")).withColumn("y", F.year("d"))
    first = windows.first_per_key(o, ["o_custkey", "y"], [F.col("d"), F.col("o_orderkey")])
    kept = windows.spaced(first, ["o_custkey"], "d", [F.col("d"), F.col("o_orderkey")], 180)
    return kept.select("o_custkey", "o_orderkey", text_date("d").alias("day"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def keep_last_per_key(spark, sf):
    order = [F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber")]
    return windows.first_per_key(table(spark, sf, "lineitem"), ["l_suppkey"], order).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""
WITH n AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem),
b AS (SELECT max(v) FILTER (WHERE i = floor(0.01 * (n - 1) + 0.5)) AS lo, max(v) FILTER (WHERE i = floor(0.99 * (n - 1) + 0.5)) AS hi FROM n)
SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 4) AS price FROM lineitem, b
""")
def winsorize_nearest(spark, sf):
    out = windows.winsorize(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", rounded("l_extendedprice", 4).alias("price"))


@query("""
WITH x AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'infinity'::DOUBLE ELSE value END AS v FROM events),
n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM x WHERE NOT isinf(v)),
b AS (SELECT max(v) FILTER (WHERE i = floor(0.05 * (n - 1) + 0.5)) AS lo, max(v) FILTER (WHERE i = floor(0.95 * (n - 1) + 0.5)) AS hi FROM n)
SELECT event_id, CASE WHEN isinf(v) THEN NULL ELSE round(least(greatest(v, lo), hi), 6) END AS value, isinf(v) AS infinite FROM x, b
""")
def winsorize_finite(spark, sf):
    """Bounds from finite values; infinities pass and are blanked afterwards."""
    x = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 97 == 0, float("inf")).otherwise(F.col("value")).alias("v"))
    out = windows.winsorize(x, "v", 0.05, 0.95, finite_only=True)
    return out.select("event_id", rounded(X.finite_or_null(F.col("v"))).alias("value"), (F.col("v") == float("inf")).alias("infinite"))


@query("""
WITH p AS (SELECT *, p_size > 10 AS a, p_retailprice < 1500 AS b, p_type <> 'ECONOMY' AS c FROM part)
SELECT * FROM (SELECT 0 AS step, 'start' AS name, count(*) AS kept, 0 AS removed FROM p UNION ALL SELECT 1, 'size', count(*) FILTER (WHERE a), count(*) - count(*) FILTER (WHERE a) FROM p
UNION ALL SELECT 2, 'price', count(*) FILTER (WHERE a AND b), count(*) FILTER (WHERE a) - count(*) FILTER (WHERE a AND b) FROM p
UNION ALL SELECT 3, 'type', count(*) FILTER (WHERE a AND b AND c), count(*) FILTER (WHERE a AND b) - count(*) FILTER (WHERE a AND b AND c) FROM p)
""")
def attrition_ladder(spark, sf):
    steps = [("size", F.col("p_size") > 10), ("price", F.col("p_retailprice") < 1500), ("type", F.col("p_type") != "ECONOMY")]
    return windows.attrition_ladder(table(spark, sf, "part"), steps)


@query("""
WITH m AS (SELECT year(o_orderdate) AS y, o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT CAST(y AS BIGINT) AS y, o_custkey, CAST(floor((row_number() OVER (PARTITION BY y ORDER BY s, o_custkey) - 1) * 5 / count(*) OVER (PARTITION BY y)) + 1 AS BIGINT) AS quintile FROM m
""")
def quintile_assignment(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), "o_custkey").agg(F.sum("o_totalprice").cast("decimal(20,2)").alias("s"))
    out = windows.rank_bucket(m, ["y"], [F.col("s"), F.col("o_custkey")], 5, "quintile")
    return out.select("y", "o_custkey", F.col("quintile").cast("long").alias("quintile"))


@query("""
WITH x AS (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value) END AS v FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0 AS k, count(v) OVER (PARTITION BY event_type) AS n FROM x),
l AS (SELECT *, CASE WHEN v IS NOT NULL THEN least(greatest(ceil(k / n * 4), 1), 4) END AS label FROM r)
SELECT event_id, CAST(label AS BIGINT) AS label, round((label - 1) / 3, 6) AS score, CASE WHEN label = 4 THEN 0.5 WHEN label = 1 THEN -0.5 WHEN label IS NOT NULL THEN 0.0 END AS extreme FROM l
""")
def avg_rank_quantile_label(spark, sf):
    x = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 11 != 0, F.round("value")).alias("v"))
    out = windows.average_rank_bucket(x, ["event_type"], "v", 4)
    return out.select("event_id", F.col("label").cast("long").alias("label"), rounded("score").alias("score"), F.col("extreme").cast("double").alias("extreme"))


@query("SELECT DISTINCT event_type, round(value, 6) AS value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 9) AS ecdf FROM events")
def ecdf(spark, sf):
    return windows.ecdf(table(spark, sf, "events"), "value", ["event_type"]).select("event_type", rounded("value").alias("value"), rounded("ecdf", 9).alias("ecdf"))


@query("""
WITH d AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS e FROM orders),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR datediff('day', reach, s) > 31 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT k, strftime(min(s), '%Y-%m-%d') AS s, strftime(max(e), '%Y-%m-%d') AS e, count(*) AS parts FROM i GROUP BY k, g
""")
def merge_intervals(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("s"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 40).cast("int")).alias("e")).distinct()
    return windows.merge_intervals(d, ["k"], "s", "e", 30).select("k", text_date("s").alias("s"), text_date("e").alias("e"), "parts")


@query("""
WITH c AS (SELECT l_suppkey, l_returnflag || l_linestatus AS f, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, f AS mode FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f) AS r FROM c) WHERE r = 1
""")
def mode_per_group(spark, sf):
    x = table(spark, sf, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("mode"))
    return windows.mode_per_key(x, ["l_suppkey"], "mode")


@query("""
WITH x AS (SELECT user_id, ts, CASE WHEN event_type = 'view' THEN value END AS a, CASE WHEN event_type = 'click' THEN value END AS b FROM events)
SELECT user_id, round(arg_max(a, ts) FILTER (WHERE a IS NOT NULL), 6) AS a, round(arg_max(b, ts) FILTER (WHERE b IS NOT NULL), 6) AS b FROM x GROUP BY 1
""")
def last_nonnull_per_group(spark, sf):
    x = table(spark, sf, "events").select("user_id", "ts", *[F.when(F.col("event_type") == k, F.col("value")).alias(n) for k, n in (("view", "a"), ("click", "b"))])
    return windows.last_non_null(x, ["user_id"], "ts", ["a", "b"]).select("user_id", rounded("a").alias("a"), rounded("b").alias("b"))


@query("""
WITH m AS (SELECT event_type, CAST(ts AS DATE) AS d, avg(value) / 1000 - 0.05 AS r FROM events GROUP BY 1, 2)
SELECT event_type, strftime(d, '%Y-%m-%d') AS d, round(exp(sum(ln(1 + r)) OVER (PARTITION BY event_type ORDER BY d)) - 1, 6) AS cumulative FROM m
""")
def cumulative_return(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg((F.avg("value") / 1000 - 0.05).alias("r"))
    return windows.cumulative_return(m, ["event_type"], "d", "r").select("event_type", text_date("d").alias("d"), rounded("cumulative").alias("cumulative"))


@query("""
SELECT event_type, CAST(CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 9 ELSE floor(p * 10) END AS BIGINT) AS bin, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 9 ELSE floor(p * 10) END) AS BIGINT) AS cumulative
FROM (SELECT event_type, value / 100 AS p FROM events) GROUP BY event_type, CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 9 ELSE floor(p * 10) END
""")
def histogram_bins(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type", X.score_bin(F.col("value") / 100, 10).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy("event_type").orderBy("bin")))


@query("""
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, ids FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, string_agg(CAST(event_id AS VARCHAR) || '@' || event_type, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY 1, 2)
""")
def filings_array_bag(spark, sf):
    """Ordered bag of a key's rows a day, as parallel arrays (joined here)."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    bag = e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("bag"))
    ids = F.array_join(F.transform("bag", lambda x: F.concat_ws("@", x["event_id"], x["event_type"])), ",")
    return bag.select("user_id", text_date("day").alias("day"), "n", ids.alias("ids"))


@query("""
WITH k AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id, lag(event_type) OVER w AS a, lead(event_type) OVER w AS b, event_type AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, a AS before, b AS after, CASE WHEN a = b AND a <> e THEN a ELSE e END AS extended FROM k
""")
def neighbour_extension(spark, sf):
    """A row takes what both its neighbours agree on; neighbours' own values only, so nothing cascades."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), "event_type")
    extended = F.when((F.col("before") == F.col("after")) & (F.col("before") != F.col("event_type")), F.col("before")).otherwise(F.col("event_type"))
    return e.select("event_id", "before", "after", extended.alias("extended"))
