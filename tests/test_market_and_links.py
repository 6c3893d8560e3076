from datetime import date

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import catalog
from ledgerline.functions import exprs as X
from ledgerline.operators import accounting, asof, enrich, events, items, lexicon, links, market, regress, reports, scores
from ledgerline.operators.market import FLAGS
from ledgerline.plans import market_queries

D = date


def link(cik="0000000001", gvkey="10", permno=100, start=D(1990, 1, 1), end=None, tier=10, rank=90, quality=4.0, sparse=False, source=1):
    return (cik, gvkey, permno, "01", start, end, tier, source, rank, quality, not sparse, sparse)


LINKS = "cik_10 string, gvkey string, kypermno int, liid string, valid_start date, valid_end date, row_quality_tier int, source_priority int, link_rank_effective int, link_quality double, has_window boolean, is_sparse_fallback boolean"


def resolve(spark, rows, filing=D(2000, 1, 1), cik="0000000001"):
    f = spark.createDataFrame([("d", cik, filing)], "doc_id string, cik_10 string, filing_date date")
    return links.resolve_links(f, spark.createDataFrame(rows, LINKS)).first()


def test_link_reasons(spark):
    assert resolve(spark, [link()])["phase_a_reason"] == "OK"
    assert resolve(spark, [link()], filing=None)["phase_a_reason"] == "BAD_INPUT"
    assert resolve(spark, [link(cik="0000000002")])["phase_a_reason"] == "CIK_NOT_IN_LINK_UNIVERSE"
    assert resolve(spark, [link(permno=-1)])["phase_a_reason"] == "CIK_PRESENT_NO_POSITIVE_LINK"
    assert resolve(spark, [link(end=D(1995, 1, 1))])["phase_a_reason"] == "NO_DATE_VALID_POSITIVE_LINK"
    r = resolve(spark, [link(), link(permno=200)])
    assert (r["phase_a_reason"], r["kypermno"], r["top_rank_tie_count"]) == ("AMBIGUOUS_LINK", None, 2)
    assert resolve(spark, [link(), link(permno=200, tier=20)])["kypermno"] == 100
    assert resolve(spark, [link(quality=1.0), link(permno=200, quality=4.0)])["kypermno"] == 200
    assert resolve(spark, [link(sparse=True, permno=300, tier=1), link()])["kypermno"] == 100
    assert resolve(spark, [link(sparse=True, permno=300)])["kypermno"] == 300


def test_premerge_codes(spark):
    f = spark.createDataFrame([("a", "1", D(2020, 1, 2)), ("b", "1", D(2020, 1, 9)), ("c", "1", D(2020, 3, 1)), ("x", "9", D(2020, 1, 2))], "doc_id string, cik_10 string, filing_date date")
    daily = spark.createDataFrame([(100, D(2020, 1, 3), 1.0), (100, D(2020, 1, 10), None), (100, D(2020, 2, 10), 2.0)], "KYPERMNO int, CALDT date, RET double")
    spec = links.join_spec("next_trading_day", required_features=("RET",))
    got = {r["doc_id"]: r["match_reason_code"] for r in links.premerge(f, spark.createDataFrame([link()], LINKS), daily, spec).collect()}
    assert got == {"a": "OK", "b": "REQUIRED_DAILY_FEATURE_MISSING", "c": "OUT_OF_CCM_COVERAGE", "x": "CIK_NOT_IN_LINK_UNIVERSE"}
    with pytest.raises(ValueError, match="alignment"):
        links.JoinSpec(alignment="FIRST_CLOSE_AFTER_ACCEPTANCE")


def test_canonical_links(spark):
    h = spark.createDataFrame([("10", 100, "01", D(1990, 1, 1), D(1999, 12, 31), "LC", "P", None), ("10", 101, "02", None, None, None, None, None)], "gvkey string, LPERMNO int, LIID string, LINKDT date, LINKENDDT date, LINKTYPE string, LINKPRIM string, LINKRANK int")
    fiscal = h.limit(0)
    hist = spark.createDataFrame([("10", "1.0", D(1995, 1, 1), D(2005, 1, 1))], "KYGVKEY string, HCIK string, HCHGDT date, HCHGENDDT date")
    desc = spark.createDataFrame([("10", "7"), ("11", "8")], "KYGVKEY string, CIK string")
    got = {r["kypermno"]: r for r in links.canonical_links(h, fiscal, hist, desc).collect()}
    assert (got[100]["cik_10"], got[100]["valid_start"], got[100]["valid_end"]) == ("0000000001", D(1990, 1, 1), D(1999, 12, 31))
    assert (got[100]["link_rank_effective"], got[100]["row_quality_tier"], got[101]["row_quality_tier"], got[101]["is_sparse_fallback"]) == (90, 10, 90, True)
    assert links.link_coverage(links.canonical_links(h, fiscal, hist, desc)).first()["rows"] == 2


def test_counted_links_give_the_same_status(spark):
    sf = "/root/testdata/sf0.001"
    rows, counted = market_queries._links(spark, sf), market_queries._links(spark, sf, counted=True)
    assert counted.agg({"alike": "sum"}).first()[0] == rows.count()
    filings = market_queries._filings(spark, sf)
    daily = spark.createDataFrame([(k, D(1995 + k % 6, 3, 1), 1.0) for k in range(1, 30)], "KYPERMNO int, CALDT date, TAX double")
    spec = links.join_spec("next_trading_day", required_features=("TAX",))
    one, other = (sorted(map(repr, links.premerge(filings, x, daily, spec, distinct_links=False).collect())) for x in (rows, counted))
    assert one == other and len(one) == filings.count()
    with pytest.raises(ValueError, match="counted"):
        links.premerge(filings, counted, daily, spec)


def test_status_table_counts_repeated_links_as_its_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        (df.unionByName(df.filter("c_custkey % 3 = 0")) if t == "customer" else df).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT doc_id, candidates FROM ({catalog.ORACLES['match_status_table']})").fetchall())
    got = {r["doc_id"]: r["candidates"] for r in catalog.QUERIES["match_status_table"](spark, str(tmp_path)).collect()}
    assert got == want


def test_links_of_a_filer_in_several_packs(spark):
    many = [link(permno=100 + i, start=D.fromordinal(D(1990, 1, 1).toordinal() + i), rank=5 + i // 100) for i in range(300)]
    r = resolve(spark, many)
    assert (r["phase_a_reason"], r["link_candidate_count"], r["top_rank_tie_count"]) == ("AMBIGUOUS_LINK", 300, 100)
    r = resolve(spark, [*many, link(permno=7, rank=1)])
    assert (r["phase_a_reason"], r["kypermno"], r["link_candidate_count"], r["top_rank_tie_count"]) == ("OK", 7, 301, 1)


def test_price_panel(spark):
    dp = spark.createDataFrame([(1, D(2020, 1, 2), -5.0, 0.1, 0.1, 60000.0, 10.0), (1, D(2020, 1, 3), 6.0, 0.2, 0.2, 70000.0, 20.0)], "KYPERMNO int, CALDT date, PRC double, RET double, RETX double, TCAP double, VOL double")
    ds = spark.createDataFrame([(1, D(2020, 1, 3), 5.5, 6.5), (2, D(2020, 1, 3), 1.0, 2.0)], "KYPERMNO int, CALDT date, BIDLO double, ASKHI double")
    delist = spark.createDataFrame([(1, D(2020, 1, 6), 500, 5.0, 0.0, -0.5, -0.5)], "KYPERMNO int, DLSTDT date, DLSTCD int, DLPRC double, DLAMT double, DLRET double, DLRETX double")
    names = spark.createDataFrame([(1, D(2019, 1, 1), D(2020, 1, 2), "TCK", 11, 1, "N", "A", "R")], "KYPERMNO int, NAMEDT date, NAMEENDDT date, TICKER string, SHRCD int, EXCHCD int, PRIMEXCH string, TRDSTAT string, SECSTAT string")
    header = spark.createDataFrame([(1, D(2019, 1, 1), D(2020, 12, 31), 10, 3, "Q", "A", "R")], "KYPERMNO int, BEGDT date, ENDDT date, HSHRCD int, HEXCD int, HPRIMEXCH string, HTRDSTAT string, HSECSTAT string")
    panel = market.final_returns(market.price_panel(ds, dp, delist, names, header, "2020-01-01"))
    got = {(r["KYPERMNO"], r["CALDT"]): r for r in panel.collect()}
    a, b, c = got[1, D(2020, 1, 2)], got[1, D(2020, 1, 3)], got[2, D(2020, 1, 3)]
    assert (a["TICKER"], a["SHRCD"], b["TICKER"], b["SHRCD"], b["EXCHCD"]) == ("TCK", 11, None, 10, 3)
    assert b["DLSTDT"] == D(2020, 1, 6) and abs(b["FINAL_RET"] - (1.2 * 0.5 - 1)) < 1e-12 and a["FINAL_RET"] == 0.1 and a["DLSTDT"] is None
    assert a["FINAL_PRC"] == 5.0 and b["FINAL_PRC"] == 5.0
    assert a["data_status"] & FLAGS["CONCEPT_OK"] and not c["data_status"] & FLAGS["HAS_RET"] and c["data_status"] & FLAGS["HAS_BIDLO"]
    filings = spark.createDataFrame([(1, "10-K", D(2020, 1, 1), "10:00:00"), (1, "8-K", D(2020, 1, 2), "09:00:00"), (1, "10KA", D(2020, 1, 2), None)], "LPERMNO int, SRCTYPE string, FILEDATE date, FILEDATETIME string")
    bag = {(r["KYPERMNO"], r["CALDT"]): r for r in market.attach_filings(panel, filings).collect()}
    assert bag[1, D(2020, 1, 2)]["filing_forms"] == ["10K/A", "8K"] and bag[1, D(2020, 1, 3)]["n_filings"] == 0
    assert market.common_major(panel).count() == 2


def test_accounting(spark):
    k = (1, "STD", 2020, 12)
    bal = spark.createDataFrame([(*k, 100.0, None, 200.0, 90.0, 5.0, 10.0)], "KYGVKEY int, KEYSET string, FYYYY int, fyra int, SEQ double, CEQ double, AT double, LT double, TXDITC double, PSTK double")
    inc = spark.createDataFrame([(*k, 20.0, 3.0, 1.0, 2.0)], "KYGVKEY int, KEYSET string, FYYYY int, fyra int, IB double, XINT double, TXDI double, DVP double")
    per = spark.createDataFrame([(*k, 2022, 12, None)], "KYGVKEY int, KEYSET string, FYYYY int, fyra int, FYEAR int, FYR int, APDEDATE date")
    annual = accounting.annual_panel(bal, inc, per)
    r = annual.first()
    assert (r["book_equity_be"], r["earnings_e"], r["cash_flow_y"], r["accounting_period_end"]) == (95.0, 24.0, 19.0, D(2022, 12, 31))
    f = spark.createDataFrame([("a", 1, D(2023, 6, 1)), ("b", 1, D(2024, 2, 1))], "doc_id string, gvkey_int int, filing_date date")
    got = {x["doc_id"]: x["book_equity_be"] for x in accounting.attach_latest_annual(f, annual, ["book_equity_be"]).collect()}
    assert got == {"a": 95.0, "b": None}
    q = spark.createDataFrame([(1, D(2023, 6, 1), 1.0), (1, D(2023, 8, 1), 2.0)], "gvkey_int int, quarter_report_date date, v double")
    assert [x["v"] for x in accounting.attach_next_quarter(f, q, ["v"]).orderBy("doc_id").collect()] == [2.0, None]


def no_broadcast(df):
    return "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_annual_panel_is_not_broadcast(spark):
    # rows are multiplied after their size is estimated, so an estimate under the limit says nothing of what a broadcast would hold
    assert no_broadcast(catalog.QUERIES["annual_panel"](spark, "/root/testdata/sf0.001"))


def test_quarterly_panel_is_not_broadcast(spark):
    assert no_broadcast(catalog.QUERIES["attach_quarterly"](spark, "/root/testdata/sf0.001"))


def test_event_screen(spark):
    rng = np.random.default_rng(2)
    days = [D.fromordinal(D(2019, 1, 1).toordinal() + i) for i in range(520)]
    fac = rng.normal(0, 0.01, (520, 3))
    ret = 0.001 + 0.0001 + fac @ [1.1, 0.4, -0.2] + rng.normal(0, 0.001, 520)
    vol = rng.uniform(50, 150, 520)
    daily = spark.createDataFrame([(1, d, float(r), float(v), 100.0, 10, 3) for d, r, v in zip(days, ret, vol, strict=True)], "KYPERMNO int, CALDT date, RET double, VOL double, SHROUT double, SHRCD int, EXCHCD int")
    factors = spark.createDataFrame([(d, *map(float, f), 0.0001) for d, f in zip(days, fac, strict=True)], "trading_date date, mkt_rf double, smb double, hml double, rf double")
    docs = spark.createDataFrame([("a", 1, days[260])], "doc_id string, KYPERMNO int, filing_trade_date date")
    r = events.event_screen(docs, daily, factors, asof.trading_calendar(daily, "CALDT")).first()
    window = slice(260 - 252, 260 - 5)
    x = np.column_stack([np.ones(247), fac[window]])
    beta, ssr, *_ = np.linalg.lstsq(x, ret[window] - 0.0001, rcond=None)
    assert abs(r["pre_ffalpha"] - beta[0]) < 1e-9 and r["pre_obs"] == 247 and not r["rank_deficient"]
    post = slice(266, 513)
    x = np.column_stack([np.ones(247), fac[post]])
    _, ssr, *_ = np.linalg.lstsq(x, ret[post] - 0.0001, rcond=None)
    assert abs(r["postevent_return_volatility"] - np.sqrt(ssr[0] / (247 - 4))) < 1e-9
    assert abs(r["filing_period_excess_return"] - (np.prod(1 + ret[260:264]) - np.prod(1 + fac[260:264, 0] + 0.0001))) < 1e-12
    base = vol[195:255]
    assert abs(r["abnormal_volume"] - (vol[260:264].mean() - base.mean()) / base.std(ddof=1)) < 1e-9
    assert abs(r["share_turnover"] - vol[8:255].sum() / 100 / 1000) < 1e-9 and r["nasdaq_dummy"] == 1


def test_regressions(spark):
    rng = np.random.default_rng(3)
    rows, est = [], []
    for q in range(6):
        n = 30 + 5 * q
        s, c, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 3, n)
        y = 0.3 * s - 0.2 * c + g + rng.normal(size=n)
        rows += [(D(2000 + q // 4, 3 * (q % 4) + 2, 1), float(a), float(b), float(d), int(e)) for a, b, d, e in zip(y, s, c, g, strict=True)]
        x = np.column_stack([np.ones(n), s, c, *[(g == k).astype(float) for k in (1, 2)]])
        est.append((n, np.linalg.lstsq(x, y, rcond=None)[0][1]))
    p = spark.createDataFrame([*rows, (D(2005, 1, 1), 1.0, 1.0, 1.0, 0), (D(2000, 2, 1), None, 1.0, 1.0, 0)], "d date, y double, s double, c double, g int")
    fits = regress.quarterly_fits(p, "y", ["s", "c"], "d", "g")
    assert fits.filter("status = 'insufficient_sample'").count() == 1
    r = regress.fama_macbeth(p, "y", ["s", "c"], "d", "g", lags=1).filter("term = 's'").first()
    w = np.array([n for n, _ in est]) / sum(n for n, _ in est)
    b = np.array([e for _, e in est])
    psi = w * (b - (w * b).sum())
    assert abs(r["estimate"] - (w * b).sum()) < 1e-9 and r["n"] == 6
    assert abs(r["se"] - np.sqrt(max((psi**2).sum() + (psi[1:] * psi[:-1]).sum(), 0))) < 1e-9
    from math import erfc, sqrt

    assert abs(r["p"] - erfc(abs(r["t"]) / sqrt(2))) < 1e-6
    grid = regress.specification_grid(p, ["y"], ["s"], ["c"], "d", "g").first()
    assert abs(grid["estimate"] - r["estimate"]) < 1e-9
    f = regress.factor_model(p.withColumn("k", F.lit("a")), "k", "y", ["s", "c"]).filter("term = 's'").first()
    assert f["n"] == len(rows) + 1 and f["status"] == "ok"


def test_enrichment(spark):
    b = spark.createDataFrame([("r1", 1, "01", D(2000, 1, 1), D(2000, 6, 1), "A.N", "A.N"), ("r2", 1, "01", D(2000, 7, 1), D(2000, 9, 1), None, ""), ("r3", 1, "01", D(2001, 1, 1), D(2001, 9, 1), "A.N", None), ("r4", 1, "02", D(2001, 1, 1), D(2001, 9, 1), "B", "C")], "bridge_row_id string, KYPERMNO int, LIID string, first_seen_caldt date, last_seen_caldt date, isin_ric string, cusip_ric string")
    got = {r["bridge_row_id"]: (r["resolution_status"], r["effective_ric"]) for r in enrich.resolve_identifiers(b).collect()}
    assert got == {"r1": ("ACCEPTED", "A.N"), "r2": ("EXTENDED", "A.N"), "r3": ("ACCEPTED", "A.N"), "r4": ("CONFLICT", None)}
    docs = spark.createDataFrame([("a", 1, D(2020, 5, 20)), ("b", 1, D(2020, 8, 20)), ("c", 9, D(2020, 5, 20))], "doc_id string, KYPERMNO int, filing_date date")
    win = spark.createDataFrame([(1, "X", D(2000, 1, 1), None)], "KYPERMNO int, ric string, window_start date, window_end date")
    req = enrich.ownership_requests(docs, win)
    rep = spark.createDataFrame([("X", D(2020, 3, 31), "Holdings by Institutions", 120.0), ("X", D(2020, 7, 10), "holdings by institutions", 50.0), ("X", D(2020, 7, 20), "holdings by institutions", 60.0), ("X", D(2020, 3, 31), "Funds", 1.0)], "ric string, date date, category string, value double")
    own = {r["doc_id"]: (r["ownership_status"], r["institutional_ownership_pct"], r["exclusion_reason"]) for r in enrich.select_ownership(req, rep).collect()}
    assert own == {"a": ("EXACT", 100.0, None), "b": ("FALLBACK", 60.0, None), "c": ("NO_MATCH", None, "NO_AUTHORITY_WINDOW")}
    br = spark.createDataFrame([(1, "X", D(2020, 1, 1), D(2020, 5, 1)), (1, "X", D(2020, 6, 1), D(2020, 9, 30))], "gvkey_int int, ric string, first_seen_caldt date, last_seen_caldt date")
    g = enrich.analyst_groups(br).first()
    assert (g["actuals_start"], g["actuals_end"], g["estimates_start"], g["estimates_end"]) == (D(2019, 12, 1), D(2021, 1, 28), D(2019, 4, 6), D(2020, 10, 31))
    act = spark.createDataFrame([(1, D(2020, 5, 1), D(2020, 3, 31), 2.0), (2, D(2020, 5, 1), None, 1.0), (3, D(2020, 5, 1), D(2020, 3, 31), 1.0)], "gvkey_int int, announcement_date date, fiscal_period_end date, actual_eps double")
    est = spark.createDataFrame([(1, D(2020, 3, 31), D(2020, 4, 15), 1.5, 0.1), (1, D(2020, 3, 31), D(2019, 12, 1), 1.0, 0.1), (2, D(2020, 3, 31), D(2020, 4, 15), 1.5, 0.1)], "gvkey_int int, fiscal_period_end date, calc_date date, mean double, dispersion double")
    p = {r["gvkey_int"]: r for r in enrich.analyst_panel(act, est).collect()}
    assert p[1]["forecast_revision_4m"] == 0.5 and p[1]["rejection_code"] is None and p[2]["fiscal_period_end"] == D(2020, 3, 31) and p[3]["rejection_code"] == "NO_SNAPSHOT"
    obs = spark.createDataFrame([(1, r, D(2020, 1 + i // 4, 1), f"c{i % 4}", float(i)) for r in ("P", "Q") for i in range(16)] + [(1, "R", D(2020, 1, 1), "c0", 9.0)], "KYPERMNO int, ric string, date date, category string, value double")
    assert [tuple(r) for r in enrich.alias_pairs(obs).collect()] == [(1, "P", "Q")]


def test_tail_surface(spark):
    rows = [("d", i, p, w) for i, (p, w) in enumerate(zip((0.95, 0.85, 0.75, 0.55, 0.35, 0.15), (1, 2, 1, 1, 1, 1), strict=True))]
    r = scores.tail_surface(spark.createDataFrame(rows, "doc_id string, i int, p double, w int"), ["doc_id"], "p", "w", ["i"]).first()
    assert abs(r["exposure_60"] - 3.4 / 7) < 1e-12 and abs(r["exposure_80"] - 2.65 / 7) < 1e-12 and abs(r["share_70"] - 4 / 7) < 1e-12
    assert abs(r["top_10_mean"] - 0.95) < 1e-12 and abs(r["top_20_mean"] - 2.65 / 3) < 1e-12


def test_text(spark):
    assert scores.split_sentences("Mr. Smith went home. It was late! See U.S. law.") == ["Mr. Smith went home.", "It was late!", "See U.S. law."]
    assert scores.stitch(["A claim.", "See id. 5.", "-----", "(a)", "Next one."]) == ["A claim. See id. 5. (a)", "Next one."]
    assert "".join(scores.chunks("word " * 100, 60)) == "word " * 100
    docs = spark.createDataFrame([("a", "loss loss gain other"), ("b", "gain thing"), ("c", ""), ("d", None)], "doc_id string, text string")
    lex = lexicon.lexicon_frame(spark, {"negative": ["loss"], "positive": ["gain"]})
    got = {r["doc_id"]: r for r in lexicon.signals(docs, lex, ["negative", "positive"]).collect()}
    assert got["a"]["negative_prop"] == 0.5 and abs(got["a"]["negative_tfidf"] - (1 + np.log(2)) / (1 + np.log(4)) * np.log(4)) < 1e-12
    assert abs(got["b"]["positive_tfidf"] - 1 / (1 + np.log(2)) * np.log(2)) < 1e-12 and got["c"]["negative_prop"] is None and got["d"]["total_tokens"] == 0


def test_segmentation(spark):
    prose = "The company makes many things and sells them in every part of the world to all of its customers.\n" * 8
    toc = "TABLE OF CONTENTS\nItem 1. Business ........ 3\nItem 1A. Risk Factors ...... 9\nItem 7. Management ...... 20\n\n"
    text = f"{toc}PART I\nItem 1. Business\n{prose}as we say in Item 7 below.\nItem 1A. Risk Factors\n{prose}\n- 12 -\n\nItem 4. [Reserved]\nPART II\nItem 7. Management's Discussion\n{prose}"
    got = {r["item_id"]: r for r in items.extract_items(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()}
    assert set(got) == {"1", "1A", "4", "7"} and got["4"]["item_status"] == "reserved" and got["7"]["item_part"] == "II"
    assert got["1"]["full_text"].startswith("Business") and "below." in got["1"]["full_text"] and "- 12 -" not in got["1A"]["full_text"]
    assert items.segment("nothing here") == [] and items.segment("Item 1. X\n" + prose, "10-K/A") == []


def test_expressions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(X.cik10(F.lit(" 123.0 "))) == "0000000123" and get(X.cik10(F.lit("x"))) is None
    assert get(X.zfill(F.lit("12345"), 3)) == "12345"
    assert get(X.normalize_form(F.lit("10-k a".replace(" ", "")))) == "10K/A"
    assert get(X.guarded_date(F.lit(20200230))) is None and get(X.guarded_date(F.lit(20200229))) == D(2020, 2, 29)
    assert get(X.share_code_name(F.lit(11))) == "Ordinary Common / Not Needing Further Definition" and get(X.share_code_name(F.lit(59))) is None
    assert get(X.majority_bucket(F.lit(0.4), F.lit(0.4), F.lit(0.2))) == "no_majority"
    with pytest.raises(Exception, match="tokens"):
        get(X.token_bucket(F.lit(600)))
    assert get(X.finite_or_null(F.lit(float("inf")))) is None and np.isnan(get(X.finite_or_null(F.lit(float("nan")))))
    total = reports.with_total(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"), "k", [F.sum("v").alias("s")]).collect()
    assert sorted((str(r["k"]), r["s"]) for r in total) == [("None", 3), ("TOTAL", 6), ("a", 1), ("b", 2)]
