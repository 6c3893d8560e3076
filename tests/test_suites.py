"""Cases of composed operators: what must raise, what must be read again, what a second attempt finds."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline import catalog
from ledgerline.operators import accounting, enrich, items, regress, review, sampling, windows
from ledgerline.sources import readers

SF = "/root/testdata/sf0.001"


def test_strategy_months_are_checked(spark):
    r = spark.createDataFrame([("s", date(2000, m, 28), m / 100) for m in range(1, 10)], "signal string, month_end date, long_short_return double")
    f = spark.createDataFrame([(date(2000, m, 28), (m * 7 % 5) / 10) for m in range(1, 10)], "month_end date, x double")
    assert regress.strategy_summary(r, f, ["x"]).count() == 2
    with pytest.raises(ValueError, match="twice"):
        regress.strategy_summary(r, f.union(f.limit(1)), ["x"])
    with pytest.raises(ValueError, match="lack"):
        regress.strategy_summary(r, f.filter("month(month_end) > 1"), ["x"])


def test_analysis_panel_needs_one_policy(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string")
    scope = lambda p, ids: spark.createDataFrame([(i, 0.1, p) for i in ids], "doc_id int, tone_prop double, cleaning_policy string")
    got = sorted((r["doc_id"], r["text_scope"]) for r in regress.analysis_panel(e, {"7": scope("v2", [1, 2]), "1A": scope("v2", [2])}, "v2").collect())
    assert got == [(1, "7"), (2, "1A"), (2, "7")]
    for bad in (scope("v1", [1]), scope(None, [1]), scope("v2", [1, 1])):
        with pytest.raises(ValueError):
            regress.analysis_panel(e, {"7": bad}, "v2")
    with pytest.raises(ValueError, match="no signal"):
        regress.signal_columns(e)


def test_reuse_follows_the_configuration(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/reuse"
    assert [readers.reuse_or_build(spark, path, c, build)[1] for c in ({"a": 1}, {"a": 1}, {"a": 2}, {"a": 1})] == [True, False, True, False]
    assert len(made) == 2 and readers.reuse_or_build(spark, path, {"a": 2}, build)[0].count() == 3


def test_archive_texts_and_lost_line_ends(spark):
    prose = "The company makes and sells many goods in many of the countries of the world every year. "
    raw = f"<SEC-HEADER>x\ny</SEC-HEADER>\n<TYPE>10-K\nPART\nI\nItem\n1. Business\n{prose}\nItem 2. Properties\n{prose}\n</TEXT>\n"
    got = items.extract_items(spark.createDataFrame([("d", raw)], "doc_id string, text string"), archive=True).collect()
    assert sorted((r["item_part"], r["item_id"]) for r in got) == [("I", "1"), ("I", "2")] and all("<" not in r["full_text"] for r in got)
    flat = f"Cover page. ITEM 1. Business {prose}ITEM 2. Properties {prose}"
    found = items.segment(flat)
    assert [x["item_id"] for x in found] == ["1", "2"] and flat[found[0]["heading_start"] :].startswith("ITEM 1.")


def test_samples_on_small_tables(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], float(i)) for i in range(30)], "k int, g string, v double")
    quotas = {r["g"]: r["quota"] for r in sampling.allocate(df, ["g"], 7).collect()}
    assert sum(quotas.values()) == 7 and max(quotas.values()) - min(quotas.values()) <= 1
    assert sum(r["quota"] for r in sampling.allocate(df, ["g"], 1000).collect()) == 30
    assert sampling.uniform_sample(df, 100, ["k"], 1).count() == 30 and sampling.uniform_sample(df, 5, ["k"], 1).collect() == sampling.uniform_sample(df.repartition(7), 5, ["k"], 1).collect()
    assert {r["quartile"]: r["count"] for r in sampling.quartile_sample(df, "v", ["k"], 2, 1).groupBy("quartile").count().collect()} == {1: 2, 2: 2, 3: 2, 4: 2}
    assert sampling.covering_sample(df, "g", "k", 2, 1).count() == 2 and sampling.first_n(df.limit(0), ["g"], [F.col("k")], 2).count() == 0


def test_reviews_of_empty_and_odd_tables(spark):
    df = spark.createDataFrame([("a", "a", 1.0), ("b", "a", 2.0), (None, "b", 1.0)], "g string, p string, w double")
    got = {r["label"]: (r["precision"], r["recall"]) for r in review.confusion(df, "g", "p", "w").collect()}
    assert got == {"a": (pytest.approx(1 / 3), 1.0), "b": (0.0, 0.0)}
    assert review.accuracy_bounds(df.limit(0), "g", "p").first()["accuracy"] is None
    with pytest.raises(ValueError, match="duplicate"):
        review.common_rows([df.union(df), df], ["g"])
    a = review.boundary_diagnostics(spark.createDataFrame([("x", "short")], "item string, full_text string"), ["item"])
    b = review.boundary_diagnostics(spark.createDataFrame([("x", "A long text. " * 40)], "item string, full_text string"), ["item"])
    change = {r["flag"]: r["change"] for r in review.compare_diagnostics(a, b, ["item"], ["short", "ends_open"]).collect()}
    assert change == {"short": -1.0, "ends_open": -1.0}


def test_quantiles_and_distribution_by_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = [float(x) for x in np.r_[rng.normal(size=3000), np.zeros(500), rng.integers(0, 5, 300)]]
    df = spark.createDataFrame([(x, i % 3) for i, x in enumerate(v)] + [(None, 0)], "v double, g int")
    s = sorted(v)
    q = windows.nearest_quantile(df, "v", [0.0, 0.01, 0.5, 0.99, 1.0]).first()
    assert list(q) == [s[int(p * (len(s) - 1) + 0.5)] for p in (0.0, 0.01, 0.5, 0.99, 1.0)]
    for r in windows.nearest_quantile(df, "v", [0.25], ["g"]).collect():
        own = sorted(x for i, x in enumerate(v) if i % 3 == r["g"])
        assert r["q0"] == own[int(0.25 * (len(own) - 1) + 0.5)]
    got = {r["value"]: r["ecdf"] for r in windows.ecdf(df, "v").collect()}
    assert all(got[x] == pytest.approx(np.searchsorted(s, x, side="right") / len(s)) for x in s[::97])
    assert windows.nearest_quantile(df.limit(0), "v", [0.5]).first()["q0"] is None and windows.ecdf(df.limit(0), "v").count() == 0


def test_forms_and_exact_or_unique(spark):
    forms = {"10-K": "10-K", "10-K405": "10-K", "10-KT": "10-K", "10-K405/A": "10-K/A", "10-KT-A": "10-K/A", "10-K405-A": "10-K/A", "10QT": "10-Q", "10-QT/A": "10-Q/A", "10-Q-A": "10-Q/A", "20-F": "20-F", "40F/A": "40-F/A", "8-K": "Other", "": "Other"}
    df = spark.createDataFrame([(f,) for f in forms] + [(None,)], "f string")
    got = {r["f"]: r["c"] for r in df.select("f", accounting.normalized_form(F.col("f")).alias("c")).collect()}
    assert got == forms | {None: None}
    docs = spark.createDataFrame([(1, "a", 1), (2, "a", 9), (3, "b", 9), (4, "z", 1)], "id int, x string, y int")
    cands = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 5, 50.0)], "x string, y int, v double")
    out = {r["id"]: (r["match_status"], r["v"]) for r in enrich.exact_or_unique(docs, cands, ["x", "y"], ["x"], ["v"]).collect()}
    assert out == {1: ("EXACT", 10.0), 2: ("AMBIGUOUS_FALLBACK_REJECTED", None), 3: ("FALLBACK", 50.0), 4: ("NO_MATCH", None)}


def test_registered_names_are_unique():
    assert len(catalog.QUERIES) > 150 and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_sample_that_covers_years(spark):
    rows = [(e, 2000 + y) for e in range(60) for y in range(6) if (e * 7 + y * y) % 5 < 2 + e % 3] + [(100, 2010), (None, 2000)]
    df = spark.createDataFrame(rows, "e int, y int")
    years = {y: {e for e, z in rows if z == y and e is not None} for y in {y for _, y in rows}}
    for n, least in ((12, 3), (25, 8), (500, 2)):
        got = {r["e"] for r in sampling.year_covering_sample(df, "e", "y", n, least, 5).collect()}
        assert len(got) == min(n, len({e for e, _ in rows if e is not None}))
        assert all(len(got & es) >= min(least, len(es)) for es in years.values())
    again = [sorted(map(tuple, sampling.year_covering_sample(d, "e", "y", 12, 3, 5).collect())) for d in (df, df.repartition(5))]
    assert again[0] == again[1] and sampling.year_covering_sample(df.limit(0), "e", "y", 3, 1, 5).count() == 0
