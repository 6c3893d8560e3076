from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.contracts import align_to, assert_unique, project_with_defaults, require_columns, union_relaxed
from ledgerline.operators import asof, sampling, windows


def brute_asof(left, right, direction, strict):
    out = []
    for i, k, t in left:
        best = None
        for rk, rt, v in right:
            if k is None or t is None or rk != k or rt is None:
                continue
            ok = (rt < t if strict else rt <= t) if direction == "backward" else (rt > t if strict else rt >= t)
            if ok and (best is None or (rt, v) > (best[0], best[1]) and direction == "backward" or direction == "forward" and (-best[0], best[1]) < (-rt, v)):
                best = (rt, v)
        out.append((i, None if best is None else best[1]))
    return sorted(out)


@pytest.mark.parametrize(("direction", "strict"), [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
@pytest.mark.parametrize("split", [False, True])
def test_asof_matches_brute_force(spark, direction, strict, split):
    rng = np.random.default_rng(1)
    pick = lambda n, top: [None if x == 0 else int(x) for x in rng.integers(0, top, n)]
    left = [(i, k, t) for i, (k, t) in enumerate(zip(pick(80, 5), pick(80, 40), strict=True))]
    right = [(k, t, i) for i, (k, t) in enumerate(zip(pick(60, 5), pick(60, 40), strict=True))]
    lf, rf = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, rt int, v int")
    period = (lambda c: F.floor(c / 10)) if split else None
    got = asof.asof_join(lf, rf, ["k"], "t", "rt", ["v"], direction=direction, strict=strict, tiebreak=["v"], period=period)
    assert sorted((r["i"], r["v"]) for r in got.collect()) == brute_asof(left, right, direction, strict)


def test_stale_nearest_row_gives_null(spark):
    left = spark.createDataFrame([(1, date(2020, 5, 1)), (1, date(2020, 1, 15)), (None, date(2020, 1, 15)), (1, None)], "k int, d date")
    right = spark.createDataFrame([(1, date(2020, 1, 1), date(2021, 1, 1), "a"), (1, date(2020, 4, 1), date(2020, 4, 15), "b")], "k int, s date, e date, v string")
    got = asof.asof_join(left, right, ["k"], "d", "s", ["v"], valid_until="e").collect()
    assert sorted((str(r["k"]), str(r["d"]), r["v"], r["matched"]) for r in got) == [("1", "2020-01-15", "a", True), ("1", "2020-05-01", None, False), ("1", "None", None, False), ("None", "2020-01-15", None, False)]
    near = asof.asof_join(left, right, ["k"], "d", "s", ["v"], tolerance_days=20).collect()
    assert {(str(r["d"]), r["v"]) for r in near if r["k"]} == {("2020-01-15", "a"), ("2020-05-01", None), ("None", None)}


def test_calendar(spark):
    days = spark.createDataFrame([(date(2020, 1, d),) for d in (2, 3, 6, 7, 7)], "d date")
    c = asof.trading_calendar(days, "d")
    assert [r["trade_index"] for r in c.orderBy("day").collect()] == [0, 1, 2, 3]
    f = spark.createDataFrame([(date(2020, 1, 3),), (date(2020, 1, 4),), (date(2020, 1, 8),), (None,)], "x date")
    get = lambda mode: [str(r["aligned_day"]) for r in asof.align_to_calendar(f, "x", c, mode).orderBy("x").collect()]
    assert get("exact_or_next") == ["None", "2020-01-03", "2020-01-06", "None"]
    assert get("strict_next") == ["None", "2020-01-06", "2020-01-06", "None"]
    assert get("exact") == ["None", "2020-01-03", "None", "None"]
    assert get("strict_previous") == ["None", "2020-01-02", "2020-01-03", "2020-01-07"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 20)), min_size=1, max_size=40))
def test_nearest_quantile(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    r = windows.nearest_quantile(df, "v", [0.0, 0.25, 0.5, 1.0]).first()
    s = sorted(v for v in values if v is not None)
    want = [s[int(np.floor(q * (len(s) - 1) + 0.5))] if s else None for q in (0.0, 0.25, 0.5, 1.0)]
    assert list(r) == want


def test_merge_intervals_and_ranks(spark):
    d = lambda m, x: date(2020, m, x)
    df = spark.createDataFrame([(1, d(1, 1), d(1, 31)), (1, d(1, 5), d(1, 6)), (1, d(2, 1), d(2, 3)), (1, d(3, 1), d(3, 2)), (2, d(1, 1), d(1, 1))], "k int, s date, e date")
    got = sorted((r["k"], str(r["s"]), str(r["e"]), r["parts"]) for r in windows.merge_intervals(df, ["k"], "s", "e", 0).collect())
    assert got == [(1, "2020-01-01", "2020-02-03", 3), (1, "2020-03-01", "2020-03-02", 1), (2, "2020-01-01", "2020-01-01", 1)]
    r = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 1, 2, 5, 8, 9])], "i int, v double")
    assert [x["bucket"] for x in windows.rank_bucket(r, [], [F.col("v"), F.col("i")], 5).orderBy("v", "i").collect()] == [1, 1, 2, 3, 3, 4, 5]
    back = spark.createDataFrame([("a", 1, 0.5), ("a", 2, -1.5), ("a", 3, None), ("a", 4, -3.0)], "k string, t int, r double")
    assert [round(x["cumulative"], 9) for x in windows.cumulative_return(back, ["k"], "t", "r").orderBy("t").collect()] == [0.5, -1.75, -1.75, 0.5]


def test_contracts(spark):
    df = spark.createDataFrame([("1", "x"), ("y", "x")], "a string, b string")
    with pytest.raises(ValueError, match=r"feed missing required columns: \['c'\]"):
        require_columns(df, ["a", "c"], "feed")
    assert [tuple(r) for r in project_with_defaults(df, {"a": "int", "n": "long"}, {"n": 0}).collect()] == [(1, 0), (None, 0)]
    assert align_to(df, spark.createDataFrame([], "b string, z date").schema).columns == ["b", "z"]
    with pytest.raises(ValueError, match="duplicate"):
        assert_unique(df, ["b"], "t")
    assert union_relaxed([df, df.select("a")]).count() == 4


def test_apportion():
    assert sampling.apportion(10, {"a": 1, "b": 1, "c": 1}, {"a": 9, "b": 9, "c": 9}) == {"a": 4, "b": 3, "c": 3}
    assert sampling.apportion(10, {"a": 8, "b": 1, "c": 1}, {"a": 3, "b": 9, "c": 9}) == {"a": 3, "b": 4, "c": 3}
    assert sampling.apportion(3, {"a": 98, "b": 1, "c": 1}, {"a": 9, "b": 9, "c": 9}, at_least_one=True) == {"a": 1, "b": 1, "c": 1}
    assert sum(sampling.apportion(99, {"a": 2, "b": 3}, {"a": 4, "b": 5}).values()) == 9
    assert sampling.half_up(5, 0.5) == 3


def test_quota_sample(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("s"))
    q = lambda n: spark.createDataFrame([(i, n) for i in range(3)], "s long, quota int")
    big, small = (sampling.quota_sample(df, ["s"], q(n), 1, ["id"]) for n in (10, 4))
    assert big.count() == 30 and small.join(big, "id", "left_anti").count() == 0
    with pytest.raises(ValueError, match="short"):
        sampling.check_quota(big, ["s"], q(50))
    assert sampling.exact_entity_sample(df, "s", 0.34, 7).select("s").distinct().count() == 2


def test_datetimes_keep_type(spark):
    left = spark.createDataFrame([(1, datetime(2020, 1, 1, 5))], "k int, t timestamp")
    right = spark.createDataFrame([(1, date(2020, 1, 1), 7)], "k int, d date, v int")
    r = asof.asof_join(left, right, ["k"], "t", "d", ["v"]).first()
    assert r["v"] == 7 and r["asof_d"] == date(2020, 1, 1)


def test_alignment_far_outside_the_calendar(spark):
    c = asof.trading_calendar(spark.sql("select explode(array(date'2020-01-02', date'2020-01-06')) d"), "d")
    f = spark.sql("select explode(array(date'1990-05-05', date'2020-01-03', date'2050-05-05', cast(null as date))) x")
    get = lambda mode: {str(r["x"]): str(r["aligned_day"]) for r in asof.align_to_calendar(f, "x", c, mode).collect()}
    for mode in ("exact_or_next", "strict_next"):
        assert get(mode) == {"1990-05-05": "2020-01-02", "2020-01-03": "2020-01-06", "2050-05-05": "None", "None": "None"}
    for mode in ("previous", "strict_previous"):
        assert get(mode) == {"1990-05-05": "None", "2020-01-03": "2020-01-02", "2050-05-05": "2020-01-06", "None": "None"}
    assert set(get("exact").values()) == {"None"}
    assert {str(r["aligned_day"]) for r in asof.align_to_calendar(f, "x", c.limit(0)).collect()} == {"None"}
