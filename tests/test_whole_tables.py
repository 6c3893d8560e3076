"""Queries that must work on all rows of their tables, held against brute force on small fixtures."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from ledgerline import catalog


def save(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_alias_components_links_all_lines(spark, tmp_path):
    rows = [(k, (k * 31 + i * i * 7) % 200, i % 7 + 1, float(i % 50 + 1)) for k in (3, 39, 40, 77) for i in range(9)]
    save(spark, tmp_path, "lineitem", rows, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double")
    root = {}
    pairs = [((k, p % 20), (k, (p * 3 + n) % 20)) for k, p, n, _ in rows]
    for a, b in pairs:
        root[a], root[b] = a, b
    for _ in range(40):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {(r["k"], r["member"]): r["root"] for r in catalog.QUERIES["alias_components"](spark, str(tmp_path)).collect()}
    assert got == {v: r[1] for v, r in root.items()}
    assert len({v: r for v, r in root.items() if v == r}) > 4


KINDS = ("view", "click", "error", "signup", "purchase")


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    """An events table of 250 rows (more than any fixed list of events), and brute-force windows of days around each row."""
    rng, path = np.random.default_rng(7), tmp_path_factory.mktemp("events")
    rows = [(1000 + i, datetime(2024, 3, 1) + timedelta(days=i % 31, hours=i % 24), int(rng.integers(0, 4)) + 50 * (i % 2), KINDS[(i + i // 31) % 5], float(rng.uniform(1, 100))) for i in range(250)]
    save(spark, path, "events", rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    days = sorted({ts.date() for _, ts, *_ in rows})
    at = {d: i for i, d in enumerate(days)}
    values, factor = {}, {}
    for _, ts, user, kind, value in rows:
        values.setdefault((user % 50, at[ts.date()]), []).append(value)
        factor.setdefault((at[ts.date()], kind), []).append(value / 1000)

    def window(user, ts, first, last):
        t = at[ts.date()]
        return [(k, values[user % 50, t + k]) for k in range(first, last + 1) if (user % 50, t + k) in values]

    return str(path), rows, at, {k: float(np.mean(v)) for k, v in factor.items()}, window


def test_event_windows_of_all_events(spark, panel):
    path, rows, _, _, window = panel
    want = sorted((doc, k, round(float(np.mean(v)) / 1000, 7)) for doc, ts, user, *_ in rows for k, v in window(user, ts, -6, 9))
    got = sorted((r["doc_id"], r["relative_day"], round(r["ret"], 7)) for r in catalog.QUERIES["event_window_range_join"](spark, path).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-7)


def test_excess_returns_of_all_events(spark, panel):
    path, rows, at, factor, window = panel
    got = {r["doc_id"]: r for r in catalog.QUERIES["compounded_excess_return"](spark, path).collect()}
    assert got.keys() == {r[0] for r in rows}
    for doc, ts, user, *_ in rows:
        near = [(at[ts.date()] + k, float(np.mean(v)) / 1000) for k, v in window(user, ts, 0, 3)]
        market = [factor[t, "view"] + 0.0001 for t, _ in near if (t, "view") in factor]
        assert got[doc]["days"] == len(near) and got[doc]["excess"] == pytest.approx(np.prod([1 + x for _, x in near]) - np.prod([1 + m for m in market]), abs=1e-7)
        inside, before = ([sum(v) for _, v in window(user, ts, a, b)] for a, b in ((0, 3), (-6, -1)))
        if len(before) > 1:
            assert got[doc]["abnormal_volume"] == pytest.approx((np.mean(inside) - np.mean(before)) / np.std(before, ddof=1), abs=1e-5)


def test_factor_models_of_all_events(spark, panel):
    path, rows, at, factor, window = panel
    got = {r["doc_id"]: r for r in catalog.QUERIES["ols_ff3_moments"](spark, path).collect()}
    assert got.keys() == {r[0] for r in rows}
    solved = 0
    for doc, ts, user, *_ in rows:
        x, y = [], []
        for k, v in window(user, ts, -6, 25):
            f = [factor.get((at[ts.date()] + k, kind)) for kind in ("view", "click", "error", "signup")]
            if None not in f:
                x.append([1, f[0], f[1] - f[2], f[3] - f[0]])
                y.append(float(np.mean(v)) / 1000 - 0.0001)
        assert got[doc]["n"] == len(y)
        if got[doc]["alpha"] is not None:
            beta, *_ = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)
            assert got[doc]["alpha"] == pytest.approx(beta[0], abs=1e-6)
            solved += 1
    assert solved > 200
