"""Grouped regressions: quarterly cross-sections, Fama-MacBeth means, Newey-West errors, portfolios and factor models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import rank_bucket

FIT_SCHEMA = "quarter date, term string, estimate double, n long, k long, r2 double, adj_r2 double, ssr double, tss double, condition double, status string"


def design(pdf: pd.DataFrame, regressors: Sequence[str], group: str | None) -> tuple[np.ndarray, list[str]]:
    """Intercept, regressors, and a dummy for every group value but the least."""
    columns, names = [np.ones(len(pdf))], ["intercept"]
    for r in regressors:
        columns.append(pdf[r].to_numpy(float))
        names.append(r)
    if group:
        for v in sorted(pdf[group].unique())[1:]:
            columns.append((pdf[group] == v).to_numpy(float))
            names.append(f"{group}_{v}")
    return np.column_stack(columns), names


def least_squares(x: np.ndarray, y: np.ndarray) -> dict:
    """Coefficients, errors and fit; ``status`` tells a short or rank-deficient sample instead of raising."""
    n, k = x.shape
    if n <= k:
        return {"status": "insufficient_sample", "n": n, "k": k}
    if np.linalg.matrix_rank(x) < k:
        return {"status": "rank_deficient", "n": n, "k": k, "condition": float(np.linalg.cond(x))}
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    ssr, tss = float(((y - x @ beta) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
    r2 = 1 - ssr / tss if tss > 0 else None
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(x.T @ x)) * ssr / (n - k), 0))
    return {"status": "ok", "n": n, "k": k, "beta": beta, "se": se, "ssr": ssr, "tss": tss, "r2": r2, "adj_r2": None if r2 is None else 1 - (1 - r2) * (n - 1) / (n - k), "condition": float(np.linalg.cond(x))}


def quarterly_fits(panel: DataFrame, outcome: str, regressors: Sequence[str], date: str, group: str | None = None) -> DataFrame:
    """One OLS a calendar quarter; a row per coefficient, or one row with the reason where there is no fit."""
    used = [outcome, *regressors, *([group] if group else [])]
    rows = panel.dropna(subset=[*used, date]).select(F.trunc(F.col(date), "quarter").alias("quarter"), *used)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, names = design(pdf, regressors, group)
        f = least_squares(x, pdf[outcome].to_numpy(float))
        terms = names if f["status"] == "ok" else [None]
        out = {c: f.get(c) for c in ("n", "k", "r2", "adj_r2", "ssr", "tss", "condition", "status")}
        return pd.DataFrame([{"quarter": pdf["quarter"].iloc[0], "term": t, "estimate": float(f["beta"][i]) if t else None, **out} for i, t in enumerate(terms)])

    return rows.groupBy("quarter").applyInPandas(fit, FIT_SCHEMA)


def newey_west(series: DataFrame, by: Sequence[str], order: str, value: str, weight: str, lags: int) -> DataFrame:
    """Weighted mean of a series with Bartlett-weighted errors: ``estimate, se, t, n``; lags run over the rows there are, in order."""
    whole = Window.partitionBy(*by)
    w = series.withColumn("__w", F.col(weight) / F.sum(weight).over(whole)).withColumn("__m", F.sum(F.col("__w") * F.col(value)).over(whole))
    w = w.withColumn("__psi", F.col("__w") * (F.col(value) - F.col("__m")))
    ordered = whole.orderBy(order)
    variance = F.sum(F.col("__psi") * F.col("__psi"))
    for lag in range(1, lags + 1):
        w = w.withColumn(f"__l{lag}", F.lag("__psi", lag).over(ordered))
        variance = variance + 2 * (1 - lag / (lags + 1)) * F.coalesce(F.sum(F.col("__psi") * F.col(f"__l{lag}")), F.lit(0.0))
    out = w.groupBy(*by).agg(F.first("__m").alias("estimate"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("se"), F.count("*").alias("n"))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("estimate") / F.col("se")))


def fama_macbeth(panel: DataFrame, outcome: str, regressors: Sequence[str], date: str, group: str | None = None, lags: int = 1, equal: bool = False) -> DataFrame:
    """Mean coefficients over quarters, weighted by observations or equally, with Newey-West errors; fits are made once."""
    fits = quarterly_fits(panel, outcome, regressors, date, group).filter("status = 'ok'")
    fits = fits.filter(F.col("term").isin("intercept", *regressors)).withColumn("weight", F.lit(1.0) if equal else F.col("n").cast("double"))
    return newey_west(fits, ["term"], "quarter", "estimate", "weight", lags).withColumn("p", F.when(F.col("se") > 0, _two_sided(F.col("t"))))


def _two_sided(t):
    """Two-sided normal tail by a rational approximation of the complementary error function (error below 1.2e-7)."""
    z = F.abs(t) / np.sqrt(2.0)
    u = 1 / (1 + 0.5 * z)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = F.lit(c) + u * poly
    return u * F.exp(-z * z - 1.26551223 + u * poly)


def specification_grid(panel: DataFrame, outcomes: Sequence[str], signals: Sequence[str], controls: Sequence[str], date: str, group: str | None = None, lags: int = 1) -> DataFrame:
    """Fama-MacBeth of every outcome on every signal with the same controls, as one grouped job in long form."""
    base = panel.select(F.col(date).alias("__d"), *([group] if group else []), *controls, *dict.fromkeys([*outcomes, *signals]))
    cells = [F.struct(F.lit(o).alias("outcome"), F.lit(s).alias("signal_name"), F.col(o).cast("double").alias("y"), F.col(s).cast("double").alias("signal")) for o in outcomes for s in signals]
    long = base.withColumn("__cell", F.explode(F.array(*cells))).select(F.trunc("__d", "quarter").alias("quarter"), *([group] if group else []), *controls, "__cell.*")
    long = long.dropna()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, names = design(pdf, ["signal", *controls], group)
        f = least_squares(x, pdf["y"].to_numpy(float))
        ok = f["status"] == "ok"
        return pd.DataFrame([{"outcome": pdf["outcome"].iloc[0], "signal_name": pdf["signal_name"].iloc[0], "quarter": pdf["quarter"].iloc[0], "estimate": float(f["beta"][1]) if ok else None, "n_obs": f["n"], "status": f["status"], "r2": f.get("r2")}])

    fits = long.groupBy("outcome", "signal_name", "quarter").applyInPandas(fit, "outcome string, signal_name string, quarter date, estimate double, n_obs long, status string, r2 double")
    good = fits.filter("status = 'ok'").withColumn("weight", F.col("n_obs").cast("double"))
    return newey_west(good, ["outcome", "signal_name"], "quarter", "estimate", "weight", lags)


def factor_model(returns: DataFrame, by: str, y: str, xs: Sequence[str]) -> DataFrame:
    """OLS of each series on factors: a row per coefficient with its error and t, and the fit's R²."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        f = least_squares(np.column_stack([np.ones(len(pdf)), pdf[list(xs)].to_numpy(float)]), pdf[y].to_numpy(float))
        ok = f["status"] == "ok"
        names = ["alpha", *xs] if ok else [None]
        return pd.DataFrame([{by: pdf[by].iloc[0], "term": t, "estimate": float(f["beta"][i]) if ok else None, "se": float(f["se"][i]) if ok else None, "t": float(f["beta"][i] / f["se"][i]) if ok and f["se"][i] > 0 else None, "n": f["n"], "r2": f.get("r2"), "status": f["status"]} for i, t in enumerate(names)])

    kind = returns.schema[by].dataType.simpleString()
    return returns.dropna(subset=[y, *xs]).groupBy(by).applyInPandas(fit, f"{by} {kind}, term string, estimate double, se double, t double, n long, r2 double, status string")


def sort_year(day):
    """July to June: a filing in July or later belongs to the next year."""
    return F.when(F.month(day) >= 7, F.year(day) + 1).otherwise(F.year(day))


def strategy_assignment(docs: DataFrame, signals: Sequence[str], first_year: int = 1997, last_year: int = 2006) -> DataFrame:
    """Quintiles of each signal among a formation year's securities (their last filing)."""
    from .windows import first_per_key

    y = docs.withColumn("sort_year", sort_year(F.col("filing_date"))).filter(F.col("sort_year").between(first_year, last_year))
    last = first_per_key(y, ["KYPERMNO", "sort_year"], [F.col("filing_date").desc(), F.col("doc_id").desc()])
    long = last.unpivot(["doc_id", "KYPERMNO", "sort_year"], list(signals), "signal", "value").filter("value is not null")
    return rank_bucket(long, ["sort_year", "signal"], [F.col("value"), F.col("doc_id")], 5, "quintile")


def long_short(assignment: DataFrame, monthly: DataFrame, weighting: str = "equal") -> DataFrame:
    """Monthly return of the top less the bottom quintile, equal or lagged-value weighted."""
    before = F.lag("MTCAP").over(Window.partitionBy("KYPERMNO").orderBy("MCALDT"))
    m = monthly.withColumn("__w", before if weighting == "value" else F.lit(1.0)).withColumn("sort_year", F.when(F.month("MCALDT") >= 7, F.year("MCALDT")).otherwise(F.year("MCALDT") - 1))
    held = assignment.filter("quintile in (1, 5)").join(m, ["KYPERMNO", "sort_year"]).filter("MRET is not null and __w > 0")
    legs = held.groupBy("signal", "MCALDT", "quintile").agg((F.sum(F.col("MRET") * F.col("__w")) / F.sum("__w")).alias("r"))
    out = legs.groupBy("signal", "MCALDT").agg(F.max(F.when(F.col("quintile") == 5, F.col("r"))).alias("top"), F.max(F.when(F.col("quintile") == 1, F.col("r"))).alias("bottom"))
    return out.filter("top is not null and bottom is not null").select("signal", F.col("MCALDT").alias("month_end"), (F.col("top") - F.col("bottom")).alias("long_short_return"))


def trading_strategy(docs: DataFrame, signals: Sequence[str], monthly: DataFrame, weighting: str = "equal", first_month: str = "1997-07-31", last_month: str = "2007-06-30", first_year: int = 1997, last_year: int = 2006) -> DataFrame:
    """Monthly long-short returns of each signal within a span of months."""
    out = long_short(strategy_assignment(docs, signals, first_year, last_year), monthly, weighting)
    return out.filter(F.col("month_end").between(first_month, last_month))


def strategy_summary(returns: DataFrame, factors: DataFrame, xs: Sequence[str], check: bool = True) -> DataFrame:
    """Factor model of each signal's monthly returns. Factors are keyed by year and month; a month twice or missing raises when checked."""
    key = lambda c: (F.year(c) * 12 + F.month(c)).alias("__m")
    f = factors.select(key(F.col("month_end")), *xs)
    r = returns.withColumn("__m", key(F.col("month_end")))
    if check:
        if f.groupBy("__m").count().filter("count > 1").limit(1).count():
            raise ValueError("factors have a month twice")
        if r.join(f, "__m", "left_anti").limit(1).count():
            raise ValueError("factors lack a month of the returns")
    return factor_model(r.join(f, "__m"), "signal", "long_short_return", xs)


def regression_panel(events: DataFrame, signals: DataFrame, industries: DataFrame, columns: Sequence[str], ownership: bool = False) -> DataFrame:
    """Event rows with text signals and industries, logarithms of sizes where positive, infinities as nulls; ``ownership`` keeps rows that have it."""
    from .events import regression_transforms

    out = events.join(signals, "doc_id").join(industries, "doc_id", "left")
    out = regression_transforms(out)
    if ownership:
        out = out.filter("institutional_ownership is not null")
    return out.select("doc_id", "filing_date", "industry_id", *columns)


#: Names of control sets, from none to all; each is the one before and more.
LADDER = {"C0": (), "C1": ("log_size", "log_bm"), "C2": ("log_size", "log_bm", "log_share_turnover", "pre_ffalpha")}


def control_ladder(panel: DataFrame, outcomes: Sequence[str], signals: Sequence[str], date: str, group: str | None = None, ladder: dict[str, Sequence[str]] | None = None, lags: int = 1, min_quarters: int = 1) -> DataFrame:
    """Fama-MacBeth of every outcome and signal under each set of controls, with a status: estimated or insufficient_sample."""
    from ..contracts import union_relaxed

    out = []
    for name, controls in (ladder or LADDER).items():
        grid = specification_grid(panel, outcomes, signals, list(controls), date, group, lags)
        out.append(grid.withColumn("controls", F.lit(name)))
    found = union_relaxed(out)
    wanted = panel.sparkSession.createDataFrame([(c, o, s) for c in (ladder or LADDER) for o in outcomes for s in signals], "controls string, outcome string, signal_name string")
    joined = wanted.join(found, ["controls", "outcome", "signal_name"], "left")
    status = F.when(F.col("n") >= min_quarters, "estimated").otherwise("insufficient_sample")
    keep = lambda c: F.when(status == "estimated", F.col(c)).alias(c)
    return joined.select("controls", "outcome", "signal_name", keep("estimate"), keep("se"), keep("t"), F.coalesce("n", F.lit(0)).alias("n"), F.when(status == "estimated", _two_sided(F.col("t"))).alias("p"), status.alias("status"))


def sample_loss(panel: DataFrame, by: Sequence[str], needs: dict[str, Sequence[str]]) -> DataFrame:
    """Rows per group and how many have all columns of each named need: ``by, need, rows, available, lost``; one pass over the panel."""
    have = []
    for name, columns in needs.items():
        full = F.lit(True)
        for c in columns:
            full = full & F.col(c).isNotNull()
        have.append(F.struct(F.lit(name).alias("need"), full.alias("full")))
    long = panel.select(*by, F.explode(F.array(*have)).alias("h")).select(*by, "h.*")
    out = long.groupBy(*by, "need").agg(F.count("*").alias("rows"), F.count(F.when(F.col("full"), 1)).alias("available"))
    return out.withColumn("lost", F.col("rows") - F.col("available"))


def fit_comparison(panel: DataFrame, outcome: str, specs: dict[str, Sequence[str]], date: str, base: str, lags: int = 1) -> DataFrame:
    """Fit of specifications on common rows and common successful quarters: mean difference of adjusted R² to ``base``, with errors."""
    from ..contracts import union_relaxed

    used = sorted({c for xs in specs.values() for c in xs})
    common = panel.dropna(subset=[outcome, date, *used])
    fits = union_relaxed([quarterly_fits(common, outcome, list(xs), date).filter("status = 'ok'").select("quarter", "n", "adj_r2").distinct().withColumn("spec", F.lit(name)) for name, xs in specs.items()])
    shared = fits.groupBy("quarter").agg(F.count("*").alias("k"), F.count_distinct("n").alias("sizes")).filter((F.col("k") == len(specs)) & (F.col("sizes") == 1)).select("quarter")
    fits = fits.join(shared, "quarter")
    ref = fits.filter(F.col("spec") == base).select("quarter", F.col("adj_r2").alias("__ref"))
    gain = fits.filter(F.col("spec") != base).join(ref, "quarter").withColumn("gain", F.col("adj_r2") - F.col("__ref")).withColumn("weight", F.col("n").cast("double"))
    return newey_west(gain, ["spec"], "quarter", "gain", "weight", lags)


def lag_sensitivity(panel: DataFrame, outcome: str, regressors: Sequence[str], date: str, lags: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """The same Fama-MacBeth under several lag lengths; quarters are fitted once."""
    from ..contracts import union_relaxed

    fits = quarterly_fits(panel, outcome, regressors, date).filter("status = 'ok'").filter(F.col("term").isin(*regressors)).withColumn("weight", F.col("n").cast("double"))
    return union_relaxed([newey_west(fits, ["term"], "quarter", "estimate", "weight", n).withColumn("lags", F.lit(n)) for n in lags])


def effect_summary(estimates: DataFrame, observed: DataFrame, signal: str, value: str, skipped: DataFrame | None = None) -> DataFrame:
    """Estimates scaled by the interquartile range of the observed signal, skipped quarters left out: ``signal, iqr, effect``."""
    rows = observed if skipped is None else observed.join(skipped, "quarter", "left_anti")
    spread = rows.groupBy(signal).agg((F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"))
    return estimates.join(spread, signal).withColumn("effect", F.col("estimate") * F.col("iqr"))


def regression_tables(panel: DataFrame, tables: dict[str, dict], date: str, group: str | None = None, lags: int = 1) -> DataFrame:
    """Several tables of regressions as one long result: ``table, outcome, signal_name, estimate, se, t, n``.

    A table is ``{"outcomes", "signals", "controls", "where"}``; ``where`` is a condition on rows (a least number of tokens, ownership).
    """
    from ..contracts import union_relaxed

    parts = []
    for name, t in tables.items():
        rows = panel.filter(t["where"]) if t.get("where") is not None else panel
        parts.append(specification_grid(rows, t["outcomes"], t["signals"], t.get("controls", ()), date, group, lags).withColumn("table", F.lit(name)))
    return union_relaxed(parts).select("table", "outcome", "signal_name", "estimate", "se", "t", "n")


def quantile_suite(panel: DataFrame, outcome: str, signal: str, date: str, buckets: Sequence[int], group: str | None = None) -> DataFrame:
    """The same regression with the signal as its quantile score, within quarters, for several numbers of quantiles."""
    from ..contracts import union_relaxed
    from .windows import average_rank_bucket

    quarterly = panel.withColumn("__q", F.trunc(F.col(date), "quarter"))
    parts = []
    for k in buckets:
        scored = average_rank_bucket(quarterly, ["__q"], signal, k).withColumnRenamed("score", "signal_score")
        parts.append(specification_grid(scored, [outcome], ["signal_score"], [], date, group).withColumn("buckets", F.lit(k)))
    return union_relaxed(parts).select("buckets", "estimate", "se", "t", "n")


def signal_columns(df: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = ("_prop", "_tfidf")) -> list[str]:
    """Names of text signals by prefix and suffix, in the order of the columns; none raises."""
    found = [c for c in df.columns if c.endswith(tuple(suffixes)) and (not prefixes or c.startswith(tuple(prefixes)))]
    if not found:
        raise ValueError(f"no signal with prefix {list(prefixes)} and suffix {list(suffixes)}")
    return found


def analysis_panel(events: DataFrame, scopes: dict[str, DataFrame], policy: str) -> DataFrame:
    """Events by text scope with the scope's signals: one row an event and scope that has it.

    Every scope table carries ``cleaning_policy``; one of another policy, or a document twice, raises.
    """
    from ..contracts import assert_unique, union_relaxed

    parts = []
    for name, df in scopes.items():
        if df.filter(~F.col("cleaning_policy").eqNullSafe(F.lit(policy))).limit(1).count():
            raise ValueError(f"scope {name} was not cleaned under {policy}")
        parts.append(assert_unique(df, ["doc_id"], f"scope {name}").drop("cleaning_policy").withColumn("text_scope", F.lit(name)))
    return events.join(union_relaxed(parts), "doc_id")
