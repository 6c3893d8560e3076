"""Window-based operators: picks per key, ranks and buckets, winsorising, ladders, portfolios of ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key by an explicit total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


RANGES = 64


def running_counts(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``upto``, the sum of ``n`` over the values up to each one (per ``by``), and ``total``; values are unique per ``by``.

    No task orders all values: they are cut into ``RANGES`` ranges at approximate quantiles, each range is ordered on its
    own, and the ranges' sums are added up.
    """
    cuts = counts.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("__cuts"))
    place = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    ranged = counts.crossJoin(F.broadcast(cuts)).withColumn("__r", place).drop("__cuts")
    key = lambda *more: Window.partitionBy(*by, *more) if by or more else Window.partitionBy(F.lit(0))
    sums = ranged.groupBy(*by, "__r").agg(F.sum("n").alias("__s"))
    before = F.coalesce(F.sum("__s").over(key().orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "__r", before.alias("__before"), F.sum("__s").over(key()).alias("total"))
    inside = ranged.withColumn("__in", F.sum("n").over(key("__r").orderBy(value)))
    return inside.join(sums, [*by, "__r"]).withColumn("upto", F.col("__in") + F.col("__before")).drop("__in", "__before", "__r")


def nearest_quantile(df: DataFrame, column: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank quantiles of non-null values: the value at position ``round(q * (n - 1))`` (halves up), per ``by``.

    The values are counted first, so the ordering works on distinct values only, range by range.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = running_counts(counts, "v", by)
    position = lambda q: F.floor(F.lit(q) * (F.col("total") - 1) + 0.5)
    picks = [F.min(F.when(F.col("upto") > position(q), F.col("v"))).alias(f"q{i}") for i, q in enumerate(quantiles)]
    return placed.groupBy(*by).agg(*picks) if by else placed.agg(*picks)


def winsorize(df: DataFrame, column: str | Sequence[str], low: float = 0.01, high: float = 0.99, finite_only: bool = False) -> DataFrame:
    """Clips columns to their nearest-rank quantiles over all rows; ``finite_only`` takes bounds from finite values and leaves the others."""
    columns = [column] if isinstance(column, str) else list(column)
    out = df
    for i, c in enumerate(columns):
        finite = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
        bounds = nearest_quantile(df.filter(finite) if finite_only else df, c, [low, high])
        out = out.crossJoin(F.broadcast(bounds.withColumnsRenamed({"q0": f"__lo{i}", "q1": f"__hi{i}"})))
    for i, c in enumerate(columns):
        finite = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
        clipped = F.least(F.greatest(F.col(c), F.col(f"__lo{i}")), F.col(f"__hi{i}"))
        out = out.withColumn(c, F.when(F.col(c).isNotNull() & (finite if finite_only else F.lit(True)), clipped).otherwise(F.col(c)))
    return out.select(*df.columns)


def rank_bucket(df: DataFrame, by: Sequence[str], order: Sequence[Column], buckets: int, out: str = "bucket") -> DataFrame:
    """``floor(rank * buckets / n) + 1`` with rank from 0 in the given total order."""
    w = Window.partitionBy(*by)
    rank, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return df.withColumn(out, F.floor(rank * buckets / n).cast("int") + 1)


def average_rank_bucket(df: DataFrame, by: Sequence[str], column: str, k: int) -> DataFrame:
    """Adds ``pct`` (average rank over non-null count), ``label`` (1..k), ``score`` in 0..1 and ``extreme`` (+.5, -.5, 0)."""
    cell = Window.partitionBy(*by)
    ordered = cell.orderBy(F.col(column).asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*by, column))
    pct = F.when(F.col(column).isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2) / F.count(column).over(cell))
    label = F.least(F.greatest(F.ceil(F.col("pct") * k), F.lit(1)), F.lit(k))
    out = df.withColumn("pct", pct).withColumn("label", F.when(F.col("pct").isNotNull(), label))
    extreme = F.when(F.col("label") == k, 0.5).when(F.col("label") == 1, -0.5).when(F.col("label").isNotNull(), 0.0)
    return out.withColumn("score", (F.col("label") - 1) / (k - 1)).withColumn("extreme", extreme)


def ecdf(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact distribution function at every distinct value: ``value, ecdf``."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running_counts(counts, "value", by).select(*by, "value", (F.col("upto") / F.col("total")).alias("ecdf"))


def attrition_ladder(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that pass all steps so far, and those each step removes, in one pass: ``step, name, kept, removed``."""
    passed, sums = F.lit(True), [F.count("*").alias("s0")]
    for i, (_, predicate) in enumerate(steps):
        passed = passed & F.coalesce(predicate, F.lit(False))
        sums.append(F.count(F.when(passed, 1)).alias(f"s{i + 1}"))
    one = df.agg(*sums)
    names = ["start", *[n for n, _ in steps]]
    items = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("kept"), (F.col(f"s{max(i - 1, 0)}") - F.col(f"s{i}")).alias("removed")) for i, n in enumerate(names)]
    return one.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def spaced(df: DataFrame, keys: Sequence[str], date: str, order: Sequence[Column], days: int) -> DataFrame:
    """Rows at least ``days`` after the row before them, kept or not; the first of a key stays."""
    before = F.lag(date).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__before", before).filter(F.col("__before").isNull() | (F.datediff(date, "__before") >= days)).drop("__before")


def cumulative_return(df: DataFrame, by: Sequence[str], order: str, ret: str) -> DataFrame:
    """Adds ``cumulative``: compounded return so far, null returns as 0; signs are tracked apart, so losses over 100 % compound too."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0))
    size = F.exp(F.sum(F.ln(F.abs(F.when(g != 0, g)))).over(w))
    sign = F.when(F.max(F.when(g == 0, 1).otherwise(0)).over(w) == 1, 0.0).when(F.sum(F.when(g < 0, 1).otherwise(0)).over(w) % 2 == 1, -1.0).otherwise(1.0)
    return df.withColumn("cumulative", F.coalesce(size, F.lit(1.0)) * sign - 1)


def last_non_null(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Per key, each column's last non-null value in time order."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap_days: int = 0) -> DataFrame:
    """Joins intervals whose start is at most ``gap_days + 1`` after the running end: ``keys, start, end, parts``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.datediff(F.col(start), reach) > gap_days + 1), 1).otherwise(0)
    islands = df.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("__island")


def mode_per_key(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Most frequent non-null value; ties give the least."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("__n"), F.col(column))).alias(column))
