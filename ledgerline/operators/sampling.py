"""Deterministic samples: hash ranks, quotas, exact entity samples, apportionment of seats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selection_key(seed: object, *columns: str) -> Column:
    """SHA-256 of the seed and the columns, joined by bars."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def quota_sample(df: DataFrame, strata: Sequence[str], quotas: DataFrame, seed: object, key: Sequence[str]) -> DataFrame:
    """The ``quota`` rows of smallest key per stratum, with ``stratum_rank``; nested samples are lower quotas of the same seed."""
    ranked = df.withColumn("selection_key", selection_key(seed, *key))
    ranked = ranked.withColumn("stratum_rank", F.row_number().over(Window.partitionBy(*strata).orderBy("selection_key", *key)))
    return ranked.join(quotas, list(strata)).filter(F.col("stratum_rank") <= F.col("quota")).drop("quota")


def check_quota(sample: DataFrame, strata: Sequence[str], quotas: DataFrame) -> None:
    """Raises when a stratum has fewer rows than its quota."""
    got = sample.groupBy(*strata).count()
    short = quotas.join(got, list(strata), "left").filter(F.coalesce("count", F.lit(0)) < F.col("quota")).limit(5).collect()
    if short:
        raise ValueError(f"strata short of their quota: {[tuple(r) for r in short]}")


def exact_entity_sample(df: DataFrame, entity: str, fraction: float, seed: int) -> DataFrame:
    """All rows of exactly ``max(1, ceil(n * fraction))`` entities, those of smallest hash."""
    entities = df.select(entity).filter(F.col(entity).isNotNull()).distinct()
    n = entities.count()
    k = max(1, -(-n * Fraction(str(fraction)).numerator // Fraction(str(fraction)).denominator))
    chosen = entities.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(entity).cast("string")), 256), entity).limit(k)
    return df.join(chosen, entity, "left_semi")


def at_ordinals(df: DataFrame, strata: Sequence[str], order: Sequence[str], targets: DataFrame) -> DataFrame:
    """Rows at given 0-based places (``ordinal``) of their stratum."""
    placed = df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1)
    return placed.join(targets, [*strata, "ordinal"], "left_semi")


def apportion(target: int, weights: Mapping[str, float], capacity: Mapping[str, int], at_least_one: bool = False) -> dict[str, int]:
    """Seats by largest remainder under capacities, in exact arithmetic: whole parts first, then one each by fraction, weight, order."""
    names = list(weights)
    seats = dict.fromkeys(names, 0)
    w = {k: Fraction(str(weights[k])) for k in names}
    left = min(target, sum(capacity[k] for k in names))
    open_ = [k for k in names if capacity[k] > 0]
    if at_least_one and left >= len(open_):
        for k in open_:
            seats[k], left = 1, left - 1
    while left > 0:
        spare = [k for k in names if seats[k] < capacity[k] and w[k] > 0] or [k for k in names if seats[k] < capacity[k]]
        total = sum(w[k] for k in spare)
        exact = {k: left * w[k] / total if total else Fraction(left, len(spare)) for k in spare}
        given = {k: min(int(exact[k]), capacity[k] - seats[k]) for k in spare}
        left -= sum(given.values())
        for k, n in given.items():
            seats[k] += n
        for k in sorted(spare, key=lambda k: (-(exact[k] - int(exact[k])), -w[k], names.index(k))):
            if left and seats[k] < capacity[k]:
                seats[k], left = seats[k] + 1, left - 1
    return seats


def half_up(n: int, fraction: float) -> int:
    """``n * fraction`` rounded half up."""
    return int(n * Fraction(str(fraction)) + Fraction(1, 2))


def nested_sample(sample: DataFrame, strata: Sequence[str], quotas: DataFrame) -> DataFrame:
    """The part of a ranked sample within lower quotas (``quota`` per stratum); strata without a quota go."""
    return sample.join(quotas, list(strata)).filter(F.col("stratum_rank") <= F.col("quota")).drop("quota")


def allocate(df: DataFrame, strata: Sequence[str], target: int, balanced: bool = False, at_least_one: bool = False) -> DataFrame:
    """Quotas of the strata that add up to ``target`` (or to all rows): by size, or equal when ``balanced``. One row a stratum comes to the driver."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *strata).collect()
    names = [str(i) for i in range(len(counts))]
    size = {k: r["n"] for k, r in zip(names, counts, strict=True)}
    seats = apportion(target, dict.fromkeys(names, 1) if balanced else size, size, at_least_one)
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in strata)
    return df.sparkSession.createDataFrame([(*[r[c] for c in strata], seats[k]) for k, r in zip(names, counts, strict=True)], f"{schema}, quota int")


def quartile_sample(df: DataFrame, measure: str, key: Sequence[str], per: int, seed: object, by: Sequence[str] = ()) -> DataFrame:
    """``per`` rows of smallest hash from each quarter of the rows by ``measure`` (ties by key): adds ``quartile``."""
    from .windows import rank_bucket

    rows = df.filter(F.col(measure).isNotNull()).withColumn("__all", F.lit(0))
    placed = rank_bucket(rows, list(by) or ["__all"], [F.col(measure), *[F.col(k) for k in key]], 4, "quartile").drop("__all")
    quotas = placed.select(*by, "quartile").distinct().withColumn("quota", F.lit(per))
    return quota_sample(placed, [*by, "quartile"], quotas, seed, key)


def uniform_sample(df: DataFrame, n: int, key: Sequence[str], seed: object) -> DataFrame:
    """Exactly ``n`` rows (or all), those of smallest hash: what a reservoir would give, but the same on every run."""
    return df.orderBy(selection_key(seed, *key), *key).limit(n)


def covering_sample(df: DataFrame, entity: str, scope: str, n: int, seed: object) -> DataFrame:
    """``n`` entities that cover most scopes, ties by hash: ``entity, scopes, place``."""
    counts = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count_distinct(scope).alias("scopes"))
    first = counts.orderBy(F.desc("scopes"), selection_key(seed, entity), entity).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("scopes"), selection_key(seed, entity), entity)))


def example_pack(df: DataFrame, by: Sequence[str], score: str, least: float, k: int, key: Sequence[str], seed: object) -> DataFrame:
    """The first ``k`` rows a group by stable key among those whose score reaches ``least``: adds ``place``."""
    w = Window.partitionBy(*by).orderBy(selection_key(seed, *key), *key)
    return df.filter(F.col(score) >= least).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def year_covering_sample(df: DataFrame, entity: str, year: str, n: int, least: int, seed: object) -> DataFrame:
    """``n`` entities (or all) so that every year has ``least`` of them where there are that many: ``entity, years``.

    Entities with the same years are alike, so only their classes come to the driver: seats go one by one to the class that
    serves most years still short (ties: more entities, then the years' names), then to the largest classes; which entities
    of a class get its seats follows from a hash.
    """
    masks = df.filter(F.col(entity).isNotNull() & F.col(year).isNotNull()).groupBy(entity).agg(F.array_join(F.array_sort(F.collect_set(F.col(year).cast("string"))), ",").alias("years"))
    left = {r["years"]: r["count"] for r in masks.groupBy("years").count().collect()}
    have: dict[str, int] = {}
    for years, k in left.items():
        for y in years.split(","):
            have[y] = have.get(y, 0) + k
    short = {y: min(least, k) for y, k in have.items()}
    seats: dict[str, int] = {}
    for _ in range(min(n, sum(left.values()))):
        spare = [m for m, k in left.items() if k > 0]
        best = min(spare, key=lambda m: (-sum(short[y] > 0 for y in m.split(",")), -left[m], m))
        seats[best] = seats.get(best, 0) + 1
        left[best] -= 1
        for y in best.split(","):
            short[y] -= 1
    quotas = df.sparkSession.createDataFrame(sorted(seats.items()), "years string, quota int")
    return quota_sample(masks, ["years"], quotas, seed, [entity]).select(entity, "years")
