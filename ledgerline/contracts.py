"""Table contracts: required columns, aliases, typed defaults, alignment before unions, uniqueness."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Iterable[str], label: str) -> None:
    """Raises ValueError that names the missing columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} missing required columns: {missing}")


def first_existing(df: DataFrame, candidates: Sequence[str], label: str | None = None) -> str | None:
    """The first candidate that is a column; with a label, its absence raises."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and label is not None:
        raise ValueError(f"{label} missing required columns: one of {list(candidates)}")
    return found


def project_with_defaults(df: DataFrame, columns: Mapping[str, str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Selects ``columns`` (name to type): what is there is cast leniently, what is absent becomes a typed default or null."""
    defaults = defaults or {}
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(defaults.get(c)).cast(t)).alias(c) for c, t in columns.items()])


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: lenient casts, typed nulls for absent ones."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows, full schema."""
    return spark.createDataFrame([], schema)


def assert_unique(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Runs one aggregation and raises ValueError if a key repeats; returns ``df``."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{label} has duplicate keys {list(keys)}")
    return df


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def truth(predicate: Column) -> Column:
    """Three-valued to two-valued: null is false."""
    return F.coalesce(predicate, F.lit(False))
