"""As-of joins and calendars.

``asof_join`` unions both sides and carries the nearest right row along each key's time order: one shuffle on the key, no
row explosion, spill-safe. A key that may hold a large share of the rows can be split by ``period`` (a function of time
that groups it into ranges): every range then starts from the last right row of the ranges before it, found by a small aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    direction: str = "backward",
    strict: bool = False,
    tolerance_days: int | None = None,
    valid_until: str | None = None,
    tiebreak: Sequence[str] = (),
    period: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """All rows of ``left`` with ``payload`` columns, ``right_time`` and ``matched`` of the nearest row of ``right``.

    Backward: the latest right time at or before (``strict``: before) the left time; forward: the earliest at or after (after).
    Of right rows with equal key and time the last by ``tiebreak`` wins, or without one the last by a hash of its payload. Null keys or times on the left stay, unmatched; null
    right times are dropped. ``tolerance_days`` and ``valid_until`` (an inclusive end, null open) blank the payload of the nearest
    row afterwards, so a stale nearest row never gives way to an older valid one. Rows that are outdated stay ``matched`` false.
    """
    forward = direction == "forward"
    columns = list(left.columns)
    extra = [valid_until] if valid_until and valid_until not in payload else []
    named = ["t", *payload, *extra]
    keyed_right = right.filter(F.col(right_time).isNotNull())
    for k in on:
        keyed_right = keyed_right.filter(F.col(k).isNotNull())
    packed = F.struct(F.col(right_time).alias("t"), *[F.col(c) for c in [*payload, *extra]])
    ltime, rtime = left.schema[left_time].dataType, right.schema[right_time].dataType
    time_type = ltime if ltime == rtime else "timestamp"
    order = F.struct(*[F.col(c) for c in tiebreak]) if tiebreak else F.xxhash64(*[F.col(c) for c in [right_time, *payload, *extra]])
    r = keyed_right.select(*on, F.col(right_time).cast(time_type).alias("__t"), packed.alias("__pick"), order.alias("__order"), F.lit(None).alias("__row")).withColumn("__side", F.lit(1 if strict else -1))
    rows = left.select(*on, F.col(left_time).cast(time_type).alias("__t"), F.struct(*columns).alias("__row")).withColumn("__side", F.lit(0))
    both = rows.unionByName(r, allowMissingColumns=True)
    partition: list = [F.col(k) for k in on]
    usable = F.col("__t").isNotNull()
    for k in on:
        usable = usable & F.col(k).isNotNull()
    # rows that can't match are spread, not gathered under the null key; maps have no hash
    partition.append(F.when(~usable, F.xxhash64(*[F.col("__row")[c] for c in columns if "map<" not in left.schema[c].dataType.simpleString()])))
    if period is not None:
        partition.append(period(F.col("__t")))
    # of right rows with one time the greatest comes last, and so is the one found
    seq = [F.col("__t").desc() if forward else F.col("__t").asc(), F.col("__side").asc(), F.col("__order").asc()]
    window = Window.partitionBy(*partition).orderBy(*seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last("__pick", ignorenulls=True).over(window)
    if period is not None:
        pick = F.min_by if forward else F.max_by
        single = r.groupBy(*on, "__t").agg(F.max_by("__pick", "__order").alias("__pick"))
        ends = single.groupBy(*on, period(F.col("__t")).alias("__p")).agg(pick("__pick", "__t").alias("__end"))
        by = Window.partitionBy(*on).orderBy(F.col("__p").desc() if forward else F.col("__p").asc()).rowsBetween(Window.unboundedPreceding, -1)
        spans = both.select(*on, period(F.col("__t")).alias("__p")).distinct().join(ends, [*on, "__p"], "left")
        spans = spans.withColumn("__before", F.last("__end", ignorenulls=True).over(by)).drop("__end")
        both = both.withColumn("__p", period(F.col("__t"))).join(spans, [*on, "__p"], "left")
        found = F.coalesce(found, F.col("__before"))
    hits = both.withColumn("__found", F.when(usable, found)).filter("__row is not null")
    ok = F.col("__found").isNotNull()
    if tolerance_days is not None:
        ok = ok & (F.abs(F.datediff(F.col("__t").cast("date"), F.col("__found.t").cast("date"))) <= tolerance_days)
    if valid_until is not None:
        ok = ok & (F.col("__found")[valid_until].isNull() | (F.col("__t").cast("date") <= F.col("__found")[valid_until].cast("date")))
    taken = [n for n in named if n != "t" and n in payload]
    return hits.select(
        *[F.col("__row")[c].alias(c) for c in columns],
        F.when(ok, F.col("__found.t")).cast(rtime).alias(f"asof_{right_time}"),
        *[F.when(ok, F.col("__found")[c]).alias(c) for c in taken],
        F.coalesce(ok, F.lit(False)).alias("matched"),
    )


def trading_calendar(df: DataFrame, day: str) -> DataFrame:
    """Distinct days with a dense index from 0: ``day, trade_index``. One row a day, so one task orders it."""
    return df.select(F.col(day).cast("date").alias("day")).filter("day is not null").distinct().withColumn("trade_index", F.row_number().over(Window.orderBy("day")) - 1)


def calendar_lookup(calendar: DataFrame, margin_days: int = 400) -> DataFrame:
    """For every calendar date around the range: ``date, next_day`` (at or after) and ``prev_day`` (at or before)."""
    bounds = calendar.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    dates = bounds.select(F.explode(F.sequence(F.date_sub("lo", margin_days), F.date_add("hi", margin_days))).alias("date"))
    joined = dates.join(calendar.select(F.col("day")), F.col("date") == F.col("day"), "left")
    after = Window.orderBy("date").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select("date", F.first("day", ignorenulls=True).over(after).alias("next_day"), F.last("day", ignorenulls=True).over(before).alias("prev_day"))


def align_to_calendar(df: DataFrame, date: str, calendar: DataFrame, mode: str = "exact_or_next") -> DataFrame:
    """Adds ``aligned_day``: strict_next, exact_or_next, exact or previous; the calendar is one row a day, so it is broadcast."""
    lookup = calendar_lookup(calendar, 0).withColumnRenamed("date", "__date")
    bounds = calendar.agg(F.min("day").alias("__lo"), F.max("day").alias("__hi"))
    anchor = F.col(date).cast("date")
    key = F.date_add(anchor, 1) if mode == "strict_next" else F.date_sub(anchor, 1) if mode == "strict_previous" else anchor
    column = "prev_day" if mode in ("previous", "strict_previous") else "next_day"
    held = F.least(key, F.col("__hi")) if column == "prev_day" else F.greatest(key, F.col("__lo"))  # however far outside the calendar
    keyed = df.crossJoin(F.broadcast(bounds)).withColumn("__key", F.when(key.isNotNull(), held)).drop("__lo", "__hi")
    out = keyed.join(F.broadcast(lookup), F.col("__key") == F.col("__date"), "left").withColumn("aligned_day", F.col(column)).drop("__key", "__date", "next_day", "prev_day")
    if mode == "exact":
        out = out.withColumn("aligned_day", F.when(F.col("aligned_day") == anchor, F.col("aligned_day")))
    return out
