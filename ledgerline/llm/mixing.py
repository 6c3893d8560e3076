"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash of their id, and each copy of a document gets a virtual finish time: the
source's tokens up to and including it, divided by the source's target. All copies, ordered by finish time, make the mix,
which is cut where the total budget is spent. A source that must repeat starts its shuffled order again, up to
``max_repeats`` rounds.

Running sums never gather a source in one task: hash ranges of a source are summed, the sums' prefix is taken, and only
the rows of one range are ordered together. The cut is found the same way: finish times grow evenly with tokens, so equal
ranges of virtual time hold equal shares of the mix, and only the range in which the budget ends is ordered. A document's
copies before the cut are then a projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

ROWS_PER_RANGE = 1000
WEIGHTS = (5, 2, 1)


def shuffle_key(id_col: str) -> Column:
    """60 bits of a hash of the id, as a long; null ids count as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """From ``source, source_size``: ``source_rank`` (by code point, null last) and ``target``.

    All tokens are shared by weight; a target stops at ``max_repeats`` times its source's size, and what is over goes to
    the others by weight, until none is above: with sources in order of size by weight, the capped ones come first. One row
    a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("source_rank", F.row_number().over(order) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    small_first = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = small_first.rowsBetween(Window.unboundedPreceding, -1)
    after = small_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    share = F.max(F.when(F.col("open"), F.struct(-F.col("cap") / F.col("weight"), -F.col("source_rank"), F.col("level"))).otherwise(None)).over(everything)["level"]
    return leveled.withColumn("share", share).select(
        "source", "source_size", "source_rank", F.when(F.col("open"), F.col("weight") * F.col("share")).otherwise(F.col("cap")).alias("target")
    )


def running_sums(sums: DataFrame, keys: list[str], order: str, value: str, per: int = 1000) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same ``keys`` that come earlier in ``order`` (a long, unique per key).

    ``per`` neighbouring values of ``order`` are summed first, so a key's rows meet in one task only as such sums.
    """
    coarse = F.expr(f"{order} div {per}")
    earlier = lambda *by: (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy
    until = Window.unboundedPreceding, -1
    totals = sums.groupBy(*keys, coarse.alias("coarse")).agg(F.sum(value).alias("total"))
    totals = totals.withColumn("passed", F.coalesce(F.sum("total").over(earlier(*keys)("coarse").rowsBetween(*until)), F.lit(0)))
    within = F.coalesce(F.sum(value).over(earlier(*keys, "coarse")(order).rowsBetween(*until)), F.lit(0))
    placed = sums.withColumn("coarse", coarse).withColumn("within", within).alias("s")
    same = F.col("s.coarse") == F.col("t.coarse")
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
    return placed.join(totals.alias("t"), same).select(*[F.col(f"s.{c}") for c in sums.columns], (F.col("within") + F.col("passed")).alias("before"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = 3,
) -> DataFrame:
    """Returns ``id_col, size, source_size, target, taken``, one row per input row.

    ``size`` is a document's length (its words by default; null texts 0). Null sources form one source, last in order. Equal
    ids and repeated rows keep their own places in the order. Documents of size 0 take 0. Empty input: no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), (size if size is not None else n_words(text_col)).alias("size"))
    rows = materialize(measured.withColumn("key", shuffle_key("doc")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    counts = rows.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "of")
    ranges = math.ceil(rows.count() / ROWS_PER_RANGE) or 1
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.expr("key div ((1L << 60) div ceil(n / %d) + 1)" % ROWS_PER_RANGE)).drop("of", "n")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("size"))
    sources = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    offsets = running_sums(sums, ["source"], "range", "size").select("source", "range", F.col("before").alias("offset"))
    sources = sources.withColumnRenamed("source", "of")
    offsets = materialize(offsets.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "offsets")
    within = Window.partitionBy("source", "range").orderBy("key", "doc", "row")
    ordered = rows.withColumn("upto", F.sum("size").over(within)).alias("r")
    same = F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.range") == F.col("o.range"))
    placed = ordered.join(offsets.alias("o"), same).select(
        "doc", "row", "key", "size", "source_size", "source_rank", "target", (F.col("upto") + F.col("offset")).alias("upto")
    )
    placed = materialize(placed, "places")
    taken = F.col("size") * _copies_before_cut(placed, ranges, max_repeats)
    return placed.select(F.col("doc").cast(kind).alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def _finish(repeat: int) -> Column:
    """Null in sources without words: their target is 0 and nothing of them is taken."""
    return F.try_divide((F.col("upto") + repeat * F.col("source_size")).cast("double"), F.col("target"))


def _place(repeat: int) -> Column:
    return F.struct(_finish(repeat).alias("finish"), F.col("source_rank").alias("rank"), F.col("key").alias("key"), F.col("row").alias("row"))


def _copies_before_cut(placed: DataFrame, ranges: int, max_repeats: int) -> Column:
    """How many copies of a row come before the place where the budget, all tokens, is spent."""
    nonempty = placed.filter("size > 0")
    slots = ranges * max_repeats
    copies = nonempty.select(
        "size", "row", F.explode(F.array(*[F.struct(_place(k).alias("place"), F.least(F.lit(2.0), _finish(k)).alias("finish")) for k in range(max_repeats)])).alias("c")
    ).select("size", "row", "c.place", F.floor(F.col("c.finish") * slots).alias("slot"))
    by_slot = copies.groupBy("slot").agg(F.sum("size").alias("size"))
    running = running_sums(by_slot, [], "slot", "size").withColumn("upto", F.col("before") + F.col("size"))
    budget = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not budget:
        return F.lit(0).cast("long")
    last = running.filter(F.col("upto") <= budget).agg(F.coalesce(F.max("slot"), F.lit(-1)).alias("slot"), F.coalesce(F.max("upto"), F.lit(0)).alias("upto")).first()
    slot = copies.filter(F.col("slot") > last["slot"]).agg(F.min("slot")).first()[0]
    if slot is None:
        cut = None
    else:
        inside = copies.filter(F.col("slot") == slot).withColumn("upto", F.lit(last["upto"]) + F.sum("size").over(Window.partitionBy("slot").orderBy("place")))
        cut = inside.filter(F.col("upto") <= budget).agg(F.max("place").alias("place")).first()["place"]
    total = F.lit(0).cast("long")
    for k in range(max_repeats):
        if slot is None:
            before = F.lit(True)
        else:
            before = F.floor(F.least(F.lit(2.0), _finish(k)) * slots) < slot
            if cut is not None:
                edge = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["rank"]).alias("rank"), F.lit(cut["key"]).alias("key"), F.lit(cut["row"]).alias("row"))
                before = before | (_place(k) <= edge)
        total = total + F.when((F.col("size") > 0) & before, 1).otherwise(0)
    return total


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """Rows of ``docs``, all columns, as often as the mix takes them.

    Rows that share an id (null too) are taken alike, as often as the one taken most. Null and empty texts have no words and
    are not taken. Columns may have any names. Empty input: no rows.
    """
    mixed = mix_sources(docs, id_col, source_col, text_col=text_col, weights=weights, max_repeats=max_repeats)
    copies = mixed.filter("taken > 0").groupBy(F.col(id_col).alias("key")).agg(F.max(F.expr("cast(taken div size as int)")).alias("copies"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # the caller's names stay inside a struct
    joined = rows.join(copies, F.col("row")[id_col].eqNullSafe(F.col("key")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
