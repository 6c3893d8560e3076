"""Near-duplicate vectors by an exact metric range join.

Cosine ``c`` of unit vectors is Euclidean distance ``sqrt(2 - 2c)``, so the threshold is a range ``eps``. Identical vectors are
collapsed first and counted. In every label, pivots (a bounded number, taken by hash) split the vectors into cells of the
nearest pivot. By the triangle inequality a vector ``y`` can be in range of some home ``x`` of cell ``c`` only if
``d(y, pc) <= radius(c) + eps`` and ``d(y, pc) <= d(y, home pivot) + 2 eps``, and the bisector of two pivots sharpens the
second; ``y`` is replicated to exactly those cells. Cells join independently: each home's links are all in its own cell. Large
cells are cut into pairs of blocks, which are compared by matrix products and give counts and spanning forests, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, short_batches
from .components import components, forest

CELL_ROWS = 1000
MAX_PIVOTS = 4096  # over all labels
BLOCK = 2000
STRIP = 500
SLACK = 1e-9


def _unit(rows: list) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosine(a, b) -> float:
    """Cosine with correctly rounded sums, for values next to the threshold."""
    a, b = [float(v) for v in a], [float(v) for v in b]
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _by_group(pdf: pd.DataFrame):
    for key, part in pdf.groupby("grp", sort=False):
        yield key, part


def _homes(pivots):
    """Cell of the nearest pivot and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pivots.value
        for pdf in batches:
            out = []
            for key, part in _by_group(pdf):
                if key in known:
                    d = _distances(_unit(part["x"].tolist()), known[key])
                    out.append(part.assign(cell=d.argmin(1), far=d.min(1)))
                else:
                    out.append(part.assign(cell=0, far=0.0))
            if out:
                yield pd.concat(out)[["grp", "gid", "mult", "x", "cell", "far"]]

    return run


def _replicas(pivots, radii, eps: float):
    """Every cell whose homes a vector may be in range of, its own included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, radius = pivots.value, radii.value
        for pdf in batches:
            out = []
            for key, part in _by_group(pdf):
                if key not in known:
                    out.append(part.assign(to=0))
                    continue
                p = known[key]
                d = _distances(_unit(part["x"].tolist()), p)
                home = part["cell"].to_numpy()
                own = d[np.arange(len(part)), home][:, None]
                between = np.maximum(_distances(p, p)[home], 1e-12)
                near = (d <= radius[key][None, :] + eps + SLACK) & (d <= own + 2 * eps + SLACK) & ((d * d - own * own) / (2 * between) <= eps + SLACK)
                near[np.arange(len(part)), home] = True
                i, to = np.nonzero(near)
                out.append(part.iloc[i].assign(to=to))
            if out:
                yield pd.concat(out)[["grp", "gid", "mult", "x", "cell", "to"]]

    return run


def _join(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "int64", "n": "int64"})
        a, b = _unit(left["x"].tolist()), _unit(right["x"].tolist())
        ia, ib, mult = left["gid"].to_numpy(), right["gid"].to_numpy(), right["mult"].to_numpy()
        raw_a, raw_b = left["x"].tolist(), right["x"].tolist()
        out = []
        for at in range(0, len(a), STRIP):
            cosine = a[at : at + STRIP] @ b.T
            linked = cosine >= threshold
            for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):
                linked[i, j] = _cosine(raw_a[at + i], raw_b[j]) >= threshold
            same = ia[at : at + STRIP, None] == ib[None, :]
            linked |= same
            n = linked @ mult - same.any(1)
            out.append(pd.DataFrame({"a": ia[at : at + STRIP], "b": -1, "n": n}))
            i, j = np.nonzero(linked & ~same)
            x, y = forest(ia[at + i], ib[j])
            out.append(pd.DataFrame({"a": x, "b": y, "n": 0}))
        return pd.concat(out).astype("int64")

    return run


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """Returns ``id_col, n_links, component_id, kept``, one row per input row.

    Rows link when their labels are equal and not null, their vectors have equal length and their cosine reaches ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing and are components of their own, as
    are rows without label. Repeated rows link with each other. A component's id is its least non-null id; ``kept`` is null
    for a null id. Ids are whole numbers (components are numbered by them). Other columns are ignored. Empty input: no rows.

    At most ``MAX_PIVOTS`` pivots over all labels, a proven bound, are broadcast; beyond some ``MAX_PIVOTS * CELL_ROWS``
    vectors, or a quarter of ``MAX_PIVOTS`` large labels, cells grow with the table and are compared as more pairs of blocks.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    eps = math.sqrt(2 - 2 * threshold)
    x = F.col("x")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & x.isNotNull() & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    rows = materialize(rows.withColumn("ok", ok).withColumn("row", F.monotonically_increasing_id()), "vectors")
    grp = F.concat_ws("|", F.size("x"), F.col("label").cast("string"))
    groups = rows.filter("ok").groupBy("label", "x").agg(F.min("row").alias("gid"), F.count("*").alias("mult"), F.min("id").alias("least"))
    groups = materialize(groups.withColumn("grp", grp), "distinct")

    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > 2 * CELL_ROWS).orderBy(F.desc("n"), "grp").limit(MAX_PIVOTS // 4).collect()
    total = sum(r["n"] for r in large)
    wanted = {r["grp"]: max(2, min(r["n"] // CELL_ROWS, MAX_PIVOTS * r["n"] // total)) for r in large}
    found: dict[str, list] = {}
    if wanted:
        odds = spark.createDataFrame([(k, v, r["n"]) for r in large for k, v in [(r["grp"], wanted[r["grp"]])]], "grp string, k long, n long")
        taken = groups.select("grp", "gid", "x").join(F.broadcast(odds), "grp").filter(F.pmod(F.xxhash64("gid"), F.col("n")) < F.col("k"))
        for r in taken.orderBy("grp", "gid").limit(2 * MAX_PIVOTS).collect():
            found.setdefault(r["grp"], []).append(r["x"])
    pivots = spark.sparkContext.broadcast({k: _unit(v) for k, v in found.items() if len(v) > 1})

    kind = groups.schema["x"].dataType.simpleString()
    homes = materialize(groups.select("grp", "gid", "mult", "x").mapInPandas(_homes(pivots), f"grp string, gid long, mult long, x {kind}, cell long, far double"), "homes")
    radius = {k: np.full(len(p), -1.0) for k, p in pivots.value.items()}
    of_cells = homes.filter(F.col("grp").isin(list(radius))) if radius else homes.limit(0)
    for r in of_cells.groupBy("grp", "cell").agg(F.max("far").alias("far")).collect() if radius else []:
        radius[r["grp"]][r["cell"]] = r["far"]
    spread = homes.drop("far").mapInPandas(_replicas(pivots, spark.sparkContext.broadcast(radius), eps), f"grp string, gid long, mult long, x {kind}, cell long, to long")
    spread = materialize(spread, "cells").withColumn("home", F.col("cell") == F.col("to"))
    blocks = spread.groupBy("grp", "to").agg(F.ceil(F.count(F.when(F.col("home"), 1)) / BLOCK).alias("lefts"), F.ceil(F.count("*") / BLOCK).alias("rights"))
    dealt = spread.join(blocks.filter("lefts > 0"), ["grp", "to"])
    mine = F.pmod(F.xxhash64("gid"), F.col("lefts"))
    units_left = dealt.filter("home").withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("side", F.lit(0))
    units_right = dealt.withColumn("j", F.pmod(F.xxhash64("gid", F.lit(1)), F.col("rights"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("side", F.lit(1))
    columns = ["grp", "to", "i", "j", "side", "gid", "mult", "x"]
    joined = units_left.select(columns).unionByName(units_right.select(columns)).groupBy("grp", "to", "i", "j").applyInPandas(_join(threshold), "a long, b long, n long")
    joined = materialize(joined, "links")

    n_links = joined.filter("b < 0").groupBy(F.col("a").alias("gid")).agg(F.sum("n").alias("n_links"))
    linked = components(joined.filter("b >= 0").select("a", "b"))
    least = groups.select("gid", "least").join(linked, F.col("gid") == F.col("vertex"), "left").withColumn("root", F.coalesce("component", "gid"))
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    per_group = groups.select("gid", "label", "x").join(n_links, "gid").join(least.select("gid", "root"), "gid").join(by_root, "root").select("label", "x", "n_links", "component_id")
    per_group = materialize(per_group, "groups")
    alone = rows.filter(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    together = rows.filter("ok").join(per_group, ["label", "x"]).select("id", "n_links", "component_id")
    return together.union(alone).select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast("long").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
