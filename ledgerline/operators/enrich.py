"""Vendor enrichment: identifier bridge, resolution by neighbours, alias groups, ownership and analyst selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..scratch import materialize
from . import asof

INSTITUTIONS = "holdings by institutions"


def bridge_universe(panel: DataFrame) -> DataFrame:
    """One row per (security, issue, identifiers) with the days seen, the last non-null attributes and filing days."""
    ids = ["KYPERMNO", "LIID", "CUSIP", "ISIN", "TICKER"]
    attributes = [c for c in panel.columns if c not in (*ids, "CALDT", "n_filings")]
    filings = F.sum(F.when(F.col("n_filings") > 0, 1).otherwise(0)) if "n_filings" in panel.columns else F.lit(0)
    out = panel.groupBy(*ids).agg(
        F.min("CALDT").alias("first_seen_caldt"), F.max("CALDT").alias("last_seen_caldt"), F.count_distinct("CALDT").alias("days"), filings.cast("long").alias("filing_days"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("CALDT"))).alias(c) for c in attributes],
    )
    value, kind = X.preferred_identifier(F.col("ISIN"), F.col("CUSIP"), F.col("TICKER"))
    return out.withColumn("bridge_row_id", X.row_key(*[F.col(c) for c in ids])).withColumn("preferred_lookup_id", value).withColumn("preferred_lookup_type", kind)


def resolve_identifiers(bridge: DataFrame) -> DataFrame:
    """Accepts agreeing look-ups by ISIN and CUSIP; an unresolved span takes what accepted spans next to it agree on.

    Neighbours are the spans before and after of the same security and issue, and only their own accepted value counts.
    """
    isin, cusip = X.clean_text(F.col("isin_ric")), X.clean_text(F.col("cusip_ric"))
    b = bridge.withColumn("accepted", F.when(isin.isNotNull() & cusip.isNotNull() & (isin != cusip), None).otherwise(F.coalesce(isin, cusip)))
    b = b.withColumn("conflict", isin.isNotNull() & cusip.isNotNull() & (isin != cusip))
    w = Window.partitionBy("KYPERMNO", "LIID").orderBy("first_seen_caldt", "last_seen_caldt", "bridge_row_id")
    b = b.withColumn("__before", F.lag("accepted").over(w)).withColumn("__after", F.lead("accepted").over(w))
    neighbour = F.when(F.col("__before").isNull(), F.col("__after")).when(F.col("__after").isNull() | (F.col("__before") == F.col("__after")), F.col("__before"))
    disagree = F.col("__before").isNotNull() & F.col("__after").isNotNull() & (F.col("__before") != F.col("__after"))
    status = F.when(F.col("accepted").isNotNull(), "ACCEPTED").when(F.col("conflict"), "CONFLICT").when(disagree, "NEIGHBOURS_DISAGREE").when(neighbour.isNotNull(), "EXTENDED").otherwise("UNRESOLVED")
    out = b.withColumn("resolution_status", status).withColumn("effective_ric", F.when(status == "ACCEPTED", F.col("accepted")).when(status == "EXTENDED", neighbour))
    return out.drop("__before", "__after", "accepted", "conflict")


def alias_pairs(observations: DataFrame, tolerance: float = 1e-6, min_pairs: int = 12, min_dates: int = 3, min_categories: int = 3, min_overlap: float = 0.5) -> DataFrame:
    """Identifier pairs of one security whose reported values agree often enough: ``KYPERMNO, a, b``.

    Observations are ``KYPERMNO, ric, date, category, value``; a security has few identifiers, so pairs stay few.
    """
    o = observations.dropDuplicates(["KYPERMNO", "ric", "date", "category"])
    size = o.groupBy("KYPERMNO", "ric").agg(F.count("*").alias("n"))
    x, y = o.withColumnRenamed("ric", "a").withColumnRenamed("value", "va"), o.withColumnRenamed("ric", "b").withColumnRenamed("value", "vb")
    both = x.join(y, ["KYPERMNO", "date", "category"]).filter("a < b")
    agree = F.abs(F.col("va") - F.col("vb")) <= tolerance
    sums = both.groupBy("KYPERMNO", "a", "b").agg(F.count("*").alias("shared"), F.count(F.when(agree, 1)).alias("same"), F.count_distinct("date").alias("dates"), F.count_distinct("category").alias("categories"))
    sums = sums.join(size.select("KYPERMNO", F.col("ric").alias("a"), F.col("n").alias("na")), ["KYPERMNO", "a"]).join(size.select("KYPERMNO", F.col("ric").alias("b"), F.col("n").alias("nb")), ["KYPERMNO", "b"])
    enough = (F.col("same") >= min_pairs) & (F.col("same") == F.col("shared")) & (F.col("dates") >= min_dates) & (F.col("categories") >= min_categories) & (F.col("shared") >= min_overlap * F.least("na", "nb"))
    return sums.filter(enough).select("KYPERMNO", "a", "b")


def alias_groups(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 20) -> DataFrame:
    """Least member of each connected group within a key: ``KYPERMNO, ric, canonical_ric``.

    Every round takes the least label of neighbours and halves the pointers; it is written to the shared folder, so lineage stays short.
    """
    edges = materialize(pairs.select("KYPERMNO", "a", "b").unionByName(pairs.select("KYPERMNO", F.col("b").alias("a"), F.col("a").alias("b"))), "alias-edges")
    label = nodes.select("KYPERMNO", "ric").distinct().withColumn("canonical_ric", F.col("ric"))
    for _ in range(max_rounds):
        near = edges.join(label.select("KYPERMNO", F.col("ric").alias("b"), F.col("canonical_ric").alias("l")), ["KYPERMNO", "b"]).groupBy("KYPERMNO", F.col("a").alias("ric")).agg(F.min("l").alias("l"))
        hop = label.select("KYPERMNO", F.col("ric").alias("canonical_ric"), F.col("canonical_ric").alias("up"))
        after = label.join(hop, ["KYPERMNO", "canonical_ric"]).join(near, ["KYPERMNO", "ric"], "left")
        after = materialize(after.select("KYPERMNO", "ric", F.least("canonical_ric", "up", "l").alias("canonical_ric"), F.col("canonical_ric").alias("old")), "alias-labels")
        label = after.drop("old")
        if not after.filter("old <> canonical_ric").limit(1).count():
            return label
    raise RuntimeError("alias groups did not settle")


def ownership_requests(docs: DataFrame, windows: DataFrame, fallback_days: int = 45) -> DataFrame:
    """Target quarter end and fallback window of each document; its identifier needs exactly one valid window."""
    d = docs.withColumn("target_quarter_end", X.quarter_end_before(F.col("filing_date"))).withColumn("effective_date", F.date_add("target_quarter_end", 1))
    d = d.withColumn("fallback_start", F.col("effective_date")).withColumn("fallback_end", F.least("filing_date", F.date_add("target_quarter_end", fallback_days)))
    inside = (F.col("effective_date") >= F.col("window_start")) & (F.col("window_end").isNull() | (F.col("effective_date") <= F.col("window_end")))
    hits = d.join(windows, "KYPERMNO").filter(inside).groupBy("doc_id").agg(F.count("*").alias("windows"), F.min("ric").alias("ric"))
    out = d.join(hits, "doc_id", "left")
    reason = F.when(F.col("KYPERMNO").isNull(), "NO_SECURITY").when(F.col("windows").isNull(), "NO_AUTHORITY_WINDOW").when(F.col("windows") > 1, "AMBIGUOUS_AUTHORITY_WINDOW")
    return out.withColumn("exclusion_reason", reason).withColumn("ric", F.when(reason.isNull(), F.col("ric"))).drop("windows")


def select_ownership(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """Exact value of the target quarter end if unique, else the unique value of the latest date in the fallback window.

    Only institutional holdings count; negatives are null, values above 100 are 100; several values of one date conflict.
    """
    value = F.when(F.col("value") >= 0, F.least("value", F.lit(100.0)))
    r = reports.filter(F.lower(F.trim("category")) == INSTITUTIONS).withColumn("v", value).filter("v is not null").select("ric", F.col("date").alias("rd"), "v")
    q = requests.filter("exclusion_reason is null")
    exact = q.join(r, (q["ric"] == r["ric"]) & (F.col("rd") == F.col("target_quarter_end"))).groupBy("doc_id").agg(F.count_distinct("v").alias("exact_n"), F.min("v").alias("exact"))
    late = q.join(r, (q["ric"] == r["ric"]) & F.col("rd").between(F.col("fallback_start"), F.col("fallback_end")))
    by_date = late.groupBy("doc_id", "rd").agg(F.count_distinct("v").alias("n"), F.min("v").alias("v"))
    last = by_date.groupBy("doc_id").agg(F.max_by(F.struct("n", "v", "rd"), "rd").alias("l"))
    out = requests.join(exact, "doc_id", "left").join(last, "doc_id", "left")
    status = F.when(F.col("exact_n") == 1, "EXACT").when(F.col("exact_n") > 1, "EXACT_CONFLICT").when(F.col("l.n") == 1, "FALLBACK").when(F.col("l.n") > 1, "FALLBACK_CONFLICT").otherwise("NO_MATCH")
    picked = F.when(status == "EXACT", F.col("exact")).when(status == "FALLBACK", F.col("l.v"))
    return out.withColumn("ownership_status", status).withColumn("institutional_ownership_pct", picked).withColumn("needs_review", status.endswith("CONFLICT")).drop("exact_n", "exact", "l")


def analyst_groups(bridge: DataFrame) -> DataFrame:
    """Request windows per company and identifier: actuals -31/+120 days, estimates -270/+31 days around the days seen."""
    g = bridge.filter("gvkey_int is not null and ric is not null").groupBy("gvkey_int", "ric").agg(F.min("first_seen_caldt").alias("a"), F.max("last_seen_caldt").alias("b"), F.count("*").alias("bridge_rows"))
    return g.select(
        "gvkey_int", "ric", "bridge_rows",
        F.date_sub("a", 31).alias("actuals_start"), F.date_add("b", 120).alias("actuals_end"), F.date_sub("a", 270).alias("estimates_start"), F.date_add("b", 31).alias("estimates_end"),
    )


def analyst_panel(actuals: DataFrame, estimates: DataFrame, months: Sequence[int] = (4, 1)) -> DataFrame:
    """Announced earnings with the latest snapshot at or before them and revisions against earlier snapshots.

    Actuals are ``gvkey_int, announcement_date, fiscal_period_end, actual_eps``; estimates ``gvkey_int, fiscal_period_end,
    calc_date, mean, dispersion``. Keys with several distinct values are rejected; a conflicting 1-month base only blanks its revision.
    """
    a = actuals.filter("gvkey_int is not null and announcement_date is not null").groupBy("gvkey_int", "announcement_date", "fiscal_period_end")
    a = a.agg(F.count_distinct("actual_eps").alias("n_actual"), F.min("actual_eps").alias("actual_eps"))
    e = estimates.filter("mean is not null and dispersion is not null").groupBy("gvkey_int", "fiscal_period_end", "calc_date")
    e = e.agg(F.count_distinct("mean").alias("n_mean"), F.min("mean").alias("mean"), F.min("dispersion").alias("dispersion"))
    latest = e.groupBy("gvkey_int", "calc_date").agg(F.count_distinct("fiscal_period_end").alias("ends"), F.min("fiscal_period_end").alias("only_end"))
    a = asof.asof_join(a, latest, ["gvkey_int"], "announcement_date", "calc_date", ["ends", "only_end"]).drop("asof_calc_date", "matched")
    a = a.withColumn("fiscal_period_end", F.coalesce("fiscal_period_end", F.when(F.col("ends") == 1, F.col("only_end"))))
    p = asof.asof_join(a, e, ["gvkey_int", "fiscal_period_end"], "announcement_date", "calc_date", ["mean", "dispersion", "n_mean"]).withColumnRenamed("asof_calc_date", "snapshot_date").drop("matched")
    p = p.withColumnRenamed("mean", "forecast_consensus_mean").withColumnRenamed("dispersion", "forecast_dispersion").withColumnRenamed("n_mean", "n_snapshot")
    for k in months:
        p = p.withColumn("__t", X.shift_months_to_end(F.col("snapshot_date"), -k))
        p = asof.asof_join(p, e, ["gvkey_int", "fiscal_period_end"], "__t", "calc_date", ["mean", "n_mean"]).drop("asof_calc_date", "matched", "__t")
        p = p.withColumn(f"forecast_revision_{k}m", F.when(F.col("n_mean") == 1, F.col("forecast_consensus_mean") - F.col("mean")))
        if k == max(months):
            p = p.withColumn("n_base", F.col("n_mean"))
        p = p.drop("mean", "n_mean")
    code = (
        F.when(F.col("n_actual") > 1, "CONFLICTING_ACTUALS")
        .when(F.col("actual_eps").isNull(), "MISSING_ACTUAL")
        .when(F.col("fiscal_period_end").isNull(), "NO_FISCAL_PERIOD")
        .when(F.col("snapshot_date").isNull(), "NO_SNAPSHOT")
        .when(F.col("n_snapshot") > 1, "CONFLICTING_SNAPSHOT")
        .when(F.col("n_base") > 1, "CONFLICTING_BASE")
    )
    return p.withColumn("rejection_code", code).drop("ends", "only_end", "n_actual", "n_snapshot", "n_base")


def lookup_handoff(bridge: DataFrame, common_only: bool = False, need_company: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """Rows to look up under a filter profile: a preferred identifier, and where asked common stock, a company, an allowed security."""
    value, kind = X.preferred_identifier(F.col("ISIN"), F.col("CUSIP"), F.col("TICKER"))
    out = bridge.withColumn("preferred_lookup_id", value).withColumn("preferred_lookup_type", kind).filter("preferred_lookup_id is not null")
    if common_only:
        out = out.filter(X.common_stock(F.col("SHRCD")))
    if need_company:
        out = out.filter("KYGVKEY is not null")
    return out if allowed is None else out.join(allowed.select("KYPERMNO").distinct(), "KYPERMNO", "left_semi")


def lookup_diagnostics(rows: DataFrame, lookups: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts of successful look-ups, of rows whose look-ups agree, differ or all failed."""
    from .review import distinct_successes

    n = distinct_successes(*lookups)
    found = [F.count(F.when(X.clean_text(F.col(c)).isNotNull(), 1)).alias(f"{c}_found") for c in lookups]
    count = lambda p, name: F.count(F.when(p, 1)).alias(name)
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *found, count(n == 0, "failed"), count(n == 1, "agreed"), count(n > 1, "differ"))


def pairwise_comparison(rows: DataFrame, lookups: Sequence[str]) -> DataFrame:
    """Per pair of look-ups: rows where both succeeded, and where they agree."""
    from itertools import combinations

    from .review import same_value

    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), same_value(a, b).alias("same")) for a, b in combinations(lookups, 2)]
    long = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return long.groupBy("a", "b").agg(F.count("same").alias("both"), F.count(F.when(F.col("same"), 1)).alias("agree"))


def instrument_authority(resolved: DataFrame, instruments: DataFrame) -> DataFrame:
    """Resolved identifiers with their instrument facts and why they can't be used, if so."""
    out = resolved.join(instruments.withColumnRenamed("ric", "effective_ric"), "effective_ric", "left")
    reason = (
        F.when(F.col("effective_ric").isNull(), "NO_IDENTIFIER")
        .when(F.col("instrument_type").isNull(), "NO_INSTRUMENT")
        .when(F.lower("instrument_type") != "ordinary share", "NOT_COMMON")
        .when(F.col("currency") != "USD", "FOREIGN_CURRENCY")
    )
    return out.withColumn("ineligible_reason", reason).withColumn("eligible", reason.isNull())


def candidate_metrics(observations: DataFrame) -> DataFrame:
    """Per security and identifier: observations, dates, categories and the span they cover."""
    return observations.groupBy("KYPERMNO", "ric").agg(
        F.count("*").alias("observations"), F.count_distinct("date").alias("dates"), F.count_distinct("category").alias("categories"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def authority_decisions(metrics: DataFrame, groups: DataFrame, min_dates: int = 3) -> DataFrame:
    """Per security and alias group its span and support, and per security a decision.

    ``NO_SUPPORT`` without a group of enough dates, ``SINGLE`` with one, ``SEQUENTIAL`` where groups follow each other in time,
    ``OVERLAP`` where any two overlap.
    """
    g = metrics.join(groups, ["KYPERMNO", "ric"]).groupBy("KYPERMNO", "canonical_ric").agg(F.sum("dates").alias("dates"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    g = g.withColumn("supported", F.col("dates") >= min_dates)
    w = Window.partitionBy("KYPERMNO", "supported").orderBy("first_date", "last_date", "canonical_ric")
    g = g.withColumn("__reach", F.max("last_date").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = g.groupBy("KYPERMNO").agg(F.count(F.when(F.col("supported"), 1)).alias("groups"), F.max(F.when(F.col("supported") & (F.col("first_date") <= F.col("__reach")), 1).otherwise(0)).alias("__over"))
    decision = F.when(F.col("groups") == 0, "NO_SUPPORT").when(F.col("groups") == 1, "SINGLE").when(F.col("__over") == 1, "OVERLAP").otherwise("SEQUENTIAL")
    return g.drop("__reach").join(s.withColumn("decision", decision).drop("__over"), "KYPERMNO")


def authority_exceptions(decisions: DataFrame) -> DataFrame:
    """Securities that need a person's look, with the reason."""
    return decisions.filter(F.col("decision").isin("NO_SUPPORT", "OVERLAP")).groupBy("KYPERMNO", "decision").agg(F.count("*").alias("candidates"))


def authority_panel(decisions: DataFrame, gap_days: int = 365) -> DataFrame:
    """Windows of the identifiers of decided securities, those of one group merged across gaps: ``KYPERMNO, ric, window_start, window_end``."""
    from .windows import merge_intervals

    ok = decisions.filter("supported").filter(F.col("decision").isin("SINGLE", "SEQUENTIAL"))
    rows = ok.select("KYPERMNO", F.col("canonical_ric").alias("ric"), F.col("first_date").alias("window_start"), F.col("last_date").alias("window_end"))
    return merge_intervals(rows, ["KYPERMNO", "ric"], "window_start", "window_end", gap_days).drop("parts")


def universe_diagnostics(universe: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Membership of two tables of keys in each other: one row of counts and rates."""
    a, b = universe.select(*key).distinct().withColumn("__a", F.lit(1)), found.select(*key).distinct().withColumn("__b", F.lit(1))
    j = a.join(b, list(key), "full")
    both = F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1))
    return j.agg(F.count("__a").alias("universe"), F.count("__b").alias("found"), both.alias("both"), F.try_divide(both, F.count("__a")).alias("coverage"), F.count(F.when(F.col("__a").isNull(), 1)).alias("unexpected"))


def exact_or_unique(docs: DataFrame, candidates: DataFrame, exact: Sequence[str], loose: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Candidates by the exact keys, else by the looser ones where only one candidate has them: adds ``values`` and ``match_status``.

    Candidates are unique by the exact keys. A miss with several loose candidates is refused as ambiguous.
    """
    packed = candidates.select(*exact, *[c for c in loose if c not in exact], F.struct(*values).alias("__v"))
    single = packed.groupBy(*loose).agg(F.count("*").alias("__n"), F.min("__v").alias("__loose"))
    out = docs.join(packed.select(*exact, F.col("__v").alias("__exact")), list(exact), "left").join(single, list(loose), "left")
    status = F.when(F.col("__exact").isNotNull(), "EXACT").when(F.col("__n") == 1, "FALLBACK").when(F.col("__n") > 1, "AMBIGUOUS_FALLBACK_REJECTED").otherwise("NO_MATCH")
    pick = F.coalesce("__exact", F.when(F.col("__n") == 1, F.col("__loose")))
    return out.withColumn("match_status", status).withColumn("__p", pick).select(*docs.columns, *[F.col("__p")[v].alias(v) for v in values], "match_status")


def plan_batches(requests: Sequence[tuple[str, object, object, int]], max_rows: int) -> list[dict]:
    """Joins requests (id, first day, last day, rows a day) into batches of at most ``max_rows`` rows, on the driver.

    Requests go in order of their spans; each joins the open batch that grows least, else opens one. A batch's fingerprint is a
    hash of its members, so the same requests give the same batches.
    """
    import hashlib

    batches: list[dict] = []
    for rid, first, last, rate in sorted(requests, key=lambda r: (r[1], r[2], r[0])):
        best = None
        for b in batches:
            lo, hi, rates = min(b["first"], first), max(b["last"], last), b["rate"] + rate
            rows = ((hi - lo).days + 1) * rates
            extra = rows - b["rows"]
            if rows <= max_rows and (best is None or extra < best[0]):
                best = (extra, b, lo, hi, rates, rows)
        if best:
            _, b, lo, hi, rates, rows = best
            b.update(first=lo, last=hi, rate=rates, rows=rows)
            b["members"].append(rid)
        else:
            batches.append({"first": first, "last": last, "rate": rate, "rows": ((last - first).days + 1) * rate, "members": [rid]})
    for b in batches:
        b["fingerprint"] = hashlib.sha256("|".join([str(b["first"]), str(b["last"]), *sorted(b["members"])]).encode()).hexdigest()[:16]
    return batches
