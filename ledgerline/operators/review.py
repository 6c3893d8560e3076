"""Reviews of texts and scores: eligible sections, split quality, lengths, agreement with gold labels, audits of cleaned scopes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import truth
from .windows import first_per_key

#: What a review status may be, and when a cleaned scope is warned about or dropped.
APPROVED, REJECTED = "approved", "rejected"
WARN_CHARS, LARGE_REMOVAL, FLOOR_TOKENS = 500, 0.4, 250
CITATION = r"(?i)^[(\[]?(?:see|cf|id|note|item|section|part)\b.{0,25}$"
FRAGMENT = r"^[a-z,;:)\]]"


def section_universe(items: DataFrame, forms: Sequence[str], scopes: Sequence[str], min_chars: int) -> DataFrame:
    """Active items of the forms and scopes whose regime holds and whose text is long enough; of an item's several texts the longest."""
    ok = (F.col("item_status") == "active") & truth(F.col("exists_by_regime")) & F.col("form").isin(*forms) & F.col("item_id").isin(*scopes)
    long = items.filter(ok).withColumn("n_chars", F.length("full_text")).filter(F.col("n_chars") >= min_chars)
    return first_per_key(long, ["doc_id", "item_id"], [F.col("n_chars").desc(), F.col("full_text").asc()])


def split_flags(sentence: Column) -> dict[str, Column]:
    """What may be wrong with a sentence that a splitter gave."""
    return {
        "very_short": F.length(sentence) < 10,
        "very_long": F.length(sentence) > 1500,
        "starts_low": truth(sentence.rlike(FRAGMENT)),
        "citation_stub": truth(sentence.rlike(CITATION)),
        "no_letters": ~truth(sentence.rlike(r"\p{L}")),
        "mostly_digits": F.regexp_count(sentence, F.lit(r"[0-9]")) * 2 > F.length(sentence),
    }


def split_quality(sentences: DataFrame, by: Sequence[str], text_col: str = "sentence") -> DataFrame:
    """Counts of sentences and of each flag per group, and the share with any."""
    flags = split_flags(F.col(text_col))
    anything = F.lit(False)
    for f in flags.values():
        anything = anything | f
    return sentences.groupBy(*by).agg(F.count("*").alias("sentences"), *[F.count(F.when(f, 1)).alias(n) for n, f in flags.items()], (F.count(F.when(anything, 1)) / F.count("*")).alias("flagged_share"))


def length_summary(df: DataFrame, by: Sequence[str], length: str, limits: Sequence[int] = (128, 256, 512)) -> DataFrame:
    """Mean, quantiles and the share over each limit."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(length).alias("mean"), *[F.percentile(length, F.lit(q)).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.99)], F.max(length).alias("longest"),
        *[(F.count(F.when(F.col(length) > x, 1)) / F.count("*")).alias(f"over_{x}") for x in limits],
    )


def recommend_limit(df: DataFrame, length: str, limits: Sequence[int], share: float) -> DataFrame:
    """The least limit that holds at least ``share`` of the rows, else the largest: one row."""
    within = [F.count(F.when(F.col(length) <= x, 1)) / F.count("*") for x in limits]
    choice = F.lit(max(limits))
    for x, w in sorted(zip(limits, within, strict=True), reverse=True, key=lambda p: p[0]):
        choice = F.when(w >= share, x).otherwise(choice)
    return df.agg(choice.cast("long").alias("recommended"), *[w.alias(f"within_{x}") for x, w in zip(limits, within, strict=True)])


def confusion(df: DataFrame, gold: str, predicted: str, weight: str | None = None) -> DataFrame:
    """Weighted precision, recall and F1 of each class: ``label, support, precision, recall, f1``; undefined ratios are null."""
    w = F.col(weight) if weight else F.lit(1.0)
    both = df.select(F.col(gold).cast("string").alias("g"), F.col(predicted).cast("string").alias("p"), w.cast("double").alias("w"))
    long = both.select(F.explode(F.array_distinct(F.array("g", "p"))).alias("label"), "g", "p", "w").filter("label is not null")
    hit = (F.col("g") == F.col("label")) & (F.col("p") == F.col("label"))
    s = long.groupBy("label").agg(F.sum(F.when(hit, F.col("w")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("g") == F.col("label"), F.col("w")).otherwise(0.0)).alias("support"), F.sum(F.when(F.col("p") == F.col("label"), F.col("w")).otherwise(0.0)).alias("named"))
    s = s.withColumn("precision", F.try_divide("tp", "named")).withColumn("recall", F.try_divide("tp", "support"))
    return s.select("label", "support", "precision", "recall", F.try_divide(2 * F.col("tp"), F.col("support") + F.col("named")).alias("f1"))


def accuracy_bounds(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Accuracy over labelled rows, and its least and greatest value had the unlabelled ones been labelled: one row."""
    hit, known, n = F.count(F.when(F.col(gold) == F.col(predicted), 1)), F.count(gold), F.count("*")
    return df.agg(n.alias("rows"), known.alias("labelled"), F.try_divide(hit, known).alias("accuracy"), F.try_divide(hit, n).alias("lower"), F.try_divide(hit + n - known, n).alias("upper"))


def review_status(status: Column, candidate: Column, needed: Column, boundary: Column) -> Column:
    """A verdict that was given stays; else a review is required for audit candidates and untrusted boundaries."""
    unclear = boundary.isNull() | boundary.isin("unknown", "review_needed")
    return F.when(status.isin(APPROVED, REJECTED), status).when(truth(candidate) | truth(needed) | unclear, "required").otherwise("not_required")


def audit_scopes(cleaned: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Adds ``drop_reason``, ``audit_candidate``, ``status`` and ``eligible`` to cleaned scopes (columns ``cleaned, stub, removed_share, boundary, review``)."""
    n = F.length("cleaned")
    reason = F.when(F.col(text_col).isNull() | (F.length(F.trim(text_col)) == 0), "empty_input").when(n == 0, "empty_after_cleaning").when(truth(F.col("stub")), "stub")
    candidate = reason.isNull() & ((n < WARN_CHARS) | (F.col("removed_share") >= LARGE_REMOVAL))
    out = cleaned.withColumn("drop_reason", reason).withColumn("audit_candidate", truth(candidate))
    out = out.withColumn("status", review_status(F.col("review"), F.col("audit_candidate"), F.lit(False), F.col("boundary")))
    return out.withColumn("eligible", F.col("drop_reason").isNull() & F.col("status").isin("not_required", APPROVED))


def scope_report(audited: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, drops by reason, candidates and eligible rows per group."""
    of = lambda r: F.count(F.when(F.col("drop_reason") == r, 1)).alias(r)
    return audited.groupBy(*by).agg(F.count("*").alias("rows"), of("empty_input"), of("empty_after_cleaning"), of("stub"), F.count(F.when(F.col("audit_candidate"), 1)).alias("candidates"), F.count(F.when(F.col("eligible"), 1)).alias("eligible"))


def boundary_diagnostics(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Flags of items whose bounds look wrong, and their rates per group."""
    text = F.coalesce("full_text", F.lit(""))
    flags = {
        "short": F.length(text) < 200,
        "ends_open": (F.length(text) > 0) & ~truth(F.rtrim(text).rlike(r"[.!?:;\")\]]$")),
        "starts_low": truth(text.rlike(r"^\s*[a-z]")),
        "holds_heading": truth(text.rlike(r"(?im)^\s*item\s+\d{1,2}[a-c]?\s*[.:]")),
        "holds_part": truth(text.rlike(r"(?im)^\s*part\s+[iv]{1,3}\s*$")),
    }
    suspicious = F.lit(False)
    for f in flags.values():
        suspicious = suspicious | f
    return items.groupBy(*by).agg(F.count("*").alias("items"), *[F.count(F.when(f, 1)).alias(n) for n, f in flags.items()], (F.count(F.when(suspicious, 1)) / F.count("*")).alias("suspicious_share"))


def compare_diagnostics(before: DataFrame, after: DataFrame, by: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Change of each flag's rate between two reports: ``by, flag, before, after, change``."""
    rate = lambda df, name: df.unpivot([*by, "items"], list(flags), "flag", "n").select(*by, "flag", F.try_divide("n", "items").alias(name))
    j = rate(before, "before").join(rate(after, "after"), [*by, "flag"], "full")
    return j.withColumn("change", F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))


def visible_prefix(sentences: DataFrame, by: Sequence[str], order: str, tokens: str, budget: int = 512, special: int = 2) -> DataFrame:
    """What a model with a token budget sees of each group: whole sentences, tokens and share of them, from the beginning."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sentences.withColumn("__upto", F.sum(tokens).over(w))
    room = budget - special
    seen = F.greatest(F.lit(0), F.least(F.col(tokens), room - (F.col("__upto") - F.col(tokens))))
    out = upto.groupBy(*by).agg(F.count("*").alias("sentences"), F.count(F.when(F.col("__upto") <= room, 1)).alias("visible_sentences"), F.sum(tokens).alias("tokens"), F.sum(seen).alias("visible_tokens"))
    return out.withColumn("visible_share", F.try_divide("visible_tokens", "tokens")).withColumn("truncated", F.col("visible_tokens") < F.col("tokens"))


def floor_sweep(items: DataFrame, tokens: str, floors: Sequence[int]) -> DataFrame:
    """Items kept and tokens kept under each least length: ``floor, kept, share, tokens``; one pass."""
    cells = [F.struct(F.lit(x).alias("floor"), (F.col(tokens) >= x).alias("in")) for x in floors]
    long = items.select(F.col(tokens).alias("__t"), F.explode(F.array(*cells)).alias("c")).select("__t", "c.*")
    return long.groupBy("floor").agg(F.count(F.when(F.col("in"), 1)).alias("kept"), (F.count(F.when(F.col("in"), 1)) / F.count("*")).alias("share"), F.sum(F.when(F.col("in"), F.col("__t")).otherwise(0)).alias("tokens"))


def surface_audit(surfaces: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Keys that each pair of surfaces shares and lacks: ``a, b, both, only_a, only_b``; one aggregation over all keys."""
    names = list(surfaces)
    parts = [surfaces[n].select(F.col(key).alias("__k")).distinct().withColumn("__s", F.lit(n)) for n in names]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    have = every.groupBy("__k").agg(F.collect_set("__s").alias("s"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.array_contains("s", a).alias("x"), F.array_contains("s", b).alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]]
    long = have.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return long.groupBy("a", "b").agg(F.count(F.when(F.col("x") & F.col("y"), 1)).alias("both"), F.count(F.when(F.col("x") & ~F.col("y"), 1)).alias("only_a"), F.count(F.when(~F.col("x") & F.col("y"), 1)).alias("only_b"))


def recombined_means(parts: DataFrame, by: str, count: str, means: Sequence[str], label: str = "TOTAL") -> DataFrame:
    """Means of pre-aggregated parts put together by their counts, per group and in total."""
    aggs = [F.sum(count).alias(count), *[F.try_divide(F.sum(F.col(m) * F.col(count)), F.sum(F.when(F.col(m).isNotNull(), F.col(count)))).alias(m) for m in means]]
    from .reports import with_total

    return with_total(parts, by, aggs, label)


def distinct_with_null(c: str) -> Column:
    """Distinct values, null counting as one."""
    return F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def distinct_successes(*columns: str) -> Column:
    """Number of unlike non-blank values among columns of a row."""
    values = F.array(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])
    return F.size(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


def same_value(a: str, b: str) -> Column:
    """Whether both columns have a value and the same one; null where one lacks it."""
    x, y = F.nullif(F.trim(F.col(a)), F.lit("")), F.nullif(F.trim(F.col(b)), F.lit(""))
    return x == y


# Sample contracts: what rows a table may draw on


def raw_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have any of the columns."""
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNotNull()
    return df.filter(some)


def regression_eligible(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have all of the columns, finite."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = df.dropna(subset=list(columns))
    for c in columns:
        if kinds[c] in ("double", "float"):
            out = out.filter(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    return out


def common_rows(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys that all frames have; a key that repeats in a frame raises."""
    from ..contracts import assert_unique

    out = assert_unique(frames[0], keys, "first sample").select(*keys)
    for i, f in enumerate(frames[1:], 2):
        out = out.join(assert_unique(f, keys, f"sample {i}").select(*keys), list(keys))
    return out
