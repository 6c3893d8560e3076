"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is scanned once for the base kinds and for a generic kind (long strings of mixed letters and digits). Matches
become rows of (document, kind, ordinal, gap before, length), so that positions are running sums in the JVM. The hashed
candidate values of the whole corpus are then aggregated by distinct owners and by the distinct repositories of each owner: a
value under many owners is a copied example, a value under one owner looks live, whether it lies in one repository or is reused
in several of that owner's. Base spans always stay; a generic match becomes a span only when a single owner has it and no base
span overlaps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Kinds in order, and their patterns. ``assign`` must match with one or more characters before its length is tested, since a short match uses up its text; the others may demand their length at once.
KINDS = ("assign", "access", "hex", "owner")
PATTERNS = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"(AKIA[A-Z0-9]{16,})",
    r"((?<![0-9a-f])[0-9a-f]{24,})",
    r"((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,})",
)
MIN_VALUE = (6, 20, 24, 20)
GENERIC = KINDS.index("owner")
MIN_DISTINCT = 12
#: One finding while rows are gathered: sorted as it stands, by start and then by kind.
FOUND = "array<struct<start:bigint,kind:int,end:bigint,owners:bigint,repos:bigint>>"


def _hits(kind: int) -> Column:
    """Matches of one kind: gap before each and its length (code points), whether it counts, and its value's hash."""
    pattern = F.lit(PATTERNS[kind])
    whole, value, gaps = F.regexp_extract_all("text", pattern, F.lit(0)), F.regexp_extract_all("text", pattern, F.lit(1)), F.split("text", PATTERNS[kind], -1)

    def hit(match: Column, i: Column) -> Column:
        v = F.element_at(value, i + 1)
        counts = F.length(v) >= MIN_VALUE[kind]
        if kind == GENERIC:
            counts = counts & v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT)
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("at"),
            F.length(F.element_at(gaps, i + 1)).alias("gap"),
            F.length(match).alias("size"),
            F.when(counts, F.unhex(F.sha2(v, 256))).alias("value"),
        )

    empty = F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,value:binary>>")
    return F.when(F.col("text").rlike(PATTERNS[kind]), F.transform(whole, hit)).otherwise(empty)


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def _joined(spans: Column, base_only: bool) -> Column:
    kept = F.filter(spans, lambda s: s["kind"] != GENERIC) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", _name(s["kind"]), s["start"], s["end"])), ",")


def _frequency(spans: DataFrame) -> DataFrame:
    """Distinct owners of each value, and distinct repositories, told apart by their owners: ``value, owners, repos``."""
    places = spans.select("value", "owner", "repo").distinct()
    by_owner = places.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def _judged(scanned: DataFrame) -> DataFrame:
    """Spans of ``row, owner, repo, hits`` with their value's frequency: ``row, kind, start, end, owners, repos``."""
    hits = scanned.filter(F.size("hits") > 0).select("row", "owner", "repo", F.explode("hits").alias("h")).select("row", "owner", "repo", "h.*")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size")).filter("value is not null")
    base_end, base_start = F.when(F.col("kind") != GENERIC, F.col("end")), F.when(F.col("kind") != GENERIC, F.col("start"))
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base_start).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("clear", clear).filter((F.col("kind") != GENERIC) | F.col("clear"))
    return spans.join(_frequency(spans), "value").filter((F.col("kind") != GENERIC) | (F.col("owners") == 1))


def _verdict(finding: Column, example_owners: int) -> Column:
    owners = finding["owners"]
    several = F.when(owners >= example_owners, "example").otherwise("shared")
    return F.when(owners > 1, several).when(finding["repos"] > 1, "reused").otherwise("single")


def _place(column: str) -> Column:
    """An owner or a repository; null is one of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    example_owners: int = 3,
) -> DataFrame:
    """Returns ``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_owner, n_example, n_live, findings``, one row per input row.

    A value is an example under ``example_owners`` owners or more and live under one. ``findings`` holds the spans as structs,
    in the order of ``spans``: ``kind, start, end``, the distinct ``owners`` and ``repos`` of the value in the whole table, and
    the ``verdict`` of the two: ``example``; ``shared`` by fewer owners, but several; ``reused`` by one owner in several of its
    repositories; ``single``, in one repository. The last two are owner-specific, so spans and counts keep both alike. A
    repository is ``repo_col`` within its owner (default: the document, by ``id_col``).

    Null texts are empty; null owners count as one of their own, and so do null repositories of an owner. Repeated rows are
    scanned each on its own. Texts without secrets give counts 0, empty ``spans`` and ``findings`` and the hash of the empty
    string. Other columns are ignored. Empty input: no rows.
    """
    text = docs.select(F.col(id_col).alias("doc"), _place(owner_col).alias("owner"), _place(repo_col or id_col).alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = text.withColumn("hits", F.concat(*[_hits(k) for k in range(len(KINDS))]))
    scanned = materialize(scanned.drop("text").withColumn("row", F.monotonically_increasing_id()), "hits")

    judged = _judged(scanned)
    span = F.struct("start", "kind", "end", "owners", "repos")
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    by_doc = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(span)).alias("found"),
        *[count(F.col("kind") == k, f"n_{name}") for k, name in enumerate(KINDS)],
        count(F.col("owners") >= example_owners, "n_example"),
        count(F.col("owners") == 1, "n_live"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    found = F.coalesce("found", F.array().cast(FOUND))
    finding = lambda s: F.struct(_name(s["kind"]).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "owners", "repos")], _verdict(s, example_owners).alias("verdict"))
    return scanned.select("row", F.col("doc").alias(id_col)).join(by_doc, "row", "left").select(
        id_col,
        *[zero(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(found, True), 256).alias("base_sha256"),
        _joined(found, False).alias("spans"),
        *[zero(n) for n in ("n_owner", "n_example", "n_live")],
        F.transform(found, finding).alias("findings"),
    )


def redact_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    length_col: str | None = "n_chars",
    repo_col: str | None = None,
    example_owners: int = 3,
    mask: str = "[SECRET]",
) -> DataFrame:
    """Rows of ``docs``, all columns, with every span of a value under fewer than ``example_owners`` owners masked.

    Overlapping spans become one mask; ``length_col`` is set to the new length of masked texts. Texts without such spans, nulls
    too, pass unchanged. Values are judged as in ``scan_secrets``: one that an owner reuses in several repositories
    (``repo_col``) is masked in each.
    """
    columns = docs.columns
    any_hit = F.lit(False)
    for pattern in PATTERNS:
        any_hit = any_hit | F.coalesce(F.col(text_col).rlike(pattern), F.lit(False))
    clean = docs.filter(~any_hit)
    given = docs.filter(any_hit).select(F.struct(*columns).alias("given"), _place(owner_col).alias("owner"), _place(repo_col or id_col).alias("repo"), F.col(text_col).alias("text"))
    given = given.withColumn("hits", F.concat(*[_hits(k) for k in range(len(KINDS))])).withColumn("row", F.monotonically_increasing_id())
    given = materialize(given, "flagged")
    live = _judged(given.select("row", "owner", "repo", "hits")).filter(F.col("owners") < example_owners)
    ended = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = live.withColumn("from", ended).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "from"))).alias("cuts"), F.max("end").alias("last"))
    text = F.col("text")

    def piece(c: Column) -> Column:
        between = F.substring(text, (c["from"] + 1).cast("int"), F.greatest(F.lit(0), c["start"] - c["from"]).cast("int"))
        return F.when(c["start"] >= c["from"], F.concat(between, F.lit(mask))).otherwise("")

    rest = F.substring(text, (F.col("last") + 1).cast("int"), F.length(text))
    masked = F.when(F.col("cuts").isNotNull(), F.concat(F.array_join(F.transform("cuts", piece), ""), rest)).otherwise(text)
    flagged = given.join(parts, "row", "left").withColumn("masked", masked)
    new = {text_col: F.col("masked")}
    if length_col in columns:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.when(F.col("cuts").isNotNull(), F.length("masked").cast(kind)).otherwise(F.col("given")[length_col])
    return clean.union(flagged.select(*[new.get(c, F.col("given")[c]).alias(c) for c in columns]))
