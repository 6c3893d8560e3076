"""Dictionary signals: token counts, document frequency, tf-idf weights and proportions by category.

Everything is a long table (document, token, count): one shuffle by document and token, one by token, and small joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def lexicon_frame(spark, words: dict[str, Sequence[str]]) -> DataFrame:
    """(token, category) rows; an entry of several tokens gives each of them."""
    raw = spark.createDataFrame([(c, w) for c, ws in words.items() for w in ws], "category string, entry string")
    return raw.select("category", F.explode(T.tokens(F.col("entry"))).alias("token")).distinct()


def replication_family(master: DataFrame, year: int = 2009) -> DataFrame:
    """(token, category) of a master list: entries of exactly that year; strong and weak modals by their code."""
    long = master.unpivot(["Word"], ["Negative", "Positive", "Uncertainty", "Litigious"], "category", "since").filter(F.col("since") == year)
    modal = master.filter(F.col("Modal").isin(1, 3)).select("Word", F.when(F.col("Modal") == 1, "modal_strong").otherwise("modal_weak").alias("category"))
    return long.select("Word", F.lower("category").alias("category")).unionByName(modal).select(F.lower("Word").alias("token"), "category").distinct()


def extended_family(master: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(token, category) where the entry is non-zero and not struck out (negative)."""
    long = master.unpivot(["Word"], list(categories), "category", "since").filter(F.col("since") > 0)
    return long.select(F.lower("Word").alias("token"), F.lower("category").alias("category")).distinct()


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, token, tf``."""
    return docs.select(id_col, F.explode(T.tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count("*").alias("df"))


def signals(docs: DataFrame, lexicon: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", recognised: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per document: ``total_tokens``, ``recognised_tokens``, and ``<category>_prop`` and ``<category>_tfidf`` of every category.

    The universe, for the number of documents and their frequencies, is ``docs`` (per ``by``); empty documents count in it, and
    their signals are null. A lexicon is small and fixed, so Spark broadcasts it within its size limit.
    """
    keys = list(by)
    # texts are split once: tokens outside the lexicon fold into one row a document before anything is shuffled
    tokens = docs.select(*keys, id_col, F.explode_outer(T.tokens(F.col(text_col))).alias("token"))
    tokens = tokens.join(lexicon.select("token", F.lit(True).alias("__used")).distinct(), "token", "left")
    if recognised is not None:
        tokens = tokens.join(recognised.select("token", F.lit(1).alias("__known")).distinct(), "token", "left")
    else:
        tokens = tokens.withColumn("__known", F.when(F.col("token").isNotNull(), 1))
    folded = tokens.groupBy(*keys, id_col, F.when(F.col("__used"), F.col("token")).alias("token")).agg(F.count(F.when(F.col("token").isNotNull(), 1)).alias("tf"), F.sum("__known").alias("__known"))
    base = folded.groupBy(*keys, id_col).agg(F.sum("tf").alias("total_tokens"), F.coalesce(F.sum("__known"), F.lit(0)).alias("recognised_tokens"))
    universe = base.groupBy(*keys).agg(F.count("*").alias("__n"))
    used = folded.filter("token is not null").drop("__known")
    df = used.groupBy(*keys, "token").agg(F.count("*").alias("df"))
    joined = used.join(df, [*keys, "token"]).join(base, [*keys, id_col])
    joined = joined.join(F.broadcast(universe), keys) if keys else joined.crossJoin(F.broadcast(universe))
    weight = (1 + F.ln("tf")) / (1 + F.ln("total_tokens")) * F.ln(F.col("__n") / F.col("df"))
    sums = joined.withColumn("w", weight).join(lexicon, "token").groupBy(*keys, id_col).agg(
        *[F.sum(F.when(F.col("category") == c, F.col("tf"))).alias(f"{c}_tf") for c in categories],
        *[F.sum(F.when(F.col("category") == c, F.col("w"))).alias(f"{c}_w") for c in categories],
    )
    out = base.join(sums, [*keys, id_col], "left")
    some = F.col("total_tokens") > 0
    return out.select(
        *keys, id_col, "total_tokens", "recognised_tokens",
        *[F.when(some, F.coalesce(f"{c}_tf", F.lit(0)) / F.col("total_tokens")).alias(f"{c}_prop") for c in categories],
        *[F.when(some, F.coalesce(f"{c}_w", F.lit(0.0))).alias(f"{c}_tfidf") for c in categories],
    )


def combined_scope(items: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """A scope of both items' texts joined by a blank line, for documents that have both; metadata must agree."""
    both = items.filter(F.col("item_id").isin(first, second)).groupBy("doc_id").agg(
        F.max(F.when(F.col("item_id") == first, F.col("full_text"))).alias("a"),
        F.max(F.when(F.col("item_id") == second, F.col("full_text"))).alias("b"),
        F.count_distinct("cik_10", "filing_date").alias("n"),
        F.first("cik_10").alias("cik_10"),
        F.first("filing_date").alias("filing_date"),
    )
    agreed = F.when(F.col("n") > 1, F.raise_error(F.lit("items of one document disagree in their metadata"))).otherwise(F.concat_ws("\n\n", "a", "b"))
    return both.filter("a is not null and b is not null").select("doc_id", "cik_10", "filing_date", F.lit(name).alias("item_id"), agreed.alias("full_text"))
