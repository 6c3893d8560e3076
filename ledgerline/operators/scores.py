"""Sentence scores: splitting, scoring by a pluggable model, item features, tail surfaces, coverage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Abbreviations that do not end a sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr st no inc corp co ltd vs etc jr sr fig sec approx dept est e.g i.e u.s".split())
CHUNK = 250_000


def split_sentences(text: str) -> list[str]:
    """Sentences by a rule splitter: an end mark, white space, then a capital, digit or quote; abbreviations and initials go on."""
    out, start = [], 0
    for m in re.finditer(r"[.!?][\"')\]]*\s+(?=[\"'(\[]*[A-Z0-9])|\n\s*\n", text):
        head = text[start : m.start() + 1]
        last = re.search(r"([A-Za-z.]+)\.$", head)
        if last and m[0].strip() and (last[1].lower() in ABBREVIATIONS or len(last[1]) == 1):
            continue
        piece = text[start : m.end()].strip()
        if piece:
            out.append(piece)
        start = m.end()
    if text[start:].strip():
        out.append(text[start:].strip())
    return out


def stitch(sentences: Sequence[str]) -> list[str]:
    """Post-processing: citation stubs join the sentence before them, lines without letters go."""
    out: list[str] = []
    for s in sentences:
        if not re.search(r"[A-Za-zÀ-ɏ]", s):
            continue
        if out and (re.fullmatch(r"[(\[]?(?:see|cf|id|note|item|section|part)\b.{0,25}", s, re.I) or re.fullmatch(r"\(?[a-z0-9]{1,3}\)?\.?", s)):
            out[-1] = f"{out[-1]} {s}"
        else:
            out.append(s)
    return out


def chunks(text: str, limit: int = CHUNK) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the best boundary: blank line, line, sentence end, space, anywhere."""
    out = []
    while len(text) > limit:
        window = text[:limit]
        cut = next((at + len(mark) for mark in ("\n\n", "\n", ". ", " ") if (at := window.rfind(mark)) > limit // 2), limit)
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def sentence_frame(docs: DataFrame, id_col: str, text_col: str, splitter: Callable[[str], list[str]] = split_sentences) -> DataFrame:
    """``id, sentence_index, sentence, n_chars``: one row a sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, s, len(s)) for d, t in zip(pdf["doc"], pdf["text"], strict=True) for i, s in enumerate(stitch([x for c in chunks(t) for x in splitter(c)]))]
            yield pd.DataFrame(rows, columns=["doc", "sentence_index", "sentence", "n_chars"])

    kind = docs.schema[id_col].dataType
    given = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    out = given.mapInPandas(run, "doc string, sentence_index int, sentence string, n_chars long")
    return out.withColumn("doc", F.col("doc").cast(kind)).withColumnRenamed("doc", id_col)


def score_sentences(sentences: DataFrame, scorer: Callable[[Sequence[str]], Sequence[tuple[float, float, float]]], text_col: str = "sentence") -> DataFrame:
    """Adds negative, neutral and positive probabilities of a scorer (called once a batch) and the winning label, in that order of preference."""
    schema = "negative_prob double, neutral_prob double, positive_prob double"

    @F.pandas_udf(schema)
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(scorer(texts.fillna("").tolist())), columns=["negative_prob", "neutral_prob", "positive_prob"])

    out = sentences.withColumn("__s", apply(F.col(text_col))).select("*", "__s.*").drop("__s")
    top = F.greatest("negative_prob", "neutral_prob", "positive_prob")
    return out.withColumn("predicted_label", F.when(F.col("negative_prob") == top, "negative").when(F.col("neutral_prob") == top, "neutral").otherwise("positive"))


def item_features(scores: DataFrame, by: Sequence[str], metrics: Sequence[str], weight: str) -> DataFrame:
    """Length-weighted means per item; null where no weight is positive."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0))
    means = [(F.sum(F.when(F.col(m).isNotNull(), F.col(m) * w)) / F.nullif(F.sum(F.when(F.col(m).isNotNull(), w)), F.lit(0))).alias(f"{m}_w_mean") for m in metrics]
    return scores.groupBy(*by).agg(F.count("*").alias("sentence_count"), F.sum(w).alias("token_count"), *means)


def pivot_items(features: DataFrame, key: str, item: str, items: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide columns ``<item>_<metric>`` for a fixed list of items."""
    return features.groupBy(key).agg(*[F.max(F.when(F.col(item) == i, F.col(m))).alias(f"{i}_{m}") for i in items for m in metrics])


def tail_surface(scores: DataFrame, by: Sequence[str], prob: str, weight: str, order: Sequence[str], thresholds: Sequence[float] = (0.6, 0.7, 0.8), tops: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """Thresholded exposures, share of 0.7 and over, weighted means of the top fractions, weighted dispersion; null keys group together."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("double")
    cell = Window.partitionBy(*by)
    ranked = scores.withColumn("__w", w).withColumn("__p", F.col(prob))
    ranked = ranked.withColumn("__n", F.count("*").over(cell)).withColumn("__r", F.row_number().over(cell.orderBy(F.col("__p").desc_nulls_last(), *order)))
    ranked = ranked.withColumn("__mean", F.sum(F.col("__w") * F.col("__p")).over(cell) / F.nullif(F.sum("__w").over(cell), F.lit(0.0)))
    total = F.nullif(F.sum("__w"), F.lit(0.0))
    wp = F.col("__w") * F.col("__p")
    name = lambda x: str(round(x * 100))
    aggs = [(F.coalesce(F.sum(F.when(F.col("__p") >= t, wp)), F.lit(0.0)) / total).alias(f"exposure_{name(t)}") for t in thresholds]
    aggs.append((F.coalesce(F.sum(F.when(F.col("__p") >= 0.7, F.col("__w"))), F.lit(0.0)) / total).alias("share_70"))
    for f in tops:
        inside = F.col("__r") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * f))
        aggs.append((F.sum(F.when(inside, wp)) / F.nullif(F.sum(F.when(inside, F.col("__w"))), F.lit(0.0))).alias(f"top_{name(f)}_mean"))
    aggs.append(F.sqrt(F.sum(F.col("__w") * (F.col("__p") - F.col("__mean")) * (F.col("__p") - F.col("__mean"))) / total).alias("dispersion"))
    return ranked.groupBy(*by).agg(*aggs)


def coverage_report(universe: DataFrame, scores: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Documents with and without scores per group."""
    have = scores.select(key).distinct().withColumn("__have", F.lit(1))
    return universe.join(have, key, "left").groupBy(*by).agg(F.count("*").alias("docs"), F.count("__have").alias("scored"), (F.count("__have") / F.count("*")).alias("coverage"))
