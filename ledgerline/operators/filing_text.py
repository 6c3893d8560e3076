"""Whole filings before segmentation: archive markup, wrapped headings, exhibit tails, quarterly parts, embedded headings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Container tags of the filing archive, and its one-line tags.
HEADER_BLOCK = r"(?is)<(?:SEC-HEADER|IMS-HEADER)>.*?</(?:SEC-HEADER|IMS-HEADER)>"
ARCHIVE_TAG = r"(?im)^[ \t]*</?(?:SEC-DOCUMENT|IMS-DOCUMENT|DOCUMENT|TEXT|TYPE|SEQUENCE|FILENAME|DESCRIPTION|PAGE)>[^\n]*$\n?"
WRAPPED = r"(?im)^([ \t]*(?:ITEM|PART))[ \t]*\n\s*(\d{1,2}[A-C]?\b|[IVX]{1,4}\b)"
#: Where exhibits begin. Weak lines count only in clusters.
STRONG_TAIL = re.compile(r"\b(?:exhibit index|index to exhibits)\b|</?ex-[a-z0-9][a-z0-9.-]*>", re.I)
WEAK_TAIL = re.compile(r"\s*exhibit\s+[a-z0-9]", re.I)
TAIL_FROM, TAIL_WINDOW = 0.6, 4000
CONTRACTS = ("whole", "without_exhibits")

#: Words that tell the part of a quarterly item whose number both parts have.
QUARTERLY_WORDS = {
    "1": {"I": ("financial statements", "financial information"), "II": ("legal proceedings",)},
    "2": {"I": ("management", "results of operations"), "II": ("unregistered sales", "use of proceeds", "equity securities")},
    "3": {"I": ("market risk", "quantitative"), "II": ("defaults",)},
    "4": {"I": ("controls",), "II": ("submission of matters", "mine safety", "reserved")},
}
ONLY_SECOND = ("1A", "5", "6")


def strip_archive(text: Column) -> Column:
    """Without the archive's header block and tags."""
    return F.regexp_replace(F.regexp_replace(text, HEADER_BLOCK, ""), ARCHIVE_TAG, "")


def join_wrapped_headings(text: Column) -> Column:
    """``ITEM`` or ``PART`` alone on a line joins the number on the next one."""
    return F.regexp_replace(text, WRAPPED, "$1 $2")


def exhibit_tail(text: str) -> int | None:
    """Where the exhibits begin: the first strong line in the last part of the text, or the first weak one of a cluster there."""
    least, at = int(len(text) * TAIL_FROM), 0
    strong, weak = [], []
    for line in text.splitlines(keepends=True):
        if STRONG_TAIL.search(line):
            strong.append(at)
        elif WEAK_TAIL.match(line):
            weak.append(at)
        at += len(line)
    found = [s for s in strong if s >= least]
    for i, w in enumerate(weak):
        company = i + 1 < len(weak) and weak[i + 1] <= w + TAIL_WINDOW or any(w <= s <= w + TAIL_WINDOW for s in strong)
        if w >= least and company:
            found.append(w)
            break
    return min(found, default=None)


def clean_documents(docs: DataFrame, text_col: str = "text", contract: str = "without_exhibits") -> DataFrame:
    """Adds ``cleaned`` and ``tail_start`` (null without exhibits); ``whole`` leaves texts as they are. Null texts stay null."""
    if contract not in CONTRACTS:
        raise ValueError(f"contract must be one of {CONTRACTS}, not {contract}")
    if contract == "whole":
        return docs.withColumn("cleaned", F.col(text_col)).withColumn("tail_start", F.lit(None).cast("long"))

    @F.pandas_udf("long")
    def tail(texts: pd.Series) -> pd.Series:
        return pd.Series([exhibit_tail(t) if t else None for t in texts], dtype="Int64")

    bare = docs.withColumn("__bare", strip_archive(F.col(text_col))).withColumn("tail_start", tail("__bare"))
    kept = F.when(F.col("tail_start").isNull(), F.col("__bare")).otherwise(F.rtrim(F.regexp_replace(F.expr("substring(__bare, 1, cast(tail_start as int))"), r"\s+$", "")))
    return bare.withColumn("cleaned", kept).drop("__bare")


def quarterly_part(item_id: Column, title: Column, marked: Column | None = None) -> Column:
    """Part of a quarterly item: the part marker above it, else its number or title; null where nothing tells."""
    low = F.lower(F.regexp_replace(title, r"\s+", " "))
    told = F.when(item_id.isin(*ONLY_SECOND), "II")
    for number, words in QUARTERLY_WORDS.items():
        for part, names in words.items():
            hit = F.lit(False)
            for n in names:
                hit = hit | F.contains(low, F.lit(n))
            told = told.when((item_id == number) & hit, part)
    return F.coalesce(marked, told) if marked is not None else told


def embedded_heading(body: Column, item_number: Column) -> Column:
    """Position (from 1) of a later item's heading at a line start inside an item's text, else 0: the item was cut too late."""
    later = F.filter(
        F.regexp_extract_all(body, F.lit(r"(?im)^[ \t]*ITEM[ \t]+(\d{1,2})[A-C]?[ \t]*[.:]"), F.lit(1)),
        lambda n: n.cast("int") > item_number,
    )
    first = F.get(later, F.lit(0))
    return F.when(first.isNull(), 0).otherwise(F.regexp_instr(body, F.concat(F.lit(r"(?im)^[ \t]*ITEM[ \t]+"), first, F.lit(r"[A-C]?[ \t]*[.:]")))).cast("long")


def omits_by_instruction(text: Column) -> Column:
    """Whether a filing says that it leaves items out under a general instruction for reduced or asset-backed disclosure."""
    return F.coalesce(text.rlike(r"(?is)general\s+instruction[s]?\s+(?:J|I\s*\(\s*[12]\s*\)|H\s*\(\s*[12]\s*\)).{0,200}?(?:omit|reduced disclosure|not required)"), F.lit(False))
