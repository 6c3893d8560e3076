"""Quality rules with cross-document line frequency.

One pass over the texts takes the per-document measures and the hashes of normalised lines. Lines are then counted by
distinct documents of a host, those above the limit are removed, and documents that lose too much
are rejected. Counts are pre-aggregated before they are shuffled and keyed by host and line, so no host lands in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, short_batches

WORDS, SYMBOLS, NUMBER = re.compile(WORD), re.compile(r"[#*$%&|<>]"), re.compile(r"[0-9]+")
WINDOW = 5


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of five words found twice or more, first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    code = word[:n].copy()
    for k in range(1, WINDOW):  # re-numbered after each word, so codes stay exact
        _, code = np.unique(code * len(ids) + word[k : n + k], return_inverse=True)
    again = np.bincount(code)[code] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:n] += again
    covered[WINDOW : n + WINDOW] -= again
    return int((np.cumsum(covered)[:-1] > 0).sum())


def line_key(line_words: list[str]) -> int:
    """Signed 64-bit hash of a line in lower case, with single spaces; whole numbers are 0 unless they are half of its words or more, as in tables."""
    numbers = [NUMBER.fullmatch(w) is not None for w in line_words]
    if 2 * sum(numbers) < len(line_words):
        line_words = ["0" if n else w for w, n in zip(line_words, numbers, strict=True)]
    return xxhash.xxh3_64_intdigest(" ".join(line_words).lower().encode("utf-8", "surrogatepass")) - (1 << 63)


def _measure(batches: Iterator[pd.DataFrame], texts: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, host, text in zip(pdf["doc"], pdf["host"], pdf["text"], strict=True):
            words, seen, dups, keys = [], set(), 0, {}
            for line in text.split("\n"):
                found = WORDS.findall(line)
                if not found:
                    continue
                words += found
                if line in seen:
                    dups += 1
                seen.add(line)
                key = line_key(found)
                keys[key] = keys.get(key, 0) + len(found)
            rows.append((doc, host, text if texts else None, len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dups, repeated_words(words), [{"line": k, "words": n} for k, n in keys.items()]))
        yield pd.DataFrame(rows, columns=["doc", "host", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, gone in zip(pdf["text"], pdf["gone"], strict=True):
            keys = set() if gone is None else set(gone)
            lines = text.split("\n") if keys else [text]
            out.append("\n".join(x for x in lines if not keys or not (w := WORDS.findall(x)) or line_key(w) not in keys))
        yield pdf.drop(columns=["text", "gone"]).assign(text=out)


def line_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    min_words: int = 10,
    min_share: float = 0.5,
    texts: bool = False,
) -> DataFrame:
    """Returns ``id_col``, the measures, ``base_failed``, ``n_removed_words`` and ``kept``, one row per input row.

    A line goes from a host's documents when more than ``max_docs`` distinct documents (ids) of that host hold it; exact copies
    are documents of their own. A document is
    depleted, and not kept, when fewer than ``min_words`` words or less than ``min_share`` of its words remain. Null texts have
    no words and fail. Null hosts are one host. Equal ids and repeated rows are judged each on its own. Other columns are
    ignored. Empty input: no rows. With ``texts`` a column ``text`` follows: the whole text without the lines that go.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(
        F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(host_col).cast("string"), F.lit("\x00")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    measured = given.mapInPandas(
        lambda batches: _measure(batches, texts),
        "doc string, host string, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:bigint,words:bigint>>",
    )
    measured = measured if texts else measured.drop("text")
    measured = materialize(measured.withColumn("host", F.xxhash64("host")).withColumn("row", F.monotonically_increasing_id()), "lines")
    lines = measured.select("row", "host", F.xxhash64("doc").alias("id"), F.explode("lines").alias("l")).select("row", "host", "id", "l.line", "l.words")
    common = lines.groupBy("host", "line").agg(F.count_distinct("id").alias("docs")).filter(F.col("docs") > max_docs).select("host", "line")
    removed = lines.select("row", "host", "line", "words").join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"), *([F.collect_set("line").alias("gone")] if texts else []))
    gone = F.coalesce("n_removed_words", F.lit(0))
    left = F.col("n_words") - gone
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measured.join(removed, "row", "left").select(
        F.col("doc").cast(kind).alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        gone.alias("n_removed_words"),
        (~base_failed & (left >= min_words) & (left >= min_share * F.col("n_words"))).alias("kept"),
        *(["text", "gone"] if texts else []),
    )
    if not texts:
        return out
    return out.mapInPandas(_without, out.drop("gone", "text").withColumn("text", F.lit("")).schema)
