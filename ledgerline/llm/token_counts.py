"""Token counts without ids: each distinct pre-token is encoded once, and documents sum the counts of their pre-tokens.

A first pass gathers the distinct pre-tokens (pre-aggregated in every task), which the tokenizer then measures. The
second pass turns each document into pre-token frequencies. Frequencies of the most common short pre-tokens (at most
``HEAD`` of at most ``HEAD_CHARS`` characters: a proven bound) are joined in place with a broadcast table; only those of
rare pre-tokens are shuffled to a join with the whole table, so no hot key is dealt to one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PieceEncoder
from .common import materialize, short_batches

HEAD = 1 << 16
HEAD_CHARS = 32
FLUSH = 300_000


def _distinct(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seen = PieceEncoder(path), Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"piece": list(seen.keys()), "n": list(seen.values())})

        for pdf in batches:
            for text in pdf["text"]:
                seen.update(encoder.pieces(text))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return run


def _measure(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(path)
        for pdf in batches:
            yield pdf.assign(tokens=[len(x) for x in encoder.encode_pieces(pdf["piece"].tolist())])

    return run


def _frequencies(path: str, head):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, known = PieceEncoder(path), head.value
        for pdf in batches:
            n_bytes, n_head, tails = [], [], []
            for text in pdf["text"]:
                total, tail = 0, []
                for piece, n in Counter(encoder.pieces(text)).items():
                    size = known.get(piece)
                    if size is None:
                        tail.append({"piece": piece, "n": n})
                    else:
                        total += n * size
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_head.append(total)
                tails.append(tail)
            yield pd.DataFrame({"doc": pdf["doc"], "n_bytes": n_bytes, "n_head": n_head, "tail": tails})

    return run


def piece_table(texts: DataFrame, path: str) -> DataFrame:
    """Distinct pre-tokens of ``text`` with occurrences ``n`` and token counts ``tokens``, written once."""
    pieces = texts.select("text").mapInPandas(_distinct(path), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return materialize(pieces.mapInPandas(_measure(path), "piece string, n long, tokens long"), "pieces")


def most_common(pieces: DataFrame) -> DataFrame:
    """At most ``HEAD`` short pre-tokens, by frequency; a histogram finds the least frequency, so no task returns more than its share."""
    short = pieces.filter(F.length("piece") <= HEAD_CHARS).withColumn("level", F.floor(F.log2("n") * 16))
    left, level = HEAD, 1 << 20
    for r in sorted(short.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        level = r["level"]
    return short.filter(F.col("level") >= level).select("piece", "tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Returns ``id_col, n_bytes, n_tokens, over_limit``, one row per input row.

    Null and empty texts: 0 bytes, 0 tokens. Repeated ids and rows: each row is counted on its own. A special token's
    string inside a text counts as that one token. Other columns of ``docs`` are ignored, whatever their names. Empty
    input: no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = piece_table(texts, tokenizer_path)
    head = spark.sparkContext.broadcast({r["piece"]: r["tokens"] for r in most_common(pieces).collect()})
    by_doc = texts.mapInPandas(_frequencies(tokenizer_path, head), "doc string, n_bytes long, n_head long, tail array<struct<piece:string,n:long>>")
    by_doc = materialize(by_doc.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rare = by_doc.select("row", F.explode("tail").alias("t")).select("row", "t.piece", "t.n")
    rest = rare.join(pieces.select("piece", "tokens"), "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("n_rest"))
    n_tokens = F.col("n_head") + F.coalesce("n_rest", F.lit(0))
    return by_doc.join(rest, "row", "left").select(F.col("doc").cast(kind).alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
