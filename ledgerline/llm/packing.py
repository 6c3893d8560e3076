"""Cost-balanced packing of documents into sequences of bounded length.

Every document is tokenised once. Whole runs of ``max_len`` ids fill sequences of their own; what remains of each
document is dealt evenly to shards of about ``SHARD_DOCS`` documents. In a shard, the remainders go in descending order of
length to the sequence of lowest cost (``linear * n + quadratic * n * n`` summed over its pieces) that still has room. The
number of a shard's sequences is the least that can hold its ids; a remainder that no sequence can hold whole is cut
over those of lowest cost, so a shard pads fewer than ``max_len`` ids in all.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PieceEncoder
from .common import short_batches

SHARD_DOCS = 2000
MAX_SHARD_BITS = 32


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut(path: str, max_len: int, end_id: int, shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(path)
        task, seen = TaskContext.get().partitionId() * 7919, 0
        for pdf in batches:
            rows = []
            for doc, ids in zip(pdf["doc"], encoder.encode(pdf["text"].tolist()), strict=True):
                ids = np.append(ids, np.asarray([end_id], ids.dtype))
                seen += 1
                for start in range(0, len(ids), max_len):
                    part = ids[start : start + max_len]
                    whole = len(part) == max_len
                    rows.append(((task + seen) % shards, doc, start, len(part), crc32(part), len(ids), b"" if whole else part.tobytes()))
            if rows:
                out = pd.DataFrame(rows, columns=["shard", "doc", "start", "length", "ids_crc32", "doc_tokens", "ids"])
                yield out.assign(width=encoder.dtype)

    return run


def assign(lengths: list[int], max_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start in it, length, sequence, offset) for documents of the given lengths, all below ``max_len``."""
    count = -(-sum(lengths) // max_len)
    filled, cost, pieces = [0] * count, [0.0] * count, []
    heap = [(0.0, s) for s in range(count)]

    def put(doc: int, start: int, n: int, s: int) -> None:
        pieces.append((doc, start, n, s, filled[s]))
        filled[s] += n
        cost[s] += linear * n + quadratic * n * n
        if filled[s] < max_len:
            heapq.heappush(heap, (cost[s], s))

    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        n, full = lengths[doc], []
        while heap and filled[heap[0][1]] + n > max_len:
            full.append(heapq.heappop(heap))
        if heap:
            put(doc, 0, n, heapq.heappop(heap)[1])
            for x in full:
                heapq.heappush(heap, x)
            continue
        start = 0
        for i, (_, s) in enumerate(full):
            take = min(n - start, max_len - filled[s])
            put(doc, start, take, s)
            start += take
            if start == n:
                for x in full[i + 1 :]:
                    heapq.heappush(heap, x)
                break
    return pieces


def _pack(max_len: int, linear: float, quadratic: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["shard"].iloc[0]) << MAX_SHARD_BITS
        full = pdf[pdf["length"] == max_len]
        rest = pdf[pdf["length"] < max_len].sort_values(["length", "ids_crc32", "start", "doc"], ascending=False, kind="stable").reset_index(drop=True)
        docs, starts, crcs, totals, widths = (rest[c].tolist() for c in ("doc", "start", "ids_crc32", "doc_tokens", "width"))
        ids = [np.frombuffer(b, w) for b, w in zip(rest["ids"], widths, strict=True)]
        placed = assign(rest["length"].tolist(), max_len, linear, quadratic)
        rows = [
            (docs[d], starts[d] + at, n, crcs[d] if n == len(ids[d]) else crc32(ids[d][at : at + n]), totals[d], base + s, offset)
            for d, at, n, s, offset in placed
        ]
        first = base + (max((p[3] for p in placed), default=-1) + 1)
        rows += [(r.doc, r.start, r.length, r.ids_crc32, r.doc_tokens, first + i, 0) for i, r in enumerate(full.itertuples())]
        return pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
) -> DataFrame:
    """Returns the pieces: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are documents of ``end_id`` alone. Repeated ids and rows are packed each on its own. Remainders of equal
    length are placed by their ids' crc32, start and document. Columns that
    are not named are ignored. Empty input: no rows. Memory is bounded by one Arrow batch and one shard.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = max(1, round(texts.count() / SHARD_DOCS))
    cut = texts.mapInPandas(
        _cut(tokenizer_path, max_len, end_id, shards),
        "shard long, doc string, start long, length long, ids_crc32 long, doc_tokens long, ids binary, width string",
    )
    packed = cut.groupBy("shard").applyInPandas(
        _pack(max_len, linear, quadratic), "doc string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return packed.withColumn("doc", F.col("doc").cast(kind)).withColumnRenamed("doc", id_col)
