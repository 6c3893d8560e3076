"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed trigrams of character classes (letters by case, digits, each ASCII sign) and binned structure (repeated
words and lines, word and line lengths), so that the vectors tell writing from junk in any language. A bounded sample of
labelled rows (``MAX_LABELLED`` a class, those of smallest hash) fits tf-idf weights and a truncated SVD; the sample's
vectors and the projection are broadcast, and every document takes exact cosine products with all of them, block by
block. The ``NEIGHBOURS`` nearest vote with their similarity, each class weighted back to its share of all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

MAX_LABELLED = 2000  # a class
GRAMS, BINS, RANK, NEIGHBOURS = 960, 64, 48, 15
DIMS = GRAMS + BINS
FOLDS = 5
PRIOR = 0.5

#: Byte classes: lower case and bytes of longer code points 1, upper case 2, digits 3, line end 4, other white space 5, each other ASCII sign its own.
_CLASS = np.full(256, 1, np.int64)
_CLASS[65:91], _CLASS[48:58] = 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 5, 4
_SIGNS = [b for b in chain(range(9), range(14, 32), range(33, 48), range(58, 65), range(91, 97), range(123, 128))]
_CLASS[_SIGNS] = 6 + np.arange(len(_SIGNS)) % 58
_CODES = np.arange(64**3, dtype=np.uint64)
_GRAM = ((_CODES * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % GRAMS


def _bins(text: str) -> list[int]:
    """Structure of a text as eight binned measures."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    # windows of about 100 words that cover the whole text
    edges = [n * i // max(1, round(n / 100)) for i in range(max(1, round(n / 100)) + 1)]
    fresh = [len(set(words[i:j])) / (j - i) for i, j in pairwise(edges)] if n else [0.0]
    letters = sum(len(w) for w in words)
    measures = (
        sum(fresh) / len(fresh),
        min(fresh),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, letters / max(1, n) / 12),
        min(1.0, n / max(1, len(lines)) / 60),
        min(1.0, np.log10(n + 1) / 5),
        sum(w.isupper() for w in words) / max(1, n),
        sum(not w.isalnum() for w in words) / max(1, n),
    )
    return [GRAMS + 8 * i + min(7, int(m * 8)) for i, m in enumerate(measures)]


def features(text: str) -> np.ndarray:
    """Damped term counts of a whole text."""
    codes = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    out = np.zeros(DIMS, np.float32)
    if len(codes) > 2:
        grams = np.bincount(_GRAM[(codes[:-2] << 12) | (codes[1:-1] << 6) | codes[2:]], minlength=GRAMS)
        out[:GRAMS] = np.log1p(grams)
        out[:GRAMS] /= max(1e-6, float(np.linalg.norm(out[:GRAMS])))
    out[_bins(text)] = 0.5
    return out


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc": pdf["doc"], "label": pdf["label"], "x": [features(t).tobytes() for t in pdf["text"]]})


def fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projection (idf times the leading right singular vectors) and unit vectors of the sample."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.3
    weighted = x * idf
    _, vectors = np.linalg.eigh(weighted.T.astype(np.float64) @ weighted)
    projection = (idf[:, None] * vectors[:, ::-1][:, :RANK]).astype(np.float32)
    return projection, unit(x @ projection)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def vote(x: np.ndarray, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest neighbours of each row, by similarity and class weight."""
    if not len(vectors):
        return np.full(len(x), PRIOR)
    cosine = unit(x @ projection) @ vectors.T
    k = min(NEIGHBOURS, len(vectors))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    power = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) * weights[near]
    total = power.sum(1)
    return np.clip(np.where(total > 0, (power * labels[near]).sum(1) / np.maximum(total, 1e-12), PRIOR), 0, 1)


def _score(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        projection, vectors, labels, weights = model.value
        for pdf in batches:
            x = np.stack([features(t) for t in pdf["text"]]) if len(pdf) else np.zeros((0, DIMS), np.float32)
            yield pd.DataFrame({"doc": pdf["doc"], "score": vote(x, projection, vectors, labels, weights)})

    return run


def fold(id_col: str):
    """The fold of a row: crc32 of its id as text, modulo ``FOLDS``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    """The broadcast model, learnt from labelled rows outside fold 0."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("string").alias("doc"), F.col(label_col).cast("int").alias("label")).filter("doc is not null and label in (0, 1)")
    known = known.filter(fold("doc") != 0).groupBy("doc").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.filter(F.col("label") == v).orderBy(F.xxhash64("doc"), "doc").limit(MAX_LABELLED) for v in (0, 1)]
    rows = [tuple(r) for r in chosen[0].union(chosen[1]).collect()]
    sample = spark.createDataFrame(rows, "doc string, label int")
    texts = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(sample), "doc").mapInPandas(_labelled, "doc string, label int, x binary").groupBy("doc", "label").agg(F.min("x").alias("x")).collect()
    found.sort(key=lambda r: r["doc"])
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32)
    y = np.array([r["label"] for r in found], np.float64)
    projection, vectors = fit(x) if found else (np.zeros((DIMS, RANK), np.float32), np.zeros((0, RANK), np.float32))
    share = np.array([totals.get(v, 0) / max(1, (y == v).sum()) for v in (0, 1)])
    weights = share[y.astype(int)] / max(share.max(), 1e-9) if found else np.zeros(0)
    return spark.sparkContext.broadcast((projection, vectors, y, weights))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3
) -> DataFrame:
    """Returns ``id_col, held_out, score, predicted``, one row per input row.

    Null texts are empty; empty texts are scored too. A null id is never held out. Repeated rows are scored each on its own;
    of a labelled id's texts the one of least features teaches, and labels that disagree count as the larger. With no labelled rows every score is ``PRIOR``. Other columns are ignored.
    Empty input: no rows.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    model = train(docs, labels, id_col, text_col, label_col)
    texts = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = texts.mapInPandas(_score(model), "doc string, score double")
    return scored.select(
        F.col("doc").cast(kind).alias(id_col),
        F.coalesce(fold("doc") == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, whose score reaches the threshold.

    Null texts are empty, and null ids and repeated rows are judged like others. Columns may have any names. Empty input: no rows.
    """
    short_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, "quality")
    schema = docs.schema

    def run(batches):
        projection, vectors, y, weights = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, DIMS), np.float32)
            yield batch.filter(_mask(vote(x, projection, vectors, y, weights) >= threshold))

    return docs.mapInArrow(run, schema)


def _mask(keep: np.ndarray):
    import pyarrow as pa

    return pa.array(keep)
