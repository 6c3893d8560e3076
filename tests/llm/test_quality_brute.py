"""The quality classifier on a whole table against a plain version: every document's neighbours by sorting all similarities."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerline.llm import quality_vote as Q

SF = "/root/testdata/sf0.01"


def test_scores_by_sorting_all_neighbours(spark):
    docs = {str(r["doc_id"]): r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    labels = defaultdict(int)
    for r in pq.read_table(f"{SF}/labels.parquet").to_pylist():
        if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            labels[str(r["doc_id"])] = max(labels[str(r["doc_id"])], r["quality"])
    known = sorted(d for d in labels if d in docs)
    assert max(sum(labels[d] == v for d in labels) for v in (0, 1)) <= Q.MAX_LABELLED  # so the bounded sample is all of them
    x = np.stack([Q.features(docs[d]) for d in known])
    y = np.array([labels[d] for d in known])
    projection, vectors = Q.fit(x)
    share = np.array([sum(v == c for v in labels.values()) / max(1, (y == c).sum()) for c in (0, 1)])
    weight = share[y] / share.max()
    scored = {str(r["doc_id"]): r["score"] for r in Q.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert scored.keys() == docs.keys()
    clear = 0
    for d, text in docs.items():
        v = Q.features(text) @ projection
        v = v / max(np.linalg.norm(v), 1e-9)
        cosine = vectors @ v
        order = np.argsort(-cosine, kind="stable")
        if cosine[order[Q.NEIGHBOURS - 1]] - cosine[order[Q.NEIGHBOURS]] < 1e-5:
            continue  # equally near ones at the edge: any choice is right
        power = sum(max(cosine[i], 0) * weight[i] for i in order[: Q.NEIGHBOURS])
        want = sum(max(cosine[i], 0) * weight[i] * y[i] for i in order[: Q.NEIGHBOURS]) / power if power > 0 else Q.PRIOR
        assert scored[d] == pytest.approx(want, abs=1e-4)
        clear += 1
    assert clear > 0.8 * len(docs)


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    got = Q.quality_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")).filter("held_out").collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels]
    assert len(held) > 200 and np.mean([p == q for p, q in held]) > 0.97


def test_the_whole_text_counts():
    good = "It was the best of the times, and so they went on to the house by the river. " * 10
    words = good.split()
    for n in range(101, len(words)):
        assert not np.array_equal(Q.features(" ".join(words[:n])), Q.features(" ".join(words[: n - 1] + ["zz!"])))
    assert Q._bins("a " * 130 + " ".join(f"w{i}" for i in range(40))) != Q._bins("a " * 170)
