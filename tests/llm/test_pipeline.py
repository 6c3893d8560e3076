"""The pipeline's stages on the smallest table against brute force; registered queries run and match their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ledgerline.llm import quality_vote, secrets, token_counts
from ledgerline.llm.common import materialize
from ledgerline.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"  # the smallest table with secrets in it


def test_stages(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs
        docs = materialize(stage(spark, docs, MORE), name)
        if name != "packing":
            assert docs.columns == columns
    scores = {r["doc_id"]: r["predicted"] for r in quality_vote.quality_scores(kept["quality"], labels).collect()}
    after_quality = {r["doc_id"] for r in kept["near_duplicates"].select("doc_id").collect()}
    assert after_quality == {d for d, p in scores.items() if p}

    from .test_small_operators import brute_links

    rows = [(r["doc_id"], r["text"], r["source"]) for r in kept["near_duplicates"].collect()]
    one = {r["doc_id"] for r in kept["secrets"].select("doc_id").collect()}
    assert one == {d for d, _, c in brute_links(rows) if d == c}
    before, after = kept["secrets"], kept["mixing"]
    assert {r["doc_id"] for r in after.collect()} == one
    assert secrets.scan_secrets(after).agg({"n_live": "sum"}).first()[0] == 0 and secrets.scan_secrets(before).agg({"n_live": "sum"}).first()[0] > 0
    mixed = kept["packing"]
    words = lambda df: df.selectExpr(r"sum(regexp_count(text, '[^\\x20\\x09-\\x0D]+'))").first()[0]
    assert abs(words(mixed) - words(after)) < 10000
    tokens = token_counts.token_counts(mixed, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    assert docs.agg({"length": "sum"}).first()[0] == tokens.agg({"n_tokens": "sum"}).first()[0] + mixed.count()


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and len(corpus_pipeline.STAGES) == 5


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    want = db.execute(ORACLES[name]).df()[columns].astype(object)
    want = want.where(want.notna(), None)
    assert sorted(map(repr, (tuple(rounded(r[c]) for c in columns) for r in got.collect()))) == sorted(map(repr, (tuple(int(v) if isinstance(v, float) and v.is_integer() and c != "target" else rounded(v) for c, v in zip(columns, r, strict=True)) for r in want.itertuples(index=False))))


CLASH = ("row", "key", "copies", "gone", "label", "score", "doc", "text_", "size", "source_size", "target", "taken", "range", "slot", "side", "family", "hits", "piece", "ids", "shard", "host", "line", "component_id", "n_shingles", "spans", "predicted")


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names the stages use inside."""
    from pyspark.sql import functions as F

    words = " ".join(f"Word{i % 977} and the others, so it is." for i in range(20_000))
    prose = "It was the best of the times and it was the worst of them, so they went to the house on the hill. " * 6
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, prose, "en", None, 10), (3, prose, "en", None, 10), (4, prose + "password: hunter22hunter", None, "b", 1), (5, words, "en", "b", 2), (6, prose.replace("house", "barn"), "en", "c", 3), (7, "x", "de", "c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df, df.select("*", *[F.lit(1).alias(c) for c in CLASH])


@pytest.mark.parametrize("at", range(5))
def test_every_stage_takes_odd_rows_and_empty_tables(spark, at):
    name, stage = corpus_pipeline.STAGES[at]
    plain, more = odd_documents(spark)
    got = stage(spark, more, SF)
    assert stage(spark, more.limit(0), SF).count() == 0
    if name == "packing":
        assert got.agg({"length": "sum"}).first()[0] == stage(spark, plain, SF).agg({"length": "sum"}).first()[0]
        assert {r["doc_id"] for r in got.select("doc_id").collect()} == {None, 1, 2, 3, 4, 5, 6, 7}
        return
    assert got.columns == more.columns
    back = sorted(map(repr, got.select(*plain.columns).collect()))
    assert back == sorted(map(repr, stage(spark, plain, SF).collect()))
    if name == "secrets":
        assert got.count() == 9 and not got.filter("text like '%hunter22%'").count()
    if name == "near_duplicates":
        assert got.filter("doc_id = 3").count() == 1 and got.filter("doc_id in (1, 2, 5, 7)").count() == 4


def test_mixing_and_packing_row_by_row(spark):
    """Every document of the mix is taken whole as often as its row says, and packing places each of its tokens once."""
    from collections import Counter

    from ledgerline.llm import mixing, packing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: (r["taken"] // r["size"] if r["size"] else 0) for r in mixing.mix_sources(docs).collect()}
    mixed = materialize(mixing.apply_mix(docs), "mixed")
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == Counter({d: n for d, n in taken.items() if n})
    path = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")
    tokens = {r["doc_id"]: r["n_tokens"] + 1 for r in token_counts.token_counts(docs, path).collect()}
    placed: dict = {}
    for r in packing.pack_sequences(mixed, path).collect():
        placed.setdefault(r["doc_id"], Counter())[r["start"]] += r["length"]
    assert {d: sum(c.values()) for d, c in placed.items()} == {d: n * tokens[d] for d, n in taken.items() if n}
