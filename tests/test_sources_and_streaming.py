import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import items
from ledgerline.sources import readers
from ledgerline.streaming import files


def test_readers(spark, tmp_path):
    readers.write_zstd(spark.range(3), f"file://{tmp_path}/a/x.parquet")
    readers.write_zstd(spark.range(5), f"file://{tmp_path}/b/x.parquet")
    readers.write_zstd(spark.range(7), f"file://{tmp_path}/b/y.parquet")
    t = readers.load_tables(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/a", f"file://{tmp_path}/b"], ["x", "y", "z"])
    assert {k: v.count() for k, v in t.items()} == {"x": 3, "y": 7}
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("b.txt", "two")
        z.writestr("a.txt", b"\xffone")
        z.writestr("c.bin", "no")
    got = readers.zipped_texts(spark, f"file://{tmp_path}/f.zip").collect()
    assert [(r["name"], r["text"], r["n_bytes"]) for r in got] == [("a.txt", "�one", 4), ("b.txt", "two", 3)]
    (tmp_path / "ff.csv").write_text("Title\n,Mkt,SMB\n19260701, 0.10, -0.24\n19260702, -99.99, 1\n192607, 2.9, -2.5\n Annual\n1926, 1, 1\n")
    rows = readers.factor_file(spark, f"file://{tmp_path}/ff.csv", ["mkt", "smb"]).collect()
    assert sorted(map(tuple, rows)) == [(date(1926, 7, 1), 0.10, -0.24), (date(1926, 7, 31), 2.9, -2.5)]
    (tmp_path / "w.txt").write_text("Loss\n\nloss\nGain \n")
    assert readers.word_list(spark, f"file://{tmp_path}/w.txt", "c").count() == 2
    spark.range(4).withColumn("full_text", F.lit("t")).coalesce(1).write.parquet(f"file://{tmp_path}/years/1999.parquet")
    y = readers.year_shards(spark, f"file://{tmp_path}/years/1999.parquet", ["id"])
    assert y.select("source_record_id").distinct().count() == 4
    assert readers.light_metadata(y, sort=["id"]).columns[0] == "id"


def test_header(spark):
    text = "ACCESSION NUMBER: 0001-08-000001\nCONFORMED SUBMISSION TYPE: 10-K\nCONFORMED PERIOD OF REPORT: 20071231\nFILED AS OF DATE: 20080301\nCENTRAL INDEX KEY: 123\nCENTRAL INDEX KEY: 456\n"
    h = items.parse_header(F.lit(text))
    n = items.parse_filename(F.lit("20081103_10-K_edgar_data_123_0000000123-08-000001.txt"))
    r = spark.range(1).select(*[c.alias(k) for k, c in {**h, **n}.items()]).first()
    assert (r["form_type"], r["filing_date"], r["primary_cik"], r["secondary_ciks"]) == ("10-K", date(2008, 3, 1), "0000000123", ["0000000456"])
    assert (r["file_date"], r["file_cik"], r["file_accession"]) == (date(2008, 11, 3), "0000000123", "0000000123-08-000001")


def test_incremental_run(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    one = spark.createDataFrame([("2020-01-01 00:10:00", 1), ("2020-01-01 01:10:00", 2)], "t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    one.write.parquet(f"{src}/a.parquet")
    run = lambda: files.run_available(files.arrivals(spark, f"{src}/*", one.schema), f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    run()
    run()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    one.limit(1).write.parquet(f"{src}/b.parquet")
    run()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3


def test_batches_are_merged_and_verified(spark, tmp_path):
    base = f"file://{tmp_path}/raw"
    for year, part in ((2001, 1), (2001, 2), (2002, 1)):
        rows = [(f"{year}-{part}-{i}" if i else "same", f"text {year} {part} {i}", "0000000001") for i in range(4)]
        spark.createDataFrame(rows, "doc_id string, full_text string, cik_10 string").write.parquet(f"{base}/{year}_batch_{part}.parquet")
    assert {y: len(f) for y, f in readers.discover(spark, base).items()} == {"2001": 2, "2002": 1}
    assert readers.merge_batches(spark, base, f"file://{tmp_path}/merged") == {"2001": 8, "2002": 4}
    wanted = spark.createDataFrame([("same",), ("2002-1-3",), ("none",)], "doc_id string")
    got = {r["doc_id"]: (r["full_text"], r["source_year"]) for r in readers.filing_texts(spark, base, wanted).collect()}
    assert got == {"same": ("text 2001 1 0", "2001"), "2002-1-3": ("text 2002 1 3", "2002")}
    assert readers.filing_texts(spark, f"file://{tmp_path}/nothing", wanted).count() == 0
    a = spark.range(5)
    assert readers.verify_copy(a, spark.range(5)) == 5
    for other in (spark.range(4), spark.range(1, 6), a.withColumnRenamed("id", "x")):
        with pytest.raises(ValueError, match="copy"):
            readers.verify_copy(a, other)
    checked = readers.check_magic(spark, f"file://{tmp_path}/merged")
    assert checked.count() >= 2 and checked.filter("not valid").count() == 0
    (tmp_path / "merged/bad.parquet").write_bytes(b"PAR1 broken file without its end")
    assert readers.check_magic(spark, f"file://{tmp_path}/merged").filter("not valid").count() == 1


def test_summaries_manifests_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "7", ""), ("b", "1", None)], "doc_id string, item_id string, full_text string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/items")
    s = readers.summarize_items(spark.read.parquet(f"file://{tmp_path}/items"))
    assert [tuple(r)[1:] for r in s.collect()] == [(3, 2, 2, 2, "OK")]
    df.limit(0).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/items")
    assert {r["status"] for r in readers.empty_files(spark, f"file://{tmp_path}/items", s).collect()} <= {"EMPTY"}
    m = readers.write_manifest(spark, f"file://{tmp_path}/run/manifest.json", {"seed": 7}, {"items": df})
    assert json.loads((tmp_path / "run/manifest.json").read_text()) == m and m["tables"]["items"]["rows"] == 3
    t = spark.createDataFrame([("a|b", 1.5, None)], "name string, x double, y int")
    assert readers.render_table(t) == "| name | x | y |\n| --- | --- | --- |\n| a\\|b | 1.5 |  |\n"
    assert readers.render_table(t, "csv") == "name,x,y\na|b,1.5,\n" and "a|b & 1.5 & " in readers.render_table(t, "latex")
    with pytest.raises(ValueError, match="at most"):
        readers.render_table(spark.range(5), limit=4)


def test_header_conflicts(spark):
    head = "ACCESSION NUMBER: 0000000123-08-000001\nCENTRAL INDEX KEY: 123\nFILED AS OF DATE: 20081103\n"
    rows = [("20081103_10-K_edgar_data_123_0000000123-08-000001.txt", head), ("20081104_10-K_edgar_data_77_0000000123-08-000002.txt", head), ("odd.txt", "none")]
    got = [(r["cik_conflict"], r["accession_conflict"], r["cik"], str(r["date"])) for r in readers.header_conflicts(spark.createDataFrame(rows, "name string, text string")).collect()]
    assert got == [(False, False, "0000000123", "2008-11-03"), (True, True, "0000000077", "2008-11-03"), (False, False, None, "None")]


def test_daily_stage(spark, tmp_path):
    from ledgerline.operators import market
    from ledgerline.plans.composite_queries import _feeds

    prices, bids, delist, names, header = _feeds(spark, "/root/testdata/sf0.001")
    feeds = {"prices": prices, "bid_ask": bids, "delist": delist, "names": names, "header": header}
    path = f"file://{tmp_path}/stage"
    built = market.daily_stage(spark, feeds, path, "1995-06-01")
    n = built["panel"].count()
    assert n > 0 and all(built[s].count() == n and built[s].columns == list(market.SURFACES[s]) for s in market.SURFACES)
    assert built["bridge"].filter("n_filings <> 0 or gvkey is not null").count() == 0
    again = market.daily_stage(spark, {}, path, "1995-06-01", "REUSE")
    assert again["core"].count() == n
    with pytest.raises(ValueError, match="mode"):
        market.daily_stage(spark, feeds, path, "1995-06-01", "OTHER")


def test_batches_of_requests():
    from ledgerline.operators.enrich import plan_batches

    day = lambda n: date.fromordinal(date(2020, 1, 1).toordinal() + n)
    requests = [("a", day(0), day(9), 1), ("b", day(0), day(9), 1), ("c", day(5), day(14), 1), ("d", day(400), day(409), 2)]
    plan = plan_batches(requests, 45)
    assert [b["members"] for b in plan] == [["a", "b", "c"], ["d"]] and [b["rows"] for b in plan] == [45, 20]
    assert [b["fingerprint"] for b in plan] == [b["fingerprint"] for b in plan_batches(requests[::-1], 45)]
    assert len(plan_batches(requests, 20)) == 3
