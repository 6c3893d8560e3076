"""Readers and writers: table sets, year shards, archives of texts, factor files, word lists, summaries."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _hadoop_walk(spark: SparkSession, base: str) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    found, walk = [], fs.listFiles(path, True)
    while walk.hasNext():
        found.append(walk.next().getPath().toString())
    return sorted(found)


def load_tables(spark: SparkSession, bases: Sequence[str], wanted: Sequence[str]) -> dict[str, DataFrame]:
    """Parquet tables by file or folder stem below the bases; the first hit wins, missing bases are passed over."""
    out: dict[str, DataFrame] = {}
    for base in bases:
        for f in _hadoop_walk(spark, base):
            for part in reversed(f.removeprefix(base).split("/")):
                stem = part.removesuffix(".parquet")
                if part.endswith(".parquet") and stem in wanted and stem not in out:
                    out[stem] = spark.read.parquet(f[: f.index(part) + len(part)])
    return out


def write_zstd(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def year_shards(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """Files named by year with a locator: ``source_record_id`` of file stem, key and the row's number among those of its key.

    It does not depend on physical order; rows that share a key are numbered by a hash of the whole row.
    """
    df = spark.read.option("mergeSchema", "true").parquet(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.parquet)?$", 1)
    w = Window.partitionBy("source_year_file", *key).orderBy(F.xxhash64(*df.columns))
    numbered = df.withColumn("source_year_file", stem).withColumn("source_row", F.row_number().over(w))
    return numbered.withColumn("source_record_id", F.concat_ws(":", "source_year_file", *key, "source_row"))


def zipped_texts(spark: SparkSession, path: str) -> DataFrame:
    """``archive, name, text, n_bytes`` of the .txt members of zip files; bytes that aren't UTF-8 are replaced. A task opens one archive at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows, size = [], 0
                    for name in sorted(n for n in z.namelist() if n.endswith(".txt")):
                        data = z.read(name)
                        rows.append((archive, name, data.decode("utf-8", "replace"), len(data)))
                        size += len(data)
                        if size > 1 << 25:
                            yield pd.DataFrame(rows, columns=["archive", "name", "text", "n_bytes"])
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=["archive", "name", "text", "n_bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, name string, text string, n_bytes long")


def factor_file(spark: SparkSession, path: str, columns: Sequence[str], missing: Sequence[float] = (-99.99, -999.0)) -> DataFrame:
    """Rows of a factor text file whose first field is a day (8 digits) or month (6 digits); months become month ends."""
    parts = F.split(F.col("value"), ",")
    period = F.trim(parts[0])
    rows = spark.read.text(path).filter(period.rlike(r"^(\d{8}|\d{6})$"))
    day = F.when(F.length(period) == 8, F.try_to_timestamp(period, F.lit("yyyyMMdd")).cast("date")).otherwise(F.last_day(F.try_to_timestamp(F.concat(period, F.lit("01")), F.lit("yyyyMMdd")).cast("date")))
    numbers = [F.trim(F.get(parts, F.lit(i + 1))).try_cast("double") for i in range(len(columns))]
    out = rows.select(day.alias("period"), *[F.when(~n.isin(*missing), n).alias(c) for n, c in zip(numbers, columns, strict=True)])
    return out.dropna()


def word_list(spark: SparkSession, path: str, category: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("entry"), F.lit(category).alias("category")).filter("entry <> ''").distinct()


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as strings (no inference pass)."""
    return spark.read.option("header", True).csv(path)


def summarize_files(df: DataFrame, cik_col: str = "cik_10", text_col: str = "full_text") -> DataFrame:
    """Per file: rows, rows with id and text, and a status."""
    have = lambda c: F.count(c) if c in df.columns else F.lit(0)
    g = df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), have(cik_col).alias("with_cik"), have(text_col).alias("with_text"))
    return g.withColumn("status", F.when(F.col("rows") == 0, "EMPTY").when(F.col("with_cik") == 0, "ERR_NO_CIK").when(F.col("with_text") == 0, "WARN_NO_TEXT").otherwise("OK"))


def light_metadata(df: DataFrame, drop: Sequence[str] = ("full_text",), sort: Sequence[str] = ()) -> DataFrame:
    out = df.drop(*drop)
    return out.orderBy(*sort) if sort else out


def discover(spark: SparkSession, base: str) -> dict[str, list[str]]:
    """Yearly parquet files below a folder by year: ``YYYY.parquet`` and ``*YYYY_batch_N.parquet``, in order."""
    out: dict[str, list[str]] = {}
    for f in _hadoop_walk(spark, base):
        name = next((p for p in reversed(f.split("/")) if p.endswith(".parquet")), "")
        if m := re.search(r"(\d{4})(?:_batch_\d+)?\.parquet$", name):
            whole = f[: f.index(name) + len(name)]
            if whole not in out.setdefault(m[1], []):
                out[m[1]].append(whole)
    return dict(sorted(out.items()))


def filing_texts(spark: SparkSession, base: str, ids: DataFrame, key: str = "doc_id", text_col: str = "full_text") -> DataFrame:
    """Texts of the wanted documents, one row each: of several the one of the first year, then the least text."""
    from ..contracts import union_relaxed
    from ..operators.windows import first_per_key

    parts = [spark.read.parquet(*files).select(key, text_col).withColumn("source_year", F.lit(year)) for year, files in discover(spark, base).items()]
    if not parts:
        return ids.select(key).limit(0).withColumn(text_col, F.lit(None).cast("string")).withColumn("source_year", F.lit(None).cast("string"))
    return first_per_key(union_relaxed(parts).join(ids.select(key).distinct(), key, "left_semi"), [key], [F.col("source_year"), F.col(text_col)])


def merge_batches(spark: SparkSession, base: str, out: str, files_per_year: int = 1) -> dict[str, int]:
    """One folder a year from its batch files, rows verified: raises ValueError when what was written has other rows than were read."""
    written = {}
    for year, files in discover(spark, base).items():
        df = spark.read.option("mergeSchema", "true").parquet(*files)
        target = f"{out}/{year}.parquet"
        df.coalesce(files_per_year).write.mode("overwrite").option("compression", "zstd").parquet(target)
        written[year] = verify_copy(df, spark.read.parquet(target))
    return written


def verify_copy(source: DataFrame, copy: DataFrame) -> int:
    """Rows of both if schema, count and an order-free checksum agree; raises ValueError otherwise."""
    if [(f.name, f.dataType) for f in source.schema.fields] != [(f.name, f.dataType) for f in copy.schema.fields]:
        raise ValueError("the copy has another schema")
    check = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()
    a, b = check(source), check(copy)
    if tuple(a) != tuple(b):
        raise ValueError(f"the copy has {b[0]} rows, the source {a[0]}, or unlike values")
    return a[0]


def check_magic(spark: SparkSession, base: str) -> DataFrame:
    """Parquet files below a folder and whether their first and last bytes are those of the format."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(base)
    mark = F.lit(b"PAR1")
    ok = (F.col("length") >= 12) & (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)
    return rows.select("path", "length", ok.alias("valid"))


def summarize_items(df: DataFrame, item_col: str = "item_id", text_col: str = "full_text") -> DataFrame:
    """Per file of item rows: rows, documents, items, rows without text, and a status."""
    g = df.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("rows"), F.count_distinct("doc_id").alias("docs"), F.count_distinct(item_col).alias("items"), F.count(F.when(F.length(F.trim(F.coalesce(text_col, F.lit("")))) == 0, 1)).alias("without_text")
    )
    return g.withColumn("status", F.when(F.col("without_text") == F.col("rows"), "WARN_NO_TEXT").otherwise("OK"))


def empty_files(spark: SparkSession, base: str, summary: DataFrame) -> DataFrame:
    """Parquet files below a folder that a summary does not list, because they have no row: ``file, status``."""
    names = [(f.rsplit("/", 1)[-1], "EMPTY") for f in _hadoop_walk(spark, base) if f.endswith(".parquet")]
    return spark.createDataFrame(names, "file string, status string").join(summary.select("file"), "file", "left_anti")


def header_conflicts(raw: DataFrame, text_col: str = "text", name_col: str = "name") -> DataFrame:
    """Filing texts with the fields of header and file name, the header's winning, and flags where both have unlike ones."""
    from ..operators.items import parse_filename, parse_header

    out = raw.withColumns(parse_header(F.col(text_col))).withColumns(parse_filename(F.col(name_col)))
    bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    listed = F.array_append(F.col("secondary_ciks"), F.col("primary_cik"))
    out = out.withColumn("cik_conflict", F.coalesce(F.col("primary_cik").isNotNull() & ~F.array_contains(listed, F.col("file_cik")), F.lit(False)))
    out = out.withColumn("accession_conflict", F.coalesce(bare("accession") != bare("file_accession"), F.lit(False)))
    return out.withColumn("cik", F.coalesce("file_cik", "primary_cik")).withColumn("date", F.coalesce("filing_date", "file_date")).withColumn("accession_used", F.coalesce("accession", "file_accession"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Hadoop opens."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_manifest(spark: SparkSession, path: str, run: dict, tables: dict[str, DataFrame]) -> dict:
    """A JSON manifest of a run: its settings, and schema and rows of each table."""
    import json

    manifest = run | {"tables": {n: {"rows": df.count(), "columns": {f.name: f.dataType.simpleString() for f in df.schema.fields}} for n, df in tables.items()}}
    write_text(spark, path, json.dumps(manifest, indent=1, sort_keys=True, default=str))
    return manifest


def render_table(df: DataFrame, kind: str = "markdown", limit: int = 1000) -> str:
    """A report table (at most ``limit`` rows; more raise) as markdown, csv or latex text."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has at most {limit} rows")
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    cells = [df.columns, *[[show(v) for v in r] for r in rows]]
    if kind == "csv":
        return "\n".join(",".join('"' + c.replace('"', '""') + '"' if re.search(r'[",\n]', c) else c for c in line) for line in cells) + "\n"
    if kind == "latex":
        body = [" & ".join(re.sub(r"([&%$#_{}])", r"\\\1", c) for c in line) + r" \\" for line in cells]
        return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}"]) + "\n"
    lines = ["| " + " | ".join(c.replace("|", r"\|") for c in line) + " |" for line in cells]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in df.columns) + " |", *lines[1:]]) + "\n"


def reuse_or_build(spark: SparkSession, path: str, config: dict, build) -> tuple[DataFrame, bool]:
    """The table of a configuration: read where a run with the same configuration has written it, else built and written.

    The folder is named by a hash of the configuration, so a changed setting never reads an old result. Tells whether it was built.
    """
    import hashlib
    import json

    name = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:24]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
    fresh = not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if fresh:
        build().write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}"), fresh
