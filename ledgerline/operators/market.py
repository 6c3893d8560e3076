"""Daily security panel: price panel, final returns, filings, links and histories, each with provenance bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import first_existing, require_columns, truth
from ..functions import exprs as X
from . import asof
from .links import TYPE_RANK, _choice, within
from .windows import first_per_key, mode_per_key

FLAGS = {
    name: 1 << i
    for i, name in enumerate(
        "HAS_RET HAS_BIDLO HAS_SHROUT HAS_DELIST NAMES_VALID HEADER_VALID PRICE_OK COMMON_OK EXCHANGE_OK VOLUME_OK CAP_OK CONCEPT_OK"
        " RET_BOTH RET_DELIST RET_PRICE RETX_BOTH RETX_DELIST RETX_PRICE HAS_FILING LINK_CANONICAL LINK_SPARSE HAS_COMP_DESC"
        " SEC_HIST_VALID SEC_HIST_STALE SEC_HEADER_USED COMP_HIST_VALID COMP_HIST_STALE NO_KEY".split()
    )
}


def _status(df: DataFrame) -> Column:
    return F.col("data_status") if "data_status" in df.columns else F.lit(0).cast("long")


def with_flags(df: DataFrame, conditional: dict[str, Column], static: int = 0) -> DataFrame:
    return df.withColumn("data_status", X.or_flags(_status(df), {FLAGS[k]: v for k, v in conditional.items()}, static))


def concept_flags(df: DataFrame) -> DataFrame:
    """Price of 1 or more, common stock, major exchange, positive volume, capital of 50 000 or more, and all of them."""
    price = F.col(first_existing(df, ("FINAL_PRC", "PRC", "DLPRC"), "panel"))
    tests = {
        "PRICE_OK": F.abs(price) >= 1, "COMMON_OK": X.common_stock(F.col("SHRCD")), "EXCHANGE_OK": X.major_exchange(F.col("EXCHCD")),
        "VOLUME_OK": F.col("VOL") > 0, "CAP_OK": F.col("TCAP") >= X.MICROCAP,
    }
    every = F.lit(True)
    for t in tests.values():
        every = every & truth(t)
    return with_flags(df, tests | {"CONCEPT_OK": every})


def common_major(df: DataFrame) -> DataFrame:
    """Rows of common stock on a major exchange, by their bits."""
    return df.filter(X.has_all(F.col("data_status"), FLAGS["COMMON_OK"] | FLAGS["EXCHANGE_OK"]))


def price_panel(bid_ask: DataFrame, prices: DataFrame, delist: DataFrame, names: DataFrame, header: DataFrame, start: str, shares: DataFrame | None = None) -> DataFrame:
    """Outer-merged feeds with names, header and shares valid on the day, and delistings on their day or the last day traded."""
    require_columns(bid_ask, ("KYPERMNO", "CALDT", "BIDLO", "ASKHI"), "bid/ask feed")
    require_columns(prices, ("KYPERMNO", "CALDT", "PRC", "RET", "RETX", "TCAP", "VOL"), "price feed")
    since = F.col("CALDT") >= F.to_date(F.lit(start))
    p = prices.filter(since).join(bid_ask.filter(since), ["KYPERMNO", "CALDT"], "full")
    p = with_flags(p, {"HAS_RET": F.col("RET").isNotNull(), "HAS_BIDLO": F.col("BIDLO").isNotNull()})
    if shares is not None:
        p = asof.asof_join(p, shares, ["KYPERMNO"], "CALDT", "SHRSDT", ["SHROUT"], valid_until="SHRSENDDT").drop("asof_SHRSDT", "matched")
        p = with_flags(p, {"HAS_SHROUT": F.col("SHROUT").isNotNull()})
    else:
        p = p.withColumn("SHROUT", F.lit(None).cast("double"))
    of_names = names.withColumn("NAMEENDDT", F.coalesce("NAMEENDDT", F.col("NAMEDT")))
    n = ["TICKER", "SHRCD", "EXCHCD", "PRIMEXCH", "TRDSTAT", "SECSTAT"]
    p = asof.asof_join(p, of_names.select("KYPERMNO", "NAMEDT", "NAMEENDDT", *n), ["KYPERMNO"], "CALDT", "NAMEDT", n, valid_until="NAMEENDDT")
    p = with_flags(p, {"NAMES_VALID": F.col("matched")}).drop("asof_NAMEDT", "matched")
    h = ["HSHRCD", "HEXCD", "HPRIMEXCH", "HTRDSTAT", "HSECSTAT"]
    of_header = header.withColumn("ENDDT", F.coalesce("ENDDT", F.col("BEGDT"))).select("KYPERMNO", "BEGDT", "ENDDT", *h)
    p = asof.asof_join(p, of_header, ["KYPERMNO"], "CALDT", "BEGDT", h, valid_until="ENDDT")
    p = with_flags(p, {"HEADER_VALID": F.col("matched")}).drop("asof_BEGDT", "matched")
    for a, b in zip(n[1:], h, strict=True):
        p = p.withColumn(a, F.coalesce(a, b)).drop(b)
    last = p.groupBy("KYPERMNO").agg(F.max("CALDT").alias("__last"))
    d = delist.join(p.select("KYPERMNO", F.col("CALDT").alias("DLSTDT"), F.lit(1).alias("__same")), ["KYPERMNO", "DLSTDT"], "left").join(last, "KYPERMNO")
    d = d.withColumn("CALDT", F.when(F.col("__same") == 1, F.col("DLSTDT")).otherwise(F.col("__last")))
    d = first_per_key(d, ["KYPERMNO", "CALDT"], [F.col("DLSTDT").desc(), F.col("DLSTCD").asc()])
    p = p.join(d.select("KYPERMNO", "CALDT", "DLSTDT", "DLSTCD", "DLPRC", "DLAMT", "DLRET", "DLRETX"), ["KYPERMNO", "CALDT"], "left")
    return concept_flags(with_flags(p, {"HAS_DELIST": F.col("DLSTDT").isNotNull()}))


def final_returns(df: DataFrame) -> DataFrame:
    """Returns with delisting returns compounded in, absolute final price, and where each came from."""
    for name, ret, delist in (("RET", "RET", "DLRET"), ("RETX", "RETX", "DLRETX")):
        r, d = F.col(ret), F.col(delist)
        df = with_flags(df, {f"{name}_BOTH": r.isNotNull() & d.isNotNull(), f"{name}_DELIST": r.isNull() & d.isNotNull(), f"{name}_PRICE": r.isNotNull() & d.isNull()})
        df = df.withColumn(f"FINAL_{name}", X.final_return(r, d))
    return df.withColumn("FINAL_PRC", F.coalesce(F.abs("DLPRC"), F.abs("PRC")))


def attach_filings(panel: DataFrame, filings: DataFrame, forms: tuple[str, ...] = ()) -> DataFrame:
    """Filings of a security on the next trading day, as arrays in order of time."""
    f = filings.withColumn("form", X.normalize_form(F.col("SRCTYPE")))
    if forms:
        f = f.filter(F.col("form").isin(*forms))
    calendar = asof.trading_calendar(panel, "CALDT")
    first = panel.agg(F.min("CALDT").alias("__first"))
    f = f.crossJoin(F.broadcast(first)).filter(F.col("FILEDATE") >= F.col("__first")).drop("__first")
    clock = F.when(F.col("FILEDATETIME").rlike(r"^\d{2}:\d{2}:\d{2}$"), F.col("FILEDATETIME")).otherwise("00:00:00")
    f = f.withColumn("filed_at", F.try_to_timestamp(F.concat_ws(" ", F.col("FILEDATE").cast("string"), clock), F.lit("yyyy-MM-dd HH:mm:ss")))
    f = asof.align_to_calendar(f, "FILEDATE", calendar).filter("aligned_day is not null")
    bag = f.groupBy(F.col("LPERMNO").alias("KYPERMNO"), F.col("aligned_day").alias("CALDT")).agg(F.array_sort(F.collect_list(F.struct("filed_at", "form"))).alias("bag"))
    bag = bag.select("KYPERMNO", "CALDT", F.transform("bag", lambda x: x["form"]).alias("filing_forms"), F.transform("bag", lambda x: x["filed_at"]).alias("filing_times"), F.size("bag").alias("n_filings"))
    out = panel.join(bag, ["KYPERMNO", "CALDT"], "left").withColumn("n_filings", F.coalesce("n_filings", F.lit(0)))
    return with_flags(out, {"HAS_FILING": F.col("n_filings") > 0})


def attach_links(panel: DataFrame, links: DataFrame) -> DataFrame:
    """The best link of each security and day; sparse links only where no other is valid."""
    positive = links.filter("kypermno > 0").withColumnRenamed("kypermno", "KYPERMNO")
    columns = ["gvkey", "liid", "link_quality", "link_rank_effective", "is_sparse_fallback", "linktype"]
    keyed = panel.select("KYPERMNO", "CALDT").distinct()
    valid = keyed.join(positive, "KYPERMNO").filter(within(F.col("CALDT"), F.col("valid_start"), F.col("valid_end"))).withColumn("kypermno", F.col("KYPERMNO"))
    order = [F.when(F.col("has_window") & ~F.col("is_sparse_fallback"), 1).otherwise(2), F.col("row_quality_tier"), F.col("source_priority"), F.col("link_rank_effective"), F.col("link_quality").desc(), *_choice()]
    best = first_per_key(valid.filter((F.col("has_window") & ~F.col("is_sparse_fallback")) | F.col("is_sparse_fallback")), ["KYPERMNO", "CALDT"], order)
    out = panel.join(best.select("KYPERMNO", "CALDT", *columns), ["KYPERMNO", "CALDT"], "left")
    label = F.when(F.col("gvkey").isNull(), "no_link").when(F.col("is_sparse_fallback"), "sparse").when(F.col("link_quality") >= 4, "primary").when(F.col("link_quality") >= 2, "secondary").otherwise("weak")
    out = out.withColumn("link_quality_flag", label).withColumn("link_rank", F.coalesce("link_rank_effective", F.lit(len(TYPE_RANK) + 3)))
    return with_flags(out, {"LINK_CANONICAL": F.col("gvkey").isNotNull() & ~F.col("is_sparse_fallback"), "LINK_SPARSE": F.col("is_sparse_fallback")})


def attach_company_description(panel: DataFrame, description: DataFrame) -> DataFrame:
    """Filer id from history, then what is there, then the description's most frequent one."""
    d = mode_per_key(description.select(F.col("KYGVKEY").cast("string").alias("gvkey"), X.cik10(F.col("CIK")).alias("__cik")), ["gvkey"], "__cik")
    out = panel.join(d, "gvkey", "left")
    have = [F.col(c) for c in ("HCIK", "CIK") if c in panel.columns]
    out = with_flags(out, {"HAS_COMP_DESC": F.col("__cik").isNotNull()})
    return out.withColumn("CIK", F.coalesce(*have, F.col("__cik"))).drop("__cik")


def merge_histories(panel: DataFrame, security_history: DataFrame, security_header: DataFrame, company_history: DataFrame) -> DataFrame:
    """Security and company attributes valid on the day; stale ones are blanked, header fills identifiers; no row is dropped."""
    s = [c for c in ("HTPCI", "HEXCNTRY", "HSCUSIP", "HISIN") if c in security_history.columns]
    hist = security_history.select(F.col("KYGVKEY").cast("string").alias("gvkey"), F.col("KYIID").alias("liid"), "HSCHGDT", "HSCHGENDDT", *s)
    near = asof.asof_join(panel, hist, ["gvkey", "liid"], "CALDT", "HSCHGDT", [*s, "HSCHGENDDT"])
    fresh = F.col("matched") & (F.col("HSCHGENDDT").isNull() | (F.col("CALDT") <= F.col("HSCHGENDDT")))
    out = with_flags(near, {"SEC_HIST_VALID": fresh, "SEC_HIST_STALE": F.col("matched") & ~fresh, "NO_KEY": F.col("gvkey").isNull()}).withColumn("__fresh", fresh)
    for c in s:
        out = out.withColumn(c, F.when(F.col("__fresh"), F.col(c)))
    out = out.drop("asof_HSCHGDT", "matched", "HSCHGENDDT", "__fresh")
    ids = {a: b for a, b in (("HSCUSIP", "SCUSIP"), ("HISIN", "ISIN")) if a in s and b in security_header.columns}
    if ids:
        header = first_per_key(security_header, ["KYGVKEY", "KYIID"], [F.col("SBEGDT").desc()]).select(F.col("KYGVKEY").cast("string").alias("gvkey"), F.col("KYIID").alias("liid"), *[F.col(b).alias(f"__{a}") for a, b in ids.items()])
        out = out.join(header, ["gvkey", "liid"], "left")
        used = F.lit(False)
        for a in ids:
            used = used | (F.col(a).isNull() & F.col(f"__{a}").isNotNull())
        out = with_flags(out, {"SEC_HEADER_USED": used})
        for a in ids:
            out = out.withColumn(a, F.coalesce(a, f"__{a}")).drop(f"__{a}")
    c = [x for x in ("HCIK", "HSIC", "HNAICS", "HGSUBIND") if x in company_history.columns]
    comp = company_history.select(F.col("KYGVKEY").cast("string").alias("gvkey"), "HCHGDT", "HCHGENDDT", *c)
    out = asof.asof_join(out, comp, ["gvkey"], "CALDT", "HCHGDT", [*c, "HCHGENDDT"])
    fresh = F.col("matched") & (F.col("HCHGENDDT").isNull() | (F.col("CALDT") <= F.col("HCHGENDDT")))
    out = with_flags(out, {"COMP_HIST_VALID": fresh, "COMP_HIST_STALE": F.col("matched") & ~fresh}).withColumn("__fresh", fresh)
    for x in c:
        out = out.withColumn(x, F.when(F.col("__fresh"), F.col(x)))
    return out.drop("asof_HCHGDT", "matched", "HCHGENDDT", "__fresh")


#: The columns of the panel's three stable surfaces, with their types.
SURFACES = {
    "core": {"KYPERMNO": "int", "CALDT": "date", "PRC": "double", "RET": "double", "RETX": "double", "FINAL_RET": "double", "FINAL_RETX": "double", "FINAL_PRC": "double", "BIDLO": "double", "ASKHI": "double", "VOL": "double", "TCAP": "double", "SHROUT": "double", "TICKER": "string", "SHRCD": "int", "EXCHCD": "int", "data_status": "bigint"},
    "daily": {"KYPERMNO": "int", "CALDT": "date", "FINAL_RET": "double", "FINAL_PRC": "double", "VOL": "double", "TCAP": "double", "SHROUT": "double", "SHRCD": "int", "EXCHCD": "int"},
    "bridge": {"KYPERMNO": "int", "CALDT": "date", "gvkey": "string", "liid": "string", "HSCUSIP": "string", "HISIN": "string", "TICKER": "string", "n_filings": "int"},
}


def surface(panel: DataFrame, name: str) -> DataFrame:
    """A stable surface of the panel: absent columns are typed nulls, a missing count of filings is 0."""
    from ..contracts import project_with_defaults

    out = project_with_defaults(panel, SURFACES[name], {"n_filings": 0})
    return out.na.fill({"n_filings": 0}) if "n_filings" in out.columns else out


def clean_panel(panel: DataFrame) -> DataFrame:
    """Concept flags anew, then common stock on a major exchange."""
    return common_major(concept_flags(panel))


def daily_stage(spark, feeds: dict[str, DataFrame], path: str, start: str, mode: str = "REBUILD") -> dict[str, DataFrame]:
    """The whole daily panel, written below ``path`` with its surfaces; ``REUSE`` reads them if all are there.

    ``feeds`` has bid_ask, prices, delist, names, header, and where known filings, links, description, security_history,
    security_header, company_history.
    """
    if mode not in ("REBUILD", "REUSE"):
        raise ValueError(f"mode must be REBUILD or REUSE, not {mode}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = lambda n: (p := jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")).getFileSystem(conf).exists(p)
    names = ("panel", *SURFACES)
    if mode == "REBUILD" or not all(done(n) for n in names):
        p = final_returns(price_panel(feeds["bid_ask"], feeds["prices"], feeds["delist"], feeds["names"], feeds["header"], start, feeds.get("shares")))
        if "filings" in feeds:
            p = attach_filings(p, feeds["filings"])
        if "links" in feeds:
            p = attach_links(p, feeds["links"])
        if "security_history" in feeds:
            p = merge_histories(p, feeds["security_history"], feeds["security_header"], feeds["company_history"])
        if "description" in feeds:
            p = attach_company_description(p, feeds["description"])
        p.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/panel")
        whole = spark.read.parquet(f"{path}/panel")
        for n in SURFACES:
            surface(whole, n).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{n}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
