"""Filing text: header fields, item segmentation, regime annotation, cleaning.

Header fields and annotations are columns; segmentation needs a running context over lines, so it is one Arrow-batched
function from a document to its item rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = re.compile(r"^[ \t>*\-•]*(?:PART[ \t]+[IV]{1,3}[ \t,.:;\-]*)?ITEM[ \t]*(\d{1,2}|[IVX]{1,5}(?![A-Za-z]))\s*([A-C]?)\s*[.:\-—)]?[ \t]*(.*)$", re.I | re.M)
PART = re.compile(r"^[ \t]*PART\s+(I{1,3}|IV)\b[ \t.:\-]*(.*)$", re.I | re.M)
CROSS = re.compile(r"(?:\bsee|\brefer(?:red)?\s+to|\bpursuant\s+to|\bunder|\bin)\s*$", re.I)
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4}
LETTERS = {1: "ABC", 7: "A", 9: "ABC"}
STUB = re.compile(r"\[?\s*(?:reserved|omitted|not applicable|none)\s*\.?\s*\]?", re.I)
PAGE_LINE = re.compile(r"[ \t]*(?:page\s+\d+(?:\s+of\s+\d+)?|-+\s*\d{1,3}\s*-+|\d{1,3}|[ivxl]{1,6})[ \t]*", re.I)
#: Validity of items whose meaning depends on the date, by form.
REGIMES_10K = [
    ("I", "1A", "RISK_FACTORS", "2005-12-01", None), ("I", "1B", "UNRESOLVED_STAFF_COMMENTS", "2005-12-01", None), ("I", "1C", "CYBERSECURITY", "2023-12-15", None),
    ("I", "4", "SUBMISSION_OF_MATTERS", None, "2010-02-28"), ("I", "4", "ITEM_4_RESERVED", "2010-02-28", "2012-01-27"), ("I", "4", "MINE_SAFETY", "2012-01-27", None),
    ("II", "6", "SELECTED_FINANCIAL_DATA", None, "2021-02-10"), ("II", "6", "ITEM_6_RESERVED", "2021-02-10", None), ("II", "7A", "MARKET_RISK", "1997-06-15", None),
    ("II", "9A", "CONTROLS", "2003-08-14", None), ("II", "9B", "OTHER_INFORMATION", "2004-08-23", None), ("II", "9C", "FOREIGN_JURISDICTIONS", "2022-01-10", None),
]


REGIMES_10Q = [
    ("I", "1", "FINANCIAL_STATEMENTS", None, None), ("I", "2", "MDA", None, None), ("I", "3", "MARKET_RISK", "1997-06-15", None), ("I", "4", "CONTROLS_AND_PROCEDURES", "2002-08-29", None),
    ("II", "1", "LEGAL_PROCEEDINGS", None, None), ("II", "1A", "RISK_FACTORS", "2005-12-01", None), ("II", "2", "CHANGES_IN_SECURITIES", None, "1996-11-17"), ("II", "2", "CHANGES_IN_SECURITIES_WITH_UNREGISTERED_SALES", "1996-11-17", "2004-08-23"),
    ("II", "2", "UNREGISTERED_SALES", "2004-08-23", None), ("II", "3", "DEFAULTS", None, None), ("II", "4", "SUBMISSION_OF_MATTERS", None, "2010-02-28"), ("II", "4", "ITEM_4_RESERVED", "2010-02-28", "2012-01-27"),
    ("II", "4", "MINE_SAFETY", "2012-01-27", None), ("II", "5", "OTHER_INFORMATION", None, None), ("II", "6", "EXHIBITS_AND_REPORTS", None, "2004-08-23"), ("II", "6", "EXHIBITS", "2004-08-23", None),
]


#: Field names of the archive's header, and the form of its file names.
HEADER_FIELDS = {"accession": r"ACCESSION NUMBER:\s*([0-9-]+)", "form_type": r"CONFORMED SUBMISSION TYPE:\s*(\S+)", "period": r"CONFORMED PERIOD OF REPORT:\s*(\d{8})", "filed": r"FILED AS OF DATE:\s*(\d{8})", "cik": r"CENTRAL INDEX KEY:\s*(\d{1,10})"}
FILE_NAME = r"(\d{8})_([^_]+)_edgar_data_(\d+)_([0-9-]+)\.txt$"


def parse_header(text: Column, limit: int = 8000) -> dict[str, Column]:
    """Fields of a filing's header."""
    head = F.substring(text, 1, limit)
    field = lambda p: F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit(""))
    ciks = F.regexp_extract_all(head, F.lit(HEADER_FIELDS["cik"]), F.lit(1))
    return {
        "accession": field(HEADER_FIELDS["accession"]),
        "form_type": field(HEADER_FIELDS["form_type"]),
        "period_end": F.try_to_timestamp(field(HEADER_FIELDS["period"]), F.lit("yyyyMMdd")).cast("date"),
        "filing_date": F.try_to_timestamp(field(HEADER_FIELDS["filed"]), F.lit("yyyyMMdd")).cast("date"),
        "primary_cik": F.lpad(F.get(ciks, F.lit(0)), 10, "0"),
        "secondary_ciks": F.transform(F.slice(F.array_distinct(ciks), 2, 1000), lambda c: F.lpad(c, 10, "0")),
    }


def parse_filename(name: Column) -> dict[str, Column]:
    """Date, form, CIK and accession of names like ``20081103_10-K_edgar_data_123_0000000123-08-000001.txt``."""
    part = lambda i: F.nullif(F.regexp_extract(name, FILE_NAME, i), F.lit(""))
    return {"file_date": F.try_to_timestamp(part(1), F.lit("yyyyMMdd")).cast("date"), "file_form": part(2), "file_cik": F.lpad(part(3), 10, "0"), "file_accession": part(4)}


def document_id(cik: Column, accession: Column, dashes: bool = True) -> Column:
    return F.concat_ws(":", cik, accession if dashes else F.replace(accession, F.lit("-"), F.lit("")))


@dataclass
class Heading:
    start: int
    end: int
    part: int | None
    number: int
    letter: str
    title: str
    listed: bool  # looks like a line of a table of contents
    prose: bool  # running text follows

    @property
    def evidence(self) -> tuple[bool, bool, int]:
        """What makes one of an item's headings the true one, in order: it is no contents line, text follows it, it comes last."""
        return not self.listed, self.prose, self.start


def default_part(number: int) -> int:
    return 1 if number <= 4 else 2 if number <= 9 else 3 if number <= 14 else 4


LEADER, PAGE_END = re.compile(r"\.{4,}|(?:\. ){4,}"), re.compile(r"\s\d{1,3}$")
CONTENTS = re.compile(r"table\s+of\s+contents|^\s*index\s*$", re.I | re.M)


def item_number(found: str) -> int | None:
    """An item's number from its digits or Roman numeral."""
    if found.isdigit():
        return int(found)
    value = 0
    digits = [{"I": 1, "V": 5, "X": 10}[c] for c in found.upper()]
    for d, after in zip(digits, [*digits[1:], 0], strict=True):
        value += -d if d < after else d
    return value or None


def headings(text: str, form: str = "10-K") -> list[Heading]:
    """All candidate item headings. A line is taken for one of a table of contents when it has dot leaders or ends in a page
    number, when the next heading follows before any text could, or when it stands below a contents title."""
    parts = [(m.start(), ROMAN[m[1].upper()]) for m in PART.finditer(text)]
    titles = [m.end() for m in CONTENTS.finditer(text)]
    rough = [(m, n) for m in ITEM.finditer(text) if (n := item_number(m[1])) and 1 <= n <= 15]
    out = []
    for i, (m, number) in enumerate(rough):
        letter = m[2].upper()
        if form.startswith("10-K") and letter and letter not in LETTERS.get(number, ""):
            continue
        title = m[3].strip()
        if CROSS.search(text[max(0, m.start() - 40) : m.start()]) or title[:1].islower() or re.match(r"\(?continued\)?", title, re.I):
            continue
        part = next((p for at, p in reversed(parts) if at <= m.start()), None)
        body = text[m.end() : rough[i + 1][0].start() if i + 1 < len(rough) else len(text)]
        lines = [x for x in body.split("\n") if x.strip()]
        stub = bool(STUB.fullmatch(title)) or bool(lines and STUB.fullmatch(lines[0].strip()))
        words = [len(x.split()) for x in lines]
        prose = any(n >= 8 for n in words)
        empty = not stub and sum(words) < 8 and i + 1 < len(rough)
        below = any(at <= m.start() for at in titles) and not prose
        out.append(Heading(m.start(), m.end(), part, number, letter, title, bool(LEADER.search(title) or PAGE_END.search(title)) or empty or below and not stub, prose))
    return out


def trim_item(body: str) -> str:
    """Item text without page lines, leading dashes, trailing part headings and what follows an empty-section marker."""
    lines = [x.rstrip() for x in body.split("\n")]
    kept = [x for i, x in enumerate(lines) if not (PAGE_LINE.fullmatch(x) and (i == 0 or not lines[i - 1].strip() or i + 1 == len(lines) or not lines[i + 1].strip()))]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).lstrip(" \t:-").strip()
    text = re.sub(r"\n\s*PART\s+[IV]+\.?\s*$", "", text, flags=re.I)
    head = text.split("\n")[0].strip() if text else ""
    return head if STUB.fullmatch(head) else text


SPARSE = re.compile(r"(?<=[.:;!?])[ \t]+(?=ITEM[ \t]+\d{1,2}[A-C]?[ \t]*[.:\-])", re.I)


def segment(text: str, form: str = "10-K") -> list[dict]:
    """Items of a filing: the best heading of each item, ended by the next heading of larger order.

    A text without headings at line starts (its line ends were lost) is tried again with lines broken before headings after an
    end mark; breaks replace a blank, so offsets stay.
    """
    if not text or form.endswith("/A"):
        return []
    if not ITEM.search(text):
        text = SPARSE.sub(lambda m: "\n".rjust(len(m[0])), text)
    groups: dict[tuple[int, int, str], list[Heading]] = {}
    annual, last, restarted = form.startswith("10-K"), (0, ""), False
    for h in headings(text, form):
        if not annual and h.part is None and not h.listed:
            restarted = restarted or (h.number, h.letter) <= last  # the second part's numbers begin anew
            last = (h.number, h.letter)
        part = default_part(h.number) if annual else h.part or (2 if restarted or h.number > 4 else 1)
        groups.setdefault((part, h.number, h.letter), []).append(h)
    best = {k: max(v, key=lambda h: h.evidence) for k, v in groups.items()}
    order = sorted(best.items(), key=lambda x: x[1].start)
    out = []
    for i, (key, h) in enumerate(order):
        end = next((o.start for k, o in order[i + 1 :] if k > key), len(text))
        body = trim_item(text[h.end : end] if not h.title else f"{h.title}\n{text[h.end : end]}")
        out.append({"item_part": "I II III IV".split()[key[0] - 1], "item_id": f"{h.number}{h.letter}", "heading_start": h.start, "text_end": end, "full_text": body, "item_status": "reserved" if STUB.fullmatch(body) else "active"})
    return out


def extract_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form_col: str | None = None, archive: bool = False) -> DataFrame:
    """One row per item of each document: part, id, offsets, text and status. Texts without headings give none.

    ``archive`` takes texts as they come from the filing archive: its markup goes and wrapped headings are joined first, and
    offsets are those of what remains.
    """
    if archive:
        from .filing_text import join_wrapped_headings, strip_archive

        docs = docs.withColumn(text_col, join_wrapped_headings(strip_archive(F.col(text_col))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"doc": d, **item} for d, t, f in zip(pdf["doc"], pdf["text"], pdf["form"], strict=True) for item in segment(t, f)]
            yield pd.DataFrame(rows, columns=["doc", "item_part", "item_id", "heading_start", "text_end", "full_text", "item_status"])

    given = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"), (F.col(form_col) if form_col else F.lit("10-K")).alias("form"))
    out = given.mapInPandas(run, "doc string, item_part string, item_id string, heading_start long, text_end long, full_text string, item_status string")
    return out.withColumn("doc", F.col("doc").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc", id_col)


def regime_frame(spark, form: str = "10-K") -> DataFrame:
    """Validity intervals of the items of an annual or quarterly form."""
    rows = spark.createDataFrame(REGIMES_10Q if form.startswith("10-Q") else REGIMES_10K, "item_part string, item_id string, canonical string, valid_from string, valid_to string")
    return rows.withColumn("valid_from", F.col("valid_from").cast("date")).withColumn("valid_to", F.col("valid_to").cast("date"))


def annotate_regime(items: DataFrame, regimes: DataFrame, date: str = "filing_date") -> DataFrame:
    """Adds ``canonical``, ``exists_by_regime`` and ``regime_status``: start inclusive, end exclusive; a missing date can't decide.

    The table of regimes is a fixed small one.
    """
    known = regimes.select("item_part", "item_id").distinct().withColumn("__known", F.lit(True))
    valid = (F.col("r.valid_from").isNull() | (F.col("r.valid_from") <= F.col(f"i.{date}"))) & (F.col("r.valid_to").isNull() | (F.col(f"i.{date}") < F.col("r.valid_to")))
    out = items.join(F.broadcast(known), ["item_part", "item_id"], "left").alias("i")
    r = F.broadcast(regimes.alias("r"))
    out = out.join(r, (F.col("i.item_part") == F.col("r.item_part")) & (F.col("i.item_id") == F.col("r.item_id")) & valid, "left").select("i.*", "r.canonical")
    exists = F.when(F.col("canonical").isNotNull(), True).when(F.col("__known") & F.col(date).isNotNull(), False)
    status = F.when(F.col("canonical").endswith("_RESERVED"), "reserved").when(F.col("canonical").isNotNull(), "active").otherwise("unknown")
    return out.withColumn("exists_by_regime", exists).withColumn("regime_status", status).drop("__known")


def clean_item(text: str, toc_window: int = 2000, tail_from: float = 0.65) -> dict:
    """Cleans an item's text: layout lines, a leading table of contents, a tail of the next part, blank runs; says what went."""
    lines = [x for x in text.replace("\r\n", "\n").split("\n") if not PAGE_LINE.fullmatch(x) or not x.strip()]
    kept = "\n".join(lines)
    hits = [m for m in re.finditer(r"^.*(?:\.{4,}|\bitem\s+\d+).*\b\d{1,3}\s*$", kept[:toc_window], re.I | re.M)]
    toc = len(hits) >= 2
    if toc:
        kept = kept[hits[-1].end() :]
    tail = re.search(r"^\s*(?:SIGNATURES?|EXHIBIT INDEX|PART\s+IV)\s*$", kept[int(len(kept) * tail_from) :], re.M)
    if tail:
        kept = kept[: int(len(kept) * tail_from) + tail.start()]
    kept = re.sub(r"\n{3,}", "\n\n", kept).strip()
    removed = 1 - len(kept) / len(text) if text else 0.0
    return {"cleaned": kept, "toc_removed": toc, "tail_removed": bool(tail), "removed_share": removed, "stub": len(kept) <= 1200 and bool(STUB.search(kept[:200])), "large_removal": removed >= 0.4}


def clean_items(items: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Adds the fields of ``clean_item`` to item rows."""

    @F.pandas_udf("cleaned string, toc_removed boolean, tail_removed boolean, removed_share double, stub boolean, large_removal boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean_item(t or "") for t in texts], columns=["cleaned", "toc_removed", "tail_removed", "removed_share", "stub", "large_removal"])

    return items.withColumn("__c", run(F.col(text_col))).select("*", "__c.*").drop("__c")


def boundary_authority(exists: Column, confident: Column) -> Column:
    """trusted, review_needed or unknown."""
    return F.when(exists.isNull(), "unknown").when(exists & F.coalesce(confident, F.lit(False)), "trusted").otherwise("review_needed")


def no_item_report(filings: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """Filings without any item, by group and in total."""
    from .reports import with_total

    have = items.select("doc_id").distinct().withColumn("__have", F.lit(1))
    joined = filings.join(have, "doc_id", "left")
    return with_total(joined, by, [F.count("*").alias("filings"), F.count(F.when(F.col("__have").isNull(), 1)).alias("without_items")])
