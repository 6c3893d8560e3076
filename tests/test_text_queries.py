"""Text queries that SQL can't express, on whole tables, against plain versions of their rules; cases of the filing text operators."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerline import catalog
from ledgerline.operators import filing_text, items, scores
from ledgerline.plans.text_queries import length_scorer

SF = "/root/testdata/sf0.001"
PROSE = "The company makes and sells many goods in many of the countries of the world every year."


@pytest.fixture(scope="module")
def documents():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"] or "") for r in t]


def page_line(line):
    s = line.strip(" \t")
    if re.fullmatch(r"page\s+\d+(\s+of\s+\d+)?", s, re.I) or re.fullmatch(r"-+[ \t]*\d{1,3}[ \t]*-+", s):
        return True
    return s.isascii() and (0 < len(s) <= 3 and s.isdigit() or 0 < len(s) <= 6 and set(s.lower()) <= set("ivxl"))


def plain_trim(body):
    lines = [x.rstrip() for x in body.split("\n")]
    kept = []
    for i, x in enumerate(lines):
        beside_blank = i == 0 or i + 1 == len(lines) or not lines[i - 1].strip() or not lines[i + 1].strip()
        if not (page_line(x) and beside_blank):
            kept.append(x)
    text = "\n".join(kept)
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    text = text.lstrip(" \t:-").strip()
    last = text.rsplit("\n", 1)
    if len(last) == 2 and re.fullmatch(r"\s*PART\s+[IV]+\.?\s*", last[1], re.I):
        text = last[0].rstrip()
    return text


def test_item_segmentation(spark, documents):
    want = []
    for doc, body in documents:
        a = "PART I\n"
        b = f"{a}Item 1. Business\n{body}\n"
        c = f"{b}Item 1A. Risk Factors\n{body}\nPART II\n"
        end = f"{c}Item 7. Management's Discussion\n{body}\nSIGNATURES\n"
        texts = [f"Business\n\n{body}\n", f"Risk Factors\n\n{body}\nPART II\n", f"Management's Discussion\n\n{body}\nSIGNATURES\n"]
        starts, stops = [len(a), len(b), len(c)], [len(b), len(c), len(end)]
        want += [(doc, p, i, s, e, len(plain_trim(t)), "active") for p, i, s, e, t in zip(("I", "I", "II"), ("1", "1A", "7"), starts, stops, texts, strict=True)]
    got = catalog.QUERIES["item_segmentation"](spark, SF).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "item_part", "item_id", "heading_start", "text_end", "n_chars", "item_status")) for r in got) == sorted(want)


def plain_sentences(text):
    out, start, i = [], 0, 0
    while i < len(text):
        j = i
        if text[i] in ".!?":
            j = i + 1
            while j < len(text) and text[j] in "\"')]":
                j += 1
            k = j
            while k < len(text) and text[k].isspace():
                k += 1
            m = k
            while m < len(text) and text[m] in "\"'([":
                m += 1
            if k > j and m < len(text) and re.match("[A-Z0-9]", text[m]):
                word = re.search(r"([A-Za-z.]+)\.$", text[start : i + 1])
                if not (word and (word[1].lower() in scores.ABBREVIATIONS or len(word[1]) == 1)):
                    out.append(text[start:k].strip())
                    start = k
                i = k
                continue
        elif text[i] == "\n":
            k = i + 1
            last = i
            while k < len(text) and text[k].isspace():
                if text[k] == "\n":
                    last = k
                k += 1
            if last > i:
                if piece := text[start : last + 1].strip():
                    out.append(piece)
                start = i = last + 1
                continue
        i += 1
    return [x for x in [*out, text[start:].strip()] if x]


def plain_stitch(sentences):
    out = []
    for s in sentences:
        if not any(c.isalpha() and ("A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ɏ") for c in s):
            continue
        stub = re.match(r"[(\[]?(see|cf|id|note|item|section|part)\b.{0,25}\Z", s, re.I) or re.match(r"\(?[a-z0-9]{1,3}\)?\.?\Z", s)
        if out and stub:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def test_sentence_split(spark, documents):
    want = {d: plain_stitch(plain_sentences(t)) for d, t in documents}
    got = {r["doc_id"]: (r["sentences"], r["longest"]) for r in catalog.QUERIES["sentence_split"](spark, SF).collect()}
    assert got == {d: (len(s), max(map(len, s))) for d, s in want.items() if s}


def test_sentence_scores(spark, documents):
    got = {r["doc_id"]: r for r in catalog.QUERIES["sentence_scores"](spark, SF).collect()}
    for d, t in documents:
        s = plain_stitch(plain_sentences(t))
        if not s:
            assert d not in got
            continue
        p = length_scorer(s)
        w = [len(re.split(r"[ \t\n\x0b\f\r]+", x)) for x in s]
        assert got[d]["sentence_count"] == len(s)
        assert got[d]["negative"] == pytest.approx(sum(a[0] * n for a, n in zip(p, w, strict=True)) / sum(w), abs=2e-6)
        assert got[d]["positive"] == pytest.approx(sum(a[2] * n for a, n in zip(p, w, strict=True)) / sum(w), abs=2e-6)


def test_clean_item_text(spark, documents):
    got = {r["doc_id"]: r for r in catalog.QUERIES["clean_item_text"](spark, SF).collect()}
    for d, t in documents:
        kept = "\n".join(x for x in t.replace("\r\n", "\n").split("\n") if not x.strip() or not page_line(x))
        listed = [x for x in kept[:2000].split("\n") if re.search(r"(\.{4,}|\bitem\s+\d+).*\b\d{1,3}\s*$", x, re.I)]
        assert len(listed) < 2 and not got[d]["toc_removed"]  # the table has none, the cases below do
        cut = int(len(kept) * 0.65)
        tail = re.search(r"^\s*(SIGNATURES?|EXHIBIT INDEX|PART\s+IV)\s*$", kept[cut:], re.M)
        kept = kept[: cut + tail.start()] if tail else kept
        while "\n\n\n" in kept:
            kept = kept.replace("\n\n\n", "\n\n")
        kept = kept.strip()
        assert (got[d]["n_chars"] or 0, got[d]["tail_removed"], got[d]["large_removal"]) == (len(kept), bool(tail), (1 - len(kept) / len(t) if t else 0) >= 0.4)


def test_clean_item_cases():
    toc = "".join(f"Item {i}. Something ........ {i}\n" for i in range(1, 6))
    c = items.clean_item(toc + f"{PROSE}\n" * 5 + "12\n" + f"{PROSE}\n" * 5 + "SIGNATURES\nJohn\n")
    assert c["toc_removed"] and c["tail_removed"] and "........" not in c["cleaned"] and "John" not in c["cleaned"] and "\n12\n" not in c["cleaned"]
    assert items.clean_item("") == {"cleaned": "", "toc_removed": False, "tail_removed": False, "removed_share": 0.0, "stub": False, "large_removal": False}


def ids(text, form="10-K"):
    return [(x["item_part"], x["item_id"], x["heading_start"]) for x in items.segment(text, form)]


def test_all_candidates_of_an_item_are_looked_at():
    listed = "".join(f"Item 1. Business ........ {i}\n" for i in range(1, 10))
    text = listed + f"Item 1. Business\n{PROSE}\n{PROSE}\nItem 2. Properties\n{PROSE}\n"
    assert ids(text)[0] == ("I", "1", len(listed))


def test_contents_roman_numbers_and_short_items():
    text = f"TABLE OF CONTENTS\nItem 1. Business 3\nItem 2. Properties 9\nPART I\nItem I. Business\n{PROSE}\nItem 2. Properties\n{PROSE}\nItem 3. Legal Proceedings\nNone.\nItem 4. Other\n{PROSE}"
    got = {i: s for _, i, s in ids(text)}
    assert got["1"] == text.index("Item I.") and got["2"] == text.rindex("Item 2.") and list(got) == ["1", "2", "3", "4"]
    assert items.item_number("IX") == 9 and items.item_number("XIV") == 14 and items.item_number("7") == 7


def test_quarterly_parts_by_marker_and_by_restart():
    body = f"\n{PROSE}\n"
    marked = f"PART I\nItem 1. Financial Statements{body}Item 2. Management's Discussion{body}PART II\nItem 1. Legal Proceedings{body}Item 6. Exhibits{body}"
    assert [x[:2] for x in ids(marked, "10-Q")] == [("I", "1"), ("I", "2"), ("II", "1"), ("II", "6")]
    bare = marked.replace("PART I\n", "").replace("PART II\n", "")
    assert [x[:2] for x in ids(bare, "10-Q")] == [("I", "1"), ("I", "2"), ("II", "1"), ("II", "6")]
    assert ids(marked, "10-Q/A") == []


def test_filing_text_cases(spark):
    rows = [
        (1, f"Item 7. MD&A\n{PROSE}\nItem 8. Financial Statements\nmore", 7), (2, f"{PROSE} see Item 8. of this\n", 7), (3, f"Item 6. x\n{PROSE}", 7), (4, None, 7),
    ]
    df = spark.createDataFrame(rows, "id int, body string, n int")
    got = {r["id"]: r["at"] for r in df.select("id", filing_text.embedded_heading(F.col("body"), F.col("n")).alias("at")).collect()}
    assert got == {1: rows[0][1].index("Item 8") + 1, 2: 0, 3: 0, 4: 0}
    notes = spark.createDataFrame([("Pursuant to General Instruction J of Form 10-K, items are omitted",), ("General Instruction I(2): reduced disclosure format",), ("General instructions J of the game",), (None,)], "t string")
    assert [r[0] for r in notes.select(filing_text.omits_by_instruction(F.col("t"))).collect()] == [True, True, False, False]
    long = f"{PROSE}\n" * 20
    cases = {"index": long + "EXHIBIT INDEX\n3.1 By-laws\n", "cluster": long + "Exhibit 10.1 Lease\nExhibit 10.2 Loan\n", "single": long + "Exhibit 10.1 Lease\n", "early": "EXHIBIT INDEX\n" + long, "tag": long + "<EX-21>\nlist\n", "none": long, "empty": "", "null": None}
    docs = spark.createDataFrame(list(cases.items()), "name string, text string")
    out = {r["name"]: (r["tail_start"], r["cleaned"]) for r in filing_text.clean_documents(docs).collect()}
    assert all(out[n] == (len(long), long.rstrip()) for n in ("index", "cluster", "tag")) and all(out[n] == (None, cases[n]) for n in ("single", "early", "none", "empty", "null"))
    assert all(r["cleaned"] == r["text"] for r in filing_text.clean_documents(docs, contract="whole").collect())
    with pytest.raises(ValueError, match="contract"):
        filing_text.clean_documents(docs, contract="other")
