"""Edge cases of every operator on small frames: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerline.llm import html_text, line_frequency, mixing, packing, quality_vote, secrets, shingle_links, token_counts, vector_links, warc
from ledgerline.llm.bpe import ODD, PIECE, PieceEncoder, check_rules
from ledgerline.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, shard long, piece string, host string, hits string, doc string"
WORD = re.compile(r"[^ \t-\r]+")


def frame(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), -1, -1, -1, "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    base = " ".join(f"word{i}" for i in range(60))
    return [
        (1, base, "a"), (2, base, "b"), (3, base.replace("word30", "other"), "a"), (4, None, None), (5, "", "a"), (6, "one two", "b"), (7, "one two", None), (None, "alone here", "c"),
        (8, "x" * 30_000 + " " + "y z " * 9000, "a"), (9, "Grüße <|endoftext|> 漢字 \x1c \x85 ✓\n\n  end", "b"), (9, "Grüße <|endoftext|> 漢字 \x1c \x85 ✓\n\n  end", "b"),
    ]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_piece_encoder_is_the_library(tokenizer):
    e = PieceEncoder(BPE)
    odd = ["", " ", "a\n\n b\t\tc  ", "don't we'll", "<|endoftext|>x<|endoftext|>", "٣٤ ՘ 𝟘", "x" * 250_000, " \x1c\x1d a"]
    for t, ids in zip(odd, e.encode(odd), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    for c in range(0, 0x3000):
        if not ODD.match(chr(c)):
            s = f"a{chr(c)}1{chr(c)}  !{chr(c)} {chr(c)}\n"
            assert [m.span() for m in PIECE.finditer(s)] == [o for _, o in tokenizer.pre_tokenizer.pre_tokenize_str(s)]


def test_piece_encoder_on_many_scripts(tokenizer):
    e, rng = PieceEncoder(BPE), np.random.default_rng(23)
    blocks = [(32, 127), (160, 591), (880, 1327), (0x2000, 0x206F), (0x3041, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F5FF), (9, 13)]
    strings = ["".join(chr(int(rng.integers(*blocks[int(b)]))) + " " * int(rng.random() < 0.2) for b in rng.integers(0, len(blocks), int(n))) for n in rng.integers(1, 400, 300)]
    strings += ["".join(chr(int(c)) for c in rng.integers(*b, 300)) for b in blocks for _ in range(5)]
    strings += [" ".join(strings) * 3, "ab " * 90_000]  # long ones, each way
    for t, ids in zip(strings, e.encode(strings), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    rules = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": []}
    check_rules(rules, "x")
    token = {"special": True, "lstrip": False, "rstrip": False, "single_word": False, "normalized": False}
    check_rules(rules | {"added_tokens": [token]}, "x")
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": rules["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [token | {"special": False}]}, {"added_tokens": [token | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="byte-level"):
            check_rules(rules | change, "x")


def test_token_counts(spark, texts, tokenizer):
    got = sorted(map(tuple, token_counts.token_counts(frame(spark, texts), BPE).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in texts]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(frame(spark, []), BPE).count() == 0


def test_token_counts_joins_rare_pieces(spark, texts, tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAD", 3)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(frame(spark, texts), BPE).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, _ in texts}


def test_packing_round_trip(spark, texts, tokenizer):
    rows = packing.pack_sequences(frame(spark, texts), BPE).collect()
    want = sorted(((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in texts), key=repr)
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    for i, ids in want:
        copies = sum(j == i for j, _ in want)  # of a repeated row
        found = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in found) == copies * len(ids)
        for r in found:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        seen = np.zeros(len(ids) + 1, int)
        for r in found:
            seen[r["start"]] += 1
            seen[r["start"] + r["length"]] -= 1
        assert (np.cumsum(seen)[:-1] == copies).all()
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in want)
    assert packing.pack_sequences(frame(spark, []), BPE).count() == 0


def test_packing_assignment_is_tight():
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 2048, 500)]
    pieces = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    filled = {}
    for _, _, n, s, offset in pieces:
        assert offset == filled.get(s, 0)
        filled[s] = offset + n
    assert sum(filled.values()) == sum(lengths) and max(filled.values()) <= 2048 and len(filled) == -(-sum(lengths) // 2048)


def test_packing_ties_do_not_follow_arrival(spark):
    rows = [(i, "one two three four five " * 20, "a") for i in range(300)]
    get = lambda n: sorted(map(tuple, packing.pack_sequences(frame(spark, rows).orderBy(F.col("doc_id") * n % 307).coalesce(1), BPE).collect()))
    assert get(1) == get(5)


def test_html():
    page = """<!doctype html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=1>Home</a></nav>
    <main><h2>Heading</h2><p>This is the first paragraph of the text, and it has a good many of the usual words.<p>Short &amp; sweet.<ul><li>One</li><li>Two</li></ul>
    <p>Here is the last of the paragraphs, which is as long as it has to be for a rule.</p><div class="share-buttons">Share this with all of your friends on the web today</div><form>Your name and the rest of it</form></main>
    <div id="comments"><p>I think that this was a very good article and I want more of it in the future.</p></div><aside>More about the author of this</aside><footer>&copy; All of it</footer><script>var x = "<p>no</p>"</script>"""
    assert html_text.main_text(page).split("\n") == [
        "Heading", "This is the first paragraph of the text, and it has a good many of the usual words.", "Short & sweet.", "One", "Two", "Here is the last of the paragraphs, which is as long as it has to be for a rule.",
    ]
    plain = "<body><div><a href=1>Home</a> <a href=2>News and more of it</a></div><p>" + "It was the best of the times and it was the worst of them for all. " * 3 + "</p><p>Yes.</p><p>" + "And so it was that we went to the house on the hill with all of the others. " * 3 + "</p></body>"
    got = html_text.main_text(plain).split("\n")
    assert len(got) == 3 and got[1] == "Yes."
    for odd in (None, "", "<", "<p", "no markup at all", "<p>" * 5000, "</p></div></body>", "<script>never closed", "&#x41;&bogus;&#0;"):
        assert isinstance(html_text.main_text(odd), str)


PROSE = "It was the best of the times and it was the worst of them for all of us. "


@pytest.mark.parametrize("around", ["<div class='wrapper sidebar-right'>{}</div>", "<div id='page' class='nav-open'>{}</div>", "<div class='layout header-fixed'>{}</div>", "<div class='site menu-left'><div class='row has-tags search'>{}</div></div>"])
@pytest.mark.parametrize("body", ["<article><p>{0}</p><p>{0}</p></article>", "<main><p>{0}</p><p>{0}</p></main>", "<p>{0}</p><p>{0}</p>"])
def test_html_names_around_the_article(around, body):
    side = "<div class='sidebar'><p>This is what the others have read and it is not of the text.</p></div>"
    page = "<body>" + around.format(body.format(PROSE * 4)) + side + "</body>"
    assert html_text.main_text(page).split("\n") == [(PROSE * 4).strip()] * 2


def test_html_names_inside_the_article():
    related = "<div class='related'><article><p>You will want to read this one of the others as well.</p></article></div>"
    page = f"<article><h2 id='Legal_status'>Legal status</h2><p>{PROSE}</p><section id='Search_methods'><h3>Methods</h3><p>{PROSE}</p></section><div class='share'>Share this with all of the friends you have</div></article>{related}"
    assert html_text.main_text(page).split("\n") == ["Legal status", PROSE.strip(), "Methods", PROSE.strip()]
    long = f"<main><p>{PROSE}</p><div id='comments'><p>{PROSE * 2}</p></div></main>"
    assert html_text.main_text(long) == PROSE.strip()


@pytest.mark.parametrize("tag", ["svg", "math", "noscript", "object", "select", "iframe"])
def test_html_unclosed_raw_tags(tag):
    assert PROSE.strip() in html_text.main_text(f"<article><p>First of all.</p><{tag}><p>{PROSE}</p></article>")
    assert PROSE.strip() not in html_text.main_text(f"<article><p>First of all.</p><script><p>{PROSE}</p></article>")


def test_html_keeps_math_and_object_text():
    page = f"<article><p>{PROSE} So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> is it.</p><object data='a'><p>{PROSE}</p></object></article>"
    assert html_text.main_text(page).split("\n") == [f"{PROSE} So x=2 is it.".replace("  ", " "), PROSE.strip()]


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>It is a text of the house.</p></article>", 5), (None, None, None, 5), (1, "u", "", 5)], "page_id long, url string, html string, n_chars long")
    assert sorted(map(tuple, html_text.extract_main_text(df).collect()), key=repr) == sorted([(1, "u", "It is a text of the house.", 26), (None, None, "", 0), (1, "u", "", 0)], key=repr)
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_line_rules(spark, texts):
    got = line_frequency.line_rules(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] in (4, 5):
            assert r["n_words"] == 0 and r["base_failed"] and not r["kept"]
    assert next(r for r in got if r["doc_id"] == 1)["kept"]
    assert line_frequency.line_rules(frame(spark, [])).count() == 0


def test_line_rules_counts_distinct_documents_per_host(spark):
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(30))
    rows = [(i, f"Common  Line 12 of all\n{own(i)}", "a") for i in range(25)] + [(100 + i, "common line 7 of ALL\n" + own(100 + i), "b") for i in range(5)]
    rows += [(200 + i, "\n".join(f"copied line {k} of the same text" for k in "abcdef"), "a") for i in range(40)]  # copies are documents of their own
    rows += [(300, "Common line 12 of all\nx", "a")] * 30  # one document, however often it is listed
    rows += [(400, "rare line of one document only, and it has to be long enough to be kept here", None)] * 30
    rows += [(500 + i, f"number page {i} of the whole report\n{own(500 + i)}", "p") for i in range(25)]
    rows += [(600 + i, f"{i} 30 45\n7 {i} 1\n{own(600 + i)}", "t") for i in range(30)]  # tables of numbers are no common lines
    got = {r["doc_id"]: r for r in line_frequency.line_rules(frame(spark, rows)).collect()}
    assert all(got[i]["n_removed_words"] == 5 and got[i]["kept"] for i in range(25))
    assert all(got[100 + i]["n_removed_words"] == 0 for i in range(5))
    assert all(got[200 + i]["n_removed_words"] == 42 and not got[200 + i]["kept"] for i in range(40))
    assert not got[300]["kept"] and got[400]["kept"] and got[400]["n_removed_words"] == 0
    assert all(got[500 + i]["n_removed_words"] == 7 and got[500 + i]["kept"] for i in range(25))
    assert all(got[600 + i]["n_removed_words"] == 0 and got[600 + i]["kept"] for i in range(30))


def test_line_rules_return_texts_without_common_lines(spark):
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(30))
    rows = [(i, f"Common line of all\n\n{own(i)}", "a") for i in range(25)] + [(100, "common line of all\nx", "b"), (None, None, "a")]
    got = {r["doc_id"]: r["text"] for r in line_frequency.line_rules(frame(spark, rows), texts=True).collect()}
    assert got == {**{i: f"\n{own(i)}" for i in range(25)}, 100: rows[25][1], None: ""}


@pytest.mark.parametrize("text", ["", "a b", "a b c d e a b c d e", "a b c d e f a b c d e x y", "a " * 30, "a b c d e f g h i j"])
def test_repeated_words(text):
    w = text.split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    assert line_frequency.repeated_words(w) == len(want)


def test_mixing(spark):
    rows = [(i, "w " * (i % 7 + 1), s) for i, s in enumerate("aaaaaaaaaaaabbbbcccccccccddddddd")] + [(None, "q q", None), (50, None, "a"), (51, "", "e"), (3, "again and again", "a")]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    total, cap = sum(r["size"] for r in got), {}
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in got)
    assert total - 10 <= sum(r["taken"] for r in got) <= total
    for r in got:
        cap[r["source_size"], r["target"]] = cap.get((r["source_size"], r["target"]), 0) + r["taken"]
    assert all(t <= 3 * s + 1e-9 and abs(k - t) <= 16 for (s, t), k in cap.items())
    assert abs(sum(t for _, t in cap) - total) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(frame(spark, rows).repartition(3)).collect()))
    assert mixing.mix_sources(frame(spark, [])).count() == 0 and mixing.mix_sources(frame(spark, [(1, None, None)])).first()["taken"] == 0
    mixed = mixing.apply_mix(frame(spark, rows[:-1]))
    assert mixed.columns == frame(spark, []).columns and mixed.count() == sum(r["taken"] // r["size"] for r in mixing.mix_sources(frame(spark, rows[:-1])).collect() if r["size"])


def brute_links(rows):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def near_copies():
    rng = np.random.default_rng(7)
    rows = []
    for family in range(12):
        words = [f"f{family}w{rng.integers(400)}" for _ in range(int(rng.integers(4, 160)))]
        for _ in range(int(rng.integers(1, 14))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 1 + len(words) // 12))):
                copy[int(rng.integers(len(copy)))] = f"n{rng.integers(10**6)}"
            if rng.random() < 0.3:
                copy = ["shared", *[f"passage{k}" for k in range(30)], *copy]
            rows.append((len(rows), " ".join(copy), "a"))
    return rows


@pytest.mark.parametrize("unit", [4_000_000, 300])
def test_shingle_links(spark, texts, monkeypatch, unit):
    monkeypatch.setattr(shingle_links, "UNIT", unit)
    rows = near_copies() + [((i or 0) + 1000 if i else i, t, s) for i, t, s in texts] + [(2000, "A B c", None), (2001, "a b C", None), (2002, "Ä b c", None)]
    got = shingle_links.link_shingles(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_links(rows)
    assert shingle_links.link_shingles(frame(spark, [])).count() == 0


def test_shingle_links_in_blocks_of_signatures(spark, monkeypatch):
    monkeypatch.setattr(shingle_links, "BUCKET", 60)
    rows = near_copies()
    assert sorted(map(tuple, shingle_links.link_shingles(frame(spark, rows)).collect()), key=repr) == brute_links(rows)


def similar_sets(rng, n):
    """A set of ``n`` hashes and one that shares just enough of it, of smaller, equal or greater size."""
    own = rng.integers(0, 1 << 63, 3 * n + 3, dtype=np.uint64)
    size = int(rng.integers(-(-3 * n // 4), n * 4 // 3 + 1))
    least = -(-75 * (n + size) // 175)
    return np.sort(own[:n]), np.sort(np.r_[own[:least], own[n : n + size - least]])


@pytest.mark.parametrize("percent", [75, 90])
def test_similar_sets_share_a_signature_and_pass_the_sketch(percent):
    rng = np.random.default_rng(13)
    low = shingle_links.bands(percent, 4000)
    for n in [*range(1, 60), *rng.integers(60, 2500, 150)]:
        for _ in range(4):
            x, y = similar_sets(rng, int(n))
            shared = len(np.intersect1d(x, y))
            if 100 * shared < percent * (len(x) + len(y) - shared) or np.array_equal(x, y):
                continue
            a, b = ({int(v) for _, v in shingle_links.signatures(s, percent, low) for v in v} for s in (x, y))
            assert a & b
            sets = shingle_links.Sketched(np.array([len(x), len(y)]), [shingle_links.parities(s).tobytes() for s in (x, y)], percent)
            assert sets.possible(np.array([0, 1]), np.array([1, 0])).all()


def test_signatures_cover_subsets_of_partitions():
    rng = np.random.default_rng(17)
    s = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    (_, n1, k), *_ = shingle_links.band_pairs(300, 75, shingle_links.bands(75, 500))
    first = next(v for _, v in shingle_links.signatures(np.sort(s), 75, shingle_links.bands(75, 500)))
    assert n1 > k // (shingle_links.SPOILT + 1) and len(first) <= 3 * n1 + k + 1 and len(first) > 2 * n1


def test_packed_fingerprints():
    rng = np.random.default_rng(19)
    for values in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.unique(rng.integers(0, 1 << 48, 1000, dtype=np.uint64)), np.unique(rng.integers(0, 1 << 30, 1000, dtype=np.uint64))):
        assert np.array_equal(shingle_links._unpacked(shingle_links._packed(values)), values)


@pytest.mark.parametrize("stage", ["keep_one", "apply_mix"])
def test_stages_keep_columns_of_any_name(spark, texts, stage):
    names = ("gone", "twice", "key", "row", "copies", "mixed_id", "mixed_copies", "mixed_copy", "side", "family")
    df = spark.createDataFrame([(i, t, s) for i, t, s in texts], "doc_id long, text string, source string").select("*", *[F.lit(n).alias(n) for n in names])
    plain = df.select("doc_id", "text", "source")
    f = shingle_links.keep_one if stage == "keep_one" else mixing.apply_mix
    got = f(df)
    assert got.schema.names == df.schema.names
    assert sorted(map(repr, got.select("doc_id", "text", "source").collect())) == sorted(map(repr, f(plain).collect()))
    assert f(df.limit(0)).count() == 0


def test_keep_one(spark, texts):
    rows = near_copies() + [((i or 0) + 1000 if i else i, t, s) for i, t, s in texts]
    kept = [r["doc_id"] for r in shingle_links.keep_one(frame(spark, rows)).collect()]
    want = brute_links(rows)
    assert sorted(map(repr, kept)) == sorted({repr(d) for d, _, c in want if d == c})


def test_keep_one_tells_texts_of_one_id_apart(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, long("a"), "x"), (5, long("a"), "x"), (5, long("b"), "x"), (None, long("c"), "x"), (None, long("d"), "x"), (None, long("d"), "x"), (None, long("b"), "x"), (7, None, "x"), (7, "", "x"), (8, long("e"), "x"), (8, long("e").replace("e7 ", "zz "), "x")]
    kept = sorted(((r["doc_id"], (r["text"] or "")[:2]) for r in shingle_links.keep_one(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted([(1, "a0"), (5, "b0"), (None, "c0"), (None, "d0"), (7, ""), (7, ""), (8, "e0")], key=repr)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (120, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(5001, 5100)]
    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in root} == root


def test_secrets(spark):
    rows = [
        (1, 'é token: token: abcdefgh password="hunter22" AKIA' + "A" * 16 + " AKIAshort deadbeef", "a"), (2, "key " + "0123456789abcdef" * 2 + " Secret=abc", "b"), (3, "key " + "0123456789abcdef" * 2, "c"),
        (4, None, None), (5, "", None), (6, "key " + "0123456789abcdef" * 2 + " aB3dE5fG7hI9jK1lM3nO5pQ", "d"), (6, "plain", "d"), (7, "api_key=" + "ab" * 20, "a"),
    ]
    got = secrets.scan_secrets(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]): r for r in got}
    first = by[1, 1, 1, 0]
    spans = "assign:25:43,access:45:65"
    assert first["spans"] == spans and first["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert by[6, 0, 0, 1]["n_owner"] == 1 and by[6, 0, 0, 1]["n_example"] == 1 and by[6, 0, 0, 1]["spans"] == "hex:4:36,owner:37:60"
    assert by[7, 1, 0, 1]["spans"] == "assign:0:48,hex:8:48"
    assert by[4, 0, 0, 0]["spans"] == "" and secrets.scan_secrets(frame(spark, [])).count() == 0
    masked = {r["doc_id"]: r for r in secrets.redact_secrets(frame(spark, [r for r in rows if r != rows[6]])).collect()}
    assert masked[7]["text"] == "[SECRET]" and masked[7]["n_chars"] == 8 and masked[4]["text"] is None
    assert masked[6]["text"].endswith("ef [SECRET]") and masked[3]["text"] == rows[2][1]


def test_secrets_of_one_owner_in_several_documents(spark):
    key, shared = "aB3dE5fG7hI9jK1lM3nO5pQ", "zY8xW6vU4tS2rQ0pO9nM7lK"
    rows = [(1, f"key {key}", "a"), (2, f"key {key}", "a"), (3, f"again {key} end", "a"), (4, f"key {shared}", "a"), (5, f"key {shared}", "b")]
    got = {r["doc_id"]: (r["spans"], r["n_owner"], r["n_live"]) for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert got == {1: ("owner:4:27", 1, 1), 2: ("owner:4:27", 1, 1), 3: ("owner:6:29", 1, 1), 4: ("", 0, 0), 5: ("", 0, 0)}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(frame(spark, rows)).collect()}
    assert masked == {1: "key [SECRET]", 2: "key [SECRET]", 3: "again [SECRET] end", 4: rows[3][1], 5: rows[4][1]}


def test_quality(spark):
    good = [(i, " ".join(f"Word{(i * k) % 97} and the others." for k in range(20)), "a") for i in range(60)]
    bad = [(100 + i, " ".join(["SPAM!!"] * (20 + i)), "a") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _, _ in good + bad] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = good + bad + [(None, None, None), (500, "", "b"), (501, "x" * 50_000, "b"), (1, good[1][1], "a")]
    got = quality_vote.quality_scores(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 200]
    assert held and all((r["predicted"] == 1) == (r["doc_id"] < 100) for r in held)
    assert {r["score"] for r in quality_vote.quality_scores(frame(spark, rows[:3]), labels.limit(0)).collect()} == {0.5}
    assert quality_vote.quality_scores(frame(spark, []), labels).count() == 0
    kept = quality_vote.keep_quality(frame(spark, rows), labels)
    assert kept.schema == frame(spark, rows).schema and kept.count() == sum(r["predicted"] for r in got)


def test_quality_ignores_held_out_labels(spark):
    rows = [(i, f"text number {i} of the lot", "a") for i in range(50)]
    label = lambda flip: spark.createDataFrame([(i, int(i % 2 == 0) ^ int(flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i, _, _ in rows], "doc_id long, quality int")
    a, b = (sorted(map(tuple, quality_vote.quality_scores(frame(spark, rows), label(f)).collect())) for f in (False, True))
    assert a == b


def vectors(spark, rows):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("gid", T.LongType())])
    return spark.createDataFrame([(*r, 0, 0) for r in rows], kind)


@pytest.mark.parametrize(("cell", "block"), [(1000, 2000), (5, 2000), (5, 7)])
def test_vector_links(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vector_links, "CELL_ROWS", cell)
    monkeypatch.setattr(vector_links, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    x = [np.float32(centres[i % 6] + rng.normal(size=8) * rng.choice([0.05, 0.25, 1.0])).tolist() for i in range(150)]
    rows = [(i, v, i % 2) for i, v in enumerate(x)] + [(200, x[0], 0), (200, x[0], 0), (201, x[0], None), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("nan")] * 8, 0), (205, [None, *x[0][1:]], 0), (206, [], 0), (207, x[0][:4], 0), (None, x[1], 1)]
    got = sorted(map(tuple, vector_links.link_vectors(vectors(spark, rows)).collect()), key=repr)
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, _ in rows]
    link = np.zeros((len(rows),) * 2, bool)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and ok[i] and ok[j] and la is not None and la == lb and len(a) == len(b):
                link[i, j] = np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.93
    root = list(range(len(rows)))
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = root[i], root[j]
        root = [b if r == a else r for r in root]
    want = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        c = min(ids) if ids else None
        want.append((d, int(link[i].sum()), c, None if d is None else d == c))
    assert got == sorted(want, key=repr)
    assert vector_links.link_vectors(vectors(spark, [])).count() == 0


def pages(spark):
    html = "<p>Grüße &amp; more</p>" * 50
    return [(3, "u3", html, 0), (1, "u1\r\nX: y", html, 0), (2, None, "other", 0), (4, "u4", None, 0), (5, "u5", "", 0), (2, None, "other", 0), (None, "n", "only", 0)]


def test_warc_round_trip(spark, tmp_path):
    rows = pages(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    got = sorted(map(tuple, warc.archive_round_trip(df, f"file://{tmp_path}/w").collect()), key=repr)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = i is not None and first[h or ""] != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_reads_other_archives_and_pushes_filters(spark, tmp_path):
    import gzip

    record = lambda kind, n, body: b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x:%d>\r\nWARC-Target-URI: http://x/%d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, n, n, len(body), body)
    big = b"z" * 200_000
    records = [record(b"warcinfo", 1, b"info"), record(b"resource", 2, big), record(b"resource", 3, b"three")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    warc.register(spark)
    df = spark.read.format("warc").load(f"file://{tmp_path}")
    assert df.filter("record_type = 'resource'").select("record_id", F.length("payload")).distinct().count() == 2
    assert [r[0] for r in df.filter("target_uri = 'http://x/3'").select("payload").collect()] == [bytearray(b"three")] * 2
    heads = spark.read.format("warc").schema("record_type string, content_length long").load(f"file://{tmp_path}").collect()
    assert sorted(r["content_length"] for r in heads) == [4, 4, 5, 5, 200_000, 200_000]
    with pytest.raises(Exception, match="digest"):
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad/c.warc").write_bytes(record(b"resource", 1, b"abc").replace(b"Content-Length", b"WARC-Payload-Digest: sha1:AAAA\r\nContent-Length"))
        spark.read.format("warc").load(f"file://{tmp_path}/bad").collect()


def test_warc_reads_subfolders_and_foreign_archives(spark, tmp_path):
    pages_df = spark.createDataFrame(pages(spark), "page_id long, url string, html string, payload long")
    root = f"file://{tmp_path}/all"
    warc.write_pages(pages_df, f"{root}/mine")
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "all/mine/foreign.warc").write_bytes(record)
    (tmp_path / "all/deep/er").mkdir(parents=True)
    (tmp_path / "all/deep/er/part-0.warc").write_bytes(record)
    (tmp_path / f"all/mine/part-{'0' * 32}.warc.gz").write_bytes(b"lost attempt")
    df = spark.read.format("warc").load(root)
    assert df.count() == 7 + 2 and df.filter("record_type = 'resource'").count() == 2
    warc.write_pages(pages_df, f"{root}/mine")
    assert spark.read.format("warc").load(root).count() == 14 + 2


def test_warc_very_long_payload(spark, tmp_path):
    html = "x" * 30_000_000
    df = spark.createDataFrame([(1, "u", html), (2, "v", html), (3, None, "y")], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archive_round_trip(df, f"file://{tmp_path}/long").collect()))
    digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert got[:2] == [(1, 30_000_000, digest, "response", None), (2, 30_000_000, digest, "revisit", 1)]


def test_warc_payload_length_without_the_payload(spark, tmp_path):
    import gzip

    noise = np.random.default_rng(1).bytes(200_000)
    fill = b"".join(b"X-%d: %s\r\n" % (i, noise[i * 50 : i * 50 + 50].hex().encode()) for i in range(300))  # a head beyond one piece
    http = lambda head: b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + noise[:50_000]
    bodies = [(b"resource", b"text/plain", noise, 200_000), (b"metadata", b"text/plain", noise[:9000], 9000), (b"warcinfo", b"text/plain", b"info", 4)]
    bodies += [(b"response", b"application/http", http(head), 50_000) for head in (b"A: b\r\n", b"Content-Length: 50000\r\n", fill, fill + b"Content-Length: 50000\r\n")]
    records = [b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, i, t, len(b), b) for i, (k, t, b, _) in enumerate(bodies)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    warc.register(spark)
    want = sorted((f"<urn:x:{i}>", n) for i, (*_, n) in enumerate(bodies) for _ in range(2))
    for more in ("", ", payload binary"):
        rows = spark.read.format("warc").schema(f"record_id string, payload_length long{more}").load(f"file://{tmp_path}").collect()
        assert sorted((r["record_id"], r["payload_length"]) for r in rows) == want


def test_secrets_of_null_owners(spark):
    key, both = "aB3dE5fG7hI9jK1lM3nO5pQ", "zY8xW6vU4tS2rQ0pO9nM7lK"
    rows = [(1, f"key {key}", None), (2, f"key {key}", None), (3, f"key {both}", None), (4, f"key {both}", "a"), (None, f"key {both}", "a")]
    got = sorted(((r["doc_id"], r["spans"]) for r in secrets.scan_secrets(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, "owner:4:27"), (2, "owner:4:27"), (3, ""), (4, ""), (None, "")], key=repr)


def test_secrets_by_owners_and_repositories(spark):
    one, more, two, three = ("aB3dE5fG7hI9jK1lM3nO5pQ", "zY8xW6vU4tS2rQ0pO9nM7lK", "5" * 24, "7" * 24)
    rows = [
        (1, f"key {one}", "a", "r"), (2, f"key {one}", "a", "r"), (3, f"key {more} {two}", "a", "r"), (4, f"key {more}", "a", "s"), (5, f"key {more} {three}", "a", None),
        (6, f"key {two} {three}", "b", "r"), (7, f"key {three}", None, "r"), (7, f"key {three}", None, "s"), (8, None, "a", "s"), (None, f"key {one}", "a", "r"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    judge = lambda **given: sorted(((r["doc_id"], [tuple(f) for f in r["findings"]]) for r in secrets.scan_secrets(docs, **given).collect()), key=repr)
    ones, mores, twos, threes = (1, 1, "single"), (1, 3, "reused"), (2, 2, "shared"), (3, 4, "example")
    want = [
        (1, [("owner", 4, 27, *ones)]), (2, [("owner", 4, 27, *ones)]), (3, [("owner", 4, 27, *mores), ("hex", 28, 52, *twos)]), (4, [("owner", 4, 27, *mores)]), (5, [("owner", 4, 27, *mores), ("hex", 28, 52, *threes)]),
        (6, [("hex", 4, 28, *twos), ("hex", 29, 53, *threes)]), (7, [("hex", 4, 28, *threes)]), (7, [("hex", 4, 28, *threes)]), (8, []), (None, [("owner", 4, 27, *ones)]),
    ]
    assert judge(repo_col="repo") == sorted(want, key=repr)
    by_doc = {i: [f[3:] for f in found] for i, found in judge()}  # without a column, each document is a repository
    assert by_doc[1] == by_doc[None] == [(1, 3, "reused")] and by_doc[4] == [(1, 3, "reused")] and by_doc[7] == [(3, 3, "example")]
    a, b = (sorted(map(repr, secrets.redact_secrets(docs, **given).collect())) for given in ({}, {"repo_col": "repo"}))
    assert a == b and sum("[SECRET]" in r for r in a) == 7


def test_mixing_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i // 2, "same words here", "ab"[i % 2]) for i in range(60)] + [(None, "same words here", None)] * 3
    a = frame(spark, rows)
    first, again, dealt = (mixing.mix_sources(df).collect() for df in (a, a, a.repartition(5)))
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and [r["size"] for r in first].count(3) == 63
    taken = [sum(r["taken"] for r in rows) for rows in (first, dealt)]
    assert taken[0] == taken[1] and 0 <= 63 * 3 - taken[0] < 3


def test_mixing_sources_without_words(spark):
    rows = [(i, "some words of this one", "a") for i in range(20)] + [(100, "", "b"), (101, None, "c"), (102, " \n\t", None)]
    got = {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix_sources(frame(spark, rows)).collect()}
    assert all(got[i] == (0.0, 0) for i in (100, 101, 102)) and sum(t for _, t in got.values()) == 100


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(o), int(v)) for k in range(3) for o, v in zip(rng.choice(100_000, 400, replace=False), rng.integers(0, 50, 400), strict=True)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = {(r["k"], r["o"]): r["before"] for r in mixing.running_sums(df, ["k"], "o", "v").collect()}
    assert got == {(k, o): sum(v for k2, o2, v in rows if k2 == k and o2 < o) for k, o, _ in rows}
    alone = df.filter("k = 0")
    assert {r["o"]: r["before"] for r in mixing.running_sums(alone, [], "o", "v").collect()} == {o: b for (k, o), b in got.items() if k == 0}
