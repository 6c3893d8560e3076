"""The block rules of HTML extraction against a plain version of their own, over whole tables, with and without semantic tags."""

import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from ledgerline.llm import html_text as H

PAGES = "/root/testdata/sf0.01/pages.parquet"
CUT = {"html", "head", "body", "nav", "ul", "li", "div", "article", "h1", "p", "footer", "section", "table", "tr", "td"}


class Plain(HTMLParser):
    """Blocks of the given tables' pages: (text, tag, link characters, in an article, out)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.parts, self.links = [], [], [], 0

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            tags = [t for t, _ in self.open]
            out = bool({"nav", "footer"} & set(tags)) or any(c == "ad" for _, c in self.open)
            self.blocks.append((text, next((t for t in reversed(tags) if t in CUT), ""), self.links, "article" in tags, out))
        self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("meta", "br"):
            self.parts.append(" " if tag == "br" else "")
            return
        if tag in CUT:
            self.flush()
            for i in range(len(self.open) - 1, -1, -1):  # an open paragraph ends here, with what is open in it
                if self.open[i][0] == "p":
                    del self.open[i:]
                    break
                if self.open[i][0] in CUT:
                    break
        self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in CUT:
            self.flush()
        at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if not {"script", "style", "title"} & {t for t, _ in self.open}:
            self.parts.append(data)
            if any(t == "a" for t, _ in self.open):
                self.links += len(re.sub(r"\s", "", data))


def plain_text(page):
    p = Plain()
    p.feed(page)
    p.flush()
    measured = []
    for text, tag, links, inside, out in p.blocks:
        words = [w.lower() for w in re.findall(r"\w+", text)]
        measured.append((len(words), sum(w in H.STOP_WORDS for w in words), links / len(re.sub(r"\s", "", text)), tag, inside, out, text))
    long = [(n, s) for n, s, link, _, _, out, _ in measured if n >= 12 and link <= 0.5 and not out]
    low, high = (0.12, 0.25) if sum(s for _, s in long) >= 0.12 * sum(n for n, _ in long) else (0, 0)
    article = any(m[4] and not m[5] for m in measured)

    def first(n, s, link, tag, inside, out, text):
        share = s / max(1, n)
        if out:
            return False
        if link > 0.5:
            return False if n >= 6 or not inside else None
        if not inside and n <= 40 and re.match(r"©|copyright\b", text, re.I):
            return False
        if n >= 12 and share >= (low if tag == "p" else high) or inside and n >= 6 and share >= low:
            return True
        return False if n >= 12 and share < low and not inside and tag != "p" else None

    labels = [first(*m) for m in measured]
    if article:
        inner = sum(len(m[6]) for m, x in zip(measured, labels, strict=True) if m[4] and x is not False)
        outer = sum(len(m[6]) for m, x in zip(measured, labels, strict=True) if not m[4] and x is True)
        assert inner >= outer  # no teasers in the tables
        labels = [False if not m[4] else x for m, x in zip(measured, labels, strict=True)]
    if True not in labels:
        labels = [True if x is None and m[3] == "p" else x for m, x in zip(measured, labels, strict=True)]
    final = []
    for i, m in enumerate(measured):
        if labels[i] is not None:
            final.append(labels[i])
            continue
        same = [j for j, o in enumerate(measured) if labels[j] is not None and o[4] == m[4]]
        sides = [max((j for j in same if j < i), default=None), min((j for j in same if j > i), default=None)]
        if m[3] == "h1" and sides[1] is not None:
            sides[0] = None
        far = sorted((abs(i - j) + 2 * (measured[j][3] != m[3]), labels[j]) for j in sides if j is not None)
        if not far:
            final.append(m[4] or not any(x is not None for x in labels) and not m[2] and m[3] != "h1" and len(m[6]) > 40)
        elif len(far) == 2 and far[0][0] == far[1][0] and far[0][1] != far[1][1]:
            final.append(m[4] or m[3] == "p")
        else:
            final.append(far[0][1])
    return "\n".join(m[6] for m, keep in zip(measured, final, strict=True) if keep)


def without_tags(page):
    """Articles, menus and footers become plain divisions without names."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", page))


@pytest.fixture(scope="module")
def pages():
    return pq.read_table(PAGES).column("html").to_pylist()


@pytest.mark.parametrize("change", [str, without_tags])
def test_pages_by_the_plain_version(pages, change):
    for page in pages:
        assert H.main_text(change(page or "")) == plain_text(change(page or ""))


def test_densities_find_the_article_without_semantic_tags(pages):
    whole, found, extra, same = 0, 0, 0, 0
    for page in pages:
        want, got = H.main_text(page).split("\n"), H.main_text(without_tags(page)).split("\n")
        whole += sum(map(len, want))
        found += sum(len(x) for x in want if x in got)
        extra += sum(len(x) for x in got if x not in want)
        same += want == got
    assert found > 0.98 * whole and extra < 0.01 * whole and same > 0.65 * len(pages)


def test_a_teaser_article_is_not_the_article():
    prose = "It was the best of the times and it was the worst of them for all of us, and so it went. "
    page = f"<div><p>{prose * 3}</p><p>{prose * 4}</p></div><article><p>{prose}</p></article>"
    assert H.main_text(page).split("\n") == [(prose * 3).strip(), (prose * 4).strip(), prose.strip()]


def test_equal_distance_and_other_languages():
    prose = "It was the best of the times and it was the worst of them for all of us, and so it went. "
    menu = "<ul><li><a href=1>Home and more of the pages here</a></li></ul>"
    assert H.main_text(f"{menu}<section>Three short words</section><div>{prose}</div>") == prose.strip()
    assert H.main_text(f"<p>{prose}</p><p>Three short words.</p>{menu}").split("\n") == [prose.strip(), "Three short words."]
    odd = "Zal lom brek tiv orun hask pel dirra moni quast elvo burrin tach sile worm. "
    assert H.main_text(f"{menu}<p>{odd}</p><p>{odd * 2}</p>").split("\n") == [odd.strip(), (odd * 2).strip()]


def test_very_long_pages():
    prose = "It was the best of the times and it was the worst of them for all of us. "
    page = "<article>" + f"<p>{prose}</p>" * 30_000 + "</article>"
    assert H.main_text(page).count("\n") == 29_999
    assert len(H.main_text("<article><p>" + prose * 50_000 + "</p></article>")) == len(prose) * 50_000 - 1
