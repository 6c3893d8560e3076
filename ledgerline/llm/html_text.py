"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks by link density, length and stop-word density; short
and unclear blocks stay open. Menus, footers, forms and the like, known by their tags, roles and names, are out beforehand.
Pass two gives every open block the label of its nearest decided neighbour of the same container, one in another kind of
element counting as farther; where both are equally near and differ, a paragraph or a block of an article stays and others go,
as they do where no neighbour is decided.

An article element is one more feature, not the rule: inside it less is asked of a block, and what densities accept outside it
goes only where the article holds at least half of all accepted text; else the element is taken for a teaser and ignored. On
pages whose long blocks hardly have stop words (another language), length and link density decide alone.

Class and id names are only hints: a name that marks an element as out counts after the whole page is read, and not where the
element holds the main element, or most of the text or of the articles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Tag names of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "annotation", "annotation-xml", "iframe", "textarea", "select", "title", "xmp", "noembed", "noframes")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
TO_THE_END = ("script", "style")  # of RAW, those that run to the end of the page when unclosed
OUT = frozenset("nav footer aside form menu dialog head button fieldset search".split())
CLOSES_P = BLOCK - {"html", "body", "head", "option"}
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words in class and id names that mark what is not the article.
NAMES_OUT = re.compile(
    r"(?:^|(?<!\bno)(?<!\bhas)(?<!\bwith)[\s_-])(?:ads?|adverts?|advertisement|advertising|adslot|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|menu|nav(?:bar|igation)?|breadcrumbs?|"
    r"sidebar|side-?bar|aside|widgets?|footer|foot|site-?header|page-?header|masthead|topbar|toolbar|comments?|commentlist|respond|disqus|replies|reply|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|"
    r"recommendations|pagination|pager|tags|tagcloud|legal|copyright|disclaimer|skip|hidden|search)(?=$|[\s_-])",
    re.I,
)
NAMES_OUT_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|promo|sponsored|comments?|repl(?:y|ies)|related|recommended)(?=$|[\s_-])", re.I)
NAMES_HEADER = re.compile(r"(?:^|[\s_-])(?:header|head)(?=$|[\s_-])", re.I)
NAMES_MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story)(?:[_-]?(?:body|content|text|main))?(?=$|[\s_-])", re.I)
#: Common function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it"
    " its more my no not of on one or our she so some than that the their them then there these they this to up was we were what when which who will"
    " with would you your au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas"
    " plus pour qu que qui sa sans se ses son sont sur un une vous aber als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine"
    " einem einen einer er es für hat ich ihr im in ist ja kann mit nach nicht noch nur ob oder sein sich sie sind so um und uns vom von vor war was"
    " wenn wie wir wird zu zum zur al como con cual de del desde donde el ella en entre era es esta este está ha han hasta hay la las le lo los más"
    " me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene un una uno y ya".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"\w+")

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A name does not count on an element with more than this share of the text around it; names of comments, related pages and advertisements need more.
MOST, MOST_ARTICLE = 0.5, 0.8
LONG_LINKS, SHORT_WORDS, LONG_WORDS = 0.5, 6, 12
STOP_LOW, STOP_HIGH = 0.12, 0.25
#: A neighbour in another kind of element counts as so much farther; kinds that hold text rather than layout.
OTHER_TAG, TEXT_TAGS = 2, ("p", "blockquote", "pre")
#: A line of rights, which is no part of the article, up to this many words.
RIGHTS, RIGHTS_WORDS = re.compile(r"©|\(c\)|copyright\b", re.I), 40


@dataclass
class Block:
    text: str
    container: int  # 0: outside of any article
    out: bool
    heading: bool
    link_chars: int
    label: str = "open"
    named: tuple[int, ...] = ()  # elements around it whose name marks them as out
    tag: str = ""  # of the nearest block-level element around it


@dataclass
class _Named:
    container: int
    most: float
    holds_main: bool = False


@dataclass
class _Open:
    tag: str
    out: bool
    container: int
    link: bool
    named: tuple[int, ...] = ()


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    heading: bool = False
    breaks: int = 0
    containers: int = 0
    named: list[_Named] = field(default_factory=list)

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", False, 0, False)

    def add(self, raw: str) -> None:
        text = html.unescape(raw)
        if text and not text.isspace():
            self.breaks = 0
        if self.top().link:
            self.link_chars += len(SPACE.sub("", text))
        self.parts.append(text)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            at = self.top()
            tag = next((e.tag for e in reversed(self.stack) if e.tag in BLOCK), "")
            self.blocks.append(Block(text, at.container, at.out, self.heading, self.link_chars, named=at.named, tag=tag))
        self.parts, self.link_chars, self.breaks = [], 0, 0

    def open(self, tag: str, attributes: str) -> None:
        at = self.top()
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        role = found.get("role", "").strip().lower()
        out = at.out or tag in OUT or role in ROLES_OUT or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        out = out or tag == "header" and not at.container
        named = at.named
        if not out and names.strip() and tag not in ("html", "body", "main"):
            marks = found.get("class", "") if at.container and tag in (*HEADINGS, "section") else names
            of_article = bool(NAMES_OUT_ARTICLE.search(marks))
            header = tag in ("div", "section", "table") and not at.container and bool(NAMES_HEADER.search(names))
            if of_article or header or tag != "article" and NAMES_OUT.search(marks):
                named = (*named, len(self.named))
                self.named.append(_Named(at.container, MOST_ARTICLE if of_article else MOST))
        container = at.container
        if not out and (tag == "main" or role == "main"):
            for i in at.named:
                self.named[i].holds_main = True
        if not container and not out and (tag in ("article", "main") or role in ("article", "main")):
            self.containers += 1
            container = self.containers
        elif not container and not out and tag in ("div", "section", "td") and names.strip() and NAMES_MAIN.search(names):
            self.containers += 1
            container = -self.containers  # a hint only
        self.stack.append(_Open(tag, out, container, at.link or tag == "a", named))

    def settle(self) -> None:
        """Puts blocks out by the names of elements around them, where those names count."""
        texts = [0 if b.out else len(b.text) - b.link_chars for b in self.blocks]
        page, articles, inside, held, held_articles = 0, 0, {}, [0] * len(self.named), [0] * len(self.named)
        for b, n in zip(self.blocks, texts, strict=True):
            page += n
            articles += n * (b.container > 0)
            inside[b.container] = inside.get(b.container, 0) + n
            for i in b.named:
                held[i] += n
                held_articles[i] += n * (b.container > 0)
        counts = []
        for e, n, m in zip(self.named, held, held_articles, strict=True):
            most = n > e.most * (inside.get(e.container, 0) if e.container else page)
            # articles below comments or related pages are those themselves
            most = most or not e.container and e.most == MOST and m > MOST * articles
            counts.append(not (e.holds_main or most))
        for b in self.blocks:
            b.out = b.out or any(counts[i] for i in b.named)

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if tag not in ("html", "body", "article", "main", "div", "section", "table", "nav", "footer", "aside", "form") and self.stack[i].tag in ("article", "main", "div", "section", "td", "th", "table", "body"):
                return  # a stray end tag does not close what is around it


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order; markup, scripts, styles and comments are gone, character references decoded."""
    p, at = _Page(), 0
    while m := TOKEN.search(page, at):
        p.add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in RAW and not end:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else len(page) if tag in TO_THE_END else at
            if tag in ("title", "iframe", "select", "textarea"):
                p.flush()
            continue
        if tag == "br":
            p.parts.append(" ")
            p.breaks += 1
            if p.breaks > 1:
                p.flush()
            continue
        if tag in BLOCK:
            p.flush()
        if end:
            p.close(tag)
            if tag in BLOCK:
                p.heading = False
        elif tag not in VOID:
            if tag in CLOSES_P:
                for i in range(len(p.stack) - 1, -1, -1):
                    if p.stack[i].tag == "p":
                        del p.stack[i:]
                        break
                    if p.stack[i].tag in BLOCK:
                        break
            if tag in BLOCK:
                p.heading = tag in HEADINGS
            if not m[3].rstrip().endswith("/") or tag in BLOCK or tag == "a":
                p.open(tag, m[3])
    p.add(UNFINISHED.sub("", page[at:]))
    p.flush()
    p.settle()
    return p.blocks


@dataclass
class _Density:
    words: int
    stops: float
    links: float


def densities(b: Block) -> _Density:
    words = [w.lower() for w in WORDS.findall(b.text)]
    chars = max(1, len(SPACE.sub("", b.text)))
    return _Density(len(words), sum(w in STOP_WORDS for w in words) / max(1, len(words)), b.link_chars / chars)


def decide(b: Block, d: _Density, inside: bool, stop_words_tell: bool) -> str:
    """Pass one: good, bad or open."""
    low, high = (STOP_LOW, STOP_HIGH) if stop_words_tell else (0.0, 0.0)
    if b.out:
        return "bad"
    if d.links > LONG_LINKS:
        return "bad" if d.words >= SHORT_WORDS or not inside else "open"
    if not inside and d.words <= RIGHTS_WORDS and RIGHTS.match(b.text):
        return "bad"
    paragraph = b.tag in TEXT_TAGS
    if d.words >= LONG_WORDS and d.stops >= (low if paragraph else high) or inside and d.words >= SHORT_WORDS and d.stops >= low:
        return "good"
    if d.words >= LONG_WORDS and d.stops < low and not inside and not paragraph:
        return "bad"
    return "open"


def classify(blocks: list[Block]) -> None:
    """Sets every block's label to good or bad."""
    found = [densities(b) for b in blocks]
    long = [d for b, d in zip(blocks, found, strict=True) if not b.out and d.words >= LONG_WORDS and d.links <= LONG_LINKS]
    tell = sum(d.stops * d.words for d in long) >= STOP_LOW * sum(d.words for d in long)
    article = any(b.container > 0 and not b.out for b in blocks)
    hinted = not article and any(b.container < 0 and not b.out for b in blocks)
    within = lambda b: b.container > 0 or hinted and b.container < 0
    for b, d in zip(blocks, found, strict=True):
        b.label = decide(b, d, within(b), tell)
    if article:
        accepted = [0, 0]
        for b in blocks:
            if b.label == "good" or b.label == "open" and b.container > 0:
                accepted[b.container > 0] += len(b.text)
        article = accepted[1] >= accepted[0]
        for b, d in zip(blocks, found, strict=True):
            if article and b.container <= 0:
                b.label = "bad"
            elif not article:
                b.container = 0
                b.label = decide(b, d, False, tell)
    if not any(b.label == "good" for b in blocks):  # a page of odd or very short paragraphs: those are its text
        for b in blocks:
            if b.label == "open" and b.tag in TEXT_TAGS:
                b.label = "good"
    decided = [(i, b) for i, b in enumerate(blocks) if b.label != "open"]
    inherited: dict[int, str] = {}
    nearest_before: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.label != "open":
            last[b.container] = i
        elif b.container in last:
            nearest_before[i] = last[b.container]
    following: dict[int, int] = {}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.label != "open":
            following[b.container] = i
            continue
        inside = within(b)
        before, after = nearest_before.get(i), following.get(b.container)
        if b.heading and after is not None:
            before = None
        if before is None and after is None:
            inherited[i] = "good" if inside or not decided and not article and not hinted and b.link_chars == 0 and not b.heading and len(b.text) > 40 else "bad"
        elif before is None or after is None:
            inherited[i] = blocks[before if after is None else after].label
        elif blocks[before].label == blocks[after].label:
            inherited[i] = blocks[before].label
        else:
            far = lambda j: abs(i - j) + OTHER_TAG * (blocks[j].tag != b.tag)
            if far(before) == far(after):
                inherited[i] = "good" if inside or b.tag in TEXT_TAGS else "bad"
            else:
                inherited[i] = blocks[min(before, after, key=far)].label
    for i, label in inherited.items():
        blocks[i].label = label


def main_text(page: str | None) -> str:
    """The article's blocks joined by line ends; null, empty and text-free pages give an empty string."""
    if not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = [main_text(h) for h in pdf["html"]]
        yield pd.DataFrame({"page": pdf["page"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Returns ``id_col, url_col, text, n_chars`` (code points), one row per input row.

    Null or empty html gives an empty text. Repeated rows are extracted each on its own. Other columns are ignored, whatever
    their names. Empty input: no rows. Memory is bounded by one Arrow batch.
    """
    short_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    given = pages.select(F.col(id_col).cast("string").alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = given.mapInPandas(_extract, "page string, url string, text string, n_chars long")
    return out.select(F.col("page").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
