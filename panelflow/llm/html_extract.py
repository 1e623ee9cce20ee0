"""HTML extraction by equivalence-class template deduction.

A page's tokens are its containers (elements that hold blocks, named by their path) and its text blocks. Over the pages
of a host, tokens with the same occurrence vector (how often they occur on each page) form an equivalence class; a vector
is kept as the sum of hashes of (page, count), so Spark adds it up without gathering pages. Pages of a host with the same
containers and blocks count once. Classes on at least half of the pages whose containers nest make the host's template; text
blocks in its containers that are the same on half of the pages, and on SUPPORT at least, belong to it, however many pages
the host has. What a page has besides the template is its text, never an article's own repeated lines.

The standard's elements and roles say what is left out everywhere: menus, headers, footers, sidebars, forms, scripts,
styles. Besides the template, names of classes and ids decide: containers that name a notice, an advert or reader comments are
left out, but where nearly all that a page has is in a container that is named so (`share-prices`, `promotion`), it counts as
text, and no name leaves a page without text that it has elsewhere than in its comments (`has-sidebar`, `nav-open`). Where article
and main elements hold at least half of what remains, all of them together are the page's text, and what is outside them
is left out.

Edge cases: null html counts as empty and gives the empty text; a null url belongs to the host ''. Unclosed elements end
where their parent ends, unknown ones are plain containers; of an unclosed element with raw text only the tag is ignored,
but an unclosed script, style, textarea or title takes the rest of the page. Below MOST_DEPTH levels elements count as
siblings. Blocks keep page order and repeated blocks; repeated rows give equal rows; page ids may repeat. Work is linear in
a page's length, however broken it is: a tag whose quotes don't end ends at its first `>`. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import materialize

#: Different pages that a template's text stands on: on two, it may as well be the text of a page and its near copy.
SUPPORT = 3

# fixed values: names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup; those of the second list take the rest of the page where they don't end.
RAW = frozenset("script style noscript template textarea title iframe svg xmp noframes".split())
TO_THE_END = frozenset("script style textarea title".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript template textarea title iframe svg button select menu dialog head object canvas audio video".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
CONTAINERS = frozenset("html body main article section div table tbody tr td center".split())
BLOCKS = CONTAINERS | LEFT_OUT | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote address figure figcaption hr thead tfoot th caption fieldset legend details summary".split())
CLOSES_P = BLOCKS - {"tr", "td", "tbody", "thead", "tfoot", "th", "caption"}
#: Words of a class or id that name what isn't the article; those of the first list do so even where a page has little else, unless it has nothing else.
NEVER_WORDS = frozenset("cookie cookies consent gdpr menu nav navbar navigation breadcrumb breadcrumbs sidebar comment comments respond disqus login signup pagination pager".split())
LEFT_OUT_WORDS = NEVER_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner notice notices alert popup modal overlay "
    "aside widget footer header masthead share sharing social related recommended newsletter subscribe subscription search toolbar".split()
)

#: Levels of elements, as in browsers; and tags in a page whose quotes may fail to end before quotes no longer count.
MOST_DEPTH = 512
_MOST_OPEN_QUOTES = 16

_SPECIAL = re.compile(r"!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>", re.S)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class _Element:
    """path: a number for the container and all around it; soft: the outermost container named like a notice, below 0 if never text."""

    __slots__ = ("name", "path", "hard", "soft", "article")

    def __init__(self, name: str, path: int, hard: bool, soft: int, article: bool) -> None:
        self.name, self.path, self.hard, self.soft, self.article = name, path, hard, soft, article


def tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash, name, attributes) of each tag, in order; name is '' for comments and the like, and at the end."""
    at = start = failed = 0
    last = page.rfind(">")
    endless: set[str] = set()  # raw elements that don't end from here on
    while (start := page.find("<", start)) >= 0:
        if page.startswith(("!", "?"), start + 1):
            if not (m := _SPECIAL.match(page, start + 1)):
                break
            yield page[at:start], "", "", m[0][8:-3] if m[0].startswith("![CDATA[") else ""
            at = start = m.end()
            continue
        if start > last or not (m := _NAME.match(page, start + 1)):
            start += 1
            continue
        rest = _REST.match(page, m.end()) if failed < _MOST_OPEN_QUOTES else None
        if rest:
            end, given = rest.end(), rest[1]
        else:  # quotes that don't end
            failed += 1
            end = page.find(">", m.end()) + 1
            given = page[m.end() : end - 1]
        name = m[2].lower()
        yield page[at:start], m[1], name, given
        at = end
        if not m[1] and name in RAW and name not in endless and not given.endswith("/"):
            if found := _RAW_END[name].search(page, at):
                at = found.end()
            elif name in TO_THE_END:
                at = len(page)
            else:
                endless.add(name)
        start = at
    yield page[at:], "", "", ""


def parse(page: str | None) -> tuple[list[tuple[int, int]], list[tuple[int, int, bool, str]]]:
    """The containers opened, in order, as (path, path around it), and the blocks (path, soft, inside an article, text) that no
    element or role leaves out. soft is 0 outside all containers named like notices."""
    opened: list[tuple[int, int]] = []
    blocks: list[tuple[int, int, bool, str]] = []
    stack = [_Element("", 0, False, 0, False)]
    depth: dict[str, int] = defaultdict(int)  # open elements of each name, so that stray end tags cost nothing
    pending: list[str] = []
    soft_ones = 0

    def end_block() -> None:
        if pending:
            top = stack[-1]
            text = _SPACE.sub(" ", entities.unescape("".join(pending))).strip()
            pending.clear()
            if text:
                blocks.append((top.path, top.soft, top.article, text))

    def add(text: str) -> None:
        if text and not stack[-1].hard:
            pending.append(text)

    def pop_to(k: int) -> None:
        if any(e.name in BLOCKS for e in stack[k:]):
            end_block()
        for e in stack[k:]:
            depth[e.name] -= 1
        del stack[k:]

    for before, slash, name, given in tags(page or ""):
        add(before)
        if not name:
            add(given)
            continue
        if slash:
            if depth[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        pop_to(k)
                        break
                    if stack[k].name in ("td", "article", "body") and name not in BLOCKS:
                        break
            continue
        if name in VOID:
            if name in ("br", "wbr"):
                add(" " if name == "br" else "")
            elif name == "hr":
                end_block()
            continue
        if name in RAW:
            continue
        if name in CLOSES_P and depth["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    pop_to(k)
                    break
                if stack[k].name in BLOCKS:
                    break
        if name in ("li", "dt", "dd", "td", "tr", "option"):
            alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}.get(name, (name,))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in alike:
                    pop_to(k)
                    break
                if stack[k].name in ("ul", "ol", "dl", "table", "article", "body"):
                    break
        if name in BLOCKS:
            end_block()
        top = stack[-1]
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(given)} if given else {}
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().strip()
        hard = top.hard or name in LEFT_OUT or attributes.get("role", "").lower() in LEFT_OUT_ROLES
        article = top.article or name in ("article", "main")
        soft = 0 if article and not top.article else top.soft
        if not soft and label and name not in ("html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong", "a", "code"):
            words = _WORD.findall(label)
            if not LEFT_OUT_WORDS.isdisjoint(words):
                soft_ones += 1
                soft = soft_ones if NEVER_WORDS.isdisjoint(words) else -soft_ones
        path = top.path
        if name in CONTAINERS and not hard:
            path = _number(f"{top.path} {name} {label}")
            opened.append((path, top.path))
        if not given.endswith("/"):
            if len(stack) > MOST_DEPTH:
                pop_to(MOST_DEPTH)
            stack.append(_Element(name, path, hard, soft, article))
            depth[name] += 1
    end_block()
    return opened, blocks


def _number(text: str) -> int:
    """A 64-bit hash, never 0: that stands for the page itself, and for a container's own token."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) | 1


def page_tokens(page: str | None) -> tuple[int, dict[tuple[int, int, int], int]]:
    """A fingerprint of the page's containers and blocks; (path, path around it, text hash or 0 for the container itself) -> times
    it occurs. The page itself is container 0."""
    opened, blocks = parse(page)
    found: dict[tuple[int, int, int], int] = defaultdict(int)
    found[0, 0, 0] = 1
    for path, around in opened:
        found[path, around, 0] += 1
    for path, _, article, text in blocks:
        if not article:
            found[path, 0, _number(text)] += 1
    return _number(repr((opened, blocks))), found


def template_paths(tokens: list[tuple[int, int, int, int, int, int]]) -> set[int]:
    """The containers of a host's template, from its tokens (path, path around, text, vector, pages, occurrences) on half of its pages.

    A class is valid in so far as it nests: a container occurs once on each of its pages, and those around it are tokens of half of
    the pages, too. A class of a single token says nothing about order, so it takes another one; the page itself always counts.
    """
    classes: dict[int, int] = defaultdict(int)
    around = {}
    for path, outer, text, vector, _, _ in tokens:
        classes[vector] += 1
        if text == 0:
            around[path] = outer
    rooted = {0}
    for path in around:
        trail, at = [], path
        while at in around and at not in rooted:
            trail.append(at)
            at = around[at]
        if at in rooted:
            rooted.update(trail)
    template = {0}
    for path, _, text, vector, pages, occurrences in tokens:
        if text == 0 and occurrences == pages and path in rooted and classes[vector] > 1:
            template.add(path)
    return template


def deduce(pdf: pd.DataFrame) -> pd.DataFrame:
    """The texts of a host's template, from its tokens on half of its pages."""
    tokens = list(zip(*(pdf[c].tolist() for c in ("path", "around", "text", "vector", "pages", "occurrences")), strict=True))
    template = template_paths(tokens)
    texts = sorted({text for path, _, text, _, pages, _ in tokens if text != 0 and path in template and pages >= SUPPORT})
    return pd.DataFrame({"h": [pdf["host"].iloc[0]], "texts": [texts]})


def extract_page(page: str | None, texts: frozenset[int]) -> str:
    blocks = parse(page)[1]
    own = [b for b in blocks if b[1] >= 0 and (b[2] or not texts or _number(b[3]) not in texts)]
    chosen = _choose([b for b in own if not b[1]]) or _choose([b for b in blocks if not b[1]])
    # nearly all text in a container that is named like a notice: then that is no notice
    total = sum(len(text) for *_, text in own)
    if 5 * sum(len(text) for *_, text in chosen) < total:
        held: dict[int, int] = defaultdict(int)
        for _, soft, _, text in own:
            held[soft] += len(text)
        named = any(b[2] for b in own)
        most = max(held, key=held.__getitem__)
        if most > 0 and 2 * held[most] >= total and (not named or any(b[2] for b in own if b[1] == most)):
            chosen = _choose([b for b in own if b[1] in (0, most)])
    if not chosen and blocks:  # all of the page is in containers named like menus or comments: the largest is no such thing
        size: dict[int, int] = defaultdict(int)
        for _, soft, _, text in blocks:
            size[soft] += len(text)
        most = max(size, key=size.__getitem__)
        chosen = _choose([b for b in blocks if b[1] == most])
    return "\n".join(text for *_, text in chosen)


def _choose(blocks: list[tuple[int, int, bool, str]]) -> list[tuple[int, int, bool, str]]:
    """The blocks in article and main elements, where these hold at least half of the text; else all."""
    named = [b for b in blocks if b[2]]
    return named if 2 * sum(len(b[3]) for b in named) >= sum(len(b[3]) for b in blocks) else blocks


#: Bytes of templates up to which they are broadcast rather than pages shuffled.
MOST_BROADCAST = 64 << 20


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                out = [(h, k, *token, n) for h, page in zip(part["host"], part["html"], strict=True) for k, found in [page_tokens(page)] for token, n in found.items()]
                yield pd.DataFrame(out, columns=["host", "page", "path", "around", "text", "n"])

    found = rows.select("host", "html").mapInPandas(tokens, "host string, page long, path long, around long, text long, n long")
    # of pages with the same containers and blocks, one counts
    found = found.groupBy("host", "path", "around", "text", "page").agg(F.max("n").alias("n"))
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")) % F.lit(2**62)
    found = found.groupBy("host", "path", "around", "text").agg(vector.cast("long").alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("occurrences"))
    size = found.where("path = 0 AND text = 0").select(F.col("host").alias("h"), F.col("pages").alias("host_pages"))
    # tokens on half of the pages are at most twice as many as a page has, so a host's are few
    often = found.join(size, F.col("host") == F.col("h")).where("2 * pages >= host_pages").drop("h")
    templates = materialize(often.groupBy("host").applyInPandas(deduce, "h string, texts array<long>").where("size(texts) > 0"), "templates")
    held = templates.agg(F.sum(F.size("texts") * 8 + F.length("h") + 64)).first()[0] or 0

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [extract_page(page, frozenset() if fixed is None else frozenset(fixed)) for page, fixed in zip(pdf["html"], pdf["texts"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = rows.join(F.broadcast(templates) if held <= MOST_BROADCAST else templates, F.col("host") == F.col("h"), "left")
    # ids travel as text: with a null among them, pandas would make them floats
    joined = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "texts")
    return joined.mapInPandas(cut, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast(kind))
