"""Main text of web pages without the parts that a site repeats on its pages.

Every element subtree that could be furniture is hashed; Spark counts, per host, on how many different pages each hash
occurs, and subtrees that recur on many pages of their host are deleted together with what is furniture by its kind
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments of readers). The library's records
hold no web pages, so the operator is general: any table of page ids, addresses and HTML.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from cutlake.functions.staging import settle
from cutlake.llm.common import attach, others, small_batches

#: A subtree is a site's template if it is on at least so many different pages of the host, and on that share of them.
MIN_PAGES, MIN_SHARE = 5, 0.1

# Fixed values of HTML: elements without content, elements whose text is no text, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that mark furniture, whole parts only ("ad" in "ad-box", not in "header-shadow").
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|adsense|adslot|banner|sponsor(?:ed|s)?|promo(?:tion|ted)?s?|cookies?|consent|gdpr|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|side|aside|footer|foot|header|masthead|topbar|toolbar|widgets?|share|sharing|social|newsletter|subscribe|subscription|signup|login|"
    r"popup|modal|overlay|notices?|notification|alert|disclaimer|comments?|commentlist|respond|reply|replies|disqus|related|recommended|recommendations|pagination|pager)(?=$|[\s_-])",
    re.I,
)
# Fixed values of HTML: start tags that end an open element of the same group.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Elements that end an open paragraph, by the rules of HTML.
ENDS_P = BLOCK - {"br", "html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "dd", "dt", "li"} | {"dd", "dt", "li"}
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "marks", "role", "children", "hash", "text")

    def __init__(self, tag: str, marks: str = "", role: str = ""):
        self.tag, self.marks, self.role = tag, marks, role
        self.children: list[Node | str] = []


class Tree(HTMLParser):
    """The element tree of a page; unclosed and misnested tags end where their surroundings do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # open elements by tag: nothing is looked for in vain

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in ENDS_P:
            self._end_paragraph()
        if tag in CLOSES:
            self._end_open(CLOSES[tag], SCOPE[tag])
        named = dict(attrs)
        node = Node(tag, f"{named.get('class') or ''} {named.get('id') or ''}".strip(), (named.get("role") or "").lower())
        if "hidden" in named or (named.get("aria-hidden") or "").lower() == "true":
            node.role = "hidden"
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash at the end means nothing in HTML

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._close(k)
                return
            if tag in INLINE and self.open[k].tag in SECTIONS:
                return  # the end of an inline element does not end the section around it

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _close(self, k):
        self.count.subtract(n.tag for n in self.open[k:])
        del self.open[k:]

    def _end_paragraph(self):
        if not self.count["p"]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == "p":
                self._close(k)
                return
            if self.open[k].tag in BLOCK:
                return

    def _end_open(self, tags, scope):
        k = len(self.open) - 1
        while k > 0 and any(self.count[t] > 0 for t in tags) and self.open[k].tag not in scope:
            if self.open[k].tag in tags:
                self._close(k)
            k -= 1


SECTIONS = frozenset("article main section div table td th ul ol dl nav aside footer header form blockquote".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark p q s samp small span strong sub sup time tt u var".split())


def parse(html: str | None) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def furniture(node: Node, inside: bool) -> bool:
    """Whether an element is furniture by its kind. ``inside``: below the article, where headers belong to the text."""
    if node.tag in SILENT or node.role == "hidden":
        return True
    if inside and node.tag == "header":
        return False
    return node.tag in FURNITURE or node.role in ROLES or bool(node.marks and node.tag not in ("article", "main", "p", "h1") and MARKS.search(node.marks))


def content(root: Node) -> list[Node]:
    """The article elements of a page, else its main elements, else the whole page; outermost ones, in page order."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag:
                found.append(node)
            elif node is root or not furniture(node, False) or (node.tag == "form" and not node.marks):
                todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
        if found:
            return found
    return [root]


def blocks(node: Node, templates: frozenset[int] | set[int]) -> list[str]:
    """The text blocks below an element without furniture and templates, white space folded."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        text = SPACES.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = [node]
    first = True
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        else:
            if not first and (furniture(item, True) or (templates and template_hash(item) in templates)):
                if item.tag in BLOCK:
                    flush()
                continue
            first = False
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(item.children))
    flush()
    return out


def template_hash(node: Node) -> int | None:
    """Hash of a subtree that may be a template: a marked or section-like element. Paragraphs, headings and lists of
    an article are its own text, however often a host repeats them, and have no hash."""
    if node.tag not in ("div", "section", "table", "ul", "ol", "details", "figure"):
        return None
    return subtree_hash(node)


def subtree_hash(node: Node) -> int:
    """64-bit hash of tags, class names and text of a subtree, white space folded; computed once."""
    try:
        return node.hash
    except AttributeError:
        pass
    stack, order = [node], []
    while stack:
        at = stack.pop()
        order.append(at)
        stack.extend(c for c in at.children if isinstance(c, Node))
    for at in reversed(order):
        state = blake2b(f"{at.tag}\0{at.marks}\0".encode("utf-8", "surrogatepass"), digest_size=8)
        for child in at.children:
            if isinstance(child, Node):
                state.update(b"\1" + child.hash.to_bytes(8, "little", signed=True))
            else:
                text = SPACES.sub(" ", child).strip()
                if text:
                    state.update(b"\2" + text.encode("utf-8", "surrogatepass") + b"\0")
        at.hash = int.from_bytes(state.digest(), "little", signed=True)
    return node.hash


MAY_BE_TEMPLATE = re.compile(r"<(?:div|section|table|ul|ol|details|figure)[\s>/]", re.I)
ARTICLE = re.compile(r"<(?:article|main)[\s>/]", re.I)


def candidates(html: str | None) -> tuple[list[int], int]:
    """Hashes of the subtrees inside a page's content that may be templates, and a hash of its text without them.

    A page without such an element behind its first article or main tag has none, and is not parsed for that.
    """
    first = ARTICLE.search(html or "")
    behind = first.start() if first else 0
    if not MAY_BE_TEMPLATE.search(html or "", behind):
        rest = (html or "")[behind:].encode("utf-8", "surrogatepass")
        return [], int.from_bytes(blake2b(rest, digest_size=8).digest(), "little", signed=True)
    hashes: dict[int, None] = {}
    text: list[str] = []
    for part in content(parse(html)):
        todo = [(c, False) for c in part.children]
        while todo:
            item, under = todo.pop()
            if isinstance(item, str):
                if not under:
                    text.append(item)
                continue
            if furniture(item, True):
                continue
            own = template_hash(item)
            if own is not None:
                hashes[own] = None
            todo.extend((c, under or own is not None) for c in item.children)
    rest = SPACES.sub(" ", " ".join(text)).strip().encode("utf-8", "surrogatepass")
    return list(hashes), int.from_bytes(blake2b(rest, digest_size=8).digest(), "little", signed=True)


def main_text(html: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the content, in page order, joined by a space."""
    return " ".join(b for part in content(parse(html)) for b in blocks(part, templates))


HASHED = StructType().add("hashes", ArrayType(LongType())).add("own", LongType())


@F.pandas_udf(HASHED)
def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        yield pd.DataFrame([candidates(html) for html in pages], columns=["hashes", "own"])


@F.pandas_udf(StringType())
def _text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, templates in batches:
        yield pd.Series([main_text(html, set() if t is None else set(t.tolist())) for html, t in zip(pages, templates)], dtype=object)


def host_of(url: str | Column) -> Column:
    """Host of an address in lower case, without port and user; '' where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host`` → ``templates`` (array of subtree hashes) for hosts that have any.

    A hash counts once for each different page text of its host, so copies of one page make no template. It is a
    template from ``min_pages`` texts and ``min_share`` of the host's texts on. A host's list is bounded by that share:
    at most 1/``min_share`` times the subtrees of an average page.
    """
    hashed = settle(small_batches(pages).select(host_of("url").alias("host"), _hashed("html").alias("h")).select("host", "h.hashes", "h.own"))
    texts = hashed.select("host", "own").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    seen = hashed.select("host", "own", F.explode("hashes").alias("hash")).distinct()
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(texts, "host").where(F.col("n") >= F.col("texts") * min_share)
    return settle(often.groupBy("host").agg(F.collect_list("hash").alias("templates")))


def page_texts(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Every page with ``text``, its main text, and ``n_chars``, the text's code points.

    ``pages``: url, html, and any further columns, which pass through (unless named like a result). The text is that
    of the article elements (else main, else the page), without furniture and without the host's templates; character
    references are decoded, white space in a block is one space, blocks are joined in page order by a space. Null and
    empty pages give ''. Null addresses share the host ''. Repeated rows come out each.
    """
    rest = others(pages, ["url", "html"], ["text", "n_chars"])
    templates = host_templates(pages, min_pages, min_share)
    rows = small_batches(pages).select("url", "html", *rest)
    if templates.isEmpty():
        rows = rows.withColumn("__t", F.lit(None).cast("array<bigint>"))
    else:
        hosts = rows.select(host_of("url").alias("host")).distinct().join(templates, "host", "left").select(F.col("host").alias("__host"), F.col("templates").alias("__t"))
        rows = attach(rows.withColumn("__host", host_of("url")), hosts, ["__host"], F.col("html"))
    out = rows.select("url", "html", *rest, _text("html", "__t").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select("url", "html", *rest, "text", "n_chars")
