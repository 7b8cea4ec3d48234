"""Main text of web pages by removing site templates.

Every page becomes a tree of elements. Subtrees are hashed (tag, attributes, text, children) and counted per host in
Spark; what recurs on many pages of a host is template and is deleted, together with menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments that their tags, roles or class names give away. Passages
(paragraphs, lists, tables, quotations) and headings recur by articles of different headings, so that copies and versions
of one article keep what they share; an article's h1 is never counted. What an article says may recur by itself, like a licence
or a saying, so passages go only at an article's edge and only if they stand there on half of the host's articles.

Defined results: null or empty html gives an empty text; null or scheme-less urls share the empty host; unclosed and stray
tags are read as browsers do in the simple cases (a new paragraph or item ends the last, an end tag closes down to its
start tag or is ignored), and a < that another < or the end follows before its > is text; a page without an article or main element is taken from its body; repeated rows
are extracted each for itself, but rows of one host with equal main text count as one page. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelens.llm.common import small_batches, staged, table

#: A subtree is template from this many pages of a host on.
MANY_PAGES = 3
#: A passage must also stand at an edge of the article, among so many blocks, on this share of the host's headings.
EDGE, PASSAGE_SHARE = 3, 0.5
#: A whole tag without < or > in its attributes, as nearly all are.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/><]*)")
_PLAIN = re.compile(r"""[^<>"']*""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt li td th b i em strong span a code table tbody tr ul ol dl u s sub sup small mark q cite".split())
_PASSAGES = frozenset("p blockquote pre figcaption ul ol dl table".split())  # counted by articles, and in articles as a whole
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FLOWING = _HEADINGS | {"p", "pre", "figcaption"}  # what stands in these is never counted by itself
_DROPPED = frozenset("head script style textarea title noscript iframe nav footer aside form button select option input template svg canvas dialog menu object audio video map xmp noembed noframes".split())
_MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar toolbar share sharing social related recommended comment comments commentlist disqus respond reply replies search login form pagination pager skip copyright".split()
)
#: Compound names that count like the words above; any other name that merely holds such a word does not.
_MARKS |= frozenset(
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper google-ad cookie-banner cookie-bar cookie-consent cookie-notice consent-banner gdpr-banner newsletter-form newsletter-signup signup-form subscribe-form search-form login-form"
    " site-header site-footer site-nav page-header page-footer main-header main-footer main-nav main-menu top-nav top-bar top-menu nav-bar nav-menu nav-links side-bar side-nav left-sidebar right-sidebar breadcrumb-nav skip-link footer-links footer-nav"
    " share-bar share-buttons share-links social-buttons social-links social-share social-media related-articles related-content related-links related-posts related-stories recommended-posts comment-form comment-list comments-area comments-section"
    " pop-up modal-dialog site-notice site-banner promo-banner sponsored-content sponsored-links copyright-notice".split()
)
_KEPT = frozenset(["body", "html", "head", "article", "main", "br", "wbr", "img", "hr"])  # never counted
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
_CLOSED_BY = {  # a start tag of the values' kind ends an open element of the key's kind
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "p": _BLOCKS - {"body", "html", "head", "title"},
}
#: By start tag: the open elements that it ends.
_CLOSES = {tag: {k for k, tags in _CLOSED_BY.items() if tag in tags} for tag in _BLOCKS | set(_CLOSED_BY)}
_FENCE = frozenset(["table", "ul", "ol", "div", "section", "article", "main", "body", "html", "aside", "nav", "td", "th", "dl", "blockquote", "form", "footer", "header"])


class Node:
    __slots__ = ("tag", "attributes", "children", "key", "linked")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.key, self.linked = tag, attributes, [], 0, tag == "a"


def _tag_end(html: str, at: int, unclosed: dict[str, bool]) -> int:
    """The place of the > that ends a tag whose name ends at `at`, or -1 where a < or the page's end comes first.

    A quote that is never closed is an ordinary character; unclosed remembers this for what follows."""
    while True:
        at = _PLAIN.match(html, at).end()
        mark = html[at : at + 1]
        if mark == ">":
            return at
        if not mark or mark == "<":
            return -1
        close = -1 if unclosed.get(mark) else html.find(mark, at + 1)
        unclosed[mark] = close < 0
        at = max(at, close) + 1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """Text ("", "", text), start tags ("name", "", attributes) and end tags ("name", "/", ...), in one pass over the page."""
    at, text = 0, 0
    unclosed: dict[str, bool] = {}
    last = html.rfind(">")
    while (at := html.find("<", at)) >= 0:
        tag = _TAG.match(html, at)
        if tag:
            end, found = tag.end() - 1, (tag[2].lower(), tag[1], tag[3])
        elif html[at + 1 : at + 2] in ("!", "?"):
            close = html.find("-->", at + 4) + 2 if html.startswith("<!--", at) else html.find(">", at)
            end, found = close if close > at else len(html) - 1, ("", "", "")
        else:
            name = _NAME.match(html, at) if at < last else None
            end = _tag_end(html, name.end(), unclosed) if name else -1
            if end < 0:
                at += 1
                continue
            found = (name[1].lower(), "/" if html[at + 1] == "/" else "", html[name.end() : end])
        if at > text:
            yield "", "", html[text:at]
        at = text = end + 1
        if not found[0]:
            continue
        yield found
        if found[0] in _RAW and not found[1]:
            close_tag = re.compile(rf"</{re.escape(found[0])}\b[^>]*>", re.I).search(html, at)
            at = text = close_tag.end() if close_tag else len(html)
    if text < len(html):
        yield "", "", html[text:]


def parse(html: str) -> Node:
    """The page's tree; texts are strings among the children, still with their character references."""
    root = Node("html", "")
    stack = [root]
    # Places in the stack of the open elements of each tag, and of those that an inline end tag doesn't reach across.
    where: defaultdict[str, list[int]] = defaultdict(list)
    fences: list[int] = []

    def close(i: int) -> None:
        for n in reversed(stack[i:]):
            where[n.tag].pop()
        del stack[i:]
        while fences and fences[-1] >= i:
            fences.pop()

    for tag, end, rest in tokens(html):
        if not tag:
            stack[-1].children.append(rest)
            continue
        if end:
            if where[tag] and (tag in _BLOCKS or not fences or fences[-1] <= where[tag][-1]):
                close(where[tag][-1])
            continue
        if tag == "html":
            continue
        last = max((where[k][-1] for k in _CLOSES.get(tag, ()) if where[k]), default=0)
        if last and (not fences or fences[-1] <= last):
            close(last)
        node = Node(tag, rest)
        stack[-1].children.append(node)
        if tag not in _RAW and tag not in _VOID:
            where[tag].append(len(stack))
            if tag in _FENCE:
                fences.append(len(stack))
            stack.append(node)
    return root


def _given_away(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or id say that this is no part of the article. inside: within an article or main."""
    if node.tag in _DROPPED or node.tag == "header" and not inside:
        return True
    if not node.attributes or node.tag in ("main", "body", "html"):
        return False
    for name, value in _ATTRIBUTE.findall(node.attributes):
        name = name.lower()
        if name not in ("hidden", "role", "class", "id"):
            continue
        words = value.strip("\"'").lower().replace("_", "-").split()
        if name == "hidden" or name == "role" and not _ROLES.isdisjoint(words) or not _MARKS.isdisjoint(words) and (name == "class" or name == "id" and node.tag not in _PROSE):
            return True
    return False


def _hash(node: Node) -> int:
    """Sets the keys of a subtree, and whether it has links, without recursion (pages may nest deeply)."""
    order, rest = [], [node]
    while rest:
        n = rest.pop()
        order.append(n)
        rest.extend(c for c in n.children if isinstance(c, Node))
    for n in reversed(order):
        parts = [n.tag, " ".join(n.attributes.split())]
        parts += [str(c.key) if isinstance(c, Node) else " ".join(c.split()) for c in n.children]
        n.linked = n.tag == "a" or any(c.linked for c in n.children if isinstance(c, Node))
        n.key = xxhash.xxh64_intdigest("\0".join(p for p in parts if p)) >> 1
    return node.key


def _counted(node: Node, inside: bool, flowing: bool) -> bool:
    """Whether a subtree can be template by its count: passages, headings but an article's h1, and whatever is no prose.

    Items, cells and inline elements are words of their list, table or line. Only outside an article, where menus are
    bare lists, do those with links count."""
    if flowing or node.tag in _KEPT:
        return False
    if node.tag in _PASSAGES or node.tag in _HEADINGS:
        return not (inside and node.tag == "h1")
    return node.tag not in _PROSE or not inside and node.linked


def _tops(root: Node) -> list[Node]:
    """The articles, or else the main elements, of a page."""
    for wanted in ("article", "main"):
        tops, rest = [], [root]
        while rest:
            node = rest.pop()
            if node.tag == wanted and not _given_away(node, False):  # not a reader's comment
                tops.append(node)
            elif not _given_away(node, False) or node is root:
                rest.extend(c for c in reversed(node.children) if isinstance(c, Node))
        if tops:
            return tops
    return []


def _walk(root: Node, templates: set[int], found: list[tuple[int, bool, int]] | None = None) -> list[tuple[str, str]]:
    """Tag and text of each block that is left; an empty text stands for what the count takes.

    found gets the keys that can count, whether articles count them, and the number of blocks before them."""
    _hash(root)
    tops = _tops(root)
    inside = bool(tops)
    is_top = {id(top) for top in tops}
    blocks: list[tuple[str, str]] = []
    held: list[str] = []
    tag = ""

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            blocks.append((tag, text))
        held.clear()

    # Of each element: the tag of its block, whether it stands in a line of text, whether in a list or table of an article.
    todo: list[tuple[Node | str | None, str, bool]] = [x for top in reversed(tops or [root]) for x in ((None, "", False), (top, "", False))]
    while todo:
        x, of, flowing = todo.pop()
        if x is None:
            close()
            tag = of
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br" or x.tag == "wbr":
            held.append(" " if x.tag == "br" else "")
        elif id(x) in is_top or not _given_away(x, inside):
            counted = id(x) not in is_top and _counted(x, inside, flowing)
            if counted and found is not None:
                if x.tag in _BLOCKS:
                    close()
                found.append((x.key, x.tag in _PASSAGES or x.tag in _HEADINGS, len(blocks)))
            if counted and x.key in templates:
                if x.tag not in _HEADINGS:
                    if x.tag in _BLOCKS:
                        close()
                    blocks.append((x.tag, ""))
                    continue
                below = x.tag.upper()  # goes if nothing of the article follows it
            else:
                below = x.tag
            flowing = flowing or x.tag in _FLOWING or inside and x.tag in _PASSAGES and x.tag != "blockquote"
            if x.tag in _BLOCKS:
                close()
                todo.append((None, of, False))
                tag = below
            else:
                below = of
            todo.extend((c, below, flowing) for c in reversed(x.children))
    close()
    return blocks


def main_text(root: Node, templates: set[int]) -> str:
    """The blocks of the article (or of the body) without templates, joined by newlines.

    A recurring heading goes with what stands below it. A page of which the count would leave no more than headings is kept whole."""
    kept: list[tuple[str, str]] = []
    gone, own = False, "h0"  # what follows belongs to headings above the level of own
    for tag, text in reversed(_walk(root, templates)):
        heading = tag.lower() in _HEADINGS
        if not text or tag != tag.lower() and tag.lower() >= own:
            gone = True
        else:
            kept.append((tag, text))
            own = tag.lower() if heading else "h7"
    if gone and all(tag.lower() in _HEADINGS for tag, _ in kept):
        return main_text(root, set())
    return "\n".join(text for _, text in reversed(kept))


def page_keys(root: Node) -> tuple[int, int, dict[int, bool]]:
    """Hashes of a page's text and of its first heading (or else the text), and the keys of the subtrees that may be template: True for passages.

    A passage may be template only among the first EDGE or the last EDGE blocks: templates stand round an article."""
    found: list[tuple[int, bool, int]] = []
    blocks = _walk(root, set(), found)
    page = xxhash.xxh64_intdigest("\n".join(text for _, text in blocks)) >> 1
    title = next((text for tag, text in blocks if tag in _HEADINGS), None)
    keys = {key: passage for key, passage, at in found if not passage or at < EDGE or at >= len(blocks) - EDGE}
    return page, page if title is None else xxhash.xxh64_intdigest(title) >> 1, keys


_KEYS = pa.list_(pa.struct([("key", pa.int64()), ("page", pa.int64()), ("passage", pa.bool_())]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, titles = [], []
        for h in batch.column(2).to_pylist():
            page, title, found = page_keys(parse(h)) if h else (0, 0, {})
            titles.append(title)
            keys.append([{"key": k, "page": title if passage else page, "passage": passage} for k, passage in sorted(found.items())])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(titles, pa.int64()), pa.array(keys, _KEYS)], names=["row", "host", "title", "keys"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(parse(h), set(k or ())) if h else "" for h, k in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, many_pages: int = MANY_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html). pages is read twice, as a scan of files."""
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), host.alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # Both reads take the same columns: a shuffle before this deals rows by all of them, and row numbers must agree.
    keyed = staged(rows.select("row", "host", "html", "page_id").mapInArrow(_keys, "row long, host string, title long, keys array<struct<key:long,page:long,passage:boolean>>"), "subtrees")
    each = keyed.select("row", "host", F.inline("keys"))
    titles = keyed.groupBy("host").agg(F.count_distinct("title").alias("titles"))
    counts = each.groupBy("host", "key").agg(F.count_distinct("page").alias("n"), F.bool_or("passage").alias("passage")).filter(F.col("n") >= many_pages)
    templates = counts.join(titles, "host").filter(~F.col("passage") | (F.col("n") >= PASSAGE_SHARE * F.col("titles"))).select("host", "key")
    of_page = each.select("row", "host", "key").join(templates, ["host", "key"]).groupBy("row").agg(F.collect_list("key").alias("keys"))  # no more than the page has
    return rows.join(of_page, "row", "left").select("page_id", "url", "html", "keys").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
