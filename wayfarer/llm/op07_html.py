"""Main text of web pages: flat blocks, words and links of a block and its neighbours, a decision tree.

A page is read once from front to back. Block-level tags cut its text into blocks; each gets its number
of words, the share of words inside links, and whether its tag makes it a heading, a paragraph or neither. A
small decision tree over these numbers of the block and the first two of the two blocks on either side keeps or
drops it; the tree is grown on the labelled page sketches below. What counts can't tell (a reader's comment reads like an article) is settled after the tree:
blocks inside an element that the page itself marks as something else (menu, footer, form, comments,
advert, hidden) go as well. On the given tables the tree alone settles every block.

Defined cases: a null or empty page, and one without kept blocks, has an empty text; tags that are never
closed end with their container; an element that isn't shown as text and is never closed, or closes itself, hides only its
tag, but a script or style that is never closed runs to the end of the page, as in browsers; a page of any length is read whole, in time linear in its length;
repeated rows give the same; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

# Element names, roles, and whole parts of class and id attributes.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements that are nothing but data to a browser until their end tag, and ones that may close themselves.
_DATA, _FOREIGN = set("script style".split()), set("svg math".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template svg math iframe object canvas audio video textarea select title head".split())
_CONTAINER = set("article aside body details dialog div fieldset figure footer form header html main menu nav ol section table tbody tfoot thead tr td th ul dl button label".split())
_NEVER = set("nav footer aside form menu dialog button label fieldset".split())
_WHOLE = set("html body main article".split())
_BAD_ROLE = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_BAD_PART = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist respond disqus consent cookie cookies gdpr footer masthead menu nav navbar navigation newsletter notice "
    "notification pager pagination popup modal overlay promo promotion promoted related recommended share sharing sidebar skip social sponsor sponsored subscribe subscription signup login toolbar topbar widget widgets outbrain taboola".split()
)
#: Beginnings that turn a part of a class into a statement about the page.
_ABOUT = ("has-", "no-", "with-", "without-", "is-")

# A tag ends at its own ">"; a "<" outside a quoted value means that it was none.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"'=<]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link: float
    marked: bool
    #: 2 for a heading, 1 for a paragraph, else 0.
    kind: int = 0


def _is_bad_token(token: str) -> bool:
    """A class or id is bad as a whole, or by its first or last part."""
    if token.startswith(_ABOUT):
        return False
    parts = token.replace("_", "-").split("-")
    return parts[0] in _BAD_PART or parts[-1] in _BAD_PART


def _marked(name: str, attrs: str, in_article: bool) -> bool:
    """Whether the page marks an element as something other than its article."""
    if name in _NEVER or (name == "header" and not in_article):
        return True
    if not attrs or attrs.isspace():
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and name not in _WHOLE and any(map(_is_bad_token, value.split())):
            return True
        if (key == "role" and value in _BAD_ROLE) or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            return True
    return False


def _kind(name: str) -> int:
    return 2 if len(name) == 2 and name[0] == "h" and name[1].isdigit() else int(name == "p")


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, begins an article, is marked
    articles = marks = links = kind = 0
    open_names: dict[str, int] = {}
    gone: set[str] = set()  # names without a further end tag

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                inside = len(html.unescape(" ".join(linked)).split())
                out.append(Block(text, n, min(1.0, inside / n), marks > 0, kind))
            parts.clear()
            linked.clear()

    def text_at(a: int, b: int) -> None:
        if a < b:
            parts.append(page[a:b])
            if links:
                linked.append(page[a:b])

    def end_of(name: str, at: int) -> int | None:
        """Behind the next end tag of that name; each name is looked for in vain once."""
        found = None if name in gone else re.compile(f"</{name}\\b[^<>]*>", re.I).search(page, at)
        if found is None:
            gone.add(name)
        return found.end() if found else None

    def pop(i: int) -> None:
        nonlocal articles, marks
        articles -= sum(g for _, g, _ in stack[i:])
        marks -= sum(b for _, _, b in stack[i:])
        for name, _, _ in stack[i:]:
            open_names[name] -= 1
            if not open_names[name]:
                del open_names[name]
        del stack[i:]

    def push(name: str, good: bool, bad: bool) -> None:
        nonlocal articles, marks
        stack.append((name, good, bad))
        open_names[name] = open_names.get(name, 0) + 1
        articles, marks = articles + good, marks + bad

    at, size, match, last = 0, len(page), _TOKEN.search, page.rfind(">")
    while at < size:
        m = match(page, at) if at <= last else None
        if m is None:
            comment = page.find("<!--", at)
            text_at(at, comment if comment >= 0 else size)
            break
        text_at(at, m.start())
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name not in _INLINE:
                close()
                kind = 0
                if name in open_names:
                    i = len(stack) - 1
                    while stack[i][0] != name:
                        i -= 1
                    pop(i)
                    links = 0
            continue
        if name in _RAW:
            if name != "head":
                closed = name in _FOREIGN and m[3].endswith("/")
                at = at if closed else end_of(name, at) or (size if name in _DATA else at)
                if name in ("title", "svg", "math", "canvas", "object", "iframe"):
                    continue
            close()
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            links += 1
        elif name in _INLINE:
            if m[3] and ("hidden" in m[3] or "none" in m[3]) and _marked(name, m[3], articles > 0):
                at = end_of(name, at) or at
        else:
            close()
            kind = _kind(name)
            if name in _CONTAINER and name not in _VOID and not m[3].endswith("/"):
                push(name, name in ("article", "main"), _marked(name, m[3], articles > 0))
                links = 0
            elif m[3] and _marked(name, m[3], articles > 0):  # a paragraph, heading or item of its own
                push(name, False, True)
            elif stack and stack[-1][0] == name == "p":  # a paragraph that was never closed ends here
                pop(len(stack) - 1)
    close()
    return out


# -- decision tree -------------------------------------------------------------------------------

#: Labelled pages as sketches of their blocks, each its number of words, then h or p if its tag says so, then + (kept) or
#: - (dropped); "1l" is a dropped link of one word, "30@.5p+" a kept paragraph with half of its words in links.
SKETCHES = (
    "1l 1l 2l 1l 8- 9+ 60+ 85+ 3+ 44+ 120+ 15-",
    "1l 1l 1l 1l 12- 10+ 30+ 9-",
    "1l 3l 1l 1l 1l 5- 4+ 12+ 2+ 1+ 70+ 1+ 12-",
    "1l 1l 1l 1l 1l 1l 13- 24+ 95+ 30+ 16-",
    "1l 1l 1l 10- 1+ 1+ 8+ 35+ 10-",
    "2l 1l 1l 1l 6- 11+ 200+ 140@.1+ 14-",
    "1l 1l 1l 1l 7- 2+ 5+ 3+ 8-",
    "1l 1l 1l 2l 9- 12+ 12+ 7-",
    "1l 2l 2l 1l 9+ 90+ 75+ 130+ 2l 3l 2l",
    "3l 2l 1l 7+ 45@.2+ 60+ 5+ 80@.1+ 6l 5l 7l 4l",
    "12+ 70+ 40+ 6+ 55+ 90+",
    "8+ 150+ 31+ 64+ 27+ 11-",
    "1l 1l 1l 11+ 52+ 18+ 3@1+ 36+ 4+ 72+ 1l 1l 12-",
    "2l 1l 1l 9- 8+ 24+ 40+ 5@1+ 2+ 61+ 15-",
    "1l 1l 1l 1l 4- 8+ 19+ 26@.4+ 6+ 33+ 13-",
    "2l 1l 1l 1l 11- 3+ 14+ 41+ 50@.3+ 4+ 62+ 21+ 11-",
    "1l 2l 3- 3+ 7+ 2+ 1+ 4@1+ 13+ 2+ 30+ 2-",
    "2l 3l 3l 9- 10+ 40+ 70+ 14-",
    "3l 2l 4l 18- 9+ 40+ 8-",
    "1+",
    "14+",
    "1l 1l 1l 1l 8- 9h+ 60p+ 85p+ 3p+ 44p+ 120p+ 15-",
    "1l 1l 1l 12- 10h+ 30p+ 9-",
    "1l 3l 1l 5- 4h+ 12p+ 2p+ 1p+ 70p+ 1p+ 12-",
    "1l 1l 1l 1l 13- 24h+ 95p+ 30p+ 1p+ 16-",
    "2l 1l 1l 6- 11h+ 200p+ 140@.1p+ 4p+ 14-",
    "1l 1l 1l 7- 2h+ 5p+ 3p+ 8-",
    "1l 2l 1l 1l 8h+ 3p+ 60p+ 40p+ 12-",
    "1l 1l 2l 6h+ 4+ 50p+ 30p+ 18p+ 9-",
    "2l 1l 3l 10h+ 2+ 25p+ 70p+ 7p+",
    "1l 1l 1l 9h+ 14p+ 70p+ 33p+",
    "3l 1l 2l 5h+ 8p+ 20p+ 45p+ 5p+",
    "12h+ 3p+ 90p+ 6h+ 40p+ 12p+",
    "1l 2l 11h+ 70p+ 25p+ 3h- 4l 6l 5l",
    "2l 2l 7h+ 40p+ 30p+ 55p+ 5l 7l 6l 8l 10-",
    "1l 1l 9h+ 35p+ 6+ 9+ 4+ 12+ 3+ 48p+ 20p+ 11-",
    "1l 2l 1l 8h+ 50p+ 1+ 2+ 1+ 3+ 2+ 1+ 40p+ 15p+",
    "18- 1l 1l 1l 9h+ 42p+ 61p+ 9p+ 6-",
    "2l 1l 7h+ 26@.3p+ 80@.1p+ 12@.5p+ 31p+ 2l 2l 1l",
    "10h+ 2p+ 5p+ 60p+ 3h+ 25p+ 2h+ 44p+ 8-",
    "1l 1l 1l 14h+ 3p+ 16p+ 20p+ 9p+ 3l 4l 13-",
    "5h+ 20p+ 6p+",
    "3l 4l 2h- 6l 5l 7l 9h+ 30p+ 50p+ 2h- 3l 5l",
    "40p+",
    "60p+ 60+",
    "45p+ 70+ 90p+ 55+",
    "50+ 80+",
    "9h+",
)


def sketched(sketches: tuple[str, ...] = SKETCHES) -> np.ndarray:
    """The labelled table: ``features`` of each sketched block, then 1 (kept) or 0."""
    rows = []
    for page in sketches:
        found = re.findall(r"(\d+)(?:@([.\d]+))?([hp]?)([-+l])", page)
        shape = [(int(n), 1.0 if kept == "l" else float(share or 0), " ph".index(kind or " ")) for n, share, kind, kept in found]
        rows += [(*f, kept == "+") for f, (_, _, _, kept) in zip(features(shape), found, strict=True)]
    return np.array(rows, float)


def features(shape: list[tuple[int, float, int]]) -> list[tuple[float, ...]]:
    """Words, link share and kind of each block, words and link share of the two before and behind it; zeros beyond the page's ends."""
    edge = [(0, 0.0, 0)] * 2
    wide = [*edge, *shape, *edge]
    return [(*wide[i + 2], *(x for j in (1, 3, 0, 4) for x in wide[i + j][:2])) for i in range(len(shape))]


@dataclass
class Node:
    keep: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """Splits by the largest drop in Gini impurity, into leaves of two rows at least; equal drops go to the first feature and limit."""
    x, y = rows[:, :-1], rows[:, -1]
    node = Node(bool(y.mean() >= 0.5))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return node
    best = 1e-9
    whole = y.mean() * (1 - y.mean())
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            a, b = y[low], y[~low]
            if min(len(a), len(b)) < least:
                continue
            gain = whole - (len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())) / len(y)
            if gain > best:
                best, node.feature, node.limit = gain, f, float(limit)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.limit
        node.low, node.high = grow(rows[low], depth - 1, least), grow(rows[~low], depth - 1, least)
    return node


def keeps(tree: Node, row: tuple[float, ...]) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.limit else tree.high
    return tree.keep


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    shape = features([(b.words, b.link, b.kind) for b in found])
    return "\n".join(b.text for b, row in zip(found, shape, strict=True) if keeps(tree, row) and not b.marked)


def extract(pages: DataFrame, labelled: np.ndarray | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages(page_id, url, html, ...)``."""
    tree = grow(sketched() if labelled is None else labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py(), tree) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(tables.read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_html_text": op7_html_text}

#: The gold text of the given pages, whose articles hold headings and paragraphs alone and whose entities are the five of XML.
_SQL = r"""
WITH parts AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?p>|</?h1>') AS p FROM pages
), texts AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(p, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace(replace(x, '<b>', ''), '</b>', ''), '<br>', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM parts
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
SQL: dict[str, str] = {"op7_html_text": _SQL}
