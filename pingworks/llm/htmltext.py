"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between block-level tags, each with the path of
block-level tags from the root and, apart from it, what of it is link text.  Text length
and punctuation are summed by path and divided by the number of its blocks.  Both ratios
are smoothed along the page with weights that fall with distance and with how far two paths
are apart, fused by their geometric mean, and averaged by path; paths over a share of the
page's mean are content.  The deepest element that holds most of the content text is the
article: what else lies in it (headings, short items) is taken in unless it is mostly links.

Elements that by tag, or by a word of their class, id or role, are menus, headers, footers,
sidebars, notices, adverts, forms or comments never count; a class does not count where the
element holds the page's main heading or article.  A page is one row and is worked on where it is: no
shuffle.

Defined cases: null html is an empty page; null page_id and url pass; repeated rows are
pages of their own; broken markup (open tags, stray ends, quotes that never close) costs no
text, and unclosed scripts reach to the end of the page; a line break starts a new block;
very long pages take time by their length (tested at 3 MB); other columns are left behind; an
empty table gives an empty result."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pingworks.llm.shared import bound_batches

# Tags of HTML by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNREAD = frozenset("head svg template object video audio canvas select option button label fieldset legend datalist output nav footer aside form dialog menu".split())
#: What a start tag closes, up to the tags that bound it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that may hold an article; the root has no tag.
SECTIONS = frozenset(("", *"html body main article section div td center".split()))
BOUNDS = frozenset("ul ol dl table".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: Words of a class, id or role that name what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup login share sharing social "
    "related recommended comment comments disqus replies widget toolbar pagination pager masthead copyright legal complementary contentinfo search".split()
)

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|=|$)", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

ARTICLE_WEIGHT = 4.0
WINDOW = 2
SHARE, HOLDS, LINKS = 0.3, 0.8, 0.5


class _Path:
    """A tag path from the root; equal paths of a page are one object."""

    __slots__ = ("above", "tag", "depth", "below")

    def __init__(self, above: _Path | None, tag: str) -> None:
        self.above, self.tag, self.depth, self.below = above, tag, above.depth + 1 if above else 0, {}

    def to(self, tag: str) -> _Path:
        found = self.below.get(tag)
        if found is None:
            found = self.below[tag] = _Path(self, tag)
        return found

    def __str__(self) -> str:
        names, p = [], self
        while p is not None:
            names.append(p.tag)
            p = p.above
        return "/".join(reversed(names))


class _Element:
    __slots__ = ("parent", "tag", "path", "inside", "unread", "marked", "main", "own", "within")

    def __init__(self, parent: _Element | None, tag: str, attributes: str) -> None:
        self.parent, self.tag = parent, tag
        self.path = parent.path.to(tag) if parent else _Path(None, tag)
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        words = {w for m in _NAMED.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())} if "=" in attributes else set()
        self.unread = tag in UNREAD or (tag == "header" and not self.inside) or bool(_HIDDEN.search(attributes.split("=", 1)[0]))
        self.marked = tag not in ("html", "body", "main") and (not MARKS.isdisjoint(words) or ("header" in words and not self.inside))
        self.main = self.within = False  # holds the main heading or an article; lies in the article found
        self.own = 0

    def holds_main(self) -> None:
        e = self
        while e is not None and not e.main:
            e.main = True
            e = e.parent


class _Block:
    __slots__ = ("at", "text", "size", "marks", "linked", "smooth")

    def __init__(self, at: _Element, text: str, linked: int) -> None:
        self.at, self.text = at, text
        self.linked = min(linked, len(text))
        self.size = len(text) - self.linked
        self.marks = len(_PUNCTUATION.findall(text)) if self.size else 0
        self.smooth = 0.0


def blocks(page: str) -> tuple[list[_Block], list[_Element]]:
    """The page's blocks in order, scripts and the like left out, and its elements,
    parents first."""
    root = _Element(None, "", "")
    out, elements, open_tags = [], [root], Counter()
    at, links, parts, linked = root, 0, [], 0
    pos = 0
    ahead = {'"': -1, "'": -1}

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(_Block(at, text, linked))
            parts.clear()
        linked = 0

    def leave(e: _Element) -> None:
        """Close all up to ``e`` and it too."""
        nonlocal at
        while at is not e.parent:
            open_tags[at.tag] -= 1
            at = at.parent

    while True:
        m = _TAG.search(page, pos)
        text = page[pos : m.start()] if m else page[pos:]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        ending, tag, attributes = m[1], m[2].lower(), m[3]
        if "'" in attributes or '"' in attributes:
            pos = _tag_end(page, m.start(3), pos, ahead)
            attributes = page[m.start(3) : pos - 1]
        if tag in RAW and not ending:
            end = _RAW_END[tag].search(page, pos)
            pos = end.start() if end else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if ending else 1
            continue
        close()
        if tag in VOID:
            continue
        if ending:
            if open_tags[tag]:
                e = at
                while e.tag != tag:
                    e = e.parent
                leave(e)
                links = 0
            continue
        if at.tag == "p":
            leave(at)
        if tag in CLOSES and any(open_tags[t] for t in CLOSES[tag]):
            e, last = at, None
            while e.parent is not None and e.tag not in BOUNDS:
                if e.tag in CLOSES[tag]:
                    last = e
                    if e.tag == tag:
                        break
                e = e.parent
            if last is not None:
                leave(last)
        at, links = _Element(at, tag, attributes), 0
        elements.append(at)
        open_tags[tag] += 1
        if tag in ("h1", "main") or (tag == "article" and not at.marked):
            at.holds_main()
    close()
    return out, elements


def _tag_end(page: str, start: int, end: int, ahead: dict[str, int]) -> int:
    """Where a tag with quotes ends: a > within quotes does not end it, unless the quote
    never closes.  ``ahead`` keeps where each kind of quote comes next."""

    def following(q: str, i: int) -> int:
        if ahead[q] < i:
            found = page.find(q, i)
            ahead[q] = found if found >= 0 else len(page)
        return ahead[q]

    i = start
    while True:
        first, q = min((following(q, i), q) for q in "\"'")
        if first >= end:
            return end
        last = following(q, first + 1)
        if last == len(page):
            return end
        i = last + 1
        if i >= end:
            end = page.find(">", i) + 1
            if end == 0:
                return len(page)


def _apart(a: _Path, b: _Path) -> float:
    """Weight by how many tags two paths do not share."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
        steps += 1
    return 2.0 / (2.0 + steps)


_NEAR = [math.exp(-d * d / 2.0) for d in range(WINDOW + 1)]


def _holder(read: list[_Block], elements: list[_Element], chosen: set[_Path]) -> _Element | None:
    """The deepest section that holds most of the chosen text, or the article around it;
    its parent where that has the main heading."""
    whole = 0
    for b in read:
        if b.at.path in chosen:
            whole += len(b.text)
            b.at.own += len(b.text)
    for e in reversed(elements[1:]):
        e.parent.own += e.own
    found = max((e for e in elements if e.own and e.own >= HOLDS * whole and e.tag in SECTIONS), key=lambda e: e.path.depth, default=None)
    if found is None:
        return None
    if found.inside:
        while found.tag not in ("article", "main"):
            found = found.parent
        return found
    above = found.parent
    if above is not None and above.tag not in ("", "html", "body") and any(b.at.tag == "h1" and b.at.parent is above for b in read):
        return above
    return found


def content(found: list[_Block], elements: list[_Element]) -> list[_Block]:
    """The blocks of the article, in page order."""
    for e in elements[1:]:
        e.unread = e.unread or e.parent.unread or (e.marked and not (e.main and e.tag != "article"))
    read = [b for b in found if not b.at.unread]
    sums: dict[_Path, list] = {}
    for b in read:
        s = sums.setdefault(b.at.path, [0, 0, 0])
        s[0] += 1
        s[1] += b.size
        s[2] += b.marks
    if not sums:
        return []
    weigh = lambda b: ARTICLE_WEIGHT if b.at.inside else 1.0
    length = {p: s[1] / s[0] for p, s in sums.items()}
    marks = {p: (s[2] + 0.5) / s[0] for p, s in sums.items()}
    top_length, top_marks = max(length.values()) or 1.0, max(marks.values())
    for i, b in enumerate(read):
        all_of = size = mark = 0.0
        for j in range(max(0, i - WINDOW), min(len(read), i + WINDOW + 1)):
            w = _NEAR[abs(i - j)] * _apart(b.at.path, read[j].at.path)
            all_of += w
            size += w * length[read[j].at.path] / top_length
            mark += w * marks[read[j].at.path] / top_marks
        b.smooth = weigh(b) * math.sqrt(size * mark) / all_of
    value: dict[_Path, float] = dict.fromkeys(sums, 0.0)
    for b in read:
        value[b.at.path] += b.smooth / sums[b.at.path][0]
    total = sum(s[1] for s in sums.values())
    mean = sum(value[p] * s[1] for p, s in sums.items()) / total if total else 0.0
    chosen = {p for p, v in value.items() if v >= SHARE * mean and (sums[p][1] or not total)}
    holder = _holder(read, elements, chosen)
    for e in elements:
        e.within = e is holder or (e.parent is not None and e.parent.within)
    return [b for b in read if b.at.path in chosen or (b.at.within and b.linked <= LINKS * len(b.text))]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in content(*blocks(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    bound_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
