"""Main text of web pages by nearest-URL page differencing.

Each page becomes lines, its blocks of text in page order. Pages are ordered by URL path within each
host; a page is paired with the one of its two neighbours whose path shares the longer prefix, the
lines of both are aligned by longest common subsequence, and shared lines are deleted as template.

Differencing alone deletes what an article shares with its neighbour's, and keeps menus and adverts
that only one page shows (the README has figures). So the markup corrects it both ways: a shared
line inside an article or main element stays; a line that is not shared goes if it stands in
navigation, headers, footers, sidebars, notices, adverts, forms or comments. Of all other lines
differencing alone decides. Scripts and styles have no lines.

An article or main element is the article also inside a form or a wrapper that is marked by its
class, unless its own class or id says that it is a comment. Inside an article only a container
whose class or role is a word of such marks goes by its name; where the word is part of a longer
one, or marks a smaller element, differencing decides; ids say nothing.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import assigned, in_order

# Elements of HTML by what they mean here.
_RAW = "script style noscript textarea iframe title"  # run to their end tag or the end of the page
_NESTED = "svg math template object canvas select"  # may close themselves, hold their like or be left open
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CHROME = frozenset("nav header footer aside button menu dialog".split())
_WRAPPERS = frozenset("form fieldset".split())  # no part of an article, but one may stand inside
_MAIN = frozenset("article main".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
_ENDS_ITSELF = frozenset("li dd dt tr option".split())
#: Words in class, id or role that mark a container as no part of the article.
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
_MAIN_WORDS = frozenset("main article".split())
_COMMENTS = re.compile(r"(?:div-)?comments?(?:-|$)")
#: Parts of a longer class or id beside which a word still marks, and first parts that say the opposite or nothing.
_NEUTRAL = frozenset("site page main top bottom left right global primary secondary box block wrapper wrap container area section bar list item content inner outer text unit slot link links form menu message popup overlay modal widget".split())
_NEGATING = frozenset("has have with without no not is hide show js enable disable".split())
_CONTAINERS = frozenset("div section ul ol".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""  # to the end of a tag, past quoted values
_ATTRIBUTES = rf"(?=[\s/>])(?:{_QUOTED}>|[^>]*+>)"  # if a quote is left open, to the first end
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(_RAW.split()) + ")" + _ATTRIBUTES + r"|<(?P<end>/?)(?P<nested>" + "|".join(_NESTED.split()) + ")" + _ATTRIBUTES + r"|<![^>]*+>|<\?[^>]*+>", re.S | re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW.split()}
#: The first tag that an open drawing or list of options cannot hold.
_LEAVES = {
    "svg": re.compile(r"</?(?:address|article|aside|b|big|blockquote|body|br|center|code|dd|details|div|dl|dt|em|figure|footer|form|h[1-6]|header|hr|html|i|img|li|main|menu|nav|ol|p|pre|section|small|span|strong|sub|sup|table|tbody|td|th|tr|tt|u|ul|var)(?=[\s/>])", re.I),
    "select": re.compile(r"</?(?!(?:option|optgroup)[\s/>])[a-z]", re.I),
}
_LEAVES["math"] = _LEAVES["svg"]
_TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:({_QUOTED})>|([^>]*+)>)")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_MARKS = re.compile(r"(?:class|id|role)\s*=", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")

#: Where a block stands: in the article, in a container that is no part of it, or in neither.
IN, OUT, OPEN = "i", "o", "u"
_DOUBT = "d"  # in a marked part of an article: its blocks are OPEN
_WRAPPED = "w"  # in a marked container that may hold an article: its own blocks are OUT
_SHOWN_AS = {_DOUBT: OPEN, _WRAPPED: OUT}


def marks(attributes: str) -> list[tuple[str, str]]:
    """(name, value) of the attributes that mark an element, in lower case."""
    if not _MARKS.search(attributes):
        return []
    return [(name.lower(), value.strip("\"'").lower()) for name, value in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role")]


def _in_article(name: str, marked: list[tuple[str, str]], place: str) -> str:
    """The place within an element of an article that carries marks. A container's own header is the article's."""
    tokens = {t for kind, value in marked if kind != "id" for t in value.split()} - {"header"}
    if name in _HEADINGS:
        return place
    if tokens & _CHROME_WORDS:
        return OUT if name in _CONTAINERS else _DOUBT
    return _DOUBT if name in _CONTAINERS and any(w in _CHROME_WORDS for t in tokens for w in _WORD.findall(t)) else place


def _marks_chrome(name: str, marked: list[tuple[str, str]]) -> bool:
    """Whether marks outside an article say that an element is no part of it: by a whole class, id or role, or for containers by a part of a longer one."""
    for kind, value in marked:
        for token in value.split():
            if token in _CHROME_WORDS:
                return True
            parts = _WORD.findall(token)
            if name in _CONTAINERS and parts and parts[0] not in _NEGATING and any(w in _CHROME_WORDS for w in parts):
                if kind != "id" or all(w in _CHROME_WORDS or w in _NEUTRAL for w in parts):
                    return True
    return False


def _is_comment(marked: list[tuple[str, str]]) -> bool:
    return any(_COMMENTS.match(t) for _, value in marked for t in value.split())


def shown(page: str) -> str:
    """The page without comments, declarations and elements whose text it does not show.

    What stands in a head and is not dropped here has no text; text or an element that may not stand
    there ends the head. Nested elements are paired by their tags. One without an end tag hides its
    own kind of content only: a drawing or list of options ends at the first tag that it cannot
    hold, of the others the tag alone goes. A tag that the end of the page cuts off goes. Time is in
    proportion to the page.
    """
    last_end = page.rfind(">") + 1  # no tag begins after it, so each scan for an end finds one
    drops: list[tuple[int, int]] = []
    stack: list[tuple[str, int, int]] = []  # open nested elements: (name, start, end) of their tags
    opened = dict.fromkeys(_NESTED.split(), 0)
    clear = (-1, 0)  # how far the content of the innermost drawing is known to hold no tag that ends it
    m = _DROPPED.search(page, 0, last_end)
    while m:
        end = m.end()
        itself = page[end - 2] == "/"
        if m[0].startswith("<!--") and end == last_end and not m[0].endswith("-->"):
            end = len(page)  # a comment that is never closed
        if m["raw"]:
            drawn = next((x for x in reversed(stack) if x[0] in ("svg", "math")), None) if itself and (opened["svg"] or opened["math"]) else None
            if drawn and clear[0] != drawn[2]:
                clear = (drawn[2], drawn[2])
            if drawn and clear[1] >= 0:
                clear = (drawn[2], -1 if _LEAVES["svg"].search(page, clear[1], m.start()) else m.start())
            if not (drawn and clear[1] >= 0):  # in a drawing it may close itself
                last = _RAW_END[m["raw"].lower()].search(page, end)
                end = last.end() if last else len(page)
        elif m["nested"]:
            name = m["nested"].lower()
            if m["end"]:
                while opened[name]:
                    last_name, start, _ = stack.pop()
                    opened[last_name] -= 1
                    if last_name == name:
                        drops.append((start, end))
                        break
            elif not (itself and name in ("svg", "math")):
                stack.append((name, m.start(), end))
                opened[name] += 1
        drops.append((m.start(), end))
        m = _DROPPED.search(page, end, last_end)
    hidden = 0
    for name, start, end in stack:
        if name in _LEAVES and start >= hidden:
            last = _LEAVES[name].search(page, end)
            hidden = last.start() if last else len(page)
            drops.append((start, hidden))
    cut = _CUT_TAG.search(page, last_end)
    if cut:
        drops.append((cut.start(), len(page)))
    parts, at = [], 0
    for start, end in sorted(drops):
        if start > at:
            parts.append(page[at:start])
        at = max(at, end)
    parts.append(page[at:])
    return " ".join(parts)


def blocks(page: str | None) -> tuple[list[str], str]:
    """Blocks of a page in order, references decoded and white space made one, and their places (a letter each)."""
    if not page:
        return [], ""
    page = shown(page)
    texts: list[str] = []
    places: list[str] = []
    now: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that have a place: (name, place within)
    opened: dict[str, int] = defaultdict(int)
    place, at = OPEN, 0

    def end_block() -> None:
        if now:
            text = _SPACES.sub(" ", html.unescape("".join(now))).strip()
            if text:
                texts.append(text)
                places.append(_SHOWN_AS.get(place, place))
            now.clear()

    for m in _TAG.finditer(page, 0, page.rfind(">") + 1):
        if m.start() > at:
            now.append(page[at : m.start()])
        at = m.end()
        name, attributes = m[2].lower(), m[3] if m[4] is None else m[4]
        if name in _INLINE and not opened[name] and not (attributes and marks(attributes)):
            if name == "br":
                now.append(" ")
            continue
        if m[1]:
            if opened[name] > 0:
                end_block()
                while stack:  # an element left open ends with the one around it
                    last, _ = stack.pop()
                    opened[last] -= 1
                    if last == name:
                        break
                place = stack[-1][1] if stack else OPEN
            elif name not in _INLINE:
                end_block()
            continue
        if stack and ((stack[-1][0] == "p" and name in _ENDS_P) or (stack[-1][0] == name and name in _ENDS_ITSELF)):
            end_block()  # its end tag was left out
            opened[stack.pop()[0]] -= 1
            place = stack[-1][1] if stack else OPEN
        inside = place
        if place != OUT:
            marked = marks(attributes) if attributes else []
            if name in _CHROME and not (place in (IN, _DOUBT) and name == "header"):
                inside = OUT
            elif name in _MAIN:
                inside = OUT if name == "article" and _is_comment(marked) else IN
            elif place in (IN, _DOUBT):
                inside = OUT if name in _WRAPPERS else _in_article(name, marked, place)
            elif place == OPEN and (name in _WRAPPERS or (name not in ("html", "body") and _marks_chrome(name, marked))):
                inside = _WRAPPED
            elif place == OPEN and name in ("div", "section") and any(w in _MAIN_WORDS for _, x in marked for w in _WORD.findall(x)):
                inside = IN
        if name not in _INLINE or inside != place:
            end_block()
        tracked = name in ("div", "section", "ul", "ol", "table", "td") or inside != place or opened[name] > 0
        if tracked and name not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append((name, inside))
            opened[name] += 1
            place = inside
    now.append(page[at:])
    end_block()
    return texts, "".join(places)


def common(a: list, b: list) -> list[bool]:
    """Which lines of a are in a longest common subsequence with b (Hunt and Szymanski: time follows the matches)."""
    where = defaultdict(list)
    for j, line in enumerate(b):
        where[line].append(j)
    ends: list[int] = []  # smallest end in b of a common subsequence of each length
    links: list[tuple | None] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    shared, link = [False] * len(a), links[-1] if links else None
    while link:
        shared[link[0]] = True
        link = link[1]
    return shared


def host_path(url: str) -> tuple[Column, Column]:
    """Host without www, and path without index names, extension, closing slash, query and fragment."""
    rest = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_replace(F.substring_index(rest, "/", 1), r"^www\.|:[0-9]+$", ""))
    path = F.regexp_replace(rest, r"^[^/]*", "")
    return host, F.regexp_replace(F.regexp_replace(path, r"(/index)?\.(html?|php|aspx?)$", ""), r"/+$", "")


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, ``text`` and ``n_chars`` of every page: its main lines joined by newlines.

    Also how it came to them: ``n_lines`` of the page, ``n_shared`` of them with its neighbour,
    ``n_template`` shared ones deleted, ``n_marked`` others deleted by the markup.

    A null or empty page has an empty text. Pages are put in order by host, path and id, and dealt
    out by ranges of that order, so a host with a third of all pages is split; a page is compared
    with one neighbour on the same host and no result depends on the partitioning (pages that
    repeat an id and a path may stand in either order). Null URLs are one host without a path.
    Pages are parsed and aligned whole, in time that follows their length (and the matches of lines
    that repeat). An empty table gives an empty result. Shuffled are hashes of all lines, and the
    texts of those that may stay; other columns are not read.
    """
    host, path = host_path(url_col)
    chosen = pages.select(host.alias("host"), path.alias("path"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()

    placed = assigned(chosen, ["host", "path", "id"], before=True, after=True)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                texts, lines, places = [], [], []
                for page in batch.column(4).to_pylist():
                    t, p = blocks(page)
                    texts.append([x if y != OUT else None for x, y in zip(t, p)])
                    lines.append([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in t])
                    places.append(p)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 3, 5, 6)), pa.array(texts, pa.list_(pa.string())), pa.array(lines, pa.list_(pa.int64())), pa.array(places, pa.string())], ["host", "path", "id", "url", "part", "own", "blocks", "lines", "places"])

    parsed = placed.select("host", "path", "id", "url", "html", "part", "own").mapInArrow(parse, f"host string, path string, id {kind}, url string, part int, own boolean, blocks array<string>, lines array<bigint>, places string")
    dealt = in_order(parsed.withColumn("blocks", F.when(F.col("own"), F.col("blocks"))), ["host", "path", "id"])  # of a borrowed page the lines suffice

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided(prev: dict | None, row: dict, nxt: dict | None) -> tuple:
            near = [x for x in (prev, nxt) if x is not None and x["host"] == row["host"]]
            shared = [False] * len(row["lines"])
            if near:
                best = max(near, key=lambda x: _prefix(x["path"], row["path"]))  # of equals the one before
                shared = common(row["lines"], best["lines"])
            text = "\n".join(b for b, p, s in zip(row["blocks"], row["places"], shared) if p == IN or (p == OPEN and not s))
            template = sum(s and p != IN for p, s in zip(row["places"], shared))
            marked = sum(not s and p == OUT for p, s in zip(row["places"], shared))
            return row["id"], row["url"], text, len(shared), sum(shared), template, marked

        prev = row = None
        out: list[tuple] = []
        for nxt in _rows(batches):
            if row is not None and row["part"] != nxt["part"]:
                if row["own"]:
                    out.append(decided(prev, row, None))
                prev, row = None, nxt
                continue
            if row is not None and row["own"]:
                out.append(decided(prev, row, nxt))
                if len(out) == 512:
                    yield _batch(out, types)
                    out = []
            prev, row = row, nxt
        if row is not None and row["own"]:
            out.append(decided(prev, row, None))
        if out:
            yield _batch(out, types)

    types = _arrow(pages.select(F.col(id_col), F.col(url_col)))
    return dealt.select("part", "own", "host", "path", "id", "url", "blocks", "lines", "places").mapInArrow(differ, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield from batch.slice(a, 256).to_pylist()


def _arrow(df: DataFrame) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in df.schema]


_COUNTS = ("n_lines", "n_shared", "n_template", "n_marked")


def _batch(rows: list[tuple], types: list) -> pa.RecordBatch:
    (a, kind), (b, _) = types
    texts = [r[2] for r in rows]
    counts = [pa.array([r[3 + k] for r in rows], pa.int64()) for k in range(len(_COUNTS))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *counts], [a, b, "text", "n_chars", *_COUNTS])
