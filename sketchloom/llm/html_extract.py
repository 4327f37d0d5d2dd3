"""HTML main-text extraction with site template removal.

Each page is parsed once into text blocks with the elements they stand in.  Every block
element's subtree has a hash of its tags and text.  Spark counts, by host, the different
contents that hold a subtree, and subtrees that recur in many contents of their host are
template: their blocks go, inside an article as well as on pages without one.  A page's
content is its article (or all its blocks), so that copies of one page count once and are
no template.

Tags, roles and class names decide beside the counts: what stands outside the article of a
page that has one, navigation, headers, footers, asides, forms, adverts, notices and reader
comments go at once, however rare they are on their host.

Defined cases: null or empty html gives the empty text; a null url, or one without ``://``,
belongs to the empty host; repeated rows count as one content and each get a row; malformed
markup is closed as browsers close it; where template would take more than half of an
article, or all of another page, the page keeps its blocks; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_checked, lower_ascii, stored


@dataclass(frozen=True)
class TemplateRule:
    """A subtree is template if at least ``min_pages`` different contents of its host, and ``min_percent`` % of them, hold it."""

    min_pages: int = 5
    min_percent: int = 20
    #: Pages on which it is template whatever their share of the host's, as for a section of a large site.
    many_pages: int = 100
    #: An article of which less than this remains keeps all its blocks.
    keep_percent: int = 50


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SKIP = frozenset(
    "script style noscript template head title nav header footer aside form button select textarea option iframe object embed svg canvas math menu dialog audio video xmp noembed noframes input label".split()
)
_BLOCK = frozenset(
    "html body address article blockquote center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section summary table tbody td tfoot th thead tr ul header footer nav aside form menu dialog legend caption".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "option": {"select"}}
_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|\w*nav|navbar|navigation|nav-?links|menu|menubar|breadcrumbs?|sidebar|side|widget|footer|foot|masthead|site-?header|page-?header|"
    r"cookies?|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"top-?bar|copyright|disclaimer|comment|comments|disqus|replies|respond|comment-?list|search|pagination|pager|skip-?link|toolbar)(?:$|[-_\s\d])",
    re.I,
)
#: Names that mean the page's frame outside an article, and the article's own parts inside one.
_FRAME = re.compile(r"(?:^|[\s])(?:header|heading|masthead|top|bottom|logo|brand|legal|tags|meta)(?:$|[\s])", re.I)
_HOLDS = ("has-", "has_", "with-", "with_", "no-", "no_", "is-", "not-", "without-")
_ASIDE = re.compile(r"(?:^|\s)(?:comment|comment-\d+|comment-body|reply|ad|advert|promo|sponsored|related|teaser)(?:$|\s)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|(?P<other>[!?][^>]*)(?:>|\Z)|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WHITE = re.compile(r"\s+")


class _Element:
    __slots__ = ("children", "content", "name", "own", "skip")

    def __init__(self, name: str, own: bool, parent: _Element | None):
        self.name, self.children = name, []
        self.own = own  # unwanted by itself
        self.skip = own or (parent is not None and parent.skip)
        self.content = name in ("article", "main") or (parent is not None and parent.content)


def _unwanted(name: str, attributes: str, content: bool) -> bool:
    if name in _SKIP:
        # an article's own header holds its title
        return not (content and name == "header")
    if not attributes:
        return False
    found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("role", "").lower() in _ROLES:
        return True
    if name in ("html", "body", "main"):
        return False
    if name == "article":  # its class may tell of the page's layout; only what it is itself counts
        return bool(_ASIDE.search(found.get("class", "")) or _ASIDE.search(found.get("id", "")))
    # has-sidebar and the like tell of what an element holds, not of what it is
    named = [t for t in f"{found.get('class', '')} {found.get('id', '')}".split() if not t.lower().startswith(_HOLDS)]
    return any(_NAMES.search(x) for x in named) or (not content and any(_FRAME.search(x) for x in named))


def parse(html: str) -> _Element:
    """The element tree; text is str among the children."""
    root = _Element("", False, None)
    stack = [root]

    def close(names, barrier=()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in barrier:
                return

    at, raw = 0, None
    while at < len(html):
        if raw:
            m = re.compile(rf"</{raw}(?=[\s/>]|\Z)", re.I).search(html, at)
            end = m.start() if m else len(html)
            if raw not in ("script", "style"):
                stack[-1].children.append(html[at:end])
            at, raw = end, None
            if m is None:
                break
        start = html.find("<", at)
        if start < 0:
            stack[-1].children.append(html[at:])
            break
        if start > at:
            stack[-1].children.append(html[at:start])
        m = _TAG.match(html, start)
        if m is None:
            stack[-1].children.append("<")
            at = start + 1
            continue
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "p" and not any(e.name == "p" for e in stack):
                stack[-1].children.append(_Element("p", False, stack[-1]))
            close({name}, () if name in _BLOCK else _CLOSES_P | {"td", "th", "table", "body"})
            continue
        if name in _CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "blockquote", "li"})
        if name in _SIBLINGS:
            close(_SIBLINGS[name], _BARRIER[name])
        if name in ("html", "body", "head") and any(e.name == name for e in stack):
            continue
        if name == "body" or (name in _BLOCK and name != "html"):
            close({"head"})
        parent = stack[-1]
        e = _Element(name, _unwanted(name, m["attributes"], parent.content), parent)
        parent.children.append(e)
        if name not in _VOID and not m["attributes"].rstrip().endswith("/") | (name in _VOID):
            stack.append(e)
            if name in _RAW:
                raw = name
    return root


def _hash(e: _Element, out: dict) -> int:
    """Hashes of all subtrees, bottom up, by element; without recursion."""
    todo = [(e, False)]
    while todo:
        x, done = todo.pop()
        if not done:
            todo.append((x, True))
            todo += [(c, False) for c in x.children if not isinstance(c, str)]
            continue
        h = xxhash.xxh64(x.name.encode())
        for c in x.children:
            if isinstance(c, str):
                if text := _WHITE.sub(" ", c).strip():
                    h.update(b"t" + text.encode("utf-8", "replace"))
            else:
                h.update(b"e" + out[id(c)].to_bytes(8, "big"))
        out[id(x)] = h.intdigest()
    return out[id(e)]


def _elements(root: _Element, into=lambda _: True):
    """All elements, in page order; below those that ``into`` refuses, none."""
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        if into(x):
            todo += [c for c in reversed(x.children) if not isinstance(c, str)]


_NEVER = frozenset("nav aside footer header script style noscript template head dialog".split())


def _rescue(root: _Element) -> bool:
    """Take an article back that only a form or a name around it had thrown out, on a page without another."""
    found = False
    for x in _elements(root, lambda e: e.name not in _NEVER):
        if x.name in ("article", "main") and not x.own:
            found = True
            for e in _elements(x, lambda e: not e.own):
                e.skip = e.own
    return found


def _inline(text: str) -> str:
    return _WHITE.sub(" ", unescape(text)).strip()


#: Elements whose subtrees are never template: whole pages and articles; and, inside an
#: article, parts that may well recur in content (a paragraph, a heading, a cell): a quoted
#: passage is no template, a box around it is.
_WHOLE = frozenset(["", "html", "body", "article", "main"])
_PARTS = frozenset("p blockquote pre center h1 h2 h3 h4 h5 h6 hr li dt dd td th tr tbody thead tfoot caption figcaption summary legend".split())


def blocks_of(html: str | None) -> tuple[list[tuple[str, list[int]]], list[int], bool, int]:
    """A page's blocks (text, hashes of the removable subtrees they stand in), its distinct
    removable subtree hashes, whether it has an article, and the hash of its content.

    On a page with an article (or main) only blocks inside it are returned.  Removable are
    the block elements below the article or the body but for ``_PARTS``.
    """
    root = parse(html or "")
    hashes: dict[int, int] = {}
    _hash(root, hashes)
    has_article = any(x.name in ("article", "main") and not x.skip for x in _elements(root)) or _rescue(root)
    frame = _WHOLE | _PARTS if has_article else _WHOLE
    blocks: list[tuple[str, list[int]]] = []
    words: list[str] = []
    inside: list[int] = []

    def flush() -> None:
        if text := _inline("".join(words)):
            blocks.append((text, list(inside)))
        words.clear()

    stack = [(root, False)]
    while stack:
        x, leave = stack.pop()
        if isinstance(x, str):
            words.append(x)
            continue
        if has_article and not x.content:  # outside: only look for articles below
            stack += [(c, False) for c in reversed(x.children) if not isinstance(c, str)]
            continue
        if leave or x.skip:
            if x.name in _BLOCK:
                flush()
                if leave and x.name not in frame:
                    inside.pop()
            continue
        if x.name == "br":
            words.append(" ")
            continue
        if x.name in _BLOCK:
            flush()
            stack.append((x, True))
            if x.name not in frame:
                signed = hashes[id(x)]
                inside.append(signed - (1 << 64) if signed >> 63 else signed)
        stack += [(c, False) for c in reversed(x.children)]
    flush()
    content = xxhash.xxh64_intdigest("\n".join(t for t, _ in blocks).encode("utf-8", "replace"))
    return blocks, sorted({h for _, own in blocks for h in own}), has_article, content - (1 << 64) if content >> 63 else content


def extract(pages: DataFrame, rule: TemplateRule = TemplateRule()) -> DataFrame:
    """(page_id, url, host, text, n_chars, n_template) for every page; the last counts blocks that went as template.

    Parsed blocks are written once to the shared folder; what is shuffled is hashes of
    subtrees and contents and, for the pages that hold template, the verdicts.
    """
    host = lower_ascii(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    source = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kinds = dict(source.dtypes)
    block = pa.struct([("text", pa.string()), ("inside", pa.list_(pa.int64()))])

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                parsed = [blocks_of(x.as_py()) for x in batch.column(3)]
                uid = pa.array(range(row, row + batch.num_rows), pa.int64())
                row += batch.num_rows
                found = pa.array([[{"text": t, "inside": h} for t, h in b] for b, *_ in parsed], pa.list_(block))
                more = [pa.array([x[k] for x in parsed], kind) for k, kind in ((1, pa.list_(pa.int64())), (2, pa.bool_()), (3, pa.int64()))]
                yield pa.RecordBatch.from_arrays([uid, *batch.columns[:3], found, *more], ["uid", "page_id", "url", "host", "blocks", "subtrees", "article", "content"])

    schema = f"uid bigint, page_id {kinds['page_id']}, url string, host string, blocks array<struct<text:string,inside:array<bigint>>>, subtrees array<bigint>, article boolean, content bigint"
    parsed = stored(source.mapInArrow(run, schema))
    size = parsed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    held = parsed.select("host", "content", F.explode("subtrees").alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    recurring = join_checked(held.where(F.col("n") >= rule.min_pages), durable(size), "host", "inner")
    enough = (F.col("n") >= rule.many_pages) | (100 * F.col("n") >= rule.min_percent * F.col("pages"))
    template = durable(recurring.where(enough).select("host", "h"))
    hits = join_checked(parsed.select("uid", "host", F.explode("subtrees").alias("h")), template, ["host", "h"], "inner")
    gone = hits.groupBy("uid").agg(F.collect_set("h").alias("gone"))  # at most a page's elements
    left = join_checked(parsed, durable(gone), "uid", "left")
    kept = F.filter("blocks", lambda b: F.col("gone").isNull() | ~F.arrays_overlap(b["inside"], F.col("gone")))
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))
    least = F.when(F.col("article"), rule.keep_percent).otherwise(0) * chars("blocks")
    kept = F.transform(F.array(kept), lambda k: F.when((F.size(k) > 0) & (100 * chars(k) >= least), k).otherwise(F.col("blocks")))[0]
    text = F.array_join(F.transform("kept", lambda b: b["text"]), " ")
    out = left.withColumn("kept", F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(kept))
    out = out.select("page_id", "url", "host", text.alias("text"), (F.size("blocks") - F.size("kept")).cast("long").alias("n_template"))
    return out.select("page_id", "url", "host", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
