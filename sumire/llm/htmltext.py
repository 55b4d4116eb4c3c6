"""HTML extraction by a site style tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, table
from .urlfilter import host_of

#: Importance below which a branch goes, pages of a host that its style must have, and damping of deeper levels.
LOW, PAGES, DEEP = 0.2, 5, 0.9
#: Depth beyond which nodes lie side by side, as in browsers.
DEEPEST = 512
#: Low branches that a broadcast holds at most; beyond it they are joined by host.
BROADCAST_ROWS = 20_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|template|iframe|noscript|noembed|xmp|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre xmp figure figcaption address details summary hr header footer nav aside form fieldset hgroup center menu dialog".split()
)
#: Of the hashes of runs of text.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6
SPACED = frozenset("br td th".split())
#: What an opening tag closes, and the tags beyond which it doesn't look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NEVER = frozenset("head nav footer aside form script style select button input textarea object canvas video audio map menu dialog datalist template svg".split())
#: Foreign content: a tag there may close itself. Tags of HTML that end it, but not within those that hold HTML.
FOREIGN, HOLDS_HTML = frozenset(("svg", "math")), frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article main section aside nav header footer figure form".split())
ROOTS = frozenset(("html", "body", "article", "main"))
#: Words that name such a part as the first or last of a class or id.
REGIONS = frozenset("adsense adverts advertisement advertisements nav navbar sidebar sidebars breadcrumb breadcrumbs footer masthead gdpr commentlist disqus pager pagination toolbar".split())
#: Words that also occur in the names of subjects (social-science, market-share): all parts must be such words, or ones like box and list.
NOISE = frozenset(
    "ad ads adv advert advertising banner banners sponsor sponsored sponsors promo promos promotion navigation menu menus cookie cookies consent notice notices popup popups modal overlay newsletter subscribe subscription signup login comment comments reply replies respond related recommended recommendations share sharing social widget widgets skip copyright disclaimer alert alerts toast".split()
)
HELPERS = frozenset(
    "area bar block body bottom box btn button buttons col column container content count form group header heading holder icon icons inner item items left link links list main media meta middle module outer page panel post posts articles right row section side site slot text thread title to top unit wrap wrapper".split()
)
#: Names with such words don't make these noise within an article.
SPARED = frozenset("h1 h2 h3 h4 h5 h6 hgroup p".split())
#: In a class like has-sidebar or comments-open: it tells something about what holds the part, and doesn't name the part.
ABOUT = frozenset("has with without no non open closed enabled disabled layout".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "style", "up", "items", "noise", "holds", "path", "depth", "content")

    def __init__(self, tag: str, style: str, up: Node | None, noise: bool):
        self.tag, self.style, self.up, self.noise, self.depth = tag, style, up, noise, up.depth + 1 if up else 0
        self.items: list[Node | str] = []
        self.holds = False  # an article or main below


def names_part(name: str) -> bool:
    """Whether a class or id names a part that isn't main text."""
    parts = [t for t in SPLIT.split(name) if t]
    if not parts or not ABOUT.isdisjoint(parts):
        return False
    if parts[0] in REGIONS or parts[-1] in REGIONS:
        return True
    return not NOISE.isdisjoint(parts) and all(t in NOISE or t in HELPERS or t in REGIONS or t.isdigit() for t in parts)


def _node(tag: str, attrs: str, up: Node, memo: dict) -> Node:
    if (known := memo.get((tag, attrs))) is None:
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTR.findall(attrs)} if attrs else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        tokens = {t for name in names.split() if not (own := set(SPLIT.split(name))) & ABOUT for t in own}
        style = tag + ("." + re.sub(r"\d+", "#", " ".join(sorted(names.split()))) if names else "")
        noise = tag in NEVER or found.get("role") in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        noise = noise or (tag == "header" or "header" in tokens) and not tokens & {"article", "entry", "post", "content", "title"} and None
        if not noise and any(map(names_part, names.split())):
            noise = True if tag in BLOCK and tag not in SPARED else "outside"
        if len(memo) > 10_000:
            memo.clear()
        known = memo[tag, attrs] = (style, noise)
    style, noise = known
    if noise is None or noise == "outside":  # a header: the page's, unless it is an article's own; so are a heading's and an inline tag's names
        at = up
        while at is not None and at.tag not in ("article", "main"):
            at = at.up
        noise = at is None
    return Node(tag, style, up, bool(noise) and tag not in ROOTS - {"article"})


def parse(html: str, memo: dict) -> Node:
    root = Node("html", "html", None, False)
    at, foreign = root, False
    for m in TOKEN.finditer(html):
        if (text := m[8]) is not None:
            at.items.append(text)
            continue
        tag = m[3] or m[6]
        if tag is None:
            if m[1] and m[1].lower() == "xmp":  # its text as it stands
                raw = _node("xmp", "", at, memo)
                raw.items.append(re.sub(r"(?is)\A<xmp\b[^>]*>|</xmp\s*>\Z", "", m[0]).replace("&", "&amp;"))
                at.items.append(raw)
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            up: Node | None = at
            while up is not None and up.tag != tag and not (up.tag in BLOCK and tag not in BLOCK):
                up = up.up
            if up is not None and up.tag == tag and up.up is not None:
                at = up.up
            continue
        if tag == "html":
            continue
        attrs = (m[4] if m[3] else m[7]) or ""
        inside = None
        if foreign:
            up = at
            while up is not None and up.tag not in FOREIGN and up.tag not in HOLDS_HTML:
                up = up.up
            inside = up if up is not None and up.tag in FOREIGN else None
            if inside is not None and tag in BREAKS:
                at, inside = inside.up, None
        foreign = foreign or tag in FOREIGN
        if tag in BLOCK:  # a block ends an open paragraph, with all inline tags left open in it
            up = at
            while up is not None and up.tag not in HOLDS_HTML and (up.tag not in BLOCK or up.tag == "p"):
                if up.tag == "p":
                    at = up.up
                    break
                up = up.up
        if tag in ENDS:
            ends, until = ENDS[tag]
            up = at
            while up is not None and up.tag not in until:
                if up.tag in ends:
                    at = up.up
                up = up.up
        node = _node(tag, attrs, at, memo)
        at.items.append(node)
        if tag in ("article", "main") and not node.noise:
            up = at
            while up is not None and not up.holds:
                up.holds = True
                up = up.up
        if tag not in VOID and not (attrs.endswith("/") and (tag in FOREIGN or inside is not None)) and node.depth < DEEPEST:
            at = node
    return root


def contents(root: Node) -> list[Node]:
    """The outermost articles or mains that aren't noise; without any, the whole page."""
    if not root.holds:
        return [root]
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main") and not node.noise:
            out.append(node)
        else:
            todo += [x for x in reversed(node.items) if not isinstance(x, str) and (x.holds or x.tag in ("article", "main")) and (not x.noise or x.holds)]
    return out


def blocks(node: Node, low: set[int] | frozenset = frozenset()) -> list[str]:
    """Texts of the blocks below, in page order, white space as one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run and (text := " ".join(unescape("".join(run)).split())):
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x is not node and (x.noise and not x.holds or low and x.path in low):
            if x.tag in BLOCK:
                flush()
        elif x.tag in SPACED:
            run.append(" ")
            todo += reversed(x.items)
            if x.tag != "br":
                run.append(" ")
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.items)
        else:
            todo += reversed(x.items)
    flush()
    return out


def styled(node: Node, whole: bool) -> list[Node]:
    """Block nodes below that the style tree judges, each with its path's hash: in an article those with a class or id of their own, else all."""
    out, todo = [], [(node, 0)]
    node.path = 0
    while todo:
        at, path = todo.pop()
        for x in at.items:
            if isinstance(x, str):
                continue
            x.path = 0
            if x.noise and not x.holds:
                continue
            own = xxhash.xxh64_intdigest(f"{path}/{x.style}") - (1 << 63)
            if x.tag in BLOCK and x.tag not in ROOTS and (whole or "." in x.style):
                x.path = own
                out.append(x)
            todo.append((x, own))
    return out


def _contents_hashed(top: Node) -> None:
    """On every node below, (hash, power) of its runs of text in page order, whatever nodes they are in."""
    order, todo = [], [top]
    while todo:
        order.append(x := todo.pop())
        todo += [y for y in x.items if not isinstance(y, str) and not (y.noise and not y.holds)]
    for x in reversed(order):
        h, power = 0, 1
        for y in x.items:
            if isinstance(y, str):
                if not (words := y.split()):
                    continue
                more, by = xxhash.xxh64_intdigest(" ".join(words)) % PRIME, BASE
            elif y.noise and not y.holds:
                continue
            else:
                more, by = y.content
            h, power = (h * by + more) % PRIME, power * by % PRIME
        x.content = (h, power)


def _features(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, page): what each distinct page of a host shows at each path: its children's styles and its text, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            rows = set()
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not html:
                    continue
                root = parse(html, memo)
                for top in contents(root):
                    found = styled(top, top is root)
                    if not found:
                        continue
                    _contents_hashed(top)
                    for x in found:
                        shape = ">".join(y.style for y in x.items if not isinstance(y, str))
                        rows.add((host, x.path, 0, xxhash.xxh64_intdigest(shape) - (1 << 63), top.content[0]))
                        rows.add((host, x.path, 1, x.content[0], top.content[0]))
            cut = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cut, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["host", "path", "kind", "feature", "page"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path long, kind int, feature long, page long")


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, path) of the branches of a host's style tree whose importance is below LOW.

    The importance of a presentation node is the entropy of its children's styles over the host's distinct pages, that of a content
    node the entropy of its texts, each divided by the largest possible (0: all alike, 1: all differ). A branch has
    (1 - DEEP) of the first and DEEP of the second; styles on fewer than PAGES distinct pages stay.
    """
    each = _features(pages).distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("c"))
    sums = each.groupBy("host", "path", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = sums.where(f"n >= {PAGES}").select("host", "path", "kind", ((F.log("n") - F.col("s") / F.col("n")) / F.log("n")).alias("h"))
    joint = entropy.groupBy("host", "path").agg(F.sum(F.expr(f"h * IF(kind = 0, {1 - DEEP}D, {DEEP}D)")).alias("importance"))
    return joint.where(f"importance < {LOW}").select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row.

    A page's main text is that of its articles (or main elements, or, without either, of all of it) less what tags, roles, classes
    and ids mark as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments, and less
    the low-importance branches of its host's style tree. A null or empty html gives an empty text; hosts are those of the urls,
    null or odd urls make one host.
    """
    scratch = Scratch(pages.sparkSession, "html")
    low = scratch.save(low_branches(pages))
    few = low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone = scratch.save(low.groupBy("host").agg(F.collect_set("path").alias("__low")).withColumnRenamed("host", "__host"))
    each = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("__page_host"))
    each = each.join(F.broadcast(gone) if few else gone, F.col("__page_host") == F.col("__host"), "left").select("page_id", "url", "html", "__low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            texts = []
            for html, branches in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                out: list[str] = []
                if html:
                    root, gone_here = parse(html, memo), set(branches or ())
                    for top in contents(root):
                        if gone_here:
                            _mark(top, top is root)
                        out += blocks(top, gone_here)
                texts.append("\n".join(out))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return each.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def _mark(top: Node, whole: bool) -> None:
    """Paths on every node below: those judged have their hash, all others 0."""
    todo = [top]
    while todo:
        x = todo.pop()
        x.path = 0
        todo += [y for y in x.items if not isinstance(y, str)]
    styled(top, whole)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
