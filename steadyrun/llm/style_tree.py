"""Operator 10: main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree: a branch is a path of elements from the body, each with
its classes, known by a hash of them. Below 64 levels only branches at depths that are powers of two are measured,
so a page costs what its length is. Over the pages that have a branch, two entropies tell what it is:
- presentation: the ways its children are laid out; a branch laid out the same everywhere is a template;
- content: each text in it, by how its occurrences spread over the pages; a text that all pages share says
  nothing, one that a single page has is content.
A branch's importance weighs both, content more the more texts it has. Branches of low importance are removed
from each page. Hosts of too few pages to tell share one tree. A text is a leaf of the tree: one whose
spread over the pages of the host is that of a template is removed wherever it stands, as most unmarked share
lines and legal notes are paragraphs like others.

HTML declares some roles itself: scripts, styles, navigation and footers are removed. Forms, headers and names
like "sidebar" or "comments" only make an element suspect: see ``_judge``. A declared article or main part is
evidence: its branches are measured against all pages of the host, so what a few of them share stays; if it has
at least half of the text that the tree leaves, the rest is dropped; and the tree removes three quarters of it only
where as much text is left beside it. What only some pages share stays where it is most of the text, so an article
that many pages of a host carry stays.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from steadyrun.sources.scratch import stored

# Elements of HTML by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"},
          "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
NOISE = set(
    "head script style noscript template iframe object embed applet canvas svg math audio video button input "
    "select textarea nav menu aside footer dialog title xmp noembed noframes".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
NOISE_CLASSES = re.compile(
    r"^(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|disqus|"
    r"footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|promo|related|respond|"
    r"share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)$"
)
#: Names like has-sidebar or comments-open tell how a page is, not what the element is.
STATE = re.compile(r"^(?:has|no|not|with|without)[_-]|[_-](?:open|closed|enabled|disabled)$")

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>|"
    r"<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
OBSERVED = "host string, path long, feature long, style long, n long, n_log_n double, pages long, main boolean"
LAYOUT_SHARE = 0.9
DEEP = 64
#: Texts below this importance stand on nearly all pages.
CONSTANT = 0.05
#: The tree of all hosts of few pages; no host has this name.
SMALL_HOSTS = " "


@dataclass
class Element:
    tag: str
    noise: bool
    main: bool
    path: int
    level: int
    #: The measured branches around, the own one included.
    trail: tuple[int, ...]
    own_noise: bool = False
    #: The innermost suspect element around, itself included, or -1; and whether it is one.
    suspect: int = -1
    own_suspect: bool = False
    #: How many suspects are around the outermost declared part.
    main_depth: int = 0
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    trail: tuple[int, ...]
    text: str
    noise: bool
    main: bool
    suspect: int = -1
    #: How many suspects are around the outermost declared part that holds the block.
    depth: int = 0


class Stack:
    """Open elements; the innermost one of a tag is found at once."""

    def __init__(self, root: Element):
        self.elements, self.places = [root], {}

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.elements))
        self.elements.append(element)

    def pop(self) -> Element:
        element = self.elements.pop()
        self.places[element.tag].pop()
        return element

    def last(self, tags: Collection[str]) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((held[-1] for t in tags if (held := self.places.get(t))), default=0)


def _marks(attrs: str) -> dict[str, str]:
    if not attrs or attrs.isspace():
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}


def _suspect(tag: str, role: str, marks: dict[str, str], in_main: bool) -> bool:
    """Whether a form, a page's header or an element's own names speak against it."""
    if tag in ("body", "html", "main"):
        return False
    if tag == "form" or role == "form" or (tag == "header" and not in_main):
        return True
    names = f"{marks.get('class', '')} {marks.get('id', '')}".lower().split()
    return any(NOISE_CLASSES.match(w) for n in names if not STATE.search(n) for w in re.split("[_-]+", n))


def _judge(blocks: list[Block], mains: list[int], around: list[int]) -> None:
    """Make the blocks of suspect elements noise, and decide which declared parts are the main ones.

    The parts inside the fewest suspect elements are; a suspect that is or holds one of them is none, nor is
    one inside them, or on a page without any, that holds most of the text. Where this leaves no text, no
    element is suspect. ``mains`` has the innermost suspect around each declared part, its own included, and
    ``around`` that around each suspect (-1: none); an outer one has a smaller number.
    """
    level = []
    for outer in around:
        level.append(1 + (level[outer] if outer >= 0 else 0))
    depths = [level[k] if k >= 0 else 0 for k in mains]
    least = min(depths, default=0)

    def chains(starts: Iterable[int]) -> list[bool]:
        marked = [False] * len(around)
        for k in starts:
            while k >= 0 and not marked[k]:
                marked[k] = True
                k = around[k]
        return marked

    cleared = chains(k for k, d in zip(mains, depths, strict=True) if d == least)
    sizes = [0] * len(around)
    for b in blocks:
        b.main = b.main and b.depth == least
        if not b.noise and b.suspect >= 0:
            sizes[b.suspect] += len(b.text)
    for k in range(len(around) - 1, -1, -1):
        if around[k] >= 0:
            sizes[around[k]] += sizes[k]
    total = sum(len(b.text) for b in blocks if not b.noise)
    inner = chains(b.suspect for b in blocks if b.main)
    fine = []
    for k, outer in enumerate(around):
        own = cleared[k] or (2 * sizes[k] > total and (inner[k] or not mains))
        fine.append(own and (outer < 0 or fine[outer]))
    bad = [b.suspect >= 0 and not fine[b.suspect] for b in blocks]
    if all(x or b.noise for x, b in zip(bad, blocks, strict=True)):
        return
    for x, b in zip(bad, blocks, strict=True):
        b.noise = b.noise or x


def parsed(source: str | None) -> tuple[list[Block], list[tuple[int, str, bool]]]:
    """The text blocks of a page in order, and (path, layout of the children, whether it is in a declared main
    part) of its measured block elements.

    Any text is accepted: unclosed elements end where HTML ends them or with their parent, stray end tags are
    ignored, a broken tag ends at the next ">". The time is in proportion to the length, however deep the page.
    """
    source = source or ""
    stack, blocks, layouts = Stack(Element("", False, False, 0, 0, ())), [], []
    held = stack.elements
    # The innermost block element (or the root) of each open element.
    parents = [held[0]]
    pieces: list[str] = []
    mains: list[int] = []
    around: list[int] = []
    depth_of: list[int] = []

    def close_block() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            top = held[-1]
            blocks.append(Block(parents[-1].trail, text, top.noise, top.main, top.suspect, top.main_depth))

    def pop(depth: int) -> None:
        while len(held) > depth:
            top = held[-1]
            if top.tag in BLOCKS:
                close_block()
                if top.level and top.trail[-1] == top.path:
                    layouts.append((top.path, " ".join(top.children), top.main))
            elif top.own_noise or top.own_suspect:
                close_block()
            stack.pop()
            parents.pop()

    at = 0
    for token in iter(lambda: TOKEN.search(source, at), None):
        if token.start() > at:
            pieces.append(source[at : token.start()])
        at = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag:
            continue
        if token["end"] or token["end2"]:
            depth = stack.last((tag,))
            if depth:
                pop(depth)
            elif tag == "br":
                pieces.append(" ")
            continue
        attrs = token["attrs"] if token["tag"] else token["attrs2"]
        if tag in SIBLINGS:
            depth = stack.last(SIBLINGS[tag])
            if depth > stack.last(SCOPES[tag]):
                pop(depth)
        if tag in CLOSES_P:
            depth = stack.last(("p",))
            if depth and stack.last(("td", "th", "div", "li")) < depth:
                pop(depth)
        if tag in VOID:
            if tag in BLOCKS:
                close_block()
            else:
                pieces.append(" " if tag in ("br", "wbr", "img") else "")
            continue
        marks = _marks(attrs)
        role = marks.get("role", "").lower()
        own_main = tag in ("article", "main") or role in ("main", "article")
        own_noise = tag in NOISE or role in NOISE_ROLES
        outer, parent = held[-1], parents[-1]
        suspect = not own_noise and _suspect(tag, role, marks, outer.main)
        if tag in BLOCKS or own_noise or suspect:
            close_block()
        path, level, trail = parent.path, parent.level, parent.trail
        if tag in BLOCKS:
            named = re.sub(r"\d+", "0", ".".join(sorted(marks.get("class", "").lower().split())))
            name = f"{tag}.{named}" if named else tag
            if parent.tag not in ("html", "") or tag not in ("html", "body"):
                parent.children.append(name)
            if tag in ("html", "body"):
                path, level, trail = 0, 0, ()
            else:
                path, level = path_of((name,), path), level + 1
                if level <= DEEP or not level & (level - 1):
                    trail += (path,)
        if suspect:
            around.append(outer.suspect)
            depth_of.append(1 + (depth_of[outer.suspect] if outer.suspect >= 0 else 0))
        innermost = len(around) - 1 if suspect else outer.suspect
        is_main = own_main and not own_noise
        main_depth = outer.main_depth
        if is_main and not outer.main:
            main_depth = depth_of[innermost] if innermost >= 0 else 0
        element = Element(
            tag, outer.noise or own_noise, outer.main or is_main, path, level, trail, own_noise, innermost, suspect, main_depth
        )
        stack.push(element)
        parents.append(element if tag in BLOCKS else parent)
        if own_main and not element.noise:
            mains.append(innermost)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(source, at)
            at = end.start() if end else len(source)
    pieces.append(source[at:])
    pop(1)
    close_block()
    _judge(blocks, mains, around)
    return blocks, layouts


def _length(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def main_text(
    source: str | None, removed: Collection[int] = (), repeated: Collection[int] = (), constant: Collection[int] = ()
) -> str:
    """The text of a page without declared noise, without the ``removed`` branches of its host and without the
    texts whose hashes are ``repeated`` over it, of which ``constant`` ones are on nearly all pages."""
    blocks, _ = parsed(source)
    kept = [b for b in blocks if not b.noise]
    declared = [b for b in kept if b.main]
    hashes = {id(b): _hash(b.text) for b in kept} if repeated else {}
    low = {id(b) for b in kept if removed and not removed.isdisjoint(b.trail)}
    told = [b for b in kept if id(b) not in low]
    gone = {id(b) for b in told if hashes and hashes[id(b)] in repeated}
    # What only some pages share is an article of theirs, if it is most of the text.
    own = [b for b in (declared or told) if not hashes or hashes[id(b)] not in constant]
    some = [b for b in own if id(b) in gone]
    if 2 * _length(some) > _length(own):
        gone -= {id(b) for b in some}
    # A page all of whose texts are repeated is one that was fetched often, not a template.
    left = [b for b in told if id(b) not in gone] or told
    main = [b for b in left if b.main]
    if 4 * _length(main) < _length(declared) and _length(left) - _length(main) < _length(declared):
        left = main = declared
    if main and 2 * _length(main) >= _length(left):
        left = main
    return "\n".join(b.text for b in left)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def path_of(names: Iterable[str], path: int = 0) -> int:
    """The branch that further elements, named like ``div.story``, lead to."""
    for name in names:
        path = _hash(f"{path}>{name}")
    return path


def observations(pages: DataFrame, host: Column) -> DataFrame:
    """What the pages add to their host's tree, summed within batches: per branch and text, and per branch and
    layout, a row with the texts' numbers n and n ln n, or the number of pages and whether the branch is in a
    declared main part. The root, path 0, has all texts and pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[tuple, list] = {}
            layouts: Counter = Counter()
            for name, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, laid = parsed(source)
                hashes = [_hash(b.text) for b in blocks]
                own = Counter((branch, h) for b, h in zip(blocks, hashes, strict=True) for branch in b.trail)
                own.update((0, h) for h in hashes)
                for (branch, feature), n in own.items():
                    held = texts.setdefault((name, branch, feature), [0, 0.0])
                    held[0] += n
                    held[1] += n * math.log(n)
                shapes: dict[int, list[str]] = {}
                mains = {path for path, _, main in laid if main}
                for path, children, _ in laid:
                    shapes.setdefault(path, []).append(children)
                layouts.update((name, path, _hash("|".join(x)), path in mains) for path, x in shapes.items())
                if blocks:
                    layouts[name, 0, 0, False] += 1
            rows = [(h, p, f, None, n, s, None, None) for (h, p, f), (n, s) in texts.items()]
            rows += [(h, p, None, f, None, None, n, m) for (h, p, f, m), n in layouts.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
            names = ["host", "path", "feature", "style", "n", "n_log_n", "pages", "main"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    given = pages.select(host.alias("host"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(run, OBSERVED)


def _spread(seen: DataFrame) -> DataFrame:
    """The entropy of the spread over pages of each text of each branch."""
    texts = seen.groupBy("host", "path", "feature")
    return texts.agg((F.log(F.sum("n")) - F.sum("n_log_n") / F.sum("n")).alias("entropy"))


def _host_pages(seen: DataFrame) -> DataFrame:
    return seen.where("style is not null and path = 0").groupBy("host").agg(F.sum("pages").alias("host_pages"))


def repeated_texts(seen: DataFrame, least_pages: int, least_importance: float) -> DataFrame:
    """(host, feature, constant) of the texts that stand on too many pages of their host, by 1 - entropy /
    ln(pages); constant ones on nearly all."""
    # What no host of enough pages would remove goes first, before the join.
    least = (1 - least_importance) * math.log(least_pages)
    often = _spread(seen.where("feature is not null and path = 0")).where(F.col("entropy") > least - 1e-9)
    told = often.join(_host_pages(seen).where(F.col("host_pages") >= least_pages), "host")
    importance = 1 - F.col("entropy") / F.log("host_pages")
    return told.where(importance < least_importance).select("host", "feature", (importance < CONSTANT).alias("constant"))


def style_tree(pages: DataFrame, host: Column) -> DataFrame:
    """(host, path, pages, importance) of every branch, importance from 0 (the same everywhere) to 1.

    Per branch on m pages: presentation is the entropy of its layouts over ln m; content is 1 less the mean,
    over its texts, of the entropy of the text's spread over pages, over ln m; within a declared main part, over
    that of all pages of the host. The more texts, the more content weighs: ``0.9 ** texts`` is left to
    presentation.
    """
    return _importance(stored(observations(pages, host), "tree"))


def _importance(seen: DataFrame) -> DataFrame:
    laid = seen.where("style is not null and path <> 0")
    layouts = laid.groupBy("host", "path", "style").agg(F.sum("pages").alias("pages"), F.max("main").alias("main"))
    p = F.col("pages").cast("double")
    shapes = layouts.groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), (F.log(F.sum(p)) - F.sum(p * F.log(p)) / F.sum(p)).alias("layout_entropy"),
        F.max("main").alias("main"),
    )
    shapes = shapes.join(_host_pages(seen), "host", "left")
    spread = _spread(seen.where("feature is not null and path <> 0"))
    content = spread.groupBy("host", "path").agg(F.avg("entropy").alias("entropy"), F.count(F.lit(1)).alias("texts"))
    on = shapes["host"].eqNullSafe(content["host"]) & (shapes["path"] == content["path"])
    both = shapes.join(content, on, "left").select(
        shapes["host"], shapes["path"], "pages", "layout_entropy", F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        F.coalesce("texts", F.lit(0)).alias("texts"), "main", "host_pages",
    )
    whole = F.when(F.col("main"), F.greatest("pages", "host_pages")).otherwise(F.col("pages"))
    scale = F.log(F.greatest("pages", F.lit(2)).cast("double"))
    presentation = F.least(F.col("layout_entropy") / scale, F.lit(1.0))
    told = F.greatest(1 - F.col("entropy") / F.log(F.greatest(whole, F.lit(2)).cast("double")), F.lit(0.0))
    left = F.pow(F.lit(LAYOUT_SHARE), F.col("texts"))
    importance = F.when(F.col("pages") > 1, left * presentation + (1 - left) * told).otherwise(1.0)
    return both.select("host", "path", "pages", importance.alias("importance"))


def extracted(pages: DataFrame, least_pages: int = 5, least_importance: float = 0.3) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    The host is taken from the url in lower case; pages without one share a tree. Null, empty and markup-only
    pages have empty text. Rows that repeat are pages like others, extra columns are ignored, an empty table
    gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), HOST, 1))
    seen = stored(observations(pages, host), "tree")
    large = F.col("host_pages") >= least_pages
    trees = _host_pages(seen).select(F.col("host").alias("member"), F.when(large, F.col("host")).otherwise(F.lit(SMALL_HOSTS)).alias("tree"))
    grown = seen.join(trees, F.col("host") == F.col("member")).withColumn("host", F.col("tree"))
    grown = stored(grown.drop("tree"), "trees")
    merged = grown.drop("member")
    low = _importance(merged).where((F.col("pages") >= least_pages) & (F.col("importance") < least_importance))
    texts = repeated_texts(merged, least_pages, least_importance)
    # Back to the members of a tree, with what they have themselves.
    branches = grown.where("style is not null and path <> 0").select("host", "member", "path").distinct().join(low.select("host", "path"), ["host", "path"])
    features = grown.where("feature is not null and path = 0").select("host", "member", "feature").distinct().join(texts, ["host", "feature"])
    nothing = F.lit(None).cast("long")
    both = branches.select("member", "path", nothing.alias("feature"), nothing.alias("constant")).union(
        features.select("member", nothing, "feature", F.when(F.col("constant"), F.col("feature")))
    )
    removed = both.groupBy("member").agg(*[F.collect_set(c).alias(n) for c, n in (("path", "removed"), ("feature", "repeated"), ("constant", "constant"))])
    removed = stored(removed, "removed")

    @F.pandas_udf("string")
    def text(sources: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for source, *lists in sources:
            sets: dict[bytes, frozenset[int]] = {}

            def hashes(found: np.ndarray | None, sets: dict = sets) -> frozenset[int]:
                if found is None:
                    return frozenset()
                name = found.tobytes()
                if name not in sets:
                    sets[name] = frozenset(found.tolist())
                return sets[name]

            yield pd.Series([main_text(s, *map(hashes, told)) for s, *told in zip(source, *lists, strict=True)], dtype=object)

    given = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("__host"))
    joined = given.join(removed, F.col("__host") == F.col("member"), "left")
    out = joined.select("page_id", "url", text("html", "removed", "repeated", "constant").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
