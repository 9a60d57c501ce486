"""Main text of web pages by wrapper induction.

Pages become trees of elements. The trees of pages of one host are aligned by simple tree matching: the largest common top-down
tree that keeps the order of siblings, whose size a dynamic program over the children of each pair of equal elements finds.
What all aligned pages have alike, structure and text, is template; slots whose text varies are content. A host's wrapper is
folded from its pages in any grouping: a page is aligned with the wrapper so far, matched nodes add up how often they were seen
and how much text they held, unmatched nodes are added. Folding is done map-side on each task's pages of a host and the
small partial wrappers are then folded by host, so a host with a third of all pages is no task's alone. Only the skeleton (the
elements that can hold blocks, without paragraphs and inline elements) is aligned; a wrapper keeps all nodes that its pages
have. On how many pages of a host a slot has a text is summed by table for all texts, so what is constant is exact.

The content slot is the varying slot that holds the most text, among those that are not of a boilerplate kind (navigation,
headers, footers, sidebars, forms, notices, adverts and comments, by element, role, class or id; scripts and styles are no
text). Every page is then read with its host's wrapper: the text of the slot's nodes and all that is in them, less boilerplate
inside it and, unless the slot is an article or main element, less blocks that are template. Of a header inside an article its
headings stay; names of classes that an article's own paragraphs may have count for containers only. Hosts with one page use the wrapper
of all hosts. Where nothing varies (a host of copies), the slot that holds the most text is the content.

Defined results: null or empty html, or a page without any block, gives an empty text; a null url is a host of its own (empty);
repeated rows are pages of their own; broken markup is closed as browsers would for paragraphs, list items and table cells;
elements may be nested to any depth; a quote that is never closed ends with its tag; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, table

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKELETON = frozenset("html body article aside main section div nav header footer form fieldset dialog ul ol menu dl table tbody tr td blockquote figure details".split())
#: An element that begins closes an open one of these.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
BOILERPLATE = frozenset("nav aside footer header form menu dialog button select input label script style head title noscript template svg math iframe object textarea".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Parts of class names and ids that mark boilerplate.
BOILERPLATE_NAMES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|side-?bar|widget\w*|foot(?:er)?|site-?header|masthead|cookie\w*|consent|gdpr|notice\w*|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comment\w*|disqus|respond|replies|pagination|pager|toolbar|alert)(?:$|[\s_-])"
)
#: Parts of names that mark boilerplate on containers only.
CONTAINER_NAMES = re.compile(r"(?i)(?:^|[\s_-])(?:related|recommend\w*|copyright|legal|disclaimer)(?:$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Part of the aligned pages that must have a text alike for it to be template, and the fewest pages that can tell.
ALIKE, FEWEST = 0.6, 3
SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'<]|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))", re.S)
#: What a tag has after its name, up to and with its end.
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


@dataclass
class Node:
    """An element: its label in the skeleton, its children (elements and texts in order) and whether it is boilerplate."""

    tag: str
    label: str
    boilerplate: bool
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)


def parse(page: str) -> Node:
    """The tree of a page. Texts are decoded."""
    root = Node("html", "html", False)
    at, pos, raw = root, 0, None
    n = len(page)
    while pos < n:
        if raw:  # up to the element's own end tag
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos, raw = (end.end() if end else n), None
            continue
        m = TOKEN.search(page, pos)
        text = page[pos : m.start() if m else n]
        if text:
            at.children.append(entities.unescape(text))
        if m is None:
            break
        pos = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            up: Node | None = at
            while up is not None and up.tag != tag and not (tag not in BLOCK and up.tag in BLOCK):
                up = up.parent
            if up is not None and up.tag == tag and up.parent is not None:
                at = up.parent
            continue
        if tag in ("html", "body") and tag == "html":
            continue
        if tag in BLOCK and tag not in CLOSES:  # a paragraph ends where a block begins
            at = _close(at, {"p"})
        if tag in CLOSES:
            at = _close(at, CLOSES[tag] | {"p"})
        names = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m.group(3))}
        marks = f"{names.get('class', '')} {names.get('id', '')}"
        away = tag in BOILERPLATE or names.get("role", "").lower() in BOILERPLATE_ROLES
        if marks.strip() and tag not in ("html", "body", "article", "main"):
            away = away or bool(BOILERPLATE_NAMES.search(marks)) or bool(tag in SKELETON and CONTAINER_NAMES.search(marks))
        node = Node(tag, f"{tag}.{'.'.join(sorted(marks.lower().split()))}".rstrip("."), away, at)
        at.children.append(node)
        if tag in RAW:
            raw = tag
        elif tag not in VOID and not m.group(3).rstrip("> \t\n\r\f").endswith("/"):
            at = node
        elif tag not in VOID and tag in BLOCK:
            at = node  # a slash closes nothing in HTML
    return root


def _close(at: Node, tags: set[str]) -> Node:
    """Leaves the nearest open element of `tags`, unless another block is between."""
    up: Node | None = at
    while up is not None and up.parent is not None:
        if up.tag in tags:
            return up.parent
        if up.tag in BLOCK:
            return at
        up = up.parent
    return at


def blocks(node: Node, drop: frozenset[str] = frozenset()) -> list[str]:
    """The text blocks in a node, in order, without boilerplate elements and without the texts in drop."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text and text not in drop:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x is not node and x.boilerplate:
            if x.tag in BLOCK:
                end()
            if x.tag == "header" and _owner(x) in ("article", "main"):  # the article's own: its headings are text
                todo += [None, *reversed([h for h in _below(x) if h.tag in HEADINGS])]
        elif x.tag in BLOCK or x.tag in ("br", "hr"):
            end()
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    end()
    return out


def _owner(node: Node) -> str:
    """The nearest section that a node is in."""
    up = node.parent
    while up is not None and up.tag not in ("article", "main", "section", "aside", "nav", "body"):
        up = up.parent
    return up.tag if up is not None else ""


def _below(node: Node) -> Iterator[Node]:
    """The elements in a node, in order, without those in boilerplate and in headings."""
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if not isinstance(x, str) and not x.boilerplate:
            yield x
            if x.tag not in HEADINGS:
                todo += reversed(x.children)


# --- alignment -------------------------------------------------------------------------------------------------------------


@dataclass
class Slot:
    """A node of a wrapper: an id of its path of labels, how many pages have it and how much own text they hold there. Trees are
    walked without recursion, as pages may nest elements without end."""

    label: str
    away: bool
    id: int
    pages: int = 0
    chars: int = 0
    children: list[Slot] = field(default_factory=list)

    def dump(self) -> list:
        """The nodes in order, each with its depth."""
        out, todo = [], [(0, self)]
        while todo:
            depth, x = todo.pop()
            out.append([depth, x.label, x.away, x.id, x.pages, x.chars])
            todo += [(depth + 1, c) for c in reversed(x.children)]
        return out

    @staticmethod
    def load(rows: list) -> Slot:
        path: list[Slot] = []
        for depth, *x in rows:
            del path[depth:]
            path.append(Slot(*x))
            if depth:
                path[-2].children.append(path[-1])
        return path[0]


def _mark(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) | min(len(text), (1 << 31) - 1) << 32


def _child(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8", "replace"), digest_size=8, key=parent.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def skeleton(root: Node, seen: set[tuple[int, int]] | None = None) -> Slot:
    """A page's tree as a wrapper of one page: elements of the skeleton, with the length of the blocks that are directly in each.
    seen: gets (slot, text) of all its blocks."""
    top = Slot(root.label, root.boilerplate, _child(0, root.label), 1)
    work: list[tuple[Node, Slot]] = [(root, top)]
    while work:
        node, slot = work.pop()
        now: list[str] = []

        def end(now: list[str] = now, slot: Slot = slot) -> None:
            text = SPACE.sub(" ", "".join(now)).strip()
            now.clear()
            if text:
                slot.chars += len(text)
                if seen is not None:
                    seen.add((slot.id, _mark(text)))

        todo: list[Node | str | None] = list(reversed(node.children))
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif x.tag in SKELETON:
                end()
                slot.children.append(Slot(x.label, x.boilerplate, _child(slot.id, x.label), 1))
                work.append((x, slot.children[-1]))
            elif x.tag in RAW or x.tag == "head":
                continue
            elif x.tag in BLOCK or x.tag in ("br", "hr"):
                end()
                todo.append(None)
                todo += reversed(x.children)
            else:
                todo += reversed(x.children)
        end()
    return top


def _table(a: Slot, b: Slot, memo: dict[tuple[int, int], int]) -> list[list[int]]:
    """The dynamic program over the children of two nodes whose pairs of children are in memo."""
    rows = [[0] * (len(b.children) + 1)]
    for x in a.children:
        last, row = rows[-1], [0]
        for j, y in enumerate(b.children):
            row.append(max(row[j], last[j + 1], last[j] + (memo[id(x), id(y)] if x.label == y.label else 0)))
        rows.append(row)
    return rows


def matching(a: Slot, b: Slot, memo: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the number of pairs in the largest order-preserving top-down mapping of equal labels."""
    if a.label != b.label:
        return 0
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (id(x), id(y)) not in memo:
            if inner := [(c, d) for c in x.children for d in y.children if c.label == d.label and (id(c), id(d)) not in memo]:
                todo += inner
                continue
            memo[id(x), id(y)] = _table(x, y, memo)[-1][-1] + 1
        todo.pop()
    return memo[id(a), id(b)]


def fold(a: Slot, b: Slot) -> Slot:
    """b aligned into a: matched nodes add up, others are inserted in order."""
    memo: dict[tuple[int, int], int] = {}
    both = lambda x, y: Slot(x.label, x.away or y.away, x.id, x.pages + y.pages, x.chars + y.chars)
    for x in a.children:
        for y in b.children:
            matching(x, y, memo)
    root = both(a, b)
    todo = [(a, b, root)]
    while todo:
        x, y, out = todo.pop()
        rows = _table(x, y, memo)
        i, j = len(x.children), len(y.children)
        while i or j:
            if i and j and rows[i][j] > max(rows[i - 1][j], rows[i][j - 1]):
                i, j = i - 1, j - 1
                out.children.append(both(x.children[i], y.children[j]))
                todo.append((x.children[i], y.children[j], out.children[-1]))
            elif i and rows[i][j] == rows[i - 1][j]:
                i -= 1
                out.children.append(x.children[i])
            else:
                j -= 1
                out.children.append(y.children[j])
        out.children.reverse()
    return root


@dataclass
class Wrapper:
    """What a host's alignment says: the path of labels of the content slot, and the texts that are template."""

    path: tuple[str, ...]
    template: frozenset[int]

    def dump(self) -> str:
        return json.dumps([self.path, sorted(self.template)])

    @staticmethod
    def load(raw: str) -> Wrapper:
        path, template = json.loads(raw)
        return Wrapper(tuple(path), frozenset(template))


def induced(root: Slot, alike: dict[int, list[tuple[int, int]]]) -> Wrapper:
    """The content slot is the varying slot that is not boilerplate and holds the most text, with what is in it. alike: the
    texts of each slot that are constant, and on how many pages."""
    order, todo = [], [root]
    while todo:
        order.append(todo.pop())
        todo += order[-1].children

    def sums(constant: bool) -> dict[int, int]:
        total: dict[int, int] = {}
        for x in reversed(order):  # children come before their parents
            own = x.chars - sum(n * (mark >> 32) for mark, n in alike.get(x.id, ())) * constant
            total[id(x)] = 0 if x.away else max(own, 0) + sum(total[id(c)] for c in x.children)
        return total

    total = sums(True)
    if not total[id(root)]:
        total = sums(False)
    template = frozenset(mark for found in alike.values() for mark, _ in found)
    at, path = root, [root.label]
    while True:  # down, as long as one child holds nearly all of the text that varies
        inner = [c for c in at.children if not c.away]
        down = max(inner, key=lambda c: total[id(c)], default=None)
        if down is None or total[id(down)] < 0.5 * total[id(at)] or total[id(down)] == 0:
            break
        tag = down.label.split(".")[0]
        if tag in ("ul", "ol", "dl", "table", "tbody", "tr", "td", "blockquote", "figure", "li", "details"):
            break
        at = down
        path.append(down.label)
        if tag in ("article", "main"):
            break
    return Wrapper(tuple(path), template)


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    found = [root]
    for label in wrapper.path[1:] if wrapper else ():
        inner = [c for n in found for c in _inside(n, label)]
        if not inner:  # this page lacks the slot: an article or main element of its own, or all that is no boilerplate
            break
        found = inner
    else:
        return _joined(found, wrapper)
    own = _first(root, ("article", "main"))
    return _joined(own or [root], wrapper)


def _joined(nodes: list[Node], wrapper: Wrapper | None) -> str:
    out = [b for n in nodes for b in blocks(n)]
    if wrapper and wrapper.template and wrapper.path[-1].split(".")[0] not in ("article", "main"):
        out = [b for b in out if _mark(b) not in wrapper.template]
    return "\n".join(out)


def _inside(node: Node, label: str) -> list[Node]:
    """The nearest skeleton descendants with a label."""
    out: list[Node] = []
    todo: list[Node | str] = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.tag in RAW:
            continue
        if x.tag in SKELETON:
            if x.label == label:
                out.append(x)
        else:
            todo += reversed(x.children)
    return out


def _first(root: Node, tags: tuple[str, ...]) -> list[Node]:
    out: list[Node] = []
    todo: list[Node | str] = list(reversed(root.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.boilerplate:
            continue
        if x.tag in tags:
            out.append(x)
        else:
            todo += reversed(x.children)
    return out


# --- on tables ---------------------------------------------------------------------------------------------------------------

HOST = r"(?s)^.*?://([^/?#]*)"


def hosted(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))


_TREES = "host string, tree string, slot bigint, mark bigint, n bigint"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers of this task's pages, by host, and how many of its pages have each text in each slot; with mark 0, have the
    slot. Pages of a host that look alike fold into one small tree."""
    by: dict[str, Slot] = {}
    counts: Counter[tuple[str, int, int]] = Counter()
    for batch in batches:
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            if page:
                seen: set[tuple[int, int]] = set()
                own = skeleton(parse(page), seen)
                by[host] = fold(by[host], own) if host in by else own
                counts.update((host, slot, mark) for slot, mark in seen)
                counts.update((host, slot, 0) for slot in {slot for slot, _ in seen})
            if len(by) > 2000 or len(counts) > 200_000:
                yield _dumped(by)
                yield _counted(counts)
                by, counts = {}, Counter()
    yield _dumped(by)
    yield _counted(counts)


def _dumped(by: dict[str, Slot]) -> pa.RecordBatch:
    zero = pa.array([0] * len(by), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([json.dumps(s.dump()) for s in by.values()], pa.string()), zero, zero, zero], ["host", "tree", "slot", "mark", "n"])


def _counted(counts: Counter[tuple[str, int, int]]) -> pa.RecordBatch:
    host, slot, mark = zip(*counts, strict=True) if counts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.nulls(len(host), pa.string()), pa.array(slot, pa.int64()), pa.array(mark, pa.int64()), pa.array(list(counts.values()), pa.int64())], ["host", "tree", "slot", "mark", "n"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of hosts: one wrapper for each, folded in a stream."""
    host, tree = None, None
    for batch in batches:
        for h, t in zip(batch["host"].to_pylist(), batch["tree"].to_pylist(), strict=True):
            one = Slot.load(json.loads(t))
            if h == host:
                tree = fold(tree, one)
            else:
                if tree is not None:
                    yield _dumped({host: tree}).select(["host", "tree"])
                host, tree = h, one
    if tree is not None:
        yield _dumped({host: tree}).select(["host", "tree"])


def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [Slot.load(json.loads(t)) for t in batch["tree"].to_pylist()]
        out = []
        for s, found in zip(slots, batch["alike"].to_pylist(), strict=True):
            alike: dict[int, list[tuple[int, int]]] = {}
            for x in found or ():
                if s.pages >= FEWEST and x["of"] >= ALIKE * s.pages:
                    alike.setdefault(x["slot"], []).append((x["mark"], x["n"]))
            out.append(induced(s, alike).dump())
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array([s.pages for s in slots], pa.int64()), pa.array(out, pa.string())], ["host", "pages", "wrapper"])


def _alike(counts: DataFrame) -> DataFrame:
    """host, alike: the texts that FEWEST pages and the part ALIKE of the pages with their slot have there; at most as many of a
    slot as its pages have on average, over ALIKE."""
    slots = counts.where("mark = 0").select("host", "slot", F.col("n").alias("of"))
    many = counts.where(f"mark <> 0 and n >= {FEWEST}").join(slots, ["host", "slot"]).where(F.col("n") >= ALIKE * F.col("of"))
    return many.groupBy("host").agg(F.collect_list(F.struct("slot", "mark", "n", "of")).alias("alike"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper: what each host's alignment says, and that of all hosts under a null host."""
    parts = table(pages.select("host", "html").transform(arrow(_partial, _TREES)), "trees")
    # in an order that doesn't depend on how the rows came
    by = lambda df: df.repartition("host").sortWithinPartitions("host", "tree").transform(arrow(_folded, "host string, tree string"))
    hosts = table(by(parts.where("tree is not null").select("host", "tree")), "hosts")
    # the wrapper of all hosts: folded in a few groups, then the groups
    groups = by(hosts.select(F.concat(F.lit("g"), F.pmod(F.xxhash64("host"), F.lit(64))).alias("host"), "tree"))
    every = by(groups.select(F.lit("all").alias("host"), "tree")).select(F.lit(None).cast("string").alias("host"), "tree")
    counts = table(parts.where("tree is null").groupBy("host", "slot", "mark").agg(F.sum("n").alias("n")), "counts")
    alike = _alike(counts)
    whole = _alike(counts.groupBy("slot", "mark").agg(F.sum("n").alias("n")).select(F.lit("all").alias("host"), "slot", "mark", "n")).select("alike")
    both = hosts.join(alike, "host", "left").select("host", "tree", "alike").unionByName(every.join(whole, F.lit(True), "left").select("host", "tree", "alike"))
    return both.transform(arrow(_induced, "host string, pages bigint, wrapper string"))


def _texts(shared: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str | None, Wrapper | None] = {None: Wrapper.load(shared) if shared else None}
        for batch in batches:
            if len(kept) > 5000:
                kept = {None: kept[None]}
            out = []
            for page, raw in zip(batch["html"].to_pylist(), batch["wrapper"].to_pylist(), strict=True):
                if raw not in kept:
                    kept[raw] = Wrapper.load(raw)
                out.append(extract(page, kept[raw]))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Wrappers are joined by host; a hot host's pages are split by the join."""
    bounded_batches(pages.sparkSession)
    rows = hosted(pages)
    found = table(wrappers(rows), "wrappers")
    every = found.where("host is null").first()
    own = found.where("host is not null and pages > 1").select("host", "wrapper")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    return rows.join(own, "host", "left").select("page_id", "url", "html", "wrapper").transform(arrow(_texts(every["wrapper"] if every else None), schema))
