"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. All pages of each host are aligned with each
other by simple tree matching and merged into one tree, the host's wrapper; then
every page is aligned with it, so that equal places get equal slot numbers.
Nodes that the wrapper lacks get a slot by their labels from the root down.

Over all pages of a host the slots are counted: how many pages have them, their
texts, characters and link text. From this the host's template is told without
looking at tag names:

* a text that a slot has on nearly all pages is template, however many such
  texts it has;
* a slot that is mostly link text is a menu;
* each page votes which of its elements are the article: from the root down,
  the walk goes into the element that has nearly all of the text and leaves its
  siblings, such as adverts and footers that vary from page to page. A slot is
  article if most of its text on all pages is. So a page with a short text
  beside long adverts is told by the other pages, and each layout of a host has
  slots of its own.

Hosts with too few different pages, and pages that have next to nothing where
their host's article is, go by their own vote. Elements that say what they are
(by tag, role or a whole class name) are never content.

The statistics count every page: one row for each host, slot and text of a task
is shuffled, never a host's pages to one task. The wrapper is made from every
page too: pages of the same tree count once, and the different trees of a host
are merged about MERGED at a time, in rounds, until one is left. It has as many
nodes of a label path as at least TEMPLATE_PAGES pages have, which is counted
over all pages, so it doesn't grow with their number. A host with a third of all
pages is only a skewed side of a join with one row for each host.
"""

from __future__ import annotations

import heapq
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written

#: Trees of a host that one group of a round merges, about.
MERGED = 64
#: Bytes of different trees that a task holds before it sends them on.
HELD_BYTES = 8 << 20
#: A text of a slot is template if it is on this share of the pages that have the slot, of at least so many.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.9, 3
#: Wrappers and templates of all hosts are broadcast within this many bytes; beyond, a host is dealt to SALTS parts of a shuffle.
BROADCAST_BYTES, SALTS = 32 << 20, 32
#: A slot is a menu if so much of its text is link text.
LINK_SHARE = 0.6
#: An element is the article if it has this share of the text where it stands, less if it is marked as such; siblings with SIDE_SHARE are part of it.
MAIN_SHARE, MARKED_SHARE, SIDE_SHARE = 0.75, 0.4, 0.2
#: A page with less than this share of its own article in its host's is judged alone.
OWN_SHARE = 0.1
#: Elements nested deeper count as children of the one at this depth.
DEPTH = 200
#: Pairs of nodes that one alignment compares in all; beyond, equal labels are matched in order.
PAIRS = 100_000

_NAME = re.compile(r"</?[a-z]", re.I)
#: A tag; the quantifiers never go back, so an unclosed quote costs one look to the end.
_TAG = re.compile(r"<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_LOOSE = re.compile(r"<(/?)([a-z][^\s/>]*+)([^>]*+)>", re.I)
_ATTR = re.compile(r"([a-z_:][-\w:.]*+)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?", re.I)
#: Elements whose content is no markup, and others that hold no text of the page.
RAW = frozenset("script style title textarea iframe".split())
SKIPPED = frozenset("noscript template svg select button object canvas math".split())
#: Elements that break text into blocks, and those without content.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles that are never the article.
APART = frozenset("head nav aside footer form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
#: Class names and ids that are never the article, as whole names.
_NAMES = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|banners?|promos?|promotions?)(?:-(?:box|slot|unit|wrap|wrapper|container|banner|block|label|top|bottom|left|right))?"
    r"|cookies?(?:-\w+)?|consent(?:-\w+)?|gdpr(?:-\w+)?|notices?|site-notice|newsletter(?:-\w+)?|subscribe|subscription|sign-?up|popup|modal|overlay"
    r"|menus?|main-menu|nav|navbar|navigation|breadcrumbs?|side-?bar(?:-\w+)?|widgets?|widget-area|related|related-(?:posts|articles|links|stories)|recommend(?:ed|ations)"
    r"|share|sharing|share-(?:buttons|links|bar)|social(?:-\w+)?|comments?|comment-?list|comments?-(?:area|section|list|form|box|wrap|wrapper)|replies|respond|disqus(?:-thread)?"
    r"|(?:site-|page-)?footer|(?:site-|page-)header|masthead|top-?bar|toolbar|paginat(?:ion|or)|pager|login|search(?:-(?:form|box))?|skip-link",
    re.I,
)
_MAIN = re.compile(r"(?:article|post|entry|story|main|content)(?:-(?:body|content|text|article))?", re.I)
#: Which open elements a start tag closes, and what stops the search, as the HTML standard has it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}


class Node:
    __slots__ = ("apart", "children", "label", "main", "mass", "slot", "tag", "texts")

    def __init__(self, tag: str, label: str, apart: bool = False, main: int = 0):
        self.tag, self.label, self.apart, self.main = tag, label, apart, main
        self.children: list[Node] = []
        #: (text, characters of it that are link text) of a text node.
        self.texts: list[tuple[str, int]] = []
        self.slot, self.mass = -1, 0


def _open(tag: str, attrs: str, parent: Node, marks: bool) -> Node:
    apart, main, label = parent.apart or tag in APART or tag == "header" and not parent.main, parent.main, tag
    if attrs.strip(" /"):
        named = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(attrs)}
        names = [x.strip("_-").replace("_", "-") for x in f"{named.get('class', '')} {named.get('id', '')}".split()]
        apart = apart or "hidden" in named or named.get("aria-hidden") == "true" or named.get("role", "").lower() in ROLES
        apart = apart or tag not in ("html", "body", "article", "main") and any(_NAMES.fullmatch(x) for x in names)
        if named.get("class"):
            label = f"{tag}.{' '.join(sorted(re.sub('[0-9]+', '0', named['class']).split()))}"
        if tag not in ("html", "body") and (named.get("itemprop") == "articleBody" or any(_MAIN.fullmatch(x) for x in names)):
            main = max(main, 1)
        if named.get("role") == "main":
            main = max(main, 2)
    main = max(main, {"main": 2, "article": 3}.get(tag, 0))
    return Node(tag, label, apart, main) if marks else Node(tag, label)


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """("", "", text) of text, ("<", tag, attributes) and ("</", tag, "") of tags; linear in the page whatever is unclosed.

    After a quote that is never closed, tags end at the next ``>``. A raw
    element or a comment that is never closed takes the rest of the page.
    """
    at, n, loose, endless = 0, len(page), False, set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "", "", page[at:]
            return
        if lt > at:
            yield "", "", page[at:lt]
        at = lt + 1
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        elif page[at : at + 1] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif not _NAME.match(page, lt):
            yield "", "", "<"
        else:
            m = None if loose else _TAG.match(page, lt)
            if m is None:
                loose, m = True, _LOOSE.match(page, lt)
            if m is None:
                return
            at, tag = m.end(), m[2].lower()
            if m[1]:
                yield "</", tag, ""
            elif (tag in RAW or tag in SKIPPED) and not m[3].endswith("/"):
                end = None if tag in endless else _closing(tag).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    return
                else:  # without an end the tag alone is left out
                    endless.add(tag)
            else:
                yield "<", tag, m[3]


def parse(page: str, marks: bool = True) -> Node:
    """The tree of a page's block elements; leaves named #text hold its blocks."""
    root = Node("#root", "#root")
    # Elements beyond DEPTH are open too, but stand for the node at that depth.
    stack, count = [("#root", root)], Counter()
    words, links, anchors = [], 0, 0

    def flush() -> None:
        nonlocal links
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                top = stack[-1][1]
                node = Node("#text", "#text", top.apart, top.main)
                node.texts.append((text, min(len(text), links)))
                top.children.append(node)
            words.clear()
        links = 0

    for kind, tag, rest in pieces(page):
        if not kind:
            words.append(rest)
            if anchors:
                links += len(rest.strip())
            continue
        if kind == "</":
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BLOCKS:
                flush()
                if count[tag]:
                    while True:
                        last = stack.pop()[0]
                        count[last] -= 1
                        if last == tag:
                            break
            continue
        if tag == "a":
            anchors = 1
        if tag == "br":
            words.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        anchors = 0
        if stack[-1][0] == "p":  # a block ends an open paragraph
            count[stack.pop()[0]] -= 1
        closes, stops = _CLOSES.get(tag, (set(), set()))
        if any(count[x] for x in closes):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stops:
                    break
                if stack[k][0] in closes:
                    count.subtract(x for x, _ in stack[k:])
                    del stack[k:]
                    break
        node = stack[-1][1]
        if len(stack) <= DEPTH:
            node = _open(tag, rest, node, marks)
            stack[-1][1].children.append(node)
        if tag not in VOID:
            stack.append((tag, node))
            count[tag] += 1
    flush()
    return root


def fold(node: Node) -> Node:
    """Runs of like siblings become one node, as repeated records of a wrapper; their texts stay in order."""
    out: list[Node] = []
    for child in node.children:
        fold(child)
        if out and out[-1].label == child.label and all(len(x.children) <= 1 and not any(c.children for c in x.children) for x in (out[-1], child)):
            if child.label == "#text":
                out[-1].texts += child.texts
            elif child.children:
                if out[-1].children and out[-1].children[0].label == child.children[0].label:
                    out[-1].children[0].texts += child.children[0].texts
                else:
                    out[-1].children += child.children
            continue
        out.append(child)
    node.children = out
    return node


def tree(node: Node) -> list:
    """The node and what is below as nested lists (label, rank, children)."""
    return [node.label, node.main, [tree(x) for x in node.children]]


def _build(wrapper: str) -> Node:
    """The tree of a wrapper from its text, slots numbered from the root down."""

    def build(item: list) -> Node:
        nonlocal count
        node = Node(item[0].partition(".")[0], item[0], main=item[1])
        node.slot, count = count, count + 1
        node.children = [build(x) for x in item[2]]
        return node

    count = 0
    return build(json.loads(wrapper) if wrapper else ["#root", 0, []])


#: The same for pages that share a wrapper; it isn't changed.
wrapper_tree = lru_cache(maxsize=64)(_build)


def match(a: Node, b: Node, budget: list[int] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most pairs of equally labelled nodes that keep order and parents.

    Once PAIRS pairs were compared, the largest is no longer sought: children
    of equal label are matched as they come.
    """
    budget = [PAIRS] if budget is None else budget
    if a.label != b.label:
        return 0, []
    if not a.children or not b.children:
        return 1, [(a, b)]
    if [x.label for x in a.children] == [x.label for x in b.children]:
        total, pairs = 1, [(a, b)]
        for x, y in zip(a.children, b.children):
            n, own = match(x, y, budget)
            total += n
            pairs += own
        return total, pairs
    budget[0] -= len(a.children) * len(b.children)
    if budget[0] < 0:
        return _in_order(a, b, budget)
    width = len(b.children) + 1
    best = [[0] * width for _ in range(len(a.children) + 1)]
    own: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(a.children, 1):
        row, above = best[i], best[i - 1]
        for j, y in enumerate(b.children, 1):
            row[j] = max(row[j - 1], above[j])
            if x.label == y.label:
                own[i, j] = match(x, y, budget)
                row[j] = max(row[j], above[j - 1] + own[i, j][0])
    pairs, i, j = [(a, b)], len(a.children), len(b.children)
    while i and j:
        if (i, j) in own and best[i][j] == best[i - 1][j - 1] + own[i, j][0]:
            pairs += own[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[-1][-1], pairs


def _in_order(a: Node, b: Node, budget: list[int]) -> tuple[int, list[tuple[Node, Node]]]:
    """Each child of ``b`` with the next child of ``a`` that has its label."""
    places: dict[str, list[int]] = {}
    for i, x in enumerate(a.children):
        places.setdefault(x.label, []).append(i)
    total, pairs, at = 1, [(a, b)], 0
    for y in b.children:
        own = places.get(y.label, ())
        k = bisect_left(own, at)
        if k < len(own):
            n, below = match(a.children[own[k]], y, budget)
            total, at = total + n, own[k] + 1
            pairs += below
    return total, pairs


def label_paths(root: Node, path: int = 0) -> Iterator[tuple[Node, Node | None, int]]:
    """(node, parent, hash of its labels from the root down), in page order; ``path`` is the hash of what is above ``root``."""
    stack: list[tuple[Node, Node | None, int]] = [(root, None, path)]
    while stack:
        node, parent, path = stack.pop()
        path = crc32(f"{node.label}\n".encode("utf-8", "replace"), path)
        yield node, parent, path
        stack += [(x, node, path) for x in node.children[::-1]]


def within(root: Node, most: dict[int, int], count: Counter, path: int = 0) -> list[Node]:
    """``root``, or nothing, without nodes beyond the number that ``most`` has for their label path and what is below them; ``count`` has those there are already."""
    kept: set[int] = set()
    for node, parent, own in label_paths(root, path):
        if (parent is None or id(parent) in kept) and count[own] < most.get(own, 0):
            count[own] += 1
            kept.add(id(node))
    for node in below([root]):
        node.children = [x for x in node.children if id(x) in kept]
    return [root] if id(root) in kept else []


def merged(a: Node, b: Node, most: dict[int, int]) -> Node:
    """``a`` with what ``b`` has besides, each new child after the one that stood before it, as far as ``within`` leaves it."""
    pairs = match(a, b)[1]
    mate = {id(y): x for x, y in pairs}
    count, paths = Counter(x[2] for x in label_paths(a)), {id(y): path for y, _, path in label_paths(b)}
    for x, y in pairs:
        out, rest = [], list(x.children)
        for child in y.children:
            known = mate.get(id(child))
            if known is None:
                out += within(child, most, count, paths[id(y)])
            else:
                at = next(i for i, c in enumerate(rest) if c is known)
                out += rest[: at + 1]
                del rest[: at + 1]
        x.children = out + rest
    return a


def weigh(node: Node) -> int:
    """Give every node the text of all below it; text nodes have theirs already."""
    if node.children:
        node.mass = sum(map(weigh, node.children))
    return node.mass


def article(node: Node) -> list[Node]:
    """The nodes whose texts are the article, by the masses of ``weigh``."""
    boxes = [x for x in node.children if any(c.label != "#text" for c in x.children) or x.main > node.main]
    if node.main < 3 and boxes and node.mass:
        best = max(boxes, key=lambda x: (x.mass, x.main))
        marked = best.main > node.main
        if best.mass >= (MARKED_SHARE if marked else MAIN_SHARE) * node.mass:
            # Other parts of the article, and its headline.
            also = [x for x in boxes if x is best or x.mass >= SIDE_SHARE * node.mass and (x.main > node.main or not marked)]
            return [x for x in node.children if x.tag == "h1" and x not in also] + [y for x in also for y in article(x)]
    return [node]


def below(nodes: list[Node]) -> Iterator[Node]:
    stack = list(nodes)
    while stack:
        node = stack.pop()
        yield node
        stack += node.children


def blocks(page: str, wrapper: str, marks: bool = True) -> list[tuple[str, int, int, bool]]:
    """(text, slot, characters of link text, whether the page alone takes it for the article).

    Where nothing is aligned, the slot is a negative hash of the block's label path.
    """
    root = fold(parse(page, marks))
    for x, y in match(wrapper_tree(wrapper), root)[1]:
        y.slot = x.slot
    for node in below([root]):
        node.mass = 0 if node.apart else sum(len(t) for t, linked in node.texts if linked < LINK_SHARE * len(t))
    weigh(root)
    own = {id(x) for x in below(article(root))}
    out, stack = [], [(root, 0)]
    while stack:
        node, path = stack.pop()
        if node.apart:
            continue
        path = crc32(f"{node.label}\n".encode("utf-8", "replace"), path)
        slot = node.slot if node.slot >= 0 else -1 - (path >> 1)
        out += [(text, slot, linked, id(node) in own) for text, linked in node.texts]
        stack += [(x, path) for x in node.children[::-1]]
    return out


def key_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _beside(rows: DataFrame, side: DataFrame, size: Column, how: str, by: str = "page_id") -> DataFrame:
    """``rows`` with the one row of ``side`` for their host: broadcast within counted bytes, else each host dealt by ``by`` to SALTS parts."""
    if (side.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), F.col("host") == F.col("of_host"), how)
    side = side.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return rows.join(side, (F.col("host") == F.col("of_host")) & (F.col("salt") == F.col("of_salt")), how).drop("salt", "of_salt")


def _text(node: Node) -> str:
    return json.dumps(tree(node), separators=(",", ":"))


def trees(rows: DataFrame, marks: bool = True) -> DataFrame:
    """(host, tree, pages): the different trees of all pages of each host, and how many pages have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["host", "tree", "pages"])

        seen, held = Counter(), 0
        for batch in batches:
            for host, page in zip(*batch.columns):
                key = host.as_py(), _text(fold(parse(page.as_py(), marks)))
                held += 0 if key in seen else len(key[1])
                seen[key] += 1
                if held > HELD_BYTES:
                    yield out()
                    seen, held = Counter(), 0
        yield out()

    found = rows.select("host", "html").mapInArrow(run, "host string, tree string, pages bigint")
    return found.groupBy("host", "tree").agg(F.sum("pages").alias("pages"))


def spread(found: DataFrame) -> DataFrame:
    """(of_host, most): as JSON, for each label path how many nodes of it at least TEMPLATE_PAGES pages have; paths that fewer have are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in top], pa.string()), pa.array([k[1] for k in top], pa.int64()), pa.array(top.values(), pa.list_(pa.int32()))], ["host", "path", "counts"])

        top: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for host, own, pages in zip(*batch.columns):
                host, times = host.as_py(), min(pages.as_py(), TEMPLATE_PAGES)
                for path, n in Counter(x[2] for x in label_paths(_build(own.as_py()))).items():
                    counts = top.setdefault((host, path), [])
                    counts += [n] * times
                    counts.sort(reverse=True)
                    del counts[TEMPLATE_PAGES:]
                if len(top) > HELD_BYTES >> 8:
                    yield out()
                    top = {}
        yield out()

    # The largest counts of a task hold the largest of all.
    top = found.select("host", "tree", "pages").mapInArrow(run, "host string, path bigint, counts array<int>").groupBy("host", "path")
    nth = F.get(F.sort_array(F.flatten(F.collect_list("counts")), False), F.lit(TEMPLATE_PAGES - 1))
    most = top.agg(nth.alias("n")).where("n IS NOT NULL")
    return most.groupBy(F.col("host").alias("of_host")).agg(F.to_json(F.collect_list(F.array("path", F.col("n").cast("bigint")))).alias("most"))


@lru_cache(maxsize=64)
def _most(most: str | None) -> dict[int, int]:
    return dict(json.loads(most)) if most else {}


def wrappers(rows: DataFrame, marks: bool = True) -> DataFrame:
    """(of_host, wrapper): the merged tree of all pages of each host.

    It has as many nodes of a label path as at least TEMPLATE_PAGES pages have.
    The groups of a round are told by hashes of the trees, and merge them from
    the most frequent to the rarest, so that the wrapper doesn't depend on how
    the rows are dealt to tasks.
    """

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_text((within(_build(x.as_py()), _most(most.as_py()), Counter()) or [Node("#root", "#root")])[0]) for x, most in zip(batch.column(1), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string()), batch.column(2)], ["host", "tree", "pages"])

    def merge(table: pa.Table) -> pa.Table:
        root, most = Node("#root", "#root"), _most(table.column("most")[0].as_py())
        pages = table.column("pages").to_pylist()
        for _, own in sorted(zip((-n for n in pages), table.column("tree").to_pylist())):
            root = merged(root, _build(own), most)
        return pa.table({"host": table.column("host")[:1], "tree": pa.array([_text(root)]), "pages": pa.array([sum(pages)], pa.int64())})

    found = written(trees(rows, marks), "wrapper-structures")
    most = written(spread(found), "wrapper-spread")
    size = F.octet_length("of_host") + F.coalesce(F.octet_length("most"), F.lit(0)) + 8
    now = _beside(found, most, size, "left", "tree").select("host", "tree", "pages", "most").mapInArrow(prune, "host string, tree string, pages bigint")
    now, turn = now.groupBy("host", "tree").agg(F.sum("pages").alias("pages")), 0
    while True:
        now = written(now, "wrapper-trees")
        counts = now.groupBy(F.col("host").alias("of_host")).agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            return now.select(F.col("host").alias("of_host"), F.col("tree").alias("wrapper"))
        turn += 1
        both = _beside(now, counts.join(most, "of_host", "left"), size, "inner", "tree")
        part = F.pmod(F.xxhash64("tree", F.lit(turn)), F.ceil(F.col("n") / MERGED))
        now = both.select("host", "tree", "pages", "most", part.alias("part")).groupBy("host", "part").applyInArrow(merge, "host string, tree string, pages bigint")


def aligned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", marks: bool = True) -> DataFrame:
    """(page_id, url, host, texts, slots, links, own, keys, main): each page's blocks with their slots.

    ``main`` is equal for pages with the same three longest blocks.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    side = wrappers(rows, marks)
    kinds = [("texts", pa.string()), ("slots", pa.int32()), ("links", pa.int32()), ("own", pa.bool_()), ("keys", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [[(*x, key_of(x[0])) for x in blocks(page.as_py(), tree.as_py(), marks)] for page, tree in zip(part.column(3), part.column(4))]
                columns = [pa.array([[x[k] for x in own] for own in found], pa.list_(kind)) for k, (_, kind) in enumerate(kinds)]
                main = [hash(tuple(x[4] for x in heapq.nlargest(3, own, key=lambda x: (len(x[0]), x[4])))) for own in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns, pa.array(main, pa.int64())], ["page_id", "url", "host", *(k for k, _ in kinds), "main"])

    both = _beside(rows, side, F.octet_length("wrapper") + F.octet_length("of_host"), "inner").select("page_id", "url", "host", "html", "wrapper")
    return both.mapInArrow(run, "page_id bigint, url string, host string, texts array<string>, slots array<int>, links array<int>, own array<boolean>, keys array<bigint>, main bigint")


def templates(table: DataFrame) -> DataFrame:
    """(of_host, template, menus, inside, outside), a row for each host of enough different pages.

    ``template`` has the (slot, key) pairs that are template; ``menus``,
    ``inside`` and ``outside`` are the slots that are menus, and those most of
    whose text is in the pages' articles or not.
    """
    block = F.arrays_zip("slots", "keys", "links", "own", F.transform("texts", F.length).alias("chars"))
    # Copies of one article say nothing about a wrapper, so pages with the same main text count once.
    first = table.groupBy("host", "main").agg(F.min_by(block, F.struct("page_id", "url")).alias("blocks"))
    # A page counts once for each slot it has, and once for each different text in it.
    texts = F.transform("blocks", lambda x: F.struct(x["slots"].alias("slot"), x["keys"].alias("key")))
    slots = F.transform("blocks", lambda x: F.struct(x["slots"].alias("slot"), F.lit(None).cast("bigint").alias("key")))
    pages = first.select("host", F.explode(F.array_distinct(F.concat(texts, slots))).alias("m")).groupBy("host", "m.slot", "m.key").agg(F.count(F.lit(1)).alias("pages"))
    pages = written(pages.where(F.col("key").isNull() | (F.col("pages") >= F.lit(TEMPLATE_SHARE * TEMPLATE_PAGES))), "wrapper-pages")
    all_pages = pages.where(F.col("key").isNull() & (F.col("pages") >= TEMPLATE_PAGES)).select("host", "slot", F.col("pages").alias("all_pages"))
    constant = pages.where("key IS NOT NULL").join(all_pages, ["host", "slot"]).where(F.col("pages") >= F.lit(TEMPLATE_SHARE) * F.col("all_pages")).groupBy("host").agg(F.collect_list(F.struct("slot", "key")).alias("template"))
    chars = lambda which: F.sum(F.when(which, F.col("b.chars")).otherwise(0))
    sums = first.select("host", F.explode("blocks").alias("b")).groupBy("host", F.col("b.slots").alias("slot")).agg(F.sum("b.chars").alias("chars"), F.sum("b.links").alias("links"), chars(F.col("b.own")).alias("own"))
    told = sums.join(all_pages, ["host", "slot"]).select("host", "slot", (F.col("links") >= F.lit(LINK_SHARE) * F.col("chars")).alias("menu"), (F.col("own") >= F.lit(0.5) * F.col("chars")).alias("inside"))
    which = lambda test: F.collect_list(F.when(test, F.col("slot")))
    told = told.groupBy("host").agg(which(F.col("menu")).alias("menus"), which(F.col("inside")).alias("inside"), which(~F.col("inside")).alias("outside"))
    hosts = first.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TEMPLATE_PAGES).select("host")
    out = hosts.join(constant, "host", "left").join(told, "host", "left")
    none = F.array().cast("array<int>")
    return out.select(F.col("host").alias("of_host"), F.coalesce("template", F.array().cast("array<struct<slot:int,key:bigint>>")).alias("template"), *(F.coalesce(c, none).alias(c) for c in ("menus", "inside", "outside")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", marks: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, templated), one row per input row.

    Without ``marks`` tags, roles and names say nothing, and only the hosts'
    statistics tell the article. ``templated`` tells whether the host had pages enough for a template. Null
    or empty html gives the empty text. Rows without a url, or with one that
    names no host, are one host. Repeated rows each get their text. Elements
    nested deeper than DEPTH, wide lists and unclosed quotes, comments and
    elements keep their text as ``parse`` and ``match`` say. Other columns are
    not read; an empty table gives an empty result.
    """
    table = written(aligned(pages, id_col, url_col, html_col, marks), "wrapper-blocks")
    known = written(templates(table), "wrapper-templates")
    joined = _beside(table, known, F.size("template") * 32 + (F.size("menus") + F.size("inside") + F.size("outside")) * 16 + F.octet_length("of_host"), "left")
    every = F.arrays_zip("texts", "slots", "links", "own", "keys")
    joined = joined.withColumn("templated", F.col("template").isNotNull())
    templated = F.col("templated")
    constant = lambda x: F.coalesce(F.array_contains("template", F.struct(x["slots"].alias("slot"), x["keys"].alias("key"))), F.lit(False))
    # Where a host has no statistics, a block is a menu by its own links.
    menu = lambda x: F.when(templated, F.array_contains("menus", x["slots"])).otherwise(x["links"] >= F.lit(LINK_SHARE) * F.length(x["texts"]))
    rest = joined.withColumn("rest", F.filter(every, lambda x: ~constant(x) & ~menu(x)))
    alone = F.filter("rest", lambda x: x["own"])
    voted = lambda x: F.array_contains("inside", x["slots"]) | (x["own"] & ~F.array_contains("outside", x["slots"]))
    host = F.filter("rest", lambda x: F.when(F.col("templated"), voted(x)).otherwise(x["own"]))
    size = lambda own: F.aggregate(own, F.lit(0), lambda n, x: n + F.length(x["texts"]))
    both = rest.select("page_id", "url", "templated", alone.alias("alone"), host.alias("host"))
    content = F.when(size(F.col("host")) < F.lit(OWN_SHARE) * size(F.col("alone")), F.col("alone")).otherwise(F.col("host"))
    text = F.array_join(F.transform(content, lambda x: x["texts"]), "\n\n")
    return both.select("page_id", "url", text.alias("text"), "templated").select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "templated")
