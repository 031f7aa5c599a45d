"""Main text of web pages by wrappers inferred per host.

Every page becomes a tree of block elements and text slots.  Inline elements are
transparent, unclosed paragraphs and list items close as browsers close them.
Adjacent siblings of one shape fold into a repeated group.  The pages of a host
are aligned one after another, level by level, by longest common subsequences
of element shapes (long rows by the shapes that occur once on both sides, and
greedily between those): what one side lacks becomes optional, what repeats
becomes a group, text that differs becomes a variable slot and text that doesn't
stays template.  The result is a union-free expression for the host
(``expression``).

Its main region is the article element that holds most text outside
boilerplate, with the articles beside it; or else main; or else the element that
holds most of the variable text, and a title (h1) that stands beside it.  Only in the last case is template text
dropped: what stays the same on ``STEADY`` different pages or more while other
slots vary.  A page without its host's region is read by the same rule on itself
alone.  Boilerplate is told by element names, and by class names, ids and roles
that consist of words of boilerplate only (``social`` but not
``social-history``); paragraphs, cells and the like need a plainer word, and
some words count only outside articles.  Where all of a page's text is
boilerplate by names, names don't count.

Wrappers are aligned within tasks first, then over a fixed number of groups of
tasks, then for the host, each time in pairs of about as many wrappers, so that
wide ones are walked a logarithmic number of times; a task passes on what it
holds at ``HOSTS`` wrappers or ``NODES`` nodes.  A wrapper keeps every child of
every element, so one task holds all that a host's pages have of different
structure.  Articles of the region are told by the element they stand in,
however many shapes they have, and a rule longer than ``ATTACHED`` goes to a file
of the shared folder that the pages name.

Defined results: null html and null urls are empty; a page without text gives
an empty text; pages may be of any length and depth; null ids and repeated rows
are kept, and a repeated page counts once in its host's template; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import column_texts, new_path, parts, ship, stored, table, taken, wanted

STEADY = 8
HOSTS = 2000
NODES = 1 << 17
GROUPS = 32
#: Characters of a rule that travel with each page of its host.
ATTACHED = 1 << 16
#: Longer texts are told apart by a digest.
LONGEST_TEMPLATE = 200
#: Rows of siblings are aligned exactly up to this product of their lengths.
EXACT = 1 << 14

# Element names by their part in a page, and words in class, id or role that mark boilerplate.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object audio video canvas select button".split())
_UNPARSED = frozenset("script style textarea title noscript template iframe".split())
_BAD = frozenset("nav footer aside form dialog menu head fieldset header".split())
_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Words that mark boilerplate only outside articles; words that may stand beside a mark; plain marks, which count on any element.
_OUTSIDE = frozenset("header legal alert form search skip disclaimer widget overlay".split())
_NEUTRAL = frozenset(
    "site page main global top bottom left right upper lower primary secondary list lists box bar block blocks slot area wrap wrapper container section item items link links "
    "button buttons btn icon icons inner outer unit holder row col column panel panels group module js the posts articles stories topics latest more recent popular follow us policy privacy count".split()
)
# Words of the article itself: they may stand beside a mark as well, but then the words above that count only outside articles don't.
_CONTENT = frozenset("article post entry content story title body text".split())
_PLAIN = frozenset(
    "ad ads adbox advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies copyright newsletter notice notices pagination pager promo "
    "promotion reply replies share sharing sponsor sponsored subscribe".split()
)
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot blockquote pre figure figcaption caption address summary article".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": set()}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset("main body html".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marked(tag: str, names: list[str], within: bool) -> bool:
    """Whether a class name, id or role consists of boilerplate words; ``within`` an article or main element."""
    for name in names:
        words = [w.lower() for w in _PART.findall(name)]
        own = within or not _CONTENT.isdisjoint(words)
        marks = [w for w in words if w in _WORDS and not (own and w in _OUTSIDE)]
        if marks and all(w in _WORDS or w in _NEUTRAL or w in _CONTENT for w in words) and (tag not in _TEXTUAL or any(w in _PLAIN for w in marks)):
            return True
    return False


class Page:
    """Nodes 0.. with parent, shape, whether boilerplate; ``items`` are child nodes or (slot) texts in order.

    ``named`` is set where only a name made a node, or one above it, boilerplate.
    """

    def __init__(self, source: str):
        self.parent, self.shape, self.bad, self.named, self.within, self.items = [-1], ["#root"], [False], [False], [False], [[]]
        self.tags = ["#root"]
        self.mark = xxhash.xxh64_intdigest(source.encode(errors="replace")) >> 11
        self._read(source)

    def _open(self, at: int, tag: str, attributes: str) -> int:
        shape, bad, named = tag, tag in _BAD, False
        if attributes.strip(" /"):
            names, role = [], ""
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role"):
                    names += value.split()
                    role = value if name == "role" else role
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    bad = True
            # a path joins shapes by slashes, so a name can't keep its own
            shape += "".join("." + x for x in sorted({re.sub(r"\d+", "0", x).replace("/", "|") for x in names}))
            named = tag not in _MAIN and _marked(tag, names, self.within[at])
            if role == "main":
                shape = "main" + shape[len(tag) :]
        self.parent.append(at)
        self.tags.append(tag)
        self.shape.append(shape)
        self.bad.append(self.bad[at] or bad)
        self.named.append(self.named[at] or named)
        self.within.append(self.within[at] or tag == "article" or shape.split(".")[0] == "main")
        self.items.append([])
        self.items[at].append(len(self.shape) - 1)
        return len(self.shape) - 1

    def boilerplate(self, at: int, names: bool = True) -> bool:
        return self.bad[at] or (names and self.named[at])

    def _read(self, source: str) -> None:
        at, pos, run, n = 0, 0, [], len(source)
        endless: set[str] = set()  # elements that no later tag closes
        opened = Counter()  # tags of the elements that are open

        def rise(top: int) -> int:
            """Closes all elements below ``top``."""
            up = at
            while up != top:
                opened[self.tags[up]] -= 1
                up = self.parent[up]
            return top

        def flush() -> None:
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    self.items[at].append(text)
                run.clear()

        while pos < n:
            m = _TOKEN.search(source, pos)
            if not m:
                run.append(source[pos:])
                break
            if m.start() > pos:
                run.append(source[pos : m.start()])
            pos = m.end()
            slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in _RAW and not slash:
                if not rest.rstrip().endswith("/") and tag not in endless:
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, pos)
                    if end:
                        pos = end.end()
                    elif tag in _UNPARSED:
                        pos = n
                    else:
                        endless.add(tag)
                continue
            if tag in _VOID or tag in _RAW:
                if tag in ("br", "hr"):
                    run.append(" ")
                continue
            if tag in _INLINE:
                names = [x for k, v in _ATTRIBUTE.findall(rest) if k.lower() in ("class", "id", "role") for x in v.strip("\"'").split()] if rest and not slash else []
                if not opened[tag] if slash else not names or not _marked(tag, names, self.within[at]):
                    continue
            flush()
            if slash:
                if opened[tag]:
                    up = at
                    while self.tags[up] != tag:
                        up = self.parent[up]
                    at = rise(self.parent[up])
                continue
            if tag not in _INLINE:
                if opened["p"]:
                    # a paragraph ends where a block begins, unless another block lies between
                    up = at
                    while self.tags[up] in _INLINE:
                        up = self.parent[up]
                    if self.tags[up] == "p":
                        while self.tags[up] == "p" or self.tags[up] in _INLINE:
                            up = self.parent[up]
                        at = rise(up)
                if tag in _CLOSES and any(opened[x] for x in _CLOSES[tag]):
                    up = at
                    while up and self.tags[up] not in _CLOSES[tag] and self.tags[up] not in _SCOPE[tag]:
                        up = self.parent[up]
                    if up and self.tags[up] in _CLOSES[tag]:
                        at = rise(self.parent[up])
            if not rest.endswith("/"):
                at = self._open(at, tag, rest)
                opened[tag] += 1
        flush()

    def find(self, path: str, tag: str = "") -> list[int]:
        """The nodes at a path of shapes, in page order; with ``tag`` their children of that name, whatever else their shape."""
        nodes = [0]
        for shape in path.split("/") if path else ():
            nodes = [x for node in nodes for x in self.items[node] if isinstance(x, int) and self.shape[x] == shape]
        if tag:
            nodes = [x for node in nodes for x in self.items[node] if isinstance(x, int) and self.shape[x].split(".")[0] == tag]
        return nodes

    def blocks(self, top: int = 0) -> Iterator[tuple[int, str]]:
        """(node, text) in page order below a node."""
        todo = [iter(self.items[top])]
        nodes = [top]
        while todo:
            for x in todo[-1]:
                if isinstance(x, int):
                    todo.append(iter(self.items[x]))
                    nodes.append(x)
                    break
                yield nodes[-1], x
            else:
                todo.pop()
                nodes.pop()


# A wrapper node is [shape, optional, repeated, pages, children, boilerplate]; a slot is
# ["#", optional, repeated, marks of up to STEADY pages, template text or None, words].
@contextmanager
def _deep():
    """Room for wrappers as deep as their pages; calls between Python functions take no stack of the process."""
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, 1_000_000))
    try:
        yield
    finally:
        sys.setrecursionlimit(old)


def slot_key(text: str) -> str:
    """A text, or the digest of a long one."""
    return text if len(text) <= LONGEST_TEMPLATE else "\0" + hashlib.blake2b(text.encode(errors="replace"), digest_size=16).hexdigest()


def wrapper_of(page: Page, names: bool = True) -> list:
    nodes = [[page.shape[i], False, False, 1, [], page.boilerplate(i, names)] for i in range(len(page.shape))]
    with _deep():
        for i in range(len(nodes) - 1, -1, -1):  # children have greater numbers than their parents
            nodes[i][4] = folded([nodes[x] if isinstance(x, int) else ["#", False, False, [page.mark], slot_key(x), len(x.split())] for x in page.items[i]])
    return nodes[0]


def _joined(a: list, b: list, pages: int) -> list:
    """Two aligned nodes or slots as one; ``pages`` is how often the two together were seen."""
    if a[0] == "#":
        return ["#", a[1] or b[1], a[2] or b[2], sorted({*a[3], *b[3]})[:STEADY], a[4] if a[4] == b[4] else None, a[5] + b[5]]
    return [a[0], a[1] or b[1], a[2] or b[2], pages, aligned(a[4], b[4]), a[5] or b[5]]


def _both(a: list, b: list) -> list:
    return _joined(a, b, 0 if a[0] == "#" else a[3] + b[3])


def folded(row: list) -> list:
    """Adjacent repeats of up to three siblings as one repeated group of each."""
    for width in (1, 2, 3):
        out: list = []
        for x in row:
            out.append(x)
            while len(out) >= 2 * width and [y[0] for y in out[-width:]] == [y[0] for y in out[-2 * width : -width]]:
                late = out[-width:]
                del out[-width:]
                for k in range(width):
                    old = out[k - width]
                    new = _joined(old, late[k], 0 if old[0] == "#" else max(old[3], late[k][3]))
                    new[2] = True
                    out[k - width] = new
        row = out
    return row


def _subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Shapes that occur once on both sides, as a longest chain that rises on both."""
    once = [{x: i for i, x in enumerate(side) if n[x] == 1} for side, n in ((a, Counter(a)), (b, Counter(b)))]
    pairs = [(i, once[1][x]) for x, i in once[0].items() if x in once[1]]
    tails: list[int] = []
    ends: list[int] = []  # pairs that end the best chain of each length
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [k]
        before.append(ends[at - 1] if at else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _greedy(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Each shape of ``a`` with its next place in ``b``, unless that lies further than the row is long."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    out, at = [], 0
    for i, x in enumerate(a):
        some = places.get(x, [])
        k = bisect_left(some, at)
        if k < len(some) and some[k] - at <= max(8, len(b) // max(1, len(a) - i)):
            out.append((i, some[k]))
            at = some[k] + 1
    return out


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal shapes, rising on both sides."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [(i, i) for i in range(lo)]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    chain = [] if len(x) * len(y) <= EXACT else _anchors(x, y)
    i = j = 0
    for p, q in [*chain, (len(x), len(y))]:
        gap = _subsequence if (p - i) * (q - j) <= EXACT else _greedy
        out += [(lo + i + u, lo + j + v) for u, v in gap(x[i:p], y[j:q])]
        if p < len(x) or q < len(y):
            out.append((lo + p, lo + q))
        i, j = p + 1, q + 1
    return out + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def aligned(a: list, b: list) -> list:
    """One row of siblings for both: matched shapes in order are joined, the others are optional."""
    out, i, j = [], 0, 0
    for p, q in [*matched([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [[x[0], True, *x[2:]] for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(_both(a[p], b[q]))
        i, j = p + 1, q + 1
    return folded(out) if len(out) > max(len(a), len(b)) else out


def merged(a: list, b: list) -> list:
    """One wrapper for the pages of both."""
    with _deep():
        return _both(a, b)


class Pairs:
    """Wrappers of one host, merged in pairs of about as many: a wide one is walked once for each doubling."""

    def __init__(self):
        self.held: list[tuple[int, list]] = []

    def add(self, wrapper: list) -> None:
        n = 1
        while self.held and self.held[-1][0] <= n:
            some, before = self.held.pop()
            n, wrapper = n + some, merged(before, wrapper)
        self.held.append((n, wrapper))

    def whole(self) -> list:
        while len(self.held) > 1:
            n, wrapper = self.held.pop()
            some, before = self.held.pop()
            self.held.append((n + some, merged(before, wrapper)))
        return self.held[0][1]

    def nodes(self) -> int:
        n, todo = 0, [w for _, w in self.held]
        while todo:
            node = todo.pop()
            n += 1
            if node[0] != "#":
                todo += node[4]
        return n


def dumped(wrapper: list) -> str:
    """JSON of the nodes in page order, each with the number of its children: no nesting, whatever the depth."""
    out, todo = [], [wrapper]
    while todo:
        node = todo.pop()
        if node[0] == "#":
            out.append(node)
        else:
            out.append([*node[:4], len(node[4]), node[5]])
            todo += reversed(node[4])
    return json.dumps(out, separators=(",", ":"))


def loaded(data: str) -> list:
    top: list = []
    open_rows = [(top, 1)]
    for node in json.loads(data):
        row, left = open_rows.pop()
        row.append(node)
        if left > 1:
            open_rows.append((row, left - 1))
        if node[0] != "#":
            n, node[4] = node[4], []
            if n:
                open_rows.append((node[4], n))
    return top[0]


def expression(node: list) -> str:
    """The wrapper as a union-free expression: (x)? optional, (x)+ repeated, TEXT a variable slot."""
    if node[0] == "#":
        body = json.dumps(node[4], ensure_ascii=False) if node[4] is not None else "TEXT"
    else:
        body = f"<{node[0]}>" + "".join(expression(x) for x in node[4]) + f"</{node[0].split('.')[0]}>"
    sign = {(True, True): "*", (True, False): "?", (False, True): "+"}.get((node[1], node[2]), "")
    return f"({body}){sign}" if sign else body


class _Tree:
    """A wrapper's nodes in page order, with parents, the words outside boilerplate below each, and whether a title is."""

    def __init__(self, wrapper: list):
        self.nodes, self.parent, todo = [], [], [(wrapper, -1)]
        while todo:
            node, up = todo.pop()
            at = len(self.nodes)
            self.nodes.append(node)
            self.parent.append(up)
            if node[0] != "#" and not node[5]:
                todo += [(x, at) for x in reversed(node[4])]
        self.mass = [x[5] if x[0] == "#" else 0 for x in self.nodes]
        self.titled = [x[0].split(".")[0] == "h1" for x in self.nodes]
        self.below: list[list[int]] = [[] for _ in self.nodes]
        for at in range(len(self.nodes) - 1, 0, -1):
            self.mass[self.parent[at]] += self.mass[at]
            self.titled[self.parent[at]] |= self.titled[at]
            self.below[self.parent[at]].append(at)

    def path(self, at: int) -> str:
        out = []
        while at > 0:
            out.append(self.nodes[at][0])
            at = self.parent[at]
        return "/".join(reversed(out))


def region(wrapper: list) -> tuple[str, str]:
    """The path of the main region and "", or that of the element it stands in and the name, article or main, that tells it there."""
    tree = _Tree(wrapper)
    found: dict[str, list[int]] = {"article": [], "main": []}
    inner = [False] * len(tree.nodes)  # within an article
    for at, node in enumerate(tree.nodes):
        up = tree.parent[at]
        inner[at] = up >= 0 and (inner[up] or tree.nodes[up][0].split(".")[0] == "article")
        tag = node[0].split(".")[0]
        if tag in found and not node[5] and not inner[at]:
            found[tag].append(at)
    for tag in ("article", "main"):
        if found[tag]:
            best = max(found[tag], key=lambda at: (tree.mass[at], -at))
            if tree.mass[best] or tag == "main":
                return tree.path(tree.parent[best]), tag
    at = 0
    while True:
        some = [x for x in tree.below[at] if tree.nodes[x][0] != "#" and not tree.nodes[x][5]]
        best = max(some, key=lambda x: (tree.mass[x], -x), default=None)
        tag = tree.nodes[best][0].split(".")[0] if best is not None else ""
        if best is None or tag in _HEADINGS or tag == "p" or tree.mass[best] * 5 < tree.mass[at] * 4 or tree.nodes[best][2] or any(tree.titled[x] for x in some if x != best):
            return tree.path(at), ""
        at = best


def _step(digest: int, shape: str) -> int:
    """The digest of a path one shape longer."""
    return xxhash.xxh64_intdigest(f"{digest}/{shape}") >> 11


def rule_of(wrapper: list) -> dict:
    """What extraction needs of a wrapper: the region, and template texts by the digest of their place in it."""
    path, tag = region(wrapper)
    if tag:
        return {"region": [path, tag], "template": []}
    nodes = [wrapper]
    for shape in path.split("/") if path else ():
        nodes = [x for node in nodes for x in node[4] if x[0] == shape]
    steady, varies, todo = [], False, [(0, node) for node in nodes]
    while todo:
        at, node = todo.pop()
        for x in node[4]:
            if x[0] != "#":
                if not x[5]:
                    todo.append((_step(at, x[0]), x))
            elif x[4] is None:
                varies = True
            elif len(x[3]) >= STEADY:
                steady.append([at, x[4]])
    return {"region": [path, ""], "template": sorted(steady) if varies else []}


def extract(source: str, rule: dict | None = None) -> str:
    """The main text of a page by its host's rule; by the page alone where the rule's region is missing or without text."""
    page = Page(source)

    def text(rule: dict, names: bool = True) -> list[str]:
        steady = rule["steady"] if "steady" in rule else {tuple(x) for x in rule["template"]}
        out: list[str] = []
        for top in page.find(*rule["region"]):
            digest = {top: 0}

            def place(at: int) -> int:
                chain = []
                while at not in digest:
                    chain.append(at)
                    at = page.parent[at]
                for x in reversed(chain):
                    digest[x] = _step(digest[page.parent[x]], page.shape[x])
                return digest[chain[0] if chain else at]

            for at, block in page.blocks(top):
                if not _dropped(page, at, names) and not (steady and (place(at), slot_key(block)) in steady):
                    out.append(block)
        return out

    out = text(rule) if rule else []
    for names in (True, False):
        if not out:
            out = text(rule_of(wrapper_of(page, names)) | {"template": []}, names)
    return "\n\n".join(out)


def _dropped(page: Page, at: int, names: bool = True) -> bool:
    """Boilerplate; a heading stays if a header within the article is all that it is in."""
    if not page.boilerplate(at, names):
        return False
    if page.tags[at] not in _HEADINGS:
        return True
    up = page.parent[at]
    if up <= 0 or page.tags[up] != "header":
        return True
    return page.boilerplate(page.parent[up], names) or page.tags[page.parent[up]] not in ("article", "main")


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARTIAL = "host string, part int, wrapper string"


def _aligned_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Pairs] = {}
    nodes = 0  # those held are no more
    part = TaskContext.get().partitionId() % GROUPS

    def rows() -> Iterator[pa.RecordBatch]:
        while held:
            hosts, data, size = [], [], 0
            while held and size < 1 << 20:
                host, pairs = held.popitem()
                hosts.append(host)
                data.append(dumped(pairs.whole()))
                size += len(data[-1])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([part] * len(hosts), pa.int32()), pa.array(data, pa.string())], ["host", "part", "wrapper"])

    for batch in batches:
        for host, source in zip(column_texts(batch, "host"), column_texts(batch, "html"), strict=True):
            page = Page(source)
            held.setdefault(host, Pairs()).add(wrapper_of(page))
            nodes += sum(map(len, page.items)) + 1
            full = len(held) >= HOSTS
            if nodes >= NODES:
                nodes = sum(pairs.nodes() for pairs in held.values())
                full |= 2 * nodes >= NODES
            if full:
                yield from rows()
                nodes = 0
    yield from rows()


def _aligned_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and group: one wrapper for each."""
    at, now = None, Pairs()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([dumped(now.whole())])], ["host", "part", "wrapper"])

    for batch in batches:
        for host, part, data in zip(*(taken(batch, c) for c in ("host", "part", "wrapper")), strict=True):
            if (host.as_py(), part.as_py()) != at:
                if at:
                    yield row()
                at, now = (host.as_py(), part.as_py()), Pairs()
            now.add(loaded(data.as_py()))
    if at:
        yield row()


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one JSON wrapper for each host."""
    spark = pages.sparkSession
    ship(spark)
    rows = wanted(pages, url="string", html="string").select(host_of("url").alias("host"), "html")
    some = rows.mapInArrow(_aligned_pages, _PARTIAL)
    for group in (F.col("part"), F.lit(0)):
        dealt = some.withColumn("part", group.cast("int")).repartition(parts(spark), "host", "part")
        some = dealt.sortWithinPartitions("host", "part", "wrapper").mapInArrow(_aligned_wrappers, _PARTIAL)
    return some.select("host", "wrapper")


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _rules(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files = 0
        for batch in batches:
            for host, wrapper in zip(taken(batch, "host"), taken(batch, "wrapper"), strict=True):
                data = json.dumps(rule_of(loaded(wrapper.as_py())))
                if len(data) > ATTACHED:
                    name = f"rule-{task.taskAttemptId()}-{files}.json"
                    files += 1
                    fs, base = _at(folder)
                    fs.create_dir(base, recursive=True)
                    with fs.open_output_stream(f"{base}/{name}") as f:
                        f.write(data.encode())
                    data = json.dumps({"file": f"{folder}/{name}"})
                yield pa.RecordBatch.from_arrays([pa.array([host.as_py()]), pa.array([data])], ["of", "rule"])

    return run


def _rule(data: str) -> dict:
    rule = json.loads(data)
    if "file" in rule:
        fs, path = _at(rule["file"])
        with fs.open_input_stream(path) as f:
            rule = json.loads(f.read())
    return rule | {"steady": {tuple(x) for x in rule["template"]}}


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for source, rule in zip(column_texts(batch, "html"), taken(batch, "rule").to_pylist(), strict=True):
            if rule is not None and rule not in known:
                if len(known) >= HOSTS:
                    known.clear()
                known[rule] = _rule(rule)
            texts.append(extract(source, known.get(rule)))
        yield pa.RecordBatch.from_arrays([taken(batch, "page_id"), taken(batch, "url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars.

    The rules are a small stored table; Spark broadcasts it if its size allows,
    else it is joined by host, and the pages of a frequent host are split.
    """
    rules, _ = stored(wrappers(pages).mapInArrow(_rules(new_path(pages.sparkSession, "long-rules")), "of string, rule string"), "rules")
    rows = wanted(pages, page_id="bigint", url="string", html="string").withColumn("host", host_of("url"))
    both = rows.join(rules, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "rule")
    return both.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")


def op2_union_free_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
