"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks, which are nodes of a graph. A classifier trained
here reads each block's text (length, links, sentences, capitals; nothing of
what the markup says about its role) and gives its costs for either label, which
are terminal capacities of the size of the edges. Smoothness edges tie blocks
that follow each other and blocks of one parent. What elements say of themselves
stands in the DOM above the blocks: an article, a menu or a block of adverts is
a node with a cost of its own, without bound where the element leaves no doubt,
and each block is tied to the two nearest such nodes. A maximum flow finds the
cheapest split into content and boilerplate; ``decide`` also says how many
blocks it gives another label than their text alone.

The classifier is a logistic regression, fitted to a bounded sample of pages:
blocks whose nearest telling element is an article count as content, those in
menus, footers and the like as boilerplate. It is held near its prior weights,
which stand alone where the sample teaches nothing.

Defined results: a null or empty page, or one without text, gives the empty
text; broken markup is read leniently, in time that grows with the page's length
only, however long it is; repeated pages give repeated results; an empty table
gives an empty result; extra columns are carried along, whatever their names,
and those named like the added ones are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import hash_sample, slices

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_TOKEN = re.compile(r"[a-z]+")
_NONE = re.compile(r"display\s*:\s*none")
_ENDS = re.compile(r"[.!?](?:\s|$)")
#: Element names by how they are read. Fixed values of the HTML standard.
_RAW = frozenset("script style noscript template iframe svg math canvas object select textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes when it stands directly in it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements and roles that never hold the article.
_OUTER = frozenset("nav footer aside menu dialog search button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
#: Words that say the same anywhere in a class or id, and such as say it as its whole or last word and hint at it elsewhere.
_BAD = frozenset("advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus navbar newsletter pagination respond sidebar sponsored".split())
_MAYBE = frozenset("ad ads banner footer masthead menu nav navigation notice notices popup promo related reply replies share sharing social sponsor subscribe toolbar widget".split())
_GOOD = frozenset("article main content".split())
#: First words of a class that make it speak of something else than the element's role.
_ABOUT = frozenset("no not non has have with without is hide show category tag topic type format single page status".split())
_FEATURES = ("bias", "log_chars", "link_share", "stops", "commas", "upper", "heading", "list_item")
#: Prior weights of the classifier, positive for content; the odds that a text can give at most, either way.
_PRIOR, CERTAIN = np.array([-1.5, 0.35, -3.0, 0.6, 0.3, -2.0, 0.5, -0.3]), 2.5
#: Capacities: between neighbours and between neighbours of one parent, across elements that tell and to the nearest and the next of those.
ADJACENT, SIBLING, ACROSS, TIES = 0.6, 0.9, 0.1, (4.0, 1.0)
#: What telling elements cost against their kind: without doubt, by a hint, a form that may hold the whole page.
SURE, HINT, FORM = np.inf, 1.0, 3.0
#: Pages that the classifier is fitted to at most and the characters of the longest, and how strongly it is held near its prior.
SAMPLE, LONGEST, HOLD = 300, 200_000, 5.0


@dataclass(frozen=True)
class Mark:
    """A telling element: its number and cost, positive for content."""

    number: int
    cost: float


@dataclass
class Block:
    text: str
    parent: int
    x: list[float]
    marks: tuple[Mark, ...]  # the nearest telling elements above, nearest first

    @property
    def weak(self) -> int | None:
        """What the markup says: 1 content, 0 boilerplate."""
        return int(self.marks[0].cost > 0) if self.marks and np.isinf(self.marks[0].cost) else None


@dataclass
class _Node:
    name: str
    number: int
    box: int  # depth of the nearest block element, itself included
    marks: tuple[Mark, ...] = ()
    article: bool = False
    outside: bool = False  # in an element that never holds the article
    hidden: bool = False


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


class _Tags:
    """Finds the ends of tags; every stretch of the page is looked at a few times at most."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.stop = (0, -1)  # from where and to where no character matters
        self.dead: set[int] = set()  # quotes from which on no tag ends
        self.gone: dict[str, int] = {}  # from where on a quote stands no more

    def _stop(self, i: int) -> int:
        if not self.stop[0] <= i <= self.stop[1]:
            m = _STOP.search(self.page, i)
            self.stop = (i, m.start() if m else len(self.page))
        return self.stop[1]

    def end(self, i: int) -> int:
        """The place behind the tag whose attributes start at ``i``; a tag whose quotes don't close ends at the next >. -1 if there is none."""
        if i > self.last:
            return -1
        start, seen = i, []
        while (at := self._stop(i)) <= self.last and at not in self.dead:
            c = self.page[at]
            if c == ">":
                return at + 1
            seen.append(at)
            close = -1 if at >= self.gone.get(c, len(self.page)) else self.page.find(c, at + 1)
            if close < 0:
                self.gone[c] = min(at, self.gone.get(c, at))
                break
            i = close + 1
        self.dead.update(seen)
        return self.page.find(">", start) + 1 or -1


def _evidence(name: str, attributes: dict[str, str], up: _Node) -> float:
    """The cost of an element by its name, role, class and id; 0 if it says nothing."""
    if name in ("html", "body"):
        return 0.0
    names = [c for key in ("class", "id") for c in attributes.get(key, "").lower().split()]
    whole = {c for c in names if c in _BAD or c in _MAYBE}
    role = attributes.get("role", "").lower()
    if name in _OUTER or role in _ROLES or whole:
        return -SURE
    if name == "header":
        return 0.0 if up.article else -SURE
    if name in ("article", "main") or role in ("main", "article"):
        return 0.0 if up.outside else SURE
    hint = 0.0
    for words in filter(None, (_TOKEN.findall(c) for c in [*names, attributes.get("aria-label", "").lower()])):
        if words[0] in _ABOUT:
            continue
        if not _BAD.isdisjoint(words) or words[-1] in _MAYBE:
            return -SURE
        if not _MAYBE.isdisjoint(words):
            hint = -HINT
    if name == "form":
        return -SURE if up.article else -FORM
    if not hint and name in ("div", "section") and not up.outside and any(c in _GOOD for c in names):
        return SURE
    return hint


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in page order, without scripts, styles, hidden and other raw elements."""
    root = _Node("", 0, 0)
    stack, made, found, held, depth = [root], 1, [], _Open(), Counter()
    tags, at = _Tags(page), 0

    def text(a: int, b: int) -> None:
        if a < b:
            part = page[a:b]
            held.parts.append(part)
            if depth["a"]:
                held.linked += len(part)

    def pop(to: int) -> None:
        for n in stack[to:]:
            depth[n.name] -= 1
        del stack[to:]

    def flush() -> None:
        nonlocal held
        said = " ".join(entities.unescape("".join(held.parts)).split()) if held.parts else ""
        top = stack[-1]
        if said and not top.hidden:
            box = stack[top.box]
            x = [
                1.0,
                float(np.log1p(len(said))),
                min(1.0, held.linked / max(1, sum(map(len, held.parts)))),
                min(3.0, len(_ENDS.findall(said)) / 2),
                min(3.0, said.count(",") / 2),
                sum(map(str.isupper, said)) / len(said),
                float(len(box.name) == 2 and box.name[0] == "h" and box.name[1].isdigit()),
                float(box.name == "li"),
            ]
            above = stack[stack[top.box - 1].box].number if top.box else 0
            found.append(Block(said, above, x, top.marks))
        held = _Open()

    while (start := page.find("<", at)) >= 0:
        text(at, start)
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            if page[start + 1 : start + 2] in ("!", "?") and (end := page.find(">", start)) >= 0:
                at = end + 1
            else:
                text(start, start + 1)
                at = start + 1
            continue
        end = tags.end(m.end())
        if end < 0:
            text(start, len(page))
            at = len(page)
            break
        at, name, said = end, m[1].lower(), page[m.end() : end - 1]
        if page[start + 1] == "/":
            if name in _BLOCK:
                flush()
            if depth[name]:
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name == "br":
            held.parts.append(" ")
        if name in _RAW and not said.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            behind = page.find(">", close.end()) if close else -1
            at = behind + 1 if behind >= 0 else len(page)
            held.parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
            if name not in ("html", "body"):
                inner = stack[-1].box
                if inner and (stack[inner].name == "p" or stack[inner].name in _CLOSES.get(name, ())):
                    pop(inner)
        if name in _VOID:
            continue
        up = stack[-1]
        attributes = {}
        for a in _ATTRIBUTE.finditer(said) if said.strip() else ():
            attributes.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        cost = _evidence(name, attributes, up) if attributes or name in _BLOCK or name == "button" else 0.0
        node = _Node(name, made, len(stack) if name in _BLOCK else up.box, up.marks, up.article, up.outside, up.hidden)
        made += 1
        if cost:
            node.marks = (Mark(node.number, cost), *up.marks)[: len(TIES)]
            node.article = cost > 0 or up.article and cost > -SURE
            node.outside = up.outside or cost == -SURE and name != "header"
        hides = attributes.get("hidden", "until-found").lower() != "until-found" or attributes.get("aria-hidden", "").lower() == "true"
        node.hidden = up.hidden or hides or bool(_NONE.search(attributes.get("style", "").lower()))
        depth[name] += 1
        stack.append(node)
    text(at, len(page))
    flush()
    return found


def max_flow_cut(source: np.ndarray, sink: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the nodes on the source side of a minimum cut; blocking flows over layers of shortest paths."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i in range(n):
        if source[i] > 0:
            tie(s, i, float(source[i]), 0.0)
        if sink[i] > 0:
            tie(i, t, float(sink[i]), 0.0)
    for a, b, c in edges:
        tie(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for k in arcs[u]:
                if room[k] > 1e-9 and level[to[k]] < 0:
                    level[to[k]] = level[u] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return np.array([level[i] >= 0 for i in range(n)], bool)
        tried, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                least = min(room[k] for k in path)
                for k in path:
                    room[k] -= least
                    room[k ^ 1] += least
                cut = next(i for i, k in enumerate(path) if room[k] <= 1e-9)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[u] < len(arcs[u]):
                k = arcs[u][tried[u]]
                if room[k] > 1e-9 and level[to[k]] == level[u] + 1:
                    break
                tried[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(k)
            u = to[k]


def odds_of(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """What the blocks' texts alone say, positive for content."""
    return np.clip(np.array([b.x for b in blocks]) @ weights, -CERTAIN, CERTAIN) if blocks else np.zeros(0)


def label(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """True for content blocks: the minimum cut of the page's graph.

    A node whose own cost outweighs all its edges (a telling element without doubt does) has that label in every
    minimum cut and joins the terminals of its neighbours; the flow runs over each connected group of the other nodes.
    """
    if not blocks:
        return np.zeros(0, bool)
    odds = list(odds_of(blocks, weights))
    edges, last, telling = [], {}, {}
    for i, b in enumerate(blocks):
        nearest = b.marks[:1]
        if i:
            edges.append((i - 1, i, ADJACENT if blocks[i - 1].marks[:1] == nearest else ACROSS))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING if blocks[last[b.parent]].marks[:1] == nearest else ACROSS))
        last[b.parent] = i
        for mark, tie in zip(b.marks, TIES):
            if mark.number not in telling:
                telling[mark.number] = len(odds)
                odds.append(mark.cost)
            edges.append((telling[mark.number], i, tie))
    cost = np.array(odds)
    weight = np.zeros(len(cost))
    near: list[list[tuple[int, float]]] = [[] for _ in cost]
    for a, b, c in edges:
        weight[a] += c
        weight[b] += c
        near[a].append((b, c))
        near[b].append((a, c))
    sure, side = np.abs(cost) > weight, cost > 0
    done = sure.copy()
    for first in np.flatnonzero(~sure):
        if done[first]:
            continue
        group, place = [int(first)], {int(first): 0}
        done[first] = True
        for i in group:  # grows while it is walked
            for k, _ in near[i]:
                if not done[k]:
                    done[k] = True
                    place[k] = len(group)
                    group.append(k)
        source, sink, inner = np.maximum(cost[group], 0), np.maximum(-cost[group], 0), []
        for i in group:
            for k, c in near[i]:
                if k in place:
                    if i < k:
                        inner.append((place[i], place[k], c))
                elif side[k]:
                    source[place[i]] += c
                else:
                    sink[place[i]] += c
        side[group] = max_flow_cut(source, sink, inner)
    return side[: len(blocks)]


def fit(pages: list[str], rounds: int = 60) -> np.ndarray:
    """Weights of the block classifier from pages with telling markup, held near the prior."""
    found = [(b.x, b.weak) for p in pages for b in blocks_of(p or "") if b.weak is not None]
    if not found:
        return _PRIOR.copy()
    x, y = np.array([f[0] for f in found]), np.array([f[1] for f in found], float)
    w = _PRIOR.copy()
    for _ in range(rounds):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w)), x.T @ (y - p) + HOLD * (_PRIOR - w))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def decide(page: str | None, weights: np.ndarray) -> tuple[str, int, int]:
    """The main text, the number of blocks, and how many of them the cut labels otherwise than their texts alone."""
    blocks = blocks_of(page or "")
    kept = label(blocks, weights)
    return "\n\n".join(b.text for b, k in zip(blocks, kept) if k), len(blocks), int((kept != (odds_of(blocks, weights) > 0)).sum())


def extract(page: str | None, weights: np.ndarray) -> str:
    return decide(page, weights)[0]


ADDED = ("text", "n_chars", "n_blocks", "n_turned")


def extract_main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """The columns ``keep`` of ``pages`` with ``text``, the main text, ``n_chars``, its code points, ``n_blocks`` and ``n_turned``, see ``decide``.

    The classifier's sample are the ``sample`` pages of at most ``longest`` characters whose hash is smallest; every page is extracted, whatever its length.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ADDED]
    chosen = hash_sample(pages.select(F.col(html).cast("string").alias("h")).where(F.length("h").between(1, longest)), "h", sample)
    weights = fit([r[0] for r in chosen.collect()])

    def run(batches):
        for part in slices(batches, "html"):
            got = [decide(p, weights) for p in part.column("html").to_pylist()]
            added = [pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.record_batch([part.column("row"), *added], ["row", *ADDED])

    # the kept columns stand in a struct, so that no name of theirs meets another
    row = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    read = pages.select(row.alias("row"), F.col(html).cast("string").alias("html"))
    out = read.mapInArrow(run, f"row {read.schema['row'].dataType.simpleString()}, text string, n_chars long, n_blocks long, n_turned long")
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), *ADDED)
