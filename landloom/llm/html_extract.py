"""HTML extraction by minimum-cut labelling.

A page is read once into blocks (runs of text between block-level tags) with their place in the element tree. A small
logistic classifier gives every block a probability of being main text; the two label costs, -log p and -log(1 - p),
become the capacities of its edges to the terminals. Neighbours in page order and blocks that stand near each other in
the tree are joined by smoothness edges, which weigh about as much as the classifier's opinion of a block without marks:
a short unmarked block goes with its neighbours, a marked one (-9) is beyond their reach. Maximum flow then gives the labelling of least total cost: the blocks still
reachable from the source are main text.

Defined results for odd input: null or blank html gives text "" and 0 characters; malformed markup is read leniently
(missing end tags, stray end tags, a tag cut off at the end, quotes never closed; an element without text content that is
never closed loses its tag alone, but an unclosed script or style runs to the page's end, and a head to its body); white space inside a block becomes one space and blocks
are joined by one line feed; repeated rows each get a row; extra columns are ignored. Nothing is cut off or capped.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One attribute: a name, and a value in quotes or bare (a quote inside a bare value, or one never closed, is a character).
_ATTRIBUTE = r"[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*))?"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(/?)([A-Za-z][^\s/>]*)((?:[\s/=]+|{_ATTRIBUTE})*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[A-Za-z][^<>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

#: Elements whose content is no text of the page. The first hold anything up to their end tag, or the page's.
RAW = set("script style".split())
DROP = set("noscript template svg iframe object head title select textarea button".split())
#: HTML's block-level elements, and those that hold no main text.
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
AWAY = set("nav footer aside form menu dialog fieldset".split())
HOME = set("article main".split())
#: Name parts of class, id and role that mark what is not the article.
AWAY_CUES = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer comment comments reply replies discussion disqus respond cookie cookies consent notice alert popup modal overlay share "
    "sharing social related recommended newsletter subscribe signup login search pagination pager toolbar masthead header widget".split()
)
HOME_CUES = set("article content post story main entry body text".split())

#: Weights of the classifier (logit of "main text").
WEIGHTS = {
    "bias": -0.5,
    "home": 4.0,
    "home_cue": 1.5,
    "away": -9.0,
    "away_cue": -9.0,
    "hidden": -9.0,
    "paragraph": 1.0,
    "heading": 0.5,
    "item": -0.5,
    "link_share": -4.0,
    "words": 0.5,
    "sentence": 0.5,
}
#: Smoothness: between neighbours in page order, and between near blocks of the tree (divided by their distance).
ADJACENT = 1.2
PROXIMITY = 1.2

_PARTS = re.compile(r"[^A-Za-z0-9]+")


def _cues(attributes: str, here: bool) -> tuple[bool, bool, bool]:
    """(away, home, hidden) by the attributes, read by name; a header's name says nothing within an article (``here``)."""
    away = home = hidden = False
    for m in _NAMED.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").strip().lower()
        if name in ("class", "id", "role"):
            parts = set(_PARTS.split(value))
            away |= not parts.isdisjoint(AWAY_CUES - {"header", "masthead"} if here else AWAY_CUES)
            home |= not parts.isdisjoint(HOME_CUES)
        hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and bool(_NO_DISPLAY.search(value)))
    return away, home, hidden


def blocks(page: str) -> list[tuple[str, float, int, int]]:
    """(text, logit, parent element number, depth) of the blocks in page order."""
    out: list[tuple[str, float, int, int]] = []
    # Stack entries: tag, element number, main area?, home cue?, outside?, hidden?
    stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", 0, False, False, False, False)]
    texts: list[str] = []
    linked: list[str] = []
    made, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal in_link
        text = " ".join(html.unescape("".join(texts)).split()) if texts else ""
        if text:
            tag, own, home, home_cue, away, hidden = stack[-1]
            parent = stack[-2][1] if len(stack) > 1 else 0
            share = min(1.0, len("".join(linked)) / max(1, len(text)))
            z = WEIGHTS["bias"] + WEIGHTS["link_share"] * share
            z += WEIGHTS["home"] * home + WEIGHTS["home_cue"] * home_cue + WEIGHTS["away"] * away + WEIGHTS["hidden"] * hidden
            z += WEIGHTS["paragraph"] * (tag in ("p", "blockquote", "pre")) + WEIGHTS["heading"] * (tag[:1] == "h" and tag[1:].isdigit())
            z += WEIGHTS["item"] * (tag == "li") + WEIGHTS["words"] * (text.count(" ") >= 9) + WEIGHTS["sentence"] * (text[-1] in ".!?…\"”")
            out.append((text, z, parent, len(stack)))
        texts.clear()
        linked.clear()

    unclosed: set[str] = set()
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            piece = page[at : m.start()]
            texts.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing, attributes = m.group(2).lower(), bool(m.group(1)), m.group(3)
        if tag in RAW or tag in DROP:
            if closing or attributes.endswith("/"):
                continue
            texts.append(" ")
            if tag not in unclosed:
                end = re.compile(rf"</{tag}\s*>|(?=<body\b)" if tag == "head" else rf"</{tag}\s*>", re.I).search(page, at)
                if end is not None:
                    at = end.end()
                else:
                    unclosed.add(tag)  # not looked for again: the cost stays in proportion to the page
            if tag in unclosed and tag in RAW:
                at = len(page)
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        in_link = False
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if stack[-1][0] == "p" or (tag == "li" and stack[-1][0] == "li"):
            stack.pop()
        _, _, home, home_cue, away, hidden = stack[-1]
        here = home or tag in HOME
        a, h, hid = _cues(attributes, here) if attributes else (False, False, False)
        made += 1
        stack.append((tag, made, here, home_cue or h, away or tag in AWAY or a or (tag == "header" and not here), hidden or hid))
    if at < len(page):
        texts.append(page[at:])
    flush()
    return out


class _Flow:
    """Maximum flow (Dinic) on a small graph with float capacities."""

    def __init__(self, n: int):
        self.heads: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []

    def edge(self, a: int, b: int, forward: float, back: float = 0.0) -> None:
        self.heads[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(forward)
        self.heads[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.heads)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in self.heads[a]:
                if self.cap[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Push all flow from s to t; True for the nodes still reachable from s."""
        while (level := self.levels(s))[t] >= 0:
            nxt = [0] * len(self.heads)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    push = min(self.cap[e] for e in path)
                    for k, e in enumerate(path):
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    k = next(k for k, e in enumerate(path) if self.cap[e] <= 1e-12)
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                edges = self.heads[a]
                while nxt[a] < len(edges):
                    e = edges[nxt[a]]
                    if self.cap[e] > 1e-12 and level[self.to[e]] == level[a] + 1:
                        break
                    nxt[a] += 1
                if nxt[a] < len(edges):
                    path.append(edges[nxt[a]])
                    a = self.to[path[-1]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break
        return [x >= 0 for x in level]


def label(found: list[tuple[str, float, int, int]], adjacent: float = ADJACENT, proximity: float = PROXIMITY) -> list[bool]:
    """Minimum-cut labels of blocks: True for main text."""
    n = len(found)
    flow = _Flow(n + 2)
    s, t = n, n + 1
    last: dict[int, int] = {}
    for k, (_, z, parent, depth) in enumerate(found):
        # -log(1 - p) is the cost of calling it boilerplate, -log p of calling it main text. What both have in common
        # flows straight through, so only the difference, which is the logit, is left to one of the terminals.
        if z > 0:
            flow.edge(s, k, z)
        else:
            flow.edge(k, t, -z)
        if k:
            flow.edge(k - 1, k, adjacent, adjacent)
        if parent in last:
            j = last[parent]
            w = proximity / (1 + abs(depth - found[j][3]) + math.log2(k - j))
            flow.edge(j, k, w, w)
        last[parent] = k
    return flow.source_side(s, t)[:n]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, keep in zip(found, label(found), strict=True) if keep) if found else ""


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars."""
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        _extract, "page_id bigint, url string, text string, n_chars bigint"
    )
