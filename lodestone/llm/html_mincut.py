"""Main text of HTML pages by minimum-cut labelling.

Every block of text is a node.  A linear classifier on its tags, class names, links and length gives
the cost of calling it content or boilerplate: the capacities to the two terminals.  Blocks that follow
each other, and blocks under the same parent, are joined by smoothness edges whose capacity falls with
their distance in the document tree.  The minimum cut, found by maximum flow, is the labelling of least
total cost; the blocks on the source's side are the main text.

A tag or class name that speaks against an element holds for all inside it, unless the element wraps the
main text, as a page-wide form or a div of class sidebar-right does: see ``lift``.

Edge cases: null or empty html has no text; pages of any length are read whole, cut-off tags and
character references included; repeated rows are read each; an empty table gives an empty result; ids
and urls may be null; further columns are not read.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import map_arrow, parts, pick, texts
from lodestone.llm.html_blocks import HEADINGS, Block, Element, Hint, blocks

#: The classifier's weights, in tenths of a unit of cost; positive for content.
AGAINST, INSIDE, OUTSIDE, HEADER, INNER_HEADER, HEADING, LINKED, LENGTH, BIAS = -120, 60, -60, -120, -10, 10, -40, 8, -12
#: Capacity between neighbours one step apart in the tree, halved with each further step.
SMOOTH = 24
#: A wrapper holds so many times the text that stands as content without it: at least, and if it may be something else.
WRAPS, WRAPS_SURELY = 2, 10


def content_cost(block: Block, has_main: bool) -> int:
    """Cost of calling the block boilerplate, less that of calling it content."""
    score = BIAS + LENGTH * min(6.0, math.log2(1 + block.text.count(" ")))
    score += LINKED * block.linked / len(block.text) + HEADING * (block.tag in HEADINGS)
    if block.against:
        score += AGAINST
    if block.header:
        score += INNER_HEADER if block.inside else HEADER
    if has_main:
        score += INSIDE if block.inside else OUTSIDE
    return round(score)


def steps(a: Element, b: Element, most: int) -> int:
    """Distance in the tree between two places, or ``most`` if it is no less."""
    n = 0
    while a is not b and n < most:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Neighbours in page order, and each block with the one before it under the same parent."""
    joined, last = {}, {}
    for i, block in enumerate(found):
        for j in {i - 1, last.get(block.place.up, -1)} - {-1}:
            joined[j, i] = SMOOTH >> max(0, steps(found[j].place, block.place, 2 + SMOOTH.bit_length()) - 2)
        last[block.place.up] = i
    return [(j, i, w) for (j, i), w in joined.items() if w]


def settled(excess: list[int], near: list[dict[int, int]]) -> list[bool | None]:
    """Labels that no cut of least cost can better: a node's own cost outweighs all its edges, those of settled ones included.

    ``excess`` takes up the edges to settled nodes, and ``near`` loses them.
    """
    label: list[bool | None] = [None] * len(excess)
    room = [sum(edges.values()) for edges in near]
    queue = deque(range(len(excess)))
    while queue:
        i = queue.popleft()
        if label[i] is None and (excess[i] > room[i] or -excess[i] >= room[i]):
            label[i] = excess[i] > room[i]
            for j, w in near[i].items():
                del near[j][i]
                room[j] -= w
                excess[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    return label


def minimum_cut(excess: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source; of several cuts of least cost, the one with the fewest.

    ``excess`` is a node's capacity from the source less that to the sink.  Nodes that outweigh their edges are
    settled first; through the others, flow is sent in phases: each finds the distances to the sink in
    the residual graph, and then sends all that goes along shortest paths.
    """
    excess, residual = excess[:], [{} for _ in excess]
    for i, j, w in joined:
        residual[i][j] = residual[i].get(j, 0) + w
        residual[j][i] = residual[j].get(i, 0) + w
    label = settled(excess, residual)
    open_ = [i for i, x in enumerate(label) if x is None]
    while True:
        far = {i: 0 for i in open_ if excess[i] < 0}
        queue = deque(far)
        while queue:
            j = queue.popleft()
            for i in residual[j]:
                if i not in far and residual[i][j]:
                    far[i] = far[j] + 1
                    queue.append(i)
        sources = [i for i in open_ if excess[i] > 0 and i in far]
        if not sources:
            break
        ahead, at = {i: list(residual[i]) for i in far}, dict.fromkeys(far, 0)
        for source in sources:
            path = [source]
            while path and excess[source] > 0:
                i = path[-1]
                if excess[i] < 0:
                    flow = min(excess[source], -excess[i], *(residual[a][b] for a, b in pairwise(path)))
                    for a, b in pairwise(path):
                        residual[a][b] -= flow
                        residual[b][a] += flow
                    excess[source] -= flow
                    excess[i] += flow
                    path = [source]
                    continue
                while at[i] < len(ahead[i]) and not (residual[i][j := ahead[i][at[i]]] and far.get(j) == far[i] - 1):
                    at[i] += 1
                if at[i] < len(ahead[i]):
                    path.append(ahead[i][at[i]])
                else:
                    path.pop()
                    if path:
                        at[path[-1]] += 1
    reached = {i for i in open_ if excess[i] > 0}
    queue = deque(reached)
    while queue:
        i = queue.popleft()
        for j, w in residual[i].items():
            if w and j not in reached:
                reached.add(j)
                queue.append(j)
    return [i in reached if x is None else x for i, x in enumerate(label)]


def marked(found: list[Block]) -> bool:
    """Whether the page says where its main text is, outside of all that speaks against it."""
    return any(b.inside and not b.against for b in found)


def free_text(some: list[Block], has_main: bool) -> int:
    """Characters, but those of links, of the blocks that are content with nothing to speak against them."""
    return sum(len(b.text) - b.linked for b in some if not b.against and content_cost(b, has_main) > 0)


class _Held:
    """What an element that speaks against it holds: blocks of its own, elements like it inside, and sums over all of that."""

    def __init__(self, hint: Hint) -> None:
        self.hint, self.blocks, self.inner = hint, [], []
        self.text, self.article, self.main = 0, False, False

    def take(self, b: Block) -> None:
        if not b.hidden:
            self.blocks.append(b)
            self.text += len(b.text) - b.linked
            self.article |= b.article
            self.main |= b.inside or b.tag == "h1"

    def add(self, other: _Held) -> None:
        self.inner.append(other)
        self.text += other.text
        self.article |= other.article
        self.main |= other.main


def lift(found: list[Block]) -> None:
    """Take hints off the elements that wrap the main text, the one with most text first.

    A wrapper holds an article or main, or, if its tag or class is one of the layout's, other marks of
    main text, an h1 or more than half of the page's text; and it holds far more than what is content
    without it.
    """
    held: dict[Hint, _Held] = {}
    for b in found:
        above, hint = [], b.hint
        while hint is not None and hint not in held:
            above.append(hint)
            hint = hint.outer
        held |= {h: _Held(h) for h in reversed(above)}
        if b.hint is not None:
            held[b.hint].take(b)
    for h in reversed(held.values()):  # those inside come before those around them
        if h.hint.outer is not None:
            held[h.hint.outer].add(h)
    roots = [h for h in held.values() if h.hint.outer is None]
    half = sum(len(b.text) - b.linked for b in found) / 2
    has_main = marked(found)
    free = free_text(found, has_main)
    while True:

        def wraps(h: _Held) -> bool:
            wide = h.hint.wide
            if not h.article and not wide or not (h.article or h.main or h.text > half):
                return False
            return h.text > free * (WRAPS if wide and not has_main else WRAPS_SURELY)

        wrapper = max(filter(wraps, roots), key=lambda h: h.text, default=None)
        if wrapper is None:
            return
        wrapper.hint.lifted = True
        at = roots.index(wrapper)
        roots[at : at + 1] = wrapper.inner[::-1]
        if wrapper.blocks:
            before, has_main = has_main, has_main or marked(wrapper.blocks)
            free = free_text(found, has_main) if has_main != before else free + free_text(wrapper.blocks, has_main)


def main_text(page: str) -> str:
    found = blocks(page)
    lift(found)
    has_main = marked(found)
    kept = minimum_cut([content_cost(b, has_main) for b in found], edges(found))
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every page."""
    rows = pick(pages, page_id=page_id, url=url, html=html)
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = [main_text(page) for page in texts(batch, "html")]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return map_arrow(rows, run, schema)
