"""Maximum-weight matching in general graphs, one connected component at a time.

Edmonds' primal-dual method (1965). The graph is a list of edges, as arrays; nothing grows with the square of the
nodes. Each step looks at all edges at once: it moves the duals as far as they go and uses one edge that has become
tight, or opens one blossom. Weights are scaled to integers, so that the duals stay exact.
"""

from __future__ import annotations

import numpy as np

#: Weights are multiples of 1 / SCALE.
SCALE = 1 << 20
#: Nodes that the exact search takes on, after the pairs that need no search. More of them, connected, are an error.
LARGEST = 20_000

_FREE, _EVEN, _ODD = 0, 1, 2


class _Search:
    """Nodes 0 to n - 1 are ends, later numbers blossoms: rings of an odd number of nodes, the first of which holds the
    ring's base, the end whose partner is outside. Even nodes are those at an even distance from the unmatched root of
    their tree."""

    def __init__(self, n: int, edges: list[tuple[int, int, int]]) -> None:
        self.n = n
        self.u, self.v, self.w = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.dual = np.full(n, self.w.max(), np.int64)  # of ends
        self.top = np.arange(n)  # outermost node of each end
        self.label = np.zeros(n, np.int8)  # of nodes
        self.partner: list[int | None] = [None] * n
        self.base = list(range(n))
        self.holder: list[int | None] = [None] * n  # the blossom around a node
        self.ends: list[np.ndarray] = [np.array([x]) for x in range(n)]
        self.entry: dict[int, tuple[int, int]] = {}  # odd node: the edge that it was reached by, from even to odd
        self.rings: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}  # blossom: nodes, edges from each to the next
        self.extra: dict[int, int] = {}  # dual of a blossom

    def turn(self, node: int, end: int) -> None:
        """Make ``end`` the base of a node: match the rest of its ring in pairs."""
        if self.base[node] == end:
            return
        nodes, links = self.rings[node]
        inner = end
        while self.holder[inner] != node:
            inner = self.holder[inner]
        at, size = nodes.index(inner), len(nodes)
        self.turn(inner, end)
        for k in range(1, size, 2):
            x, y = links[(at + k) % size]
            self.turn(nodes[(at + k) % size], x)
            self.turn(nodes[(at + k + 1) % size], y)
            self.partner[x], self.partner[y] = y, x
        self.rings[node] = nodes[at:] + nodes[:at], links[at:] + links[:at]
        self.base[node] = end

    def up(self, node: int) -> list[tuple[int, int, int]]:
        """The way from an even node to its root: (node, and the edge to it from the one before). The first has none."""
        way = [(node, -1, -1)]
        while (mate := self.partner[self.base[node]]) is not None:
            odd = int(self.top[mate])
            way.append((odd, self.base[node], mate))
            x, y = self.entry[odd]
            node = int(self.top[x])
            way.append((node, y, x))
        return way

    def flip(self, end: int, other: int) -> None:
        """Match an end of an even node with ``other`` outside, and along the way to the root what follows from it."""
        while True:
            node = int(self.top[end])
            mate = self.partner[self.base[node]]
            self.turn(node, end)
            self.partner[end] = other
            if mate is None:
                return
            odd = int(self.top[mate])
            x, y = self.entry[odd]
            self.turn(odd, y)
            self.partner[y] = x
            end, other = x, y

    def use(self, x: int, y: int) -> bool:
        """Use a tight edge from an even node; True if it made the matching larger."""
        a, b = int(self.top[x]), int(self.top[y])
        if self.label[b] == _FREE:
            self.label[b] = _ODD
            self.entry[b] = (x, y)
            self.label[self.top[self.partner[self.base[b]]]] = _EVEN
            return False
        left, right = self.up(a), self.up(b)
        if left[-1][0] != right[-1][0]:
            self.flip(x, y)
            self.flip(y, x)
            return True
        seen = {node: i for i, (node, _, _) in enumerate(left)}
        j = next(i for i, (node, _, _) in enumerate(right) if node in seen)
        self.close(left[: seen[right[j][0]] + 1], right[: j + 1], x, y)
        return False

    def close(self, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], x: int, y: int) -> None:
        """The ring of two ways that end in one node, over the edge x, y between their beginnings."""
        nodes = [node for node, _, _ in reversed(left)] + [node for node, _, _ in right[:-1]]
        links = [(there, here) for _, here, there in reversed(left[1:])] + [(x, y)] + [(here, there) for _, here, there in right[1:]]
        ring = len(self.base)
        self.rings[ring], self.extra[ring] = (nodes, links), 0
        self.base.append(self.base[nodes[0]])
        self.holder.append(None)
        self.ends.append(np.concatenate([self.ends[k] for k in nodes]))
        self.label = np.append(self.label, np.int8(_EVEN))
        for k in nodes:
            self.holder[k] = ring
        self.top[self.ends[ring]] = ring

    def open(self, ring: int) -> None:
        """Take an odd blossom apart. The nodes from where it was reached to its base stay in the tree."""
        nodes, links = self.rings.pop(ring)
        del self.extra[ring]
        for k in nodes:
            self.holder[k] = None
            self.top[self.ends[k]] = k
            self.label[k] = _FREE
        x, y = self.entry.pop(ring)
        size, at = len(nodes), nodes.index(int(self.top[y]))
        step = -1 if at % 2 == 0 else 1  # the way round of an even number of edges
        self.label[nodes[at]], self.entry[nodes[at]] = _ODD, (x, y)
        while at % size:
            even, odd = (at + step) % size, (at + 2 * step) % size
            here, there = links[even] if step == 1 else links[odd][::-1]
            self.label[nodes[even]], self.label[nodes[odd]] = _EVEN, _ODD
            self.entry[nodes[odd]] = (here, there)
            at = odd

    def grow(self) -> bool:
        """One more pair; False if no larger weight is possible."""
        self.label[:] = _FREE
        self.entry.clear()
        alone = [x for x in range(self.n) if self.partner[x] is None]
        self.label[self.top[alone]] = _EVEN
        while True:
            a, b = self.top[self.u], self.top[self.v]
            la, lb = self.label[a], self.label[b]
            slack = self.dual[self.u] + self.dual[self.v] - 2 * self.w
            reach = np.flatnonzero((np.maximum(la, lb) == _EVEN) & (np.minimum(la, lb) == _FREE))
            meet = np.flatnonzero((la == _EVEN) & (lb == _EVEN) & (a != b))
            even = self.label[self.top] == _EVEN
            step, event, what = int(self.dual[even].min(initial=np.iinfo(np.int64).max)), "end", -1
            if reach.size and (d := int(slack[k := reach[slack[reach].argmin()]])) < step:
                step, event, what = d, "edge", int(k)
            if meet.size and (d := int(slack[k := meet[slack[meet].argmin()]]) // 2) < step:
                step, event, what = d, "edge", int(k)
            outer = [r for r in self.rings if self.holder[r] is None]
            for r in outer:
                if self.label[r] == _ODD and self.extra[r] // 2 < step:
                    step, event, what = self.extra[r] // 2, "open", r
            if event == "end":
                return False
            self.dual[even] -= step
            self.dual[self.label[self.top] == _ODD] += step
            for r in outer:
                self.extra[r] += {_EVEN: 2 * step, _ODD: -2 * step}.get(int(self.label[r]), 0)
            if event == "open":
                self.open(what)
                continue
            x, y = int(self.u[what]), int(self.v[what])
            if self.use(*((x, y) if self.label[self.top[x]] == _EVEN else (y, x))):
                return True


def _settled(edges: dict[tuple[str, str], int]) -> tuple[list[tuple[str, str]], dict[tuple[str, str], int]]:
    """Pairs that some best matching has, and the edges left without their nodes: an edge that weighs at least as
    much as the next heaviest at both its nodes together can replace those in any matching."""
    pairs: list[tuple[str, str]] = []
    while True:
        near: dict[str, list[tuple[int, str]]] = {}
        for (u, v), w in edges.items():
            near.setdefault(u, []).append((w, v))
            near.setdefault(v, []).append((w, u))
        top = {x: sorted(ws, key=lambda e: (-e[0], e[1]))[:2] for x, ws in near.items()}
        rest = lambda x, y: next((w for w, z in top[x] if z != y), 0)  # noqa: B023, E731
        gone: set[str] = set()
        for (u, v), w in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
            if u not in gone and v not in gone and w >= rest(u, v) + rest(v, u):
                pairs.append((u, v))
                gone |= {u, v}
        if not gone:
            return pairs, edges
        edges = {k: w for k, w in edges.items() if not gone & set(k)}


def max_weight_matching(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """The pairs of a matching of greatest weight. Edges without a positive weight are never used, and of parallel
    edges the heaviest counts."""
    simple: dict[tuple[str, str], int] = {}
    for u, v, w in edges:
        if u != v and w > 0:
            key = (min(u, v), max(u, v))
            simple[key] = max(simple.get(key, 0), round(w * SCALE))
    out, left = _settled(simple)
    root: dict[str, str] = {x: x for key in left for x in key}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in left:
        root[find(u)] = find(v)
    parts: dict[str, list[tuple[str, str, int]]] = {}
    for (u, v), w in left.items():
        parts.setdefault(find(u), []).append((u, v, w))
    for part in parts.values():
        names = sorted({x for u, v, _ in part for x in (u, v)})
        if len(names) > LARGEST:
            raise ValueError(f"{len(names)} connected nodes are left to match, more than {LARGEST}")
        number = {x: i for i, x in enumerate(names)}
        search = _Search(len(names), sorted((number[u], number[v], w) for u, v, w in part))
        while search.grow():
            pass
        out += [(names[u], names[v]) for u, v in enumerate(search.partner) if v is not None and v > u]
    return sorted(out)
