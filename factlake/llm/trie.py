"""A path-compressed trie of globally ordered sets, searched for sets of a given Jaccard similarity."""

from __future__ import annotations

import numpy as np


class Node:
    __slots__ = ("children", "edge", "items", "least", "most")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.items = edge, {}, []
        #: Smallest and largest set below.
        self.least, self.most = 1 << 62, 0


class PrefixTrie:
    """Sets are sorted arrays of unsigned integers; the sort order is the global order.

    ``group`` gives the component of an item: subtrees whose items all are in the searcher's
    component already are not searched again.
    """

    def __init__(self, percent: int, find):
        self.root, self.percent, self.find = Node(np.zeros(0, np.uint64)), percent, find

    def needed(self, a: int, b: int) -> int:
        """Smallest overlap with 100 * overlap >= percent * union for sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def insert(self, item: int, tokens: np.ndarray) -> None:
        node, at, size = self.root, 0, len(tokens)
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if at == size:
                node.items.append(item)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                leaf = Node(tokens[at:])
                leaf.least = leaf.most = size
                leaf.items.append(item)
                node.children[int(tokens[at])] = leaf
                return
            n = min(len(child.edge), size - at)
            differ = np.flatnonzero(child.edge[:n] != tokens[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.edge):
                upper = Node(child.edge[:same])
                upper.least, upper.most = child.least, child.most
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                node.children[int(tokens[at])] = upper
                child = upper
            node, at = child, at + same

    def search(self, item: int, tokens: np.ndarray):
        """Items similar to the set, each with its overlap; those of the item's own component are passed over."""
        n, percent = len(tokens), self.percent
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            edge = node.edge
            if len(edge):
                at = np.searchsorted(tokens, edge)
                at[at == n] = n - 1
                hits = int((tokens[at] == edge).sum())
                depth, overlap = depth + len(edge), overlap + hits
                rest = n - int(np.searchsorted(tokens, edge[-1], "right"))
            else:
                rest = n
            # Only sets between percent and 1 / percent of this size can match.
            if node.most * 100 < percent * n or percent * node.least > 100 * n:
                continue
            least = max(node.least, -(-percent * n // 100))
            if overlap + min(rest, node.most - depth) < self.needed(n, least):
                continue
            for other in node.items:
                if overlap >= self.needed(n, depth) and self.find(other) != self.find(item):
                    yield other, overlap
            stack.extend((c, depth, overlap) for c in node.children.values())


class Components:
    """Union-find over 0 .. n-1 in which the smallest member leads."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def linked(sets: list[np.ndarray], percent: int, comp: Components | None = None) -> list[tuple[int, int]]:
    """Links that connect just what the similar pairs among the sets connect, by one trie for all.

    comp: components known before; they grow by the links, which join no two sets of one component.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i].tobytes()[:64], i))
    comp = comp or Components(len(sets))
    trie, links = PrefixTrie(percent, comp.find), []
    for i in order:
        if not len(sets[i]):
            continue
        for j, _ in trie.search(i, sets[i]):
            links.append((i, j))
            comp.join(i, j)
        trie.insert(i, sets[i])
    return links
