"""Adaptive radix trees over byte strings: nodes whose child tables grow from 4 to 16, 48 and 256 places, and paths without branches in one node."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class Few:
    """A sorted list of edge bytes beside the list of children; full at 4 or at 16."""

    __slots__ = ("edges", "nodes", "room")

    def __init__(self, room: int = 4):
        self.edges, self.nodes, self.room = bytearray(), [], room

    def get(self, edge: int) -> Node | None:
        at = self.edges.find(edge)
        return self.nodes[at] if at >= 0 else None

    def put(self, edge: int, node: Node) -> Few | Indexed:
        """The table that holds node under edge: this one or, if there was no room, a larger one."""
        at = self.edges.find(edge)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.edges) == self.room:
            wider = Few(16) if self.room == 4 else Indexed()
            for old, kept in zip(self.edges, self.nodes, strict=True):
                wider.put(old, kept)
            return wider.put(edge, node)
        at = sum(e < edge for e in self.edges)
        self.edges.insert(at, edge)
        self.nodes.insert(at, node)
        return self

    def __iter__(self) -> Iterator[Node]:
        return iter(self.nodes)


class Indexed:
    """256 one-byte places that point into up to 48 children."""

    __slots__ = ("nodes", "place")

    def __init__(self) -> None:
        self.place, self.nodes = bytearray(256), []

    def get(self, edge: int) -> Node | None:
        at = self.place[edge]
        return self.nodes[at - 1] if at else None

    def put(self, edge: int, node: Node) -> Indexed | Full:
        if self.place[edge]:
            self.nodes[self.place[edge] - 1] = node
            return self
        if len(self.nodes) == 48:
            full = Full()
            for old in range(256):
                if self.place[old]:
                    full.put(old, self.nodes[self.place[old] - 1])
            return full.put(edge, node)
        self.nodes.append(node)
        self.place[edge] = len(self.nodes)
        return self

    def __iter__(self) -> Iterator[Node]:
        return (self.nodes[at - 1] for at in self.place if at)


class Full:
    """A child for each of 256 bytes."""

    __slots__ = ("nodes",)

    def __init__(self) -> None:
        self.nodes: list[Node | None] = [None] * 256

    def get(self, edge: int) -> Node | None:
        return self.nodes[edge]

    def put(self, edge: int, node: Node) -> Full:
        self.nodes[edge] = node
        return self

    def __iter__(self) -> Iterator[Node]:
        return (x for x in self.nodes if x is not None)


class Node:
    """What all keys below share: the first upto bytes of the key numbered row. ends are the numbers of the keys that are no longer."""

    __slots__ = ("ends", "kids", "row", "upto")

    def __init__(self, row: int, upto: int):
        self.row, self.upto = row, upto
        self.kids: Few | Indexed | Full = Few()
        self.ends: list[int] = []


def shared_bytes(a: bytes, b: bytes, start: int, stop: int) -> int:
    """Up to where, at most stop, a and b agree, given that they do up to start; by halving."""
    stop = min(stop, len(a), len(b))
    if a[start:stop] == b[start:stop]:
        return stop
    low, high = start, stop - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[start:mid] == b[start:mid] else (low, mid - 1)
    return low


def build(keys: Sequence[bytes]) -> Node:
    """The tree of all keys, in whatever order they come; its root stands for the empty string."""
    root = Node(0, 0)
    for row, key in enumerate(keys):
        node, above, at = root, root, 0
        while True:
            same = shared_bytes(keys[node.row], key, at, node.upto)
            if same < node.upto:
                # the key leaves the node's path half-way: a node for what both share
                upper = Node(node.row, same)
                upper.kids = upper.kids.put(keys[node.row][same], node)
                above.kids = above.kids.put(key[above.upto], upper)
                node = upper
            if len(key) == node.upto:
                node.ends.append(row)
                break
            below = node.kids.get(key[node.upto])
            if below is None:
                leaf = Node(row, len(key))
                leaf.ends.append(row)
                node.kids = node.kids.put(key[node.upto], leaf)
                break
            above, node, at = node, below, node.upto
    return root
