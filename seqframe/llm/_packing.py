"""Best-fit-decreasing packing over a balanced search tree of remaining capacities."""

from __future__ import annotations

from collections.abc import Sequence


class Tree:
    """AVL tree of (remaining, bin) pairs: insert, remove, and the smallest pair not below a key."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None  # a node is [key, left, right, height]

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _fix(self, node):
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if lean > 1:
            if self._height(node[1][1]) < self._height(node[1][2]):
                node[1] = self._turn(node[1], 1, 2)
            return self._turn(node, 2, 1)
        if lean < -1:
            if self._height(node[2][2]) < self._height(node[2][1]):
                node[2] = self._turn(node[2], 2, 1)
            return self._turn(node, 1, 2)
        return node

    def _turn(self, node, to: int, of: int):
        up = node[of]
        node[of], up[to] = up[to], node
        for x in (node, up):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return up

    def insert(self, key) -> None:
        def put(node):
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._fix(node)

        self.root = put(self.root)

    def remove(self, key) -> None:
        def least(node):
            return least(node[1]) if node[1] else node[0]

        def cut(node, key):
            if key == node[0]:
                if node[1] is None or node[2] is None:
                    return node[1] or node[2]
                node[0] = least(node[2])
                node[2] = cut(node[2], node[0])
            else:
                side = 1 if key < node[0] else 2
                node[side] = cut(node[side], key)
            return self._fix(node)

        self.root = cut(self.root, key)

    def ceiling(self, key):
        node, best = self.root, None
        while node:
            if node[0] >= key:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each item and the number of bins; an item above ``capacity`` gets a bin of its own.

    Items enter by falling size (ties: in order), each into the bin with the least room that holds it.
    """
    tree, bins = Tree(), 0
    where = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.ceiling((sizes[i], -1))
        if room is None:
            room = (max(capacity, sizes[i]), bins)
            bins += 1
        else:
            tree.remove(room)
        where[i] = room[1]
        tree.insert((room[0] - sizes[i], room[1]))
    return where, bins


def even_bins(sizes: Sequence[int], bins: int) -> list[int]:
    """Spread items over exactly ``bins`` bins of near equal sums.

    Items above the mean of what is left take bins of their own; the rest is packed best-fit
    decreasing into the smallest capacity for which the other bins suffice.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    where, left, total = [0] * len(sizes), bins, sum(sizes)
    while order and left > 1 and sizes[order[0]] * left > total:
        left -= 1
        where[order[0]] = left
        total -= sizes[order.pop(0)]
    rest = [sizes[i] for i in order]
    low, high = max([-(-total // left), *rest[:1]]), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        if best_fit_decreasing(rest, mid)[1] <= left:
            high = mid
        else:
            low = mid + 1
    for i, b in zip(order, best_fit_decreasing(rest, low)[0]):
        where[i] = b
    return where
