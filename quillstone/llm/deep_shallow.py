"""Deep-shallow ordering of byte strings: multikey quicksort to a shallow depth, blind tries for what is left."""

from __future__ import annotations

SHALLOW = 16


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving over slices."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] is common, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Node:
    __slots__ = ("branches", "depth")

    def __init__(self, depth: int):
        self.depth, self.branches = depth, {}


class BlindTrie:
    """Branch bytes and depths only. A search compares branch bytes alone and ends at some leaf; one comparison with
    that leaf's string tells where the new string leaves its path. Key -1 is a string that ends at the node."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node, path = self.root, []
        while isinstance(node, _Node):
            path.append(node)
            byte = s[node.depth] if node.depth < len(s) else -1
            node = node.branches.get(byte) or next(iter(node.branches.values()))
        at = common(s, self.strings[node[0]])
        if at == len(s) == len(self.strings[node[0]]):
            node.append(i)
            return
        byte_of = lambda x: x[at] if at < len(x) else -1
        other = self.strings[node[0]]
        above = [p for p in path if p.depth < at]
        below = path[len(above)] if len(above) < len(path) else node
        if isinstance(below, _Node) and below.depth == at:
            below.branches[byte_of(s)] = [i]
            return
        new = _Node(at)
        new.branches = {byte_of(other): below, byte_of(s): [i]}
        if above:
            parent = above[-1]
            parent.branches[other[parent.depth] if parent.depth < len(other) else -1] = new
        else:
            self.root = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indices in order, and each one's common prefix with the one before (0 for the first)."""
        order, lcps, stack = [], [], [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, _Node):
                keys = sorted(node.branches)
                stack.extend((node.branches[k], node.depth if n else shared) for n, k in reversed(list(enumerate(keys))))
            else:
                order += node
                lcps += [shared, *[len(self.strings[node[0]])] * (len(node) - 1)]
        return order, lcps


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of ``strings`` and the common prefix of each with the one before."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= 1:
            order += group
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            order += trie.ordered()[0]
        else:
            byte = lambda i: strings[i][depth] if depth < len(strings[i]) else -1  # noqa: B023, E731
            pivot = byte(group[len(group) // 2])
            less, same, more = [], [], []
            for i in group:
                b = byte(i)
                (less if b < pivot else more if b > pivot else same).append(i)
            if pivot < 0:
                stack += [(more, depth), (same, SHALLOW), (less, depth)]
            else:
                stack += [(more, depth), (same, depth + 1), (less, depth)]
    return order, [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))][: len(order)]
