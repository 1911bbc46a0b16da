"""Algorithms over small in-memory scenes, for grouped pandas functions: graphs, assignment, boards."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterable, Sequence

Edge = Sequence[int]


def _neighbours(edges: Iterable[Edge], directed: bool = False) -> dict[int, set[int]]:
    out: dict[int, set[int]] = defaultdict(set)
    for a, b, *_ in edges:
        out[a].add(b)
        out[b] |= set() if directed else {a}
    return out


class Forest:
    """Disjoint sets with path halving."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_forest(edges: list[Edge]) -> tuple[int, int]:
    """(total weight, edges) of a minimum spanning forest of an undirected graph."""
    forest, weight, count = Forest(), 0, 0
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if forest.join(a, b):
            weight, count = weight + w, count + 1
    return int(weight), count


def component_sizes(edges: list[Edge]) -> tuple[int, int]:
    """(components, nodes of the largest)."""
    forest = Forest()
    for a, b, *_ in edges:
        forest.join(a, b)
    sizes: dict[int, int] = defaultdict(int)
    for node in list(forest.up):
        sizes[forest.find(node)] += 1
    return len(sizes), max(sizes.values(), default=0)


def cut_counts(edges: list[Edge]) -> tuple[int, int]:
    """(bridges, articulation points) of a simple undirected graph, by low points of a depth-first walk without recursion."""
    near = _neighbours(edges)
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    bridges, joints = 0, set()
    for root in near:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        children, stack = 0, [(root, None, iter(near[root]))]
        while stack:
            node, parent, rest = stack[-1]
            for nxt in rest:
                if nxt == parent:
                    continue
                if nxt in seen:
                    low[node] = min(low[node], seen[nxt])
                else:
                    seen[nxt] = low[nxt] = len(seen)
                    children += node == root
                    stack.append((nxt, node, iter(near[nxt])))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    bridges += low[node] > seen[parent]
                    if parent != root and low[node] >= seen[parent]:
                        joints.add(parent)
        if children > 1:
            joints.add(root)
    return bridges, len(joints)


def max_flow(edges: list[Edge], source: int, sink: int) -> int:
    """Largest flow in a directed graph; shortest augmenting paths."""
    room: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for a, b, capacity in edges:
        room[a][b] += int(capacity)
        room[b][a] += 0
    total = 0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            node = queue.popleft()
            for nxt, left in room[node].items():
                if left > 0 and nxt not in came:
                    came[nxt] = node
                    queue.append(nxt)
        if sink not in came:
            return total
        path, node = [], sink
        while node != source:
            path.append((came[node], node))
            node = came[node]
        push = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= push
            room[b][a] += push
        total += push


def strong_component_count(edges: list[Edge]) -> int:
    """Strongly connected components, by finishing order and the reversed graph."""
    ahead, back = _neighbours(edges, True), _neighbours([(b, a) for a, b, *_ in edges], True)
    nodes = {n for e in edges for n in e[:2]}
    order, seen = [], set()
    for root in nodes:
        stack = [(root, iter(ahead.get(root, ())))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            nxt = next((n for n in rest if n not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(ahead.get(nxt, ()))))
    count, done = 0, set()
    for root in reversed(order):
        if root in done:
            continue
        count += 1
        queue = [root]
        done.add(root)
        while queue:
            for n in back.get(queue.pop(), ()):
                if n not in done:
                    done.add(n)
                    queue.append(n)
    return count


def unique_topological_order(edges: list[Edge]) -> list[int] | None:
    """The order if it is the only one; None on a cycle or where two nodes could come next."""
    ahead = _neighbours(edges, True)
    waiting: dict[int, int] = defaultdict(int)
    for a, b in {(a, b) for a, b, *_ in edges}:
        waiting[a] += 0
        waiting[b] += 1
    ready, out = [n for n, k in waiting.items() if k == 0], []
    while ready:
        if len(ready) > 1:
            return None
        node = ready.pop()
        out.append(node)
        for nxt in ahead.get(node, ()):
            waiting[nxt] -= 1
            if waiting[nxt] == 0:
                ready.append(nxt)
    return out if len(out) == len(waiting) else None


def cheapest_paths(edges: list[Edge], start: int) -> list[tuple[int, int, int]]:
    """(node, cost, number of cheapest paths) in an undirected graph with positive weights."""
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, int(w)))
        near[b].append((a, int(w)))
    if start not in near:
        return []
    cost, ways, heap, done = {start: 0}, {start: 1}, [(0, start)], set()
    while heap:
        c, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        for nxt, w in near[node]:
            if nxt not in cost or c + w < cost[nxt]:
                cost[nxt], ways[nxt] = c + w, ways[node]
                heapq.heappush(heap, (c + w, nxt))
            elif c + w == cost[nxt]:
                ways[nxt] += ways[node]
    return [(n, cost[n], ways[n]) for n in sorted(cost)]


def assignment(gain: list[list[float]]) -> float:
    """Largest total of a one-to-one assignment of rows to columns, by shortest augmenting paths with potentials."""
    if not gain or not gain[0]:
        return 0.0
    if len(gain) > len(gain[0]):
        gain = [list(column) for column in zip(*gain, strict=True)]
    n, m = len(gain), len(gain[0])
    row_price, col_price, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        best, came, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[j]:
            used[j], row, step, to = True, owner[j], float("inf"), 0
            for c in range(1, m + 1):
                if not used[c]:
                    slack = -gain[row - 1][c - 1] - row_price[row] - col_price[c]
                    if slack < best[c]:
                        best[c], came[c] = slack, j
                    if best[c] < step:
                        step, to = best[c], c
            for c in range(m + 1):
                if used[c]:
                    row_price[owner[c]] += step
                    col_price[c] -= step
                else:
                    best[c] -= step
            j = to
        while j:
            owner[j], j = owner[came[j]], came[j]
    return sum(gain[owner[c] - 1][c - 1] for c in range(1, m + 1) if owner[c])
