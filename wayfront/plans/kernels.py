"""Searches on one network held by one task: plain Python, no Spark.

A network is a dict from node to its outgoing (node, costs) pairs.  Costs are
non-negative integers.  Ties are settled by the whole cost vector and then by the path,
so results don't depend on the order of edges.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Callable, Iterable
from operator import add

import numpy as np

Vector = tuple[int, ...]
Edges = dict[int, list[tuple[int, Vector]]]


class Network(defaultdict):
    """Outgoing edges of each node, and what searches for one target share: kept until another target is asked for."""

    def __init__(self) -> None:
        super().__init__(list)
        self._back: Edges | None = None
        self._to_go: tuple[tuple, list[dict[int, int]]] | None = None
        #: A target and what a search has found for it.
        self.kept: tuple = (None, None)

    @property
    def back(self) -> Edges:
        """The edges turned round."""
        if self._back is None:
            self._back = network((dst, src, c) for src, own in self.items() for dst, c in own)
        return self._back

    def to_go(self, target: int, m: int) -> list[dict[int, int]]:
        """Least sums of each of the first m costs from every node to the target."""
        if self._to_go is None or self._to_go[0] != (target, m):
            self._to_go = (target, m), [distances(self.back, target, k) for k in range(m)]
        return self._to_go[1]


def network(rows: Iterable[tuple[int, int, Vector]]) -> Network:
    out = Network()
    for src, dst, c in rows:
        out[src].append((dst, c))
    return out


def shortest(net: Edges, source: int, key: Callable[[Vector], tuple], target: int | None = None) -> dict[int, tuple[tuple, Vector, tuple[int, ...]]]:
    """Least (key, vector, path) to every node that is reached, or to those no farther than ``target``.

    ``key`` maps an edge's costs to a tuple that is summed by component.
    """
    first: Vector | None = next((c for own in net.values() for _, c in own), None)
    zero = tuple(0 for _ in first) if first else ()
    start = (tuple(0 for _ in key(zero)) if first else (), zero, (source,))
    done: dict[int, tuple[tuple, Vector, tuple[int, ...]]] = {}
    best: dict[int, tuple] = {}
    heap = [start]
    while heap:
        label = heapq.heappop(heap)
        least, vector, path = label
        node = path[-1]
        if node in done:
            continue
        done[node] = label
        if node == target:
            break
        for other, c in net.get(node, ()):
            if other not in done:
                new = (tuple(map(add, least, key(c))), tuple(map(add, vector, c)), (*path, other))
                if other not in best or new < best[other]:
                    best[other] = new
                    heapq.heappush(heap, new)
    return done


def shortest_each(net: Edges, source: int, target: int, weights: np.ndarray) -> set[tuple[Vector, tuple[int, ...]]]:
    """Vectors and paths that ``shortest`` finds for the sums of each row of ``weights`` (whole, not negative), for all rows at once.

    Labels are corrected until none changes.  A node's labels are kept once, and each row
    has its sum there and which label it is; equal sums are settled by vector and path.
    """
    order = list(hops(net, source))
    if target not in order:
        return set()
    most = int(weights.max(initial=0)) * sum(max(c) for node in order for _, c in net.get(node, ())) * len(weights[0])
    weights = np.ascontiguousarray(weights.T, np.int64 if most < 1 << 62 else object)
    n = weights.shape[1]
    first: Vector | None = next((c for own in net.values() for _, c in own), None)
    labels: dict[int, list[tuple[Vector, tuple[int, ...]]]] = {source: [(tuple(0 for _ in first or ()), (source,))]}
    sums = {source: np.zeros(n, weights.dtype)}
    which = {source: np.zeros(n, np.int64)}
    place = {node: k for k, node in enumerate(order)}
    waiting, queued = [0], {0}
    while waiting:
        k = heapq.heappop(waiting)
        queued.discard(k)
        node = order[k]
        if node == target:
            continue
        used = np.unique(which[node]).tolist()
        for other, c in net.get(node, ()):
            added = sum(w * x for w, x in zip(weights, c, strict=False) if x)
            new = sums[node] + added
            old = sums.get(other)
            more = {i: (tuple(map(add, labels[node][i][0], c)), (*labels[node][i][1], other)) for i in used}
            if old is None:
                better = np.ones(n, bool)
                labels[other], which[other] = [], np.full(n, -1)
            else:
                better = new < old
                same = np.flatnonzero(new == old)
                pairs = which[node][same] * len(labels[other]) + which[other][same]
                for pair in np.unique(pairs).tolist():
                    i, j = divmod(pair, len(labels[other]))
                    if more[i] < labels[other][j]:
                        better[same[pairs == pair]] = True
            if not better.any():
                continue
            number = np.full(len(labels[node]), -1)
            known = {label: j for j, label in enumerate(labels[other])}
            for i in np.unique(which[node][better]).tolist():
                number[i] = known.setdefault(more[i], len(known))
            labels[other] = list(known)
            which[other] = np.where(better, number[which[node]], which[other])
            sums[other] = new if old is None else np.where(better, new, old)
            if place[other] not in queued:
                queued.add(place[other])
                heapq.heappush(waiting, place[other])
    return {labels[target][j] for j in np.unique(which[target]).tolist()}


def tree(net: Edges, source: int, k: int, target: int | None = None) -> tuple[dict[int, int], dict[int, int]]:
    """Least sums of the k-th cost (0-based), and the node before each on such a path: the least one of equals.

    With a ``target`` the search ends where the target leaves the queue.
    """
    dist, before, done = {source: 0}, {}, set()
    heap = [(0, source)]
    while heap:
        d, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if node == target:
            break
        for other, c in net.get(node, ()):
            new = d + c[k]
            if other not in done and ((old := dist.get(other)) is None or new < old or new == old and node < before[other]):
                if new != old:
                    heapq.heappush(heap, (new, other))
                dist[other], before[other] = new, node
    return {n: dist[n] for n in done}, {n: before[n] for n in done if n in before}


def walk(before: dict[int, int], end: int) -> list[int]:
    """Nodes from ``end`` back to where ``before`` begins."""
    out = [end]
    while out[-1] in before:
        out.append(before[out[-1]])
    return out


def both_ways(net: Network, source: int, target: int, k: int) -> tuple[list[int], int, int] | None:
    """Path, least sum of the k-th cost and meeting node, by searches from both ends that take turns by distance.

    They end when the two queues' least distances add up to no less than the best meeting.
    """
    sides = (net, net.back)
    dist, before, done = ({source: 0}, {target: 0}), ({}, {}), (set(), set())
    heaps = [[(0, source)], [(0, target)]]
    best = (0, source) if source == target else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] < best[0]):
        s = 0 if heaps[0][0] <= heaps[1][0] else 1
        d, node = heapq.heappop(heaps[s])
        if node in done[s]:
            continue
        done[s].add(node)
        for other, c in sides[s].get(node, ()):
            new = d + c[k]
            if new < dist[s].get(other, new + 1):
                dist[s][other], before[s][other] = new, node
                heapq.heappush(heaps[s], (new, other))
            if other in dist[1 - s] and other in dist[s]:
                met = (dist[s][other] + dist[1 - s][other], other)
                best = met if best is None else min(best, met)
    if best is None:
        return None
    cost, meet = best
    return walk(before[0], meet)[::-1] + walk(before[1], meet)[1:], cost, meet


def hops_both_ways(net: Network, source: int, target: int) -> tuple[list[int], int] | None:
    """Path and fewest edges, by levels from both ends, the smaller one first; of equal meetings the least node."""
    sides = (net, net.back)
    far, before = ({source: 0}, {target: 0}), ({}, {})
    level = [[source], [target]]
    while level[0] and level[1]:
        met = [(far[0][n] + far[1][n], n) for n in (far[0] if len(far[0]) < len(far[1]) else far[1]) if n in far[0] and n in far[1]]
        if met:
            n_edges, meet = min(met)
            return walk(before[0], meet)[::-1] + walk(before[1], meet)[1:], n_edges
        s = 0 if len(level[0]) <= len(level[1]) else 1
        ahead = []
        for node in sorted(level[s]):
            for other, _ in sides[s].get(node, ()):
                if other not in far[s]:
                    far[s][other], before[s][other] = far[s][node] + 1, node
                    ahead.append(other)
        level[s] = ahead
    return None


def reverse_tree(net: Network, target: int, key: Callable[[Vector], int], m: int = 3) -> tuple[dict[int, tuple], dict[int, int]]:
    """(least sum of ``key``, first m costs) from each node to the target, and the next node on the way.

    Ties of sums go to the least vector, then to the least next node.
    """
    best = {target: (0, *(0,) * m)}
    after: dict[int, int] = {}
    done: set[int] = set()
    heap = [(best[target], target)]
    while heap:
        label, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        for other, c in net.back.get(node, ()):
            new = (label[0] + key(c), *map(add, label[1:], c[:m]))
            if other not in done and (other not in best or new < best[other] or new == best[other] and node < after[other]):
                if new != best.get(other):
                    heapq.heappush(heap, (new, other))
                best[other], after[other] = new, node
    return best, after


def distances(net: Edges, source: int, k: int) -> dict[int, int]:
    """Least sum of the k-th cost (0-based) to every node that is reached."""
    done: dict[int, int] = {}
    heap = [(0, source)]
    while heap:
        d, node = heapq.heappop(heap)
        if node not in done:
            done[node] = d
            for other, c in net.get(node, ()):
                if other not in done:
                    heapq.heappush(heap, (d + c[k], other))
    return done


def hops(net: Edges, source: int) -> dict[int, int]:
    """Fewest edges to every node that is reached."""
    done, queue = {source: 0}, deque([source])
    while queue:
        node = queue.popleft()
        for other, _ in net.get(node, ()):
            if other not in done:
                done[other] = done[node] + 1
                queue.append(other)
    return done


class Front2:
    """A front of pairs: first parts rise, second parts fall."""

    def __init__(self) -> None:
        self.x: list[int] = []
        self.y: list[int] = []

    def covers(self, x: int, y: int) -> bool:
        k = bisect_right(self.x, x)
        return k > 0 and self.y[k - 1] <= y

    def add(self, x: int, y: int) -> None:
        k = bisect_right(self.x, x)
        end = k
        while end < len(self.y) and self.y[end] >= y:
            end += 1
        if k and self.x[k - 1] == x:
            k -= 1
        self.x[k:end], self.y[k:end] = [x], [y]


class FrontN:
    """A front of vectors of any length."""

    def __init__(self) -> None:
        self.rows: list[Vector] = []

    def covers(self, *v: int) -> bool:
        return any(all(a <= b for a, b in zip(r, v, strict=True)) for r in self.rows)

    def add(self, *v: int) -> None:
        self.rows = [r for r in self.rows if not all(a <= b for a, b in zip(v, r, strict=True))] + [v]


def pareto(net: Network, source: int, target: int, m: int, bounds: bool = True, seeds: Iterable[Vector] = (), max_expanded: int | None = None) -> tuple[list[Vector], dict[str, int]]:
    """All efficient cost vectors (first ``m`` costs) from source to target, in order, and counters.

    Labels leave the queue in lexicographic order of vector plus lower bound, so a node's
    labels come with rising first parts and only the other parts need comparing.  Labels
    are tested again when they leave the queue.  ``seeds`` are vectors of known paths;
    a label that a seed strictly dominates is dropped.  ``exact`` is 0 if the budget ended
    the search.
    """
    stats = {"expanded": 0, "generated": 0, "open_peak": 0, "live": 0, "exact": 1}
    if bounds:
        to_go = net.to_go(target, m)
    else:
        near = hops(net.back, target)
        to_go = [dict.fromkeys(near, 0)] * m
    if source not in to_go[0]:
        return [], stats
    kind = Front2 if m == 3 else FrontN
    fronts: dict[int, Front2 | FrontN] = defaultdict(kind)
    seeds = [tuple(s[:m]) for s in seeds]
    zero = tuple([0] * m)
    heap = [(tuple(h[source] for h in to_go), zero, source)]
    found: list[Vector] = []
    while heap:
        bound, g, node = heapq.heappop(heap)
        if fronts[node].covers(*g[1:]) or fronts[target].covers(*bound[1:]):
            continue
        if max_expanded is not None and stats["expanded"] >= max_expanded:
            stats["exact"] = 0
            break
        fronts[node].add(*g[1:])
        stats["expanded"] += 1
        stats["live"] += 1
        if node == target:
            found.append(g)
            continue
        for other, c in net.get(node, ()):
            if other not in to_go[0]:
                continue
            new = tuple(a + b for a, b in zip(g, c, strict=False))
            least = tuple(a + h[other] for a, h in zip(new, to_go, strict=True))
            if fronts[other].covers(*new[1:]) or fronts[target].covers(*least[1:]):
                continue
            if any(s != least and all(a <= b for a, b in zip(s, least, strict=True)) for s in seeds):
                continue
            stats["generated"] += 1
            heapq.heappush(heap, (least, new, other))
        stats["open_peak"] = max(stats["open_peak"], len(heap))
    return found, stats


def one_label_each(net: Network, source: int, target: int, m: int) -> tuple[list[Vector], dict[str, int]]:
    """The same front as ``pareto`` finds, by a queue with one label at most for each node.

    A node's other labels wait in a heap of its own; the next one that is not covered
    enters the queue when its label has left it.
    """
    stats = {"expanded": 0, "generated": 0, "open_peak": 0, "live": 0, "exact": 1}
    to_go = net.to_go(target, m)
    if source not in to_go[0]:
        return [], stats
    kind = Front2 if m == 3 else FrontN
    fronts: dict[int, Front2 | FrontN] = defaultdict(kind)
    waiting: dict[int, list] = defaultdict(list)
    queued: dict[int, tuple] = {}
    heap: list[tuple] = []
    found: list[Vector] = []

    def offer(node: int, label: tuple) -> None:
        """Queue the least label of the node; the others wait."""
        now = queued.get(node)
        if now is None or label < now:
            if now is not None:
                heapq.heappush(waiting[node], now)
            queued[node] = label
            heapq.heappush(heap, (*label, node))
        else:
            heapq.heappush(waiting[node], label)

    def covered(node: int, label: tuple) -> bool:
        return fronts[node].covers(*label[1][1:]) or fronts[target].covers(*label[0][1:])

    offer(source, (tuple(h[source] for h in to_go), tuple([0] * m)))
    while heap:
        bound, g, node = heapq.heappop(heap)
        if queued.get(node) != (bound, g):
            continue  # another label took its place
        del queued[node]
        if not covered(node, (bound, g)):
            fronts[node].add(*g[1:])
            stats["expanded"] += 1
            stats["live"] += 1
            if node == target:
                found.append(g)
            else:
                for other, c in net.get(node, ()):
                    if other not in to_go[0]:
                        continue
                    new = tuple(map(add, g, c))
                    label = (tuple(a + h[other] for a, h in zip(new, to_go, strict=True)), new)
                    if not covered(other, label):
                        stats["generated"] += 1
                        offer(other, label)
        while waiting[node]:
            label = heapq.heappop(waiting[node])
            if not covered(node, label):
                offer(node, label)
                break
        stats["open_peak"] = max(stats["open_peak"], len(queued))
    return found, stats
