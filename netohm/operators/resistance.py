"""Driver-to-sink resistance of each net and segment scales, worked out inside the net's row."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.sources.shared import ship

OPEN = 1e-15


def _adjacent(edges) -> dict[str, list[tuple[str, float]]]:
    g: dict[str, list[tuple[str, float]]] = {}
    for e in edges:
        if e["r"] >= 0:  # a negative resistor is left out of both methods
            g.setdefault(e["n1"], []).append((e["n2"], e["r"]))
            g.setdefault(e["n2"], []).append((e["n1"], e["r"]))
    return g


def match(pin: str, nodes) -> str | None:
    """The node of a pin: that very name, else the least node with the same base."""
    if pin in nodes:
        return pin
    base = pin.split(":", 1)[0]
    return min((n for n in nodes if n.split(":", 1)[0] == base), default=None)


def distances(edges, source: str) -> dict[str, float]:
    """Least sums of resistance from source to every node it reaches."""
    g, best, heap = _adjacent(edges), {source: 0.0}, [(0.0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > best[n]:
            continue
        for m, r in g.get(n, ()):
            if d + r < best.get(m, float("inf")):
                best[m] = d + r
                heapq.heappush(heap, (d + r, m))
    return best


def _factor(g: dict[str, dict[str, float]], ground: dict[str, float]) -> tuple[dict[str, int], list[tuple[float, list[tuple[str, float]]]]]:
    """Elimination of all nodes, fewest neighbours first: each node's step, and its pivot with the shares that its neighbours take.

    Conductances only add up, so there is no cancellation; a tree fills nothing in.
    """
    heap = [(len(x), n) for n, x in g.items()]
    heapq.heapify(heap)
    step: dict[str, int] = {}
    out = []
    while heap:
        degree, n = heapq.heappop(heap)
        if n in step or degree != len(g[n]):
            continue
        near = g.pop(n)
        pivot = ground[n] + sum(near.values())
        step[n] = len(out)
        out.append((pivot, [(m, c / pivot) for m, c in near.items()]))
        listed = list(near.items())
        for i, (m, c) in enumerate(listed):
            own = g[m]
            del own[n]
            ground[m] += c * ground[n] / pivot
            for o, d in listed[:i]:
                own[o] = g[o][m] = own.get(o, 0.0) + c * d / pivot
        for m, _ in listed:
            heapq.heappush(heap, (len(g[m]), m))
    return step, out


def equivalent(edges, source: str, sinks: list[str], strict: bool = False) -> dict[str, float]:
    """Thevenin resistance from source to each sink node, from a sparse factor of the Laplacian grounded at the source, over the source's component.

    strict: no result at all if the net has nodes outside that component.
    """
    live = [e for e in edges if e["r"] > OPEN and e["n1"] != e["n2"]]
    reach = {source}
    around = _adjacent(live)
    stack = [source]
    while stack:
        for m, _ in around.get(stack.pop(), ()):
            if m not in reach:
                reach.add(m)
                stack.append(m)
    every = {n for e in edges for n in (e["n1"], e["n2"])}
    if len(reach) < 2 or (strict and every - reach):
        return {}
    g: dict[str, dict[str, float]] = {n: {} for n in reach if n != source}
    ground = dict.fromkeys(g, 0.0)
    for e in live:
        a, b, c = e["n1"], e["n2"], 1 / e["r"]
        if a not in reach:
            continue
        if source in (a, b):
            ground[b if a == source else a] += c
        else:
            g[a][b] = g[b][a] = g[a].get(b, 0.0) + c
    step, factor = _factor(g, ground)
    out = {}
    for s in sinks:
        if s not in step:
            continue
        share, todo, total = {s: 1.0}, [(step[s], s)], 0.0
        while todo:
            k, n = heapq.heappop(todo)
            pivot, near = factor[k]
            x = share.pop(n)
            total += x * x / pivot
            for m, part in near:
                if m not in share:
                    share[m] = 0.0
                    heapq.heappush(todo, (step[m], m))
                share[m] += x * part
        if total > 0:
            out[s] = total
    return out


def net_resistances(driver: str, sinks, edges, method: str = "dijkstra", strict: bool = False) -> dict[str, float]:
    if not driver:
        return {}
    nodes = {n for e in edges for n in (e["n1"], e["n2"])}
    source = match(driver, nodes)
    out: dict[str, float] = {}
    if method == "equivalent":
        if source is None:
            return {}
        to = {s: match(s, nodes) for s in sinks}
        got = equivalent(edges, source, [n for n in to.values() if n], strict)
        return {s: got[n] for s, n in to.items() if n in got}
    reached = distances(edges, source if source is not None else driver)
    for s in sinks:
        n = match(s, reached)
        if n is not None:
            out[s] = reached[n]
    return out


def driver_sink_resistances(nets: DataFrame, method: str = "dijkstra", strict: bool = False) -> DataFrame:
    """(lib_id, net, driver, sink, r), r in file units; method is dijkstra or equivalent. Unreached sinks have no row."""

    def run(frames):
        for f in frames:
            rows = []
            for lib, net, driver, sinks, edges in zip(f.lib_id, f.net, f.driver, f.sinks, f.edges):
                rows += [(lib, net, driver, s, r) for s, r in net_resistances(driver, sinks, edges, method, strict).items()]
            yield pd.DataFrame(rows, columns=["lib_id", "net", "driver", "sink", "r"])

    ship(nets.sparkSession)
    return nets.select("lib_id", "net", "driver", "sinks", "edges").mapInPandas(run, "lib_id string, net string, driver string, sink string, r double")


def equivalent_resistance(edges, source: str, sink: str) -> float:
    """Of one pair of nodes; 0 where it is undefined."""
    return equivalent(edges, source, [sink]).get(sink, 0.0) if source != sink else 0.0


def segment_scales(driver: str, sinks, edges, ratios: dict[str, float], average: float) -> list[tuple[str, str, float]]:
    """Scales (a, b, scale), a < b, of the resistors on the breadth-first tree from the driver.

    A segment that leads to one sink only takes what that sink's target leaves after the shared part at the average; others take the average.
    """
    nodes = {n for e in edges for n in (e["n1"], e["n2"])}
    root = match(driver, nodes) if driver else None
    if root is None:
        return []
    g = _adjacent(edges)
    parent, order = {root: None}, [root]
    for n in order:
        for m, _ in g.get(n, ()):
            if m not in parent:
                parent[m] = n
                order.append(m)
    at = {}
    for s in sinks:
        n = match(s, parent)
        if n is not None and s in ratios:
            at[s] = n
    below: dict[str, set[str]] = {n: set() for n in order}
    for s, n in at.items():
        below[n].add(s)
    for n in reversed(order[1:]):
        below[parent[n]] |= below[n]
    weight = {n: next(r for m, r in g[parent[n]] if m == n) for n in order[1:]}
    scale = {n: average for n in order[1:]}
    for s, n in at.items():
        path = []
        while n != root:
            path.append(n)
            n = parent[n]
        own = [x for x in path if len(below[x]) == 1]
        exclusive, shared = sum(weight[x] for x in own), sum(weight[x] for x in path if len(below[x]) != 1)
        target = (exclusive + shared) * ratios[s] - shared * average
        if exclusive > OPEN and target > 0:
            for x in own:
                scale[x] = target / exclusive
    return [(min(n, parent[n]), max(n, parent[n]), v) for n, v in scale.items()]


def per_net(resistances: DataFrame, how: str) -> DataFrame:
    """max, avg or total resistance of each net."""
    f = {"max": F.max, "avg": F.avg, "total": F.sum}[how]
    return resistances.groupBy("lib_id", "net").agg(f("r").alias("r"))
