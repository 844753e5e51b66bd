"""Graphs of edges (src, dst): strongly connected components and one cycle of each.

What has at most BOUND edges, a whole graph or a component of a larger one, is closed within one task by depth-first and breadth-first
search, whatever the length of its cycles. Larger graphs are taken apart by joins in rounds, each a table in the shared folder, until what
is left is below the bound; a component that is above it alone has its cycle found by joins, a round a step.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.session import stored

#: Edges that one task takes.
BOUND = 200_000
CIRCLES = "node string, component string, n_nodes long, length int, cycle string"


def strong_components(edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """The nodes of each strongly connected component that holds an edge, by depth-first search with a stack of its own."""
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on: set[str] = set()
    found = []
    for root in list(after):
        todo: list[tuple[str, Iterator[str]]] = []
        new: str | None = None if root in order else root
        while new is not None or todo:
            if new is not None:
                order[new] = low[new] = len(order)
                held.append(new)
                on.add(new)
                todo.append((new, iter(after.get(new, ()))))
            node, ahead = todo[-1]
            new = None
            for other in ahead:
                if other not in order:
                    new = other
                    break
                if other in on:
                    low[node] = min(low[node], order[other])
            if new is not None:
                continue
            todo.pop()
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
            if low[node] == order[node]:
                at = len(held) - 1
                while held[at] != node:
                    at -= 1
                part = held[at:]
                del held[at:]
                on.difference_update(part)
                if len(part) > 1 or node in after.get(node, ()):
                    found.append(part)
    return found


def shortest_cycle(after: dict[str, list[str]], start: str) -> list[str]:
    """Of the shortest cycles through start the first in order, [start, ..., start]; after: sorted successors within start's component."""
    parent: dict[str, str] = {}
    level = [start]  # in order of the paths to them
    while True:
        for node in level:
            if start in after.get(node, ()):
                path = [start, node]
                while path[-1] != start:
                    path.append(parent[path[-1]])
                return path[::-1]
        following = []
        for node in level:
            for other in after[node]:
                if other not in parent and other != start:
                    parent[other] = node
                    following.append(other)
        level = following


def _circles(edges: list[tuple[str, str]]) -> Iterator[tuple[str, str, int, int, str]]:
    """Rows of CIRCLES for a graph that is held whole."""
    parts = strong_components(edges)
    of = {node: k for k, part in enumerate(parts) for node in part}
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in sorted(edges):
        if a in of and of[a] == of.get(b):
            after[a].append(b)
    for part in parts:
        least = min(part)
        cycle = shortest_cycle(after, least)
        for node in part:
            yield node, least, len(part), len(cycle) - 1, ">".join(cycle)


def _in_one_task(edges: DataFrame) -> DataFrame:
    """CIRCLES of at most BOUND edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [pair for batch in batches for pair in zip(batch["src"], batch["dst"], strict=True)]
        yield pd.DataFrame(list(_circles(pairs)), columns=[field.split()[0] for field in CIRCLES.split(", ")])

    return edges.select("src", "dst").coalesce(1).mapInPandas(run, CIRCLES)


def circles(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """CIRCLES: every node on a cycle of edges (src, dst), with its component's least node, its size and a shortest cycle through that node,
    as 'A>B>A', and its length; of equally short ones the first in order. No length is a limit. Ends are strings; edges with a null end are dropped."""
    whole = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    if whole.count() <= bound:
        return _in_one_task(whole)
    inner = cyclic_edges(whole, bound)
    return members(inner).join(cycles(inner, bound), "component").select("node", "component", "n_nodes", "length", "cycle")


def _spread(pairs: Iterable[tuple[str, str, str | None]]) -> Iterator[tuple[str, str]]:
    """(node, label) of edges (src, dst, None) and starts (node, node, label), held whole: labels in order, each to nodes that have none yet."""
    after: dict[str, list[str]] = defaultdict(list)
    starts = []
    for a, b, label in pairs:
        if label is None:
            after[a].append(b)
        else:
            starts.append((label, a))
    seen: set[str] = set()
    for label, start in sorted(starts):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo.extend(after.get(node, ()))
                yield node, label


def spread(edges: DataFrame, starts: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, label): of each node that starts (node, label) reach along edges (src, dst) the least label that does. Up to bound edges and starts go
    within one task; more by joins, a round a step of the longest way, only from nodes whose label the last round has lowered."""
    whole = stored(edges.select("src", "dst").distinct())
    starts = stored(starts.groupBy("node").agg(F.min("label").alias("label")))
    if whole.count() + starts.count() <= bound:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            triples = (row for batch in batches for row in zip(batch["src"], batch["dst"], batch["label"], strict=True))
            yield pd.DataFrame(list(_spread(triples)), columns=["node", "label"])

        both = whole.withColumn("label", F.lit(None).cast("string")).unionByName(starts.select(F.col("node").alias("src"), F.col("node").alias("dst"), "label"))
        return both.coalesce(1).mapInPandas(run, "node string, label string")
    labels = new = starts
    while True:
        steps = new.join(whole, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("label").alias("label")).withColumnRenamed("dst", "node")
        known = labels.withColumnRenamed("label", "before")
        new = stored(steps.join(known, "node", "left").where("before IS NULL OR label < before").select("node", "label"))
        if new.isEmpty():
            return labels
        labels = stored(labels.unionByName(new).groupBy("node").agg(F.min("label").alias("label")))


def _labelled(edges: DataFrame) -> DataFrame:
    """(src, dst, component) of at most BOUND edges, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [pair for batch in batches for pair in zip(batch["src"], batch["dst"], strict=True)]
        least = {node: name for part in strong_components(pairs) for name in (min(part),) for node in part}
        yield pd.DataFrame([(a, b, least[a]) for a, b in pairs if a in least and least[a] == least.get(b)], columns=["src", "dst", "component"])

    return edges.select("src", "dst").coalesce(1).mapInPandas(run, "src string, dst string, component string")


def _reach(edges: DataFrame) -> DataFrame:
    """(node, least_from, least_to): the least node that reaches each node, and the least one that it reaches, itself included.

    A round takes the labels of neighbours and then the label of the label, which also reaches the node, or is reached, so rounds
    grow with the logarithm of the longest path on all but odd graphs. Minima combine before they are shuffled.
    """
    ahead, back = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")), edges.select(F.col("dst").alias("node"), F.col("src").alias("to"))
    nothing = F.lit(None).cast("string")
    labels = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("f"), F.col("node").alias("t"))
    while True:
        near = labels.unionByName(labels.join(ahead, "node").select(F.col("to").alias("node"), "f", nothing.alias("t"))).unionByName(labels.join(back, "node").select(F.col("to").alias("node"), nothing.alias("f"), "t"))
        near = near.groupBy("node").agg(F.min("f").alias("f"), F.min("t").alias("t"))
        before = labels.select("node", F.col("f").alias("f0"), F.col("t").alias("t0"))
        from_, to = labels.select(F.col("node").alias("f"), F.col("f").alias("ff")), labels.select(F.col("node").alias("t"), F.col("t").alias("tt"))
        new = near.join(from_, "f", "left").join(to, "t", "left").join(before, "node")
        new = stored(new.select("node", F.least("f", "ff").alias("f"), F.least("t", "tt").alias("t"), "f0", "t0"))
        labels = new.select("node", "f", "t")
        if new.where("f != f0 OR t != t0").isEmpty():
            return labels.select("node", F.col("f").alias("least_from"), F.col("t").alias("least_to"))


def cyclic_edges(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """(src, dst, component): the edges within strongly connected components, with the least node of theirs. Ends are strings; no length is a limit.

    Edges between nodes that aren't reached from, or don't reach, the same least node are on no cycle. Where the least node that
    reaches a node is also the least that it reaches, the two are strongly connected, and that component is known. What is left
    is looked at again without the other edges, and within one task as soon as it is below the bound.
    """
    left = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    parts = []
    while left.count() > bound:
        labels = _reach(left)
        a, b = (labels.select(F.col("node").alias(end), F.struct("least_from", "least_to").alias(f"at_{end}")) for end in ("src", "dst"))
        same = stored(left.join(a, "src").join(b, "dst").where(F.xxhash64("at_src") == F.xxhash64("at_dst")).select("src", "dst", "at_src.*"))
        parts.append(same.where("least_from = least_to").select("src", "dst", F.col("least_from").alias("component")))
        left = same.where("least_from != least_to").select("src", "dst")
    return reduce(DataFrame.unionByName, [*parts, stored(_labelled(left))])


def members(inner: DataFrame) -> DataFrame:
    """(node, component) of cyclic_edges."""
    return inner.select(F.explode(F.array("src", "dst")).alias("node"), "component").distinct()


def cycles(inner: DataFrame, bound: int = BOUND) -> DataFrame:
    """(component, n_nodes, length, cycle) of cyclic_edges: of each component a shortest cycle through its least node, as 'A>B>A'; of equally
    short ones the first in order. Each component of up to bound edges is a group of one task; larger ones go by joins."""
    sizes = stored(inner.groupBy("component").agg(F.count("*").alias("n_edges")))
    columns = ["component", "n_nodes", "length", "cycle"]

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        found = next(_circles(list(zip(rows["src"], rows["dst"], strict=True))))
        return pd.DataFrame([found[1:]], columns=columns)

    small = inner.join(sizes.where(F.col("n_edges") <= bound).select("component"), "component", "left_semi")
    closed = small.groupBy("component").applyInPandas(close, "component string, n_nodes long, length int, cycle string")
    large = sizes.where(F.col("n_edges") > bound).select("component")
    return closed if large.isEmpty() else closed.unionByName(_by_steps(inner.join(large, "component", "left_semi")))


def _by_steps(inner: DataFrame) -> DataFrame:
    """cycles() by joins: paths from the least node grow by one row for each node that is new to its component, a round for each step."""
    sizes = stored(members(inner).groupBy("component").agg(F.count("*").alias("n_nodes")))
    paths = sizes.select("component", F.col("component").alias("node"), F.array("component").alias("path"))
    seen, found = stored(paths.select("component", "node")), []
    while True:
        steps = paths.withColumnRenamed("node", "src").join(inner, ["component", "src"]).groupBy("component", "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        steps = stored(steps.withColumnRenamed("dst", "node"))
        done = steps.where("node = component").select("component", "path")
        if not done.isEmpty():
            found.append(done)
        paths = stored(steps.join(seen, ["component", "node"], "left_anti").join(done.select("component"), "component", "left_anti"))
        if paths.isEmpty():
            closed = reduce(DataFrame.unionByName, found)
            return closed.join(sizes, "component").select("component", "n_nodes", (F.size("path") - 1).alias("length"), F.array_join("path", ">").alias("cycle"))
        seen = stored(seen.unionByName(paths.select("component", "node")))
