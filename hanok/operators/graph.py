"""Bounded shortest paths and connected groups as iterated joins.

Every round ends in a checkpoint in the shared folder, so the plan stays short and a lost executor costs no more than
the running round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.session import cut, settled

SLACK = 1e-6  # metres a walk may go too far against rounding; the limit itself is held at the end


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed copies (node, next, length) of undirected edges (a, b, length)."""
    there = edges.select(F.col("a").alias("node"), F.col("b").alias("next"), "length")
    back = edges.select(F.col("b").alias("node"), F.col("a").alias("next"), "length")
    return there.unionByName(back)


def bounded_paths(starts: DataFrame, edges: DataFrame, limit: float, hops: int = 3) -> DataFrame:
    """Shortest distance from each source to every node within ``limit``, with the node before it.

    ``starts(source, node, dist)`` may hold several entry nodes per source; ``edges(a, b, length)``. Walks begin at the
    distinct entry nodes, so sources that share one share its walk, and each source takes the best over its entries at the
    end. A round walks ``hops`` edges from the nodes improved in the round before, keeps the best per (entry, node), and goes
    on only with those that beat the distance known so far. Sums are pre-aggregated on the map side; the frontier holds one
    row per (entry, node). Ends when nothing improves.
    """
    steps = cut(both_ways(edges).groupBy("node", "next").agg(F.min("length").alias("length")))
    entry = cut(starts.filter(F.col("dist") <= limit).groupBy("source", "node").agg(F.min("dist").alias("dist")))
    # entries that many sources share are walked from once, as far as the nearest of these sources may go
    roots = entry.groupBy(F.col("node").alias("root")).agg((F.lit(limit) - F.min("dist")).alias("left"))

    def best(df):
        return df.groupBy("root", "node").agg(F.min(F.struct("dist", "prev")).alias("m"), F.first("left").alias("left")).select("root", "node", "m.dist", "m.prev", "left")

    known = cut(roots.select("root", F.col("root").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("prev"), "left"))
    frontier = known
    while True:
        reached = None
        edge_of_round = frontier
        for _ in range(hops):
            moved = (
                edge_of_round.join(steps, "node")
                .select("root", F.col("next").alias("node"), (F.col("dist") + F.col("length")).alias("dist"), F.col("node").alias("prev"), "left")
                .filter(F.col("dist") <= F.col("left") + SLACK)
            )
            edge_of_round = best(moved)
            reached = edge_of_round if reached is None else reached.unionByName(edge_of_round)
        old = known.select("root", "node", F.col("dist").alias("_known"))
        better = best(reached).join(old, ["root", "node"], "left").filter(F.col("_known").isNull() | (F.col("dist") < F.col("_known")))
        frontier = cut(better.drop("_known"))
        if frontier.isEmpty():
            break
        known = cut(best(known.unionByName(frontier)))
    begun = entry.select("source", F.col("node").alias("root"), F.col("dist").alias("_begun"))
    whole = begun.join(known, "root").select("source", "node", (F.col("_begun") + F.col("dist")).alias("dist"), "prev").filter(F.col("dist") <= limit)
    nearest = whole.groupBy("source", "node").agg(F.min(F.struct("dist", "prev")).alias("m"))
    return cut(nearest.select("source", "node", "m.dist", "m.prev"))


def routes(paths: DataFrame, goals: DataFrame) -> DataFrame:
    """The nodes from a source's entry to each of its goals: ``goals(source, goal, node)`` with ``nodes ARRAY``, entry first.

    ``paths(source, node, prev)`` as :func:`bounded_paths` gives it. Pointers are doubled: round ``k`` knows the node
    ``2^k`` steps back. A goal then takes the doubled pointers from the longest down, each time every row of its route
    adding the one ``2^k`` steps before it, so a route of any length is complete after as many joins as its length has
    bits. Rows stay narrow; a list is only built at the end, one per goal and no longer than its route.
    """
    jumps = [settled(paths.filter("prev is not null").select("source", "node", F.col("prev").alias("back")))]
    while True:
        far = jumps[-1]
        onward = far.select("source", F.col("node").alias("back"), F.col("back").alias("_next"))
        doubled = settled(far.join(onward, ["source", "back"]).select("source", "node", F.col("_next").alias("back")))
        if doubled.isEmpty():
            break
        jumps.append(doubled)
    rows = goals.select("source", "goal", "node", F.lit(0).cast("bigint").alias("step"))
    for k in reversed(range(len(jumps))):
        before = rows.join(jumps[k], ["source", "node"]).select("source", "goal", F.col("back").alias("node"), (F.col("step") + 2**k).alias("step"))
        rows = rows.unionByName(before)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("at"), "node")))
    return rows.groupBy("source", "goal").agg(F.transform(listed, lambda s: s["node"]).alias("nodes"))


def connected_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``group_id`` (smallest id) of every node ``id`` under the undirected ``links(a, b)``.

    Each round hands every node the smallest label around it and then the label of its label, so long chains close in
    few rounds.
    """
    pairs = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(nodes.select("id", F.col("id").alias("group_id")))
    while True:
        near = pairs.join(labels, pairs.b == labels.id).select(F.col("a").alias("id"), "group_id")
        lowest = labels.unionByName(near).groupBy("id").agg(F.min("group_id").alias("group_id"))
        jump = lowest.select(F.col("id").alias("group_id"), F.col("group_id").alias("_next"))
        new = settled(lowest.join(jump, "group_id", "left").select("id", F.coalesce("_next", "group_id").alias("group_id")))
        changed = new.join(labels.withColumnRenamed("group_id", "_old"), "id").filter(F.col("group_id") != F.col("_old"))
        done = changed.isEmpty()
        labels = new
        if done:
            return labels
