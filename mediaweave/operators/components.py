"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014), and labels
that are kept from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.sources.shared import dealt, publish, publish_by, remove, shared_dir

#: A node with more neighbours than that is a hub, whose edges are dealt to as many tasks as hold so many each; the number
#: rises with the edges, so that there are never more than MOST_HUBS.
HUB, MOST_HUBS = 100_000, 10_000


def _neighbours(edges: DataFrame, both: bool) -> DataFrame:
    near = edges.select(F.col("high").alias("node"), F.col("low").alias("other"))
    return near.unionAll(edges.select(F.col("low").alias("node"), F.col("high").alias("other"))) if both else near


def _hook(edges: DataFrame, both: bool, hubs: DataFrame | None) -> DataFrame:
    """Link each node's neighbours to the smallest of them and itself. edges: high > low; hubs: node, parts.
    both: neighbours above the node, or else those below it and the node itself.

    A node's smallest neighbour is found map-side; it goes back to the neighbours by a join, for hubs by part."""
    near = _neighbours(edges, both)
    least = near.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    if hubs is None:
        pairs = near.join(dealt(least), "node")
    else:
        parts = F.coalesce("parts", F.lit(1))
        parted = near.join(F.broadcast(hubs), "node", "left").withColumn("part", F.pmod(F.xxhash64("other"), parts).cast("int"))
        copies = least.join(F.broadcast(hubs), "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        pairs = parted.select("node", "other", "part").join(dealt(copies.select("node", "least", "part")), ["node", "part"])
    if both:
        out = pairs.filter("other > node").select(F.col("other").alias("high"), F.col("least").alias("low"))
    else:
        out = pairs.select(F.col("other").alias("high"), F.col("least").alias("low")).unionAll(least.select(F.col("node").alias("high"), F.col("least").alias("low")))
    return out.filter("high > low").distinct()


def _described(edges: DataFrame, hub: int) -> tuple[tuple, DataFrame | None]:
    """What tells one set of edges from another, and its hubs if it has any."""
    degrees = _neighbours(edges, True).groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)")).alias("mark"))
    row = degrees.agg(F.sum("n").alias("n"), F.sum("mark").alias("mark"), F.max("n").alias("most")).first()
    hub = max(hub, -(-(row.n or 0) // MOST_HUBS))
    if (row.most or 0) <= hub:
        return (row.n, row.mark), None
    hubs = degrees.filter(F.col("n") > hub).select("node", F.ceil(F.col("n") / hub).cast("int").alias("parts")).collect()  # MOST_HUBS at most
    return (row.n, row.mark), edges.sparkSession.createDataFrame([tuple(r) for r in hubs], "node long, parts int")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", hub: int = HUB) -> DataFrame:
    """One row for each node that has an edge to another: node, component (the smallest node it reaches).

    Only edges are kept between rounds. Each round is written to the shared folder, so that the plan stays short and a
    lost executor costs one round, and removes what the round before has written."""
    spark = edges.sparkSession
    shared_dir(spark)
    state, path = publish_by(edges.select(F.greatest(src, dst).cast("long").alias("high"), F.least(src, dst).cast("long").alias("low")).filter("high > low").distinct())
    was = None
    while True:
        mark, hubs = _described(state, hub)
        if mark == was or mark[0] is None:
            break
        after, to = publish_by(_hook(_hook(state, True, hubs), False, hubs))
        remove(spark, path)
        state, path, was = after, to, mark
    return state.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(state.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())


def extend_components(labels: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """labels: node, component, all that earlier calls have returned (a node's last label is its smallest); edges: new ones,
    of nodes that are known or not. What the edges change: the labels of nodes that are new, or whose component has
    merged (node, component), and the merges of components that there were (was, now).

    The new edges are contracted to labels first, so that the stars' rounds follow the batch and not what is kept; kept
    labels are only scanned, for the batch's nodes and for the components that it merges."""
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = nodes.join(dealt(labels.groupBy("node").agg(F.min("component").alias("component"))), "node", "left")
    known = publish(known.select("node", F.coalesce("component", "node").alias("label"), F.col("component").isNull().alias("fresh")))
    for side in ("a", "b"):
        ends = ends.join(known.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side)
    merged = connected_components(ends.filter("label_a <> label_b").select("label_a", "label_b"), "label_a", "label_b")
    merges = publish(merged.filter("node <> component").select(F.col("node").alias("was"), F.col("component").alias("now")))
    new = known.filter("fresh").join(merges, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("component"))
    # a component that merges now has not merged before: all labels that name it are its nodes' last ones
    moved = labels.join(merges, F.col("component") == F.col("was")).select("node", F.col("now").alias("component"))
    kept = merges.join(known.filter("fresh").select(F.col("node").alias("was")), "was", "left_anti")  # a new node was no component
    return new.unionByName(moved), kept
