"""Connected components over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Each round hooks every node onto its smallest neighbour, shortens the hooks until all point at roots, and contracts
    the edges onto the roots; every component with an edge left loses at least half of its roots, so rounds grow with
    the logarithm of the size. Minima are combined before each shuffle, so a node with very many edges is summed on the
    map side, and joins have one row a node on their other side, which adaptive execution can split around. Each step is
    written to the shared folder, and deleted once the next one is. Nothing is collected but a row count each round. Nulls
    at either end drop the edge; loops and repeated edges change nothing; no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull())
    live = materialise(pairs.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    found = None
    while not live.isEmpty():
        both = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up"), F.lit(None).cast(both.schema["u"].dataType).alias("over")), "hooks")
        up = step.select("node", "up")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            following = materialise(up.join(over, "up").select("node", "up", "over"), "hooks")
            discard(step)
            step, up = following, following.select("node", F.col("over").alias("up"))
            if step.where(F.col("over") != F.col("up")).isEmpty():
                break
        if found is None:
            found, own = up.select("node", F.col("up").alias("component")), None
        else:
            roots = up.select(F.col("node").alias("component"), "up")
            moved = materialise(found.join(roots, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "components")
            discard(found)
            found, own = moved, step
        left = (
            live.join(up.select(F.col("node").alias("u"), F.col("up").alias("ru")), "u")
            .join(up.select(F.col("node").alias("v"), F.col("up").alias("rv")), "v")
            .where(F.col("ru") != F.col("rv"))
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
        left = materialise(left, "edges")
        discard(live)
        if own is not None:
            discard(own)
        live = left
    if found is None:
        return live.select(F.col("u").alias("node"), F.col("u").alias("component"))
    discard(live)
    return found
