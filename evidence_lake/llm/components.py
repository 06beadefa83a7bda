"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_lake.llm.common import released, staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (smaller and itself) neighbours on its smallest one; a node of many edges is aggregated, not gathered."""
    near = _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every u has one edge, and no u is a v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("root").alias("root")).where("low > 1 OR (low = 1 AND root = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node with an edge, a staged table. edges: u, v of any ordered type."""
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        new = staged(_stars(_stars(now, large=True), large=False), "edges")
        released(now)
        now = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = staged(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "parts")
    released(now)
    return out


def merged(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of the edges behind `parts` and of `edges`: only the components that edges join are worked on."""
    of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_part"))
    joined = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_part", "u").alias("u"), F.coalesce("v_part", "v").alias("v"))
    upper = components(joined)
    of_parts = parts.join(upper.select(F.col("node").alias("component"), F.col("component").alias("upper")), "component", "left").select("node", F.coalesce("upper", "component").alias("component"))
    return of_parts.union(upper.join(parts, "node", "left_anti").select("node", "component"))
