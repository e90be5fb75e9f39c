"""Ownership trees and connected components.

Trees are walked level by level with one equi-join each, at most ``max_depth`` times and
no further than they reach; levels are cut, so the plan grows with the depth, not its square. Defined results: unknown and null parents end a chain; a row with
two roles counts twice where roles are joined; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.workspace import cut, cut_round


def descendants(operators: DataFrame, roots: DataFrame | None = None, *, max_depth: int = 10) -> DataFrame:
    """(root_id, id, depth) of everything below each root, the root itself at depth 0."""
    start = (operators.select("id") if roots is None else roots.select("id")).where("id is not null").distinct()
    level = start.select(F.col("id").alias("root_id"), "id", F.lit(0).alias("depth"))
    edges = operators.select(F.col("id").alias("child"), F.col("parent_id").alias("id")).where("id is not null")
    out = level
    for depth in range(1, max_depth + 1):
        level = cut(level.join(edges, "id").select("root_id", F.col("child").alias("id"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def vessels_by_group(operators: DataFrame, edges: DataFrame, vessels: DataFrame, roots: DataFrame | None = None, *, max_depth: int = 10) -> DataFrame:
    """(root_id, mmsi, name, operator, depth) of the vessels tied to a root or what it owns."""
    tree = descendants(operators, roots, max_depth=max_depth)
    tied = tree.join(edges.select(F.col("operator_id").alias("id"), "mmsi"), "id").join(operators.select("id", F.col("canonical").alias("operator")), "id")
    return tied.join(vessels.select("mmsi", "name"), "mmsi").select("root_id", "mmsi", "name", "operator", "depth")


def ancestor_chain(operators: DataFrame, starts: DataFrame | None = None, *, max_depth: int = 10) -> DataFrame:
    """(start_id, id, canonical, depth) from the top owner (depth 0) down to each start."""
    first = (operators.select("id") if starts is None else starts.select("id")).where("id is not null").distinct()
    level = first.select(F.col("id").alias("start_id"), "id", F.lit(0).alias("up"))
    owner = operators.select("id", F.col("parent_id").alias("parent")).where("parent_id is not null")
    out = level
    for up in range(1, max_depth + 1):
        level = cut(level.join(owner, "id").select("start_id", F.col("parent").alias("id"), F.lit(up).alias("up")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    known = out.join(operators.select("id", "canonical"), "id")
    top = known.groupBy("start_id").agg(F.max("up").alias("top"))
    return known.join(top, "start_id").select("start_id", "id", "canonical", (F.col("top") - F.col("up")).alias("depth"))


def assert_acyclic(operators: DataFrame) -> None:
    """Raises if an owner is below itself.

    Every round replaces an ancestor by that ancestor's ancestor of the same distance, so a
    chain of n owners ends after log2(n) rounds and only a cycle goes on."""
    up = cut(operators.where("id is not null and parent_id is not null").select("id", F.col("parent_id").alias("at")))
    rounds = max(1, up.count()).bit_length() + 1
    for _ in range(rounds):
        up = cut(up.join(up.select(F.col("id").alias("at"), F.col("at").alias("next")), "at").select("id", F.col("next").alias("at")))
        if not up.limit(1).count():
            return
    raise ValueError(f"ownership has a cycle through operator {up.agg(F.min('id')).first()[0]}")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): the least id that each node is connected to by links (x, y).

    Every round takes the least label among neighbours and then the label of that label,
    so chains shorten by doubling; only whether anything changed reaches the driver."""
    both = cut(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    linked = cut(both.select(F.col("x").alias("id")).distinct().withColumn("root", F.col("id")))
    while True:
        near = both.join(linked, both["y"] == linked["id"]).groupBy("x").agg(F.min("root").alias("least"))
        step = linked.join(near, linked["id"] == near["x"], "left").select("id", F.least("root", F.coalesce("least", "root")).alias("new"), "root")
        jump = step.select(F.col("id").alias("at"), F.col("new").alias("to"))
        moved = cut_round(step.join(jump, F.col("new") == F.col("at"), "left").select("id", F.least("new", F.coalesce("to", "new")).alias("next"), "root"))
        linked = moved.select("id", F.col("next").alias("root"))
        if not moved.where("next <> root").limit(1).count():
            break
    return nodes.select("id").join(linked, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
