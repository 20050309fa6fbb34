"""Joint hierarchies and skinned vertices by matrix columns.

A matrix is an array of 16 doubles, column by column, as (by, node) rows of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = [float(i % 5 == 0) for i in range(16)]
#: Levels of a hierarchy are halved each round, so 2 ** ROUNDS of them are enough.
ROUNDS = 16


def product(a: Column, b: Column) -> Column:
    """a times b."""
    cell = lambda i: sum((F.get(a, F.lit(k * 4) + i % 4) * F.get(b, (i / 4).cast("int") * 4 + k) for k in range(4)), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def applied(m: Column, x: Column, y: Column, z: Column) -> Column:
    """struct(x, y, z): a point moved by a matrix."""
    row = lambda i: F.get(m, i) * x + F.get(m, 4 + i) * y + F.get(m, 8 + i) * z + F.get(m, 12 + i)
    return F.struct(*(row(i).alias(c) for i, c in enumerate("xyz")))


def world_matrices(nodes: DataFrame, by: str, rounds: int | None = None) -> DataFrame:
    """(by, node, world): the product of all matrices from the root down to each node, of nodes (by, node, parent, matrix).

    Pointer doubling: each round a node takes over what its ancestor knows and that
    ancestor's ancestor, so a chain of n nodes is done in log2 n joins.  A parent that is
    not there is none.  Without ``rounds`` the rounds go on until no node has an ancestor
    left, each written to the checkpoint folder; a cycle is an error.
    """
    rows = nodes.select(by, "node", F.col("parent").alias("up"), F.col("matrix").alias("world"))
    for done in range(ROUNDS if rounds is None else rounds):
        if rounds is None:
            rows = rows.checkpoint()
            if rows.where("up IS NOT NULL").isEmpty():
                return rows.select(by, "node", "world")
        above = rows.select(by, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("world").alias("_world"))
        met = rows.join(above, [by, "up"], "left")
        rows = met.select(by, "node", F.col("_up").alias("up"), F.when(F.col("_world").isNotNull(), product(F.col("_world"), F.col("world"))).otherwise(F.col("world")).alias("world"))
    if rounds is None and not rows.where("up IS NOT NULL").isEmpty():
        raise ValueError("nodes form a cycle")
    return rows.select(by, "node", "world")


def repaired_weights(influences: DataFrame, by: list[str]) -> DataFrame:
    """influences (by, joint, weight) with weights that add up to 1 for every vertex.

    Negative ones and those that are no numbers count as 0; joints named twice are added;
    a vertex whose weights are all 0 follows its smallest joint.
    """
    clean = F.when(F.isnan("weight") | F.col("weight").isNull() | (F.col("weight") < 0), 0.0).otherwise(F.col("weight"))
    once = influences.groupBy(*by, "joint").agg(F.sum(clean).alias("weight"))
    sums = once.groupBy(*by).agg(F.sum("weight").alias("_total"), F.min("joint").alias("_first"))
    fair = F.when(F.col("_total") > 0, F.col("weight") / F.nullif(F.col("_total"), F.lit(0.0))).otherwise((F.col("joint") == F.col("_first")).cast("double"))
    return once.join(sums, by).select(*by, "joint", fair.alias("weight")).where("weight > 0")


def skinned(vertices: DataFrame, influences: DataFrame, joints: DataFrame, by: str, vertex: str) -> DataFrame:
    """(by, vertex, x, y, z): vertices moved by their joints, one grouped weighted sum.

    vertices (by, vertex, x, y, z), influences (by, vertex, joint, weight), joints (by,
    node, world, inverse): the joint's matrix now and the inverse of the one in which
    the vertices were bound.  A vertex of no known joint stays where it is.
    """
    moves = joints.select(by, F.col("node").alias("joint"), product(F.col("world"), F.col("inverse")).alias("_m"))
    weighted = repaired_weights(influences, [by, vertex]).join(moves, [by, "joint"]).join(vertices.select(by, vertex, "x", "y", "z"), [by, vertex])
    moved = weighted.withColumn("_p", applied(F.col("_m"), F.col("x"), F.col("y"), F.col("z")))
    sums = moved.groupBy(by, vertex).agg(*(F.sum(F.col("_p")[c] * F.col("weight")).alias(f"_{c}") for c in "xyz"))
    return vertices.join(sums, [by, vertex], "left").select(by, vertex, *(F.coalesce(f"_{c}", c).alias(c) for c in "xyz"))
