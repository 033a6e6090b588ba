"""Nearest neighbours without a cross join, and attention over the graph that they make."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.storage import erased, written


#: Points of the fullest cell at first; more make the cells smaller, as all points of a cell meet.
MAX_CELL = 2_000


def knn(points: DataFrame, x: str, y: str, key: str, k: int = 8, rounds: int = 80, among: DataFrame | None = None, same: bool = False) -> DataFrame:
    """src, dst, distance, rank: the k nearest others of each point by plain distance, of the points `among` if they are
    given; ties by key. With `same` a point of the other table that has its key is one of the others.

    Points fall into square cells of about 2k points, or smaller ones where a cluster would fill one; a point meets the 9
    cells around it by an equi-join. It is done when its k-th neighbour lies within one cell's width, as nothing nearer
    can be farther off. What isn't done, and no more, goes on with cells of twice the width, over all points.
    """
    placed = lambda df: df.select(F.col(key).alias("k_"), F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")).filter("x_ is not null and y_ is not null")
    asking = placed(points)
    pts = asking if among is None else placed(among)
    box = (pts if among is None else pts.withColumn("of_", F.lit(1)).unionByName(asking.withColumn("of_", F.lit(0)))).agg(F.count(F.lit(1) if among is None else F.when(F.col("of_") == 1, 1)).alias("n"), *[f(c).alias(f"{n}{c}") for c in ("x_", "y_") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not box.n or among is None and box.n < 2:
        return pts.limit(0).select(F.col("k_").alias("src"), F.col("k_").alias("dst"), F.col("x_").alias("distance"), F.lit(0).alias("rank"))
    k = min(k, box.n - 1 if among is None else box.n)
    wide, high = max(box.hix_ - box.lox_, 1e-12), max(box.hiy_ - box.loy_, 1e-12)
    size = max(math.sqrt(wide * high * 2 * k / box.n), max(wide, high) / 1e6)
    for _ in range(30):
        full = pts.groupBy(F.floor(F.col("x_") / size), F.floor(F.col("y_") / size)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n
        if full <= max(MAX_CELL, 8 * k) or size / 2 <= max(wide, high) / 1e9:
            break
        size /= 4
    todo, parts = asking, []
    other = F.lit(True) if same else F.col("k_") != F.col("dst")
    for _ in range(rounds):
        cell = lambda c: F.floor(F.col(c) / size)
        cells = pts.select(F.col("k_").alias("dst"), F.col("x_").alias("dx"), F.col("y_").alias("dy"), cell("x_").alias("cx"), cell("y_").alias("cy"))
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        asked = todo.select("k_", "x_", "y_", F.explode(around).alias("o")).select("k_", "x_", "y_", (cell("x_") + F.col("o.i")).alias("cx"), (cell("y_") + F.col("o.j")).alias("cy"))
        met = asked.join(cells, ["cx", "cy"]).filter(other).withColumn("distance", F.sqrt((F.col("x_") - F.col("dx")) ** 2 + (F.col("y_") - F.col("dy")) ** 2))
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("k_").orderBy("distance", "dst"))).filter(F.col("rank") <= k)
        whole = 3 * size >= 3 * max(wide, high)  # one cell holds all
        full = ranked.groupBy("k_").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n")).filter((F.col("n") == k) & (F.lit(whole) | (F.col("far") <= size)))
        # each round is written down: the next neither computes nor plans it again
        part = written(ranked.join(full.select("k_"), "k_", "left_semi").select(F.col("k_").alias("src"), "dst", "distance", "rank"))
        parts.append(part)
        if whole:
            break
        todo, before = written(todo.join(part.select(F.col("src").alias("k_")).distinct(), "k_", "left_anti")), todo
        if before is not asking:
            erased(before)
        if todo.isEmpty():
            break
        size *= 2
    return reduce(DataFrame.unionByName, parts)


def edge_weights(edges: DataFrame) -> DataFrame:
    """Inverse distances that sum to 1 for each source."""
    w = 1 / (F.col("distance") + 1e-9)
    return edges.withColumn("w", w).withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).drop("w")


def attention(edges: DataFrame, score: str, weight: str | None = None, leak: float = 0.2) -> DataFrame:
    """edges with alpha, the softmax over each source of the leaky score times the edge's weight."""
    s = F.when(F.col(score) > 0, F.col(score)).otherwise(leak * F.col(score)) * (F.col(weight) if weight else F.lit(1.0))
    w = Window.partitionBy("src")
    out = edges.withColumn("e_", s).withColumn("e_", F.exp(F.col("e_") - F.max("e_").over(w)))
    return out.withColumn("alpha", F.col("e_") / F.sum("e_").over(w)).drop("e_")


def gather(edges: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """node, h: the attention-weighted sum of the neighbours' vectors; a node without neighbours keeps its own."""
    met = edges.join(nodes.select(F.col("node").alias("dst"), F.col("h").alias("h_")), "dst")
    sums = met.groupBy("src").agg(F.array(*[F.sum(F.col("alpha") * F.col("h_")[i]) for i in range(dim)]).alias("new_"))
    return nodes.join(sums.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("new_", "h").alias("h"))
