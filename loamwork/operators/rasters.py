"""Rasters as tables of cells, brought to one grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Cells of `dx` by `dy` from the upper left corner (x0, y0): rows go down, columns to the right, both from 0."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    @property
    def x1(self) -> float:
        return self.x0 + self.cols * self.dx

    @property
    def y1(self) -> float:
        return self.y0 - self.rows * self.dy


def template(grids: list[Grid], resolution: float) -> Grid:
    """The grid of square cells that covers all grids."""
    x0, y0, x1, y1 = min(g.x0 for g in grids), max(g.y0 for g in grids), max(g.x1 for g in grids), min(g.y1 for g in grids)
    whole = lambda span: max(1, math.ceil(span / resolution - 1e-9))
    return Grid(x0, y0, resolution, resolution, whole(y0 - y1), whole(x1 - x0))


def cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """row, col of all cells of a grid."""
    return spark.range(grid.rows * grid.cols).select(F.floor(F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col"))


def _squares(source: DataFrame) -> DataFrame:
    """r, c, and v00, v01, v10, v11: the values of the four cells from (r, c) on, of each square of which any has one."""
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    each = source.select("row", "col", F.col("value").cast("double").alias("v"), F.explode(corner).alias("k")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    at = each.select((F.col("row") - F.col("k.i")).alias("r"), (F.col("col") - F.col("k.j")).alias("c"), "k", "v")
    held = lambda i, j: F.max(F.when((F.col("k.i") == i) & (F.col("k.j") == j), F.col("v"))).alias(f"v{i}{j}")
    return at.groupBy("r", "c").agg(*[held(i, j) for i in (0, 1) for j in (0, 1)])


def resample(source: DataFrame, grid: Grid, target: Grid, method: str = "bilinear") -> DataFrame:
    """row, col, value of the target's cells that have one, from a source (row, col, value) on its grid.

    A target cell's centre lies between four source cells' centres; its value is their bilinear mean, over those that
    have a value (at the edge, and beside gaps, fewer). `near` takes the source cell that holds the centre. Centres
    outside the source's extent have none.

    The grids meet by whole numbers: each target cell computes which square of source cells it lies in, and a source
    cell is sent to the four squares that it is a corner of. So there is one join by equality, with a row for a target
    cell on one side and a row for a square on the other, and the weights are an expression.
    """
    x = target.x0 + (F.col("col") + 0.5) * target.dx
    y = target.y0 - (F.col("row") + 0.5) * target.dy
    inside = (x >= grid.x0) & (x < grid.x1) & (y <= grid.y0) & (y > grid.y1)
    wanted = cells(source.sparkSession, target).filter(inside)
    fx, fy = (x - grid.x0) / grid.dx, (grid.y0 - y) / grid.dy
    if method == "near":
        placed = wanted.select("row", "col", F.floor(fy).cast("int").alias("r"), F.floor(fx).cast("int").alias("c"))
        held = source.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").cast("double").alias("value"))
        return placed.join(held, ["r", "c"]).select("row", "col", "value")
    fx, fy = fx - 0.5, fy - 0.5
    placed = wanted.select("row", "col", F.floor(fy).cast("int").alias("r"), F.floor(fx).cast("int").alias("c"), (fy - F.floor(fy)).alias("fy"), (fx - F.floor(fx)).alias("fx"))
    weight = {(i, j): (F.col("fy") if i else 1 - F.col("fy")) * (F.col("fx") if j else 1 - F.col("fx")) for i in (0, 1) for j in (0, 1)}
    zero = F.lit(0.0)

    def total(f) -> Column:
        return sum((F.when(F.col(f"v{i}{j}").isNotNull(), f(i, j)).otherwise(zero) for i, j in weight), zero)

    met = placed.join(_squares(source), ["r", "c"]).withColumn("w", total(lambda i, j: weight[i, j])).withColumn("s", total(lambda i, j: weight[i, j] * F.col(f"v{i}{j}")))
    return met.filter("w > 0").select("row", "col", (F.col("s") / F.col("w")).alias("value"))


def align(sources: dict[str, tuple[DataFrame, Grid]], resolution: float | None = None, target: Grid | None = None, method: str = "bilinear") -> tuple[DataFrame, Grid]:
    """row, col, band, value of all sources on one grid: the target, or the one that covers them all."""
    if not sources:
        raise ValueError("[align] there is no source")
    target = target or template([g for _, g in sources.values()], resolution)
    out = None
    for name, (source, grid) in sources.items():
        band = resample(source, grid, target, method).select("row", "col", F.lit(name).alias("band"), "value")
        out = band if out is None else out.unionByName(band)
    return out, target
