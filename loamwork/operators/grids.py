"""Space-time cubes as long tables: generation, scaling, loss terms, assimilation, folds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.functions.columns import taper
from loamwork.functions.storage import erased, written


def synthetic_cube(spark: SparkSession, rows: int, cols: int, steps: int, gain: float = 0.03, loss: float = 0.015, noise: float = 0.2, seed: int = 1) -> DataFrame:
    """t, row, col, elev, precip, soc (t from 1): rain with a season and a gradient to the east; the store gains with rain
    and loses in proportion to itself and to rain over its mean, never under 5.

    Draws are hashes of cell, step and seed. One cell's series is a fold over its steps.
    """
    u = lambda *k: (F.pmod(F.xxhash64(*k, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda *k: F.sqrt(-2 * F.log(u(*k, F.lit("a")))) * F.cos(2 * F.pi() * u(*k, F.lit("b")))
    cells = spark.range(rows * cols).select((F.col("id") % rows).cast("int").alias("row"), F.floor(F.col("id") / rows).cast("int").alias("col"))
    x, y = (-1 + 2 * F.col(c) / max(1, n - 1) for c, n in (("col", cols), ("row", rows)))
    cells = cells.withColumn("elev", 100 + 40 * (x + y) + 15 * F.sin(4 * x) + 5 * normal(F.lit("elev"), "row", "col"))
    season = lambda t: 90 + 80 * F.sin((t - 3) * (2 * math.pi / 12))
    rain = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda t: F.greatest(F.lit(0.0), season(t) * (0.6 + 0.3 * (x + 1)) + 8 * normal(F.lit("rain"), "row", "col", t)))
    cells = cells.withColumn("p", rain)
    mean = cells.agg(F.avg(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) / steps).alias("m")).first().m  # one row
    start = F.greatest(F.lit(8.0), 20 + 0.03 * (F.col("elev") - 100) + normal(F.lit("start"), "row", "col"))
    shocks = F.transform(F.slice("p", 1, steps - 1), lambda p, i: F.struct(p.alias("p"), (noise * normal(F.lit("shock"), "row", "col", i)).alias("e"))) if steps > 1 else F.array().cast("array<struct<p:double,e:double>>")
    then = lambda a, s: F.greatest(F.lit(5.0), F.element_at(a, -1) + gain * s["p"] - loss * F.element_at(a, -1) * s["p"] / mean + s["e"])
    series = F.aggregate(shocks, F.array(start), lambda a, s: F.concat(a, F.array(then(a, s))))
    long = cells.withColumn("s", series).select("row", "col", "elev", F.posexplode(F.arrays_zip(F.col("p").alias("precip"), F.col("s").alias("soc"))).alias("t", "v"))
    return long.select((F.col("t") + 1).alias("t"), "row", "col", "elev", "v.precip", "v.soc")


def scaled(cube: DataFrame, names: list[str], floor: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """The cube with columns as z-scores (a deviation under the floor counts as 1) and the scaling table."""
    one = cube.agg(*[F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c) for c in names])
    table = one.select(F.inline(F.array(*names)))
    stats = {r.name: r for r in table.collect()}
    out = cube
    for c in names:
        sd = stats[c].sd
        out = out.withColumn(c, (F.col(c) - F.lit(stats[c].mean)) / F.lit(sd if sd is not None and sd >= floor else 1.0))
    return out, table


def lag_loss(df: DataFrame, by: list[str], order: str, value: str, rate: float, level: float, weight: float = 1.0) -> DataFrame:
    """Per group the weighted mean square of the step less the decay that a first-order model asks for."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(value).over(w)
    off = (F.col(value) - before) - (-rate * (before - level))
    return df.withColumn("off_", off).groupBy(*by).agg(F.count("off_").alias("n_steps"), (weight * F.avg(F.col("off_") ** 2)).alias("loss"))


def round_robin_folds(df: DataFrame, cluster: str, order: str, folds: int = 5) -> DataFrame:
    """Folds 1..folds dealt in turn inside each cluster, beginning with another fold in each."""
    k = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(cluster))
    names = df.select(cluster).distinct().withColumn("k_", k)
    w = Window.partitionBy(cluster).orderBy(order)
    return df.join(F.broadcast(names) if names.count() <= 100_000 else names, cluster).withColumn("fold", (F.row_number().over(w) + F.col("k_") - 2) % folds + 1).drop("k_")


def spatial_clusters(df: DataFrame, x: str, y: str, k: int = 5, starts: int = 3, seed: int = 1) -> DataFrame:
    """df with `cluster` 1..k by k-means on the coordinates: the best of some starts. Rows without coordinates have none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    placed = VectorAssembler(inputCols=[x, y], outputCol="place_", handleInvalid="skip").transform(df)
    models = [KMeans(featuresCol="place_", predictionCol="cluster_", k=k, seed=seed + i).fit(placed) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    lost = df.filter(F.col(x).isNull() | F.isnan(x) | F.col(y).isNull() | F.isnan(y)).withColumn("cluster", F.lit(None).cast("int"))
    return best.transform(placed).withColumn("cluster", F.col("cluster_") + 1).select(*df.columns, "cluster").unionByName(lost)


def fold_summary(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_folds"), *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))])


#: Observations of one update, whose matrices are on the driver, and members.
MAX_OBSERVATIONS, MAX_MEMBERS = 2_000, 2_000


def assimilate(ensemble: DataFrame, observations: DataFrame, radius: float | None = None, seed: int = 1, perturb: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stochastic ensemble Kalman update. ensemble: member, row, col, value; observations: row, col, observed, sd.

    The members' values at the observed cells are a small matrix (members x observations) on the driver, within stated
    limits; streaming.assimilation has the update by tile. Each cell's gain needs that matrix and its own members only,
    so cells are independent groups in Spark. With a radius the gain is tapered by distance. Without `perturb` all
    members see the observations as they are. Returns the analysis ensemble, and the gain's norm of each cell.
    """
    n_obs, n_members = observations.count(), ensemble.agg(F.count_distinct("member").alias("n")).first().n
    if n_obs > MAX_OBSERVATIONS or n_members > MAX_MEMBERS:
        raise ValueError(f"[assimilate] {n_obs} observations and {n_members} members; at most {MAX_OBSERVATIONS} and {MAX_MEMBERS}\nHint: streaming.assimilation.batch_tiles goes tile by tile")
    obs = observations.select("row", "col", "observed", "sd").orderBy("col", "row").toPandas()
    at = ensemble.join(F.broadcast(observations.select("row", "col")), ["row", "col"], "left_semi").toPandas()
    wide = at.pivot_table(index="member", columns=["col", "row"], values="value").sort_index()
    hx = wide.reindex(columns=pd.MultiIndex.from_arrays([obs.col, obs.row])).to_numpy()
    if np.isnan(hx).any():
        raise ValueError("[assimilate] a member lacks a value at an observed cell")
    n = len(hx)
    ha = hx - hx.mean(axis=0)
    inverse = np.linalg.inv(ha.T @ ha / (n - 1) + np.diag(obs.sd.to_numpy() ** 2))
    noise = np.random.default_rng(seed).normal(size=hx.shape) * obs.sd.to_numpy() * perturb
    innovation = obs.observed.to_numpy() + noise - hx
    place = obs[["row", "col"]].to_numpy(float)
    sent = ensemble.sparkSession.sparkContext.broadcast((ha, inverse, innovation, place))

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        ha, inverse, innovation, place = sent.value
        pdf = pdf.sort_values("member")
        x = pdf.value.to_numpy()
        gain = ((x - x.mean()) @ ha / (len(x) - 1)) @ inverse
        if radius:
            z = np.sqrt(((place - [pdf.row.iloc[0], pdf.col.iloc[0]]) ** 2).sum(axis=1)) / radius
            near = 1 - 5 / 3 * z**2 + 5 / 8 * z**3 + z**4 / 2 - z**5 / 4
            far = 4 - 5 * z + 5 / 3 * z**2 + 5 / 8 * z**3 - z**4 / 2 + z**5 / 12 - 2 / (3 * np.maximum(z, 1e-12))
            gain = gain * np.maximum(0, np.where(z <= 1, near, np.where(z <= 2, far, 0)))
        return pdf.assign(value=x + innovation @ gain, gain=float(np.sqrt((gain**2).sum())))[["member", "row", "col", "value", "gain"]]

    out = ensemble.select("member", "row", "col", "value").groupBy("row", "col").applyInPandas(update, "member int, row int, col int, value double, gain double")
    return out.drop("gain"), out.groupBy("row", "col").agg(F.first("gain").alias("gain"), F.stddev_samp("value").alias("sd"))


def cube_arrays(cube: DataFrame, static: list[str], moving: list[str], target: str, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(steps, channels, height, width) and (steps, height, width) of a long table (t, row, col, ...): what a network of
    grids is fitted on. Gaps are NaN; a cube over `most` cells is an error."""
    n = cube.count()
    if n > most:
        raise ValueError(f"[cube_arrays] {n} cells; {most} at most")
    pdf = cube.select("t", "row", "col", *static, *moving, target).toPandas()
    t, r, c = (pd.factorize(pdf[x], sort=True) for x in ("t", "row", "col"))
    grid = np.full((len(static) + len(moving) + 1, len(t[1]), len(r[1]), len(c[1])), np.nan)
    for k, name in enumerate([*static, *moving, target]):
        grid[k, t[0], r[0], c[0]] = pdf[name].to_numpy(float)
    return grid[:-1].transpose(1, 0, 2, 3), grid[-1]


def assimilate_steps(ensemble: DataFrame, observations: DataFrame, radius: float | None = None, seed: int = 1) -> DataFrame:
    """The ensemble (member, row, col, value) after the observations (t, row, col, observed, sd) of each step in turn:
    the state that goes on is the whole ensemble. Each step's is written down, as the next reads it several times."""
    times = [r.t for r in observations.select("t").distinct().orderBy("t").collect()]
    before = None
    for i, t in enumerate(times):
        ensemble = written(assimilate(ensemble, observations.filter(F.col("t") == F.lit(t)).drop("t"), radius, seed + i)[0])
        if before is not None:
            erased(before)
        before = ensemble
    return ensemble


def terrain_slope(cells: DataFrame, value: str, size: float = 1.0) -> DataFrame:
    """cells (row, col, value) with `slope` in degrees, from the neighbours on either side; at an edge or gap from the
    side that there is."""

    def rise(by: str, along: str) -> Column:
        w = Window.partitionBy(by).orderBy(along)
        side = lambda f, step: F.when(f(along).over(w) == F.col(along) + step, f(value).over(w))
        before, after = side(F.lag, -1), side(F.lead, 1)
        whole = (after - before) / (2 * size)
        return F.coalesce(whole, (after - F.col(value)) / size, (F.col(value) - before) / size, F.lit(0.0))

    out = cells.withColumn("dx_", rise("row", "col")).withColumn("dy_", rise("col", "row"))
    return out.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("dx_") ** 2 + F.col("dy_") ** 2)))).drop("dx_", "dy_")


def taper_table(spark: SparkSession, radius: float, steps: int) -> DataFrame:
    d = spark.range(steps + 1).select((F.col("id") * (2.5 * radius / steps)).alias("distance"))
    return d.withColumn("taper", taper("distance", radius))
