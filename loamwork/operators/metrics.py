"""Prediction scores as one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.columns import col, finite


def rmse(obs: Column | str, pred: Column | str) -> Column:
    ok = finite(obs, pred)
    return F.sqrt(F.avg(F.when(ok, (col(obs) - col(pred)) ** 2)))


def mae(obs: Column | str, pred: Column | str) -> Column:
    return F.avg(F.when(finite(obs, pred), F.abs(col(obs) - col(pred))))


def bias(obs: Column | str, pred: Column | str) -> Column:
    """Positive where predictions are too low."""
    return F.avg(F.when(finite(obs, pred), col(obs) - col(pred)))


def r2(obs: Column | str, pred: Column | str) -> Column:
    """1 - SSres / SStot; null for one pair or a constant observation; below 0 where worse than the mean."""
    ok = finite(obs, pred)
    n, total = F.count(F.when(ok, 1)), F.var_pop(F.when(ok, col(obs)))
    return F.when((n > 1) & (total > 0), 1 - F.avg(F.when(ok, (col(obs) - col(pred)) ** 2)) / total)


def coverage(obs: Column | str, lower: Column | str, upper: Column | str) -> Column:
    """Share of observations inside their interval, bounds included."""
    return F.avg(F.when(finite(obs, lower, upper), col(obs).between(col(lower), col(upper)).cast("double")))


def interval_score(obs: Column | str, lower: Column | str, upper: Column | str, alpha: float = 0.05) -> Column:
    y, lo, hi = col(obs), col(lower), col(upper)
    below, above = F.greatest(lo - y, F.lit(0.0)), F.greatest(y - hi, F.lit(0.0))
    return F.avg(F.when(finite(y, lo, hi), (hi - lo) + 2 / alpha * below + 2 / alpha * above))


def score(df: DataFrame, by: list[str], obs: str = "observed", pred: str = "predicted", lower: str | None = None, upper: str | None = None, interval: float = 0.95) -> DataFrame:
    """One row per group: n, rmse, mae, r2, bias and, with bounds, picp and interval_score. One aggregate, so partial
    sums are all that is shuffled."""
    ok = finite(obs, pred)
    out = [F.count(F.when(ok, 1)).alias("n"), rmse(obs, pred).alias("rmse"), mae(obs, pred).alias("mae"), r2(obs, pred).alias("r2"), bias(obs, pred).alias("bias")]
    if lower and upper:
        out += [coverage(obs, lower, upper).alias("picp"), interval_score(obs, lower, upper, round(1 - interval, 12)).alias("interval_score")]
    return df.groupBy(*by).agg(*out)


def calibration_error(df: DataFrame, obs: str, quantiles: str, levels: list[float]) -> DataFrame:
    """Per level the share of observations at or below the predicted quantile and its distance to the level; the mean
    distance is the expected calibration error. quantiles: an array column in the levels' order; rows with a quantile or
    observation that isn't finite are left out."""
    whole = df.filter(finite(obs) & (F.size(quantiles) == len(levels)) & F.forall(quantiles, lambda q: finite(q)))
    below = [F.avg((F.col(obs) <= F.col(quantiles)[i]).cast("double")) for i in range(len(levels))]
    one = whole.agg(F.array(*[F.struct(F.lit(level).alias("level"), b.alias("share")) for level, b in zip(levels, below, strict=True)]).alias("l"))
    return one.select(F.inline("l")).withColumn("gap", F.abs(F.col("share") - F.col("level")))


def median_deviation(df: DataFrame, by: list[str], value: str, floor: float = 1e-6) -> DataFrame:
    """Median of each group and the median distance to it, at least `floor`: two aggregates, the first joined back."""
    middle = df.groupBy(*by).agg(F.median(value).alias("median"))
    met = df.join(middle, by)
    return met.groupBy(*by, "median").agg(F.greatest(F.lit(floor), F.median(F.abs(F.col(value) - F.col("median")))).alias("deviation"))


def frequencies(df: DataFrame, value: str, top: int | None = None) -> DataFrame:
    """Values by how often they occur, ties by value."""
    out = df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value)
    return out.limit(top) if top else out


def varying_columns(df: DataFrame, names: list[str], least: float = 1e-12) -> list[str]:
    """The columns whose variance is above `least`, by one aggregate."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in names]).first()
    return [c for c in names if row[c] is not None and row[c] > least]
