"""Posterior draws as a long table (query_id, draw_id, value) and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators.quantiles import quantiles

LEVELS = [round(0.05 * i, 2) for i in range(1, 20)]


def quantile_name(p: float) -> str:
    return f"q{round(100 * p):02d}"


def from_arrays(df: DataFrame, query_id: str, draws: str) -> DataFrame:
    return df.select(F.col(query_id).alias("query_id"), F.posexplode(draws).alias("draw_id", "value"))


def from_gaussian(df: DataFrame, query_id: str, mean: str, sd: str, draws: int = 500, seed: int = 1) -> DataFrame:
    """Seeded normal draws; the seed and the query alone fix a draw, not the partitioning."""
    u = lambda k: (F.pmod(F.xxhash64("query_id", "draw_id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    long = df.select(F.col(query_id).alias("query_id"), F.col(mean).alias("m_"), F.col(sd).alias("s_"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw_id"))
    z = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))
    return long.withColumn("value", F.col("m_") + F.col("s_") * z).drop("m_", "s_")


def summary(draws: DataFrame, probs: tuple[float, ...] = (0.05, 0.5, 0.95), query: str = "query_id", value: str = "value") -> DataFrame:
    """Mean, sd (n - 1) and exact quantiles of each query, which may have any number of draws."""
    out = quantiles(draws, [query], value, list(probs), [F.count(value).alias("n_draws"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")])
    return out.select(query, "n_draws", "mean", "sd", *[F.col("q")[i].alias(quantile_name(p)) for i, p in enumerate(probs)])


def split_variance(draws: DataFrame, aleatoric: Column | float = 0.0) -> DataFrame:
    """Epistemic sd from the draws, and total sd with the aleatoric part."""
    return draws.groupBy("query_id").agg(F.stddev_samp("value").alias("epistemic_sd")).withColumn("total_sd", F.sqrt(F.col("epistemic_sd") ** 2 + F.lit(aleatoric) ** 2))


def crps(draws: DataFrame, truth: DataFrame, query: str = "query_id", value: str = "value", observed: str = "observed") -> DataFrame:
    """Continuous ranked probability score of each query: mean |x - y| less half the mean distance of two draws, which
    sorted draws give without pairs."""
    met = draws.join(truth, query)
    w = Window.partitionBy(query)
    ranked = met.select(query, value, observed, F.row_number().over(w.orderBy(value)).alias("i"), F.count(F.lit(1)).over(w).alias("s"))
    spread = F.sum((2 * F.col("i") - F.col("s") - 1) * F.col(value)) / (F.first("s") * F.first("s"))
    return ranked.groupBy(query).agg((F.avg(F.abs(F.col(value) - F.col(observed))) - spread).alias("crps"))


def interval_coverage(draws: DataFrame, truth: DataFrame, levels: list[float] = LEVELS, query: str = "query_id", value: str = "value", observed: str = "observed") -> DataFrame:
    """Per nominal level the empirical coverage of central intervals and their mean width. All levels' quantiles come
    from one aggregate of the draws."""
    probs = sorted({round(p, 6) for level in levels for p in ((1 - level) / 2, 1 - (1 - level) / 2)})
    at = {p: i for i, p in enumerate(probs)}
    cut = quantiles(draws, [query], value, probs).join(truth, query)
    bounds = [(level, F.col("q")[at[round((1 - level) / 2, 6)]], F.col("q")[at[round(1 - (1 - level) / 2, 6)]]) for level in levels]
    rows = cut.select(observed, F.inline(F.array(*[F.struct(F.lit(level).alias("level"), lo.alias("lo"), hi.alias("hi")) for level, lo, hi in bounds])))
    return rows.groupBy("level").agg(F.avg(F.col(observed).between(F.col("lo"), F.col("hi")).cast("double")).alias("picp"), F.avg(F.col("hi") - F.col("lo")).alias("mpiw"))


def reliability(coverage: DataFrame) -> DataFrame:
    return coverage.select("level", "picp", (F.col("picp") - F.col("level")).alias("gap"))
