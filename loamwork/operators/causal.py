"""Sensitivity, effects over time, trends and causal graphs."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.functions.columns import confounder_bias
from loamwork.functions.storage import erased, written
from loamwork.functions.tails import normal_two_sided, t_quantile


def confounded(cases: DataFrame, effect: float, se: float, df: float) -> DataFrame:
    """cases (r2_outcome, r2_exposure: a confounder's partial R2 with either) with the bias and the adjusted effect."""
    bias = confounder_bias(se, df, F.col("r2_outcome"), F.col("r2_exposure"))
    return cases.withColumn("bias", bias).withColumn("adjusted", F.lit(effect) - math.copysign(1, effect) * F.col("bias"))


def sensitivity_grid(spark: SparkSession, effect: float, se: float, df: float, size: int = 51, r2_max: float = 0.5) -> DataFrame:
    """Bias and adjusted effect on a grid of partial R2 with outcome and exposure. The cells are counted, not joined."""
    step = r2_max / (size - 1)
    grid = spark.range(size * size).select((F.floor(F.col("id") / size) * step).alias("r2_outcome"), ((F.col("id") % size) * step).alias("r2_exposure"))
    return confounded(grid, effect, se, df)


def robustness_summary(effect: float, se: float, df: float, q: float = 1.0, alpha: float = 0.05) -> dict:
    t = effect / se

    def value(x: float) -> float:
        f2 = x * x / df
        return 0.5 * (math.sqrt(f2 * f2 + 4 * f2) - f2)

    critical = t_quantile(1 - alpha / 2, df)
    return {"t": t, "rv": value(abs(t) * q), "rv_alpha": value(abs(t) * max(0.0, (abs(t) - critical) / abs(t)))}


def rolling_effect(df: DataFrame, time: str, outcome: str, exposure: str, window: int = 24, step: int = 6, min_n: int = 10) -> DataFrame:
    """The exposure's slope in windows over the index of the distinct times.

    A row is exploded to the windows that it is in (window / step at most) and summed there, so nothing is joined by
    range. Windows with fewer than min_n rows have a null slope.
    """
    index = df.select(time).distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(time)) - 1)
    n_times = index.count()
    starts = list(range(0, max(0, n_times - window) + 1, step))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (window - 1)) / step)).cast("int")
    last = F.least(F.lit(len(starts) - 1), F.floor(F.col("i") / step)).cast("int")
    placed = df.join(F.broadcast(index) if n_times <= 100_000 else index, time).filter(first <= last).withColumn("w", F.explode(F.sequence(first, last)))
    x, y = F.col(exposure).cast("double"), F.col(outcome).cast("double")
    sums = placed.groupBy("w").agg(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.min(F.when(F.col("i") == F.col("w") * step + window // 2, F.col(time))).alias("centre"))
    return sums.select((F.col("w") * step).cast("long").alias("start"), "centre", "n", F.when(F.col("n") >= min_n, F.col("slope")).alias("slope"))


#: Rows of a block of a series whose signs are counted by one task, and values of a series.
BLOCK, MAX_SERIES = 2_048, 20_000_000


def sign_sum(df: DataFrame, order: str, value: str, block: int = BLOCK) -> int:
    return signs(df, order, value, block)[1]


def signs(df: DataFrame, order: str, value: str, block: int = BLOCK) -> tuple[int, int]:
    """The number of values, and of all pairs in order those that rise less those that fall, without making the pairs.

    A series of one block comes to the driver. A longer one is merge-sorted: in each round neighbouring blocks are one group, in which the values of the later half
    are placed among the sorted ones of the earlier half; a block is twice as long in each round, and a group's sorted
    halves are numbers only. Rows that are equal in the order come in the order of their values.
    """
    ranked = df.filter(F.col(value).isNotNull() & F.col(order).isNotNull()).select(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    few = ranked.limit(block + 1).collect()  # one look tells whether that is all
    if len(few) <= block:
        x = np.array([v for _, v in sorted((r.o, r.v) for r in few)])
        return len(x), sum(int(np.sign(x[i + 1 :] - x[i]).sum()) for i in range(len(x) - 1))
    ranked = written(ranked)
    n = ranked.count()
    if n > MAX_SERIES:
        raise ValueError(f"[sign_sum] {n} values; {MAX_SERIES} at most, as the last two halves are one group")
    parts = max(1, -(-n // block))
    # sorted runs of the series, numbered in its order
    runs = ranked.repartitionByRange(parts, "o", "v").sortWithinPartitions("o", "v").withColumn("part", F.spark_partition_id())

    def inside(batches):
        held = [(int(p), float(v)) for pdf in batches for p, v in zip(pdf["part"], pdf["v"], strict=True)]
        if held:
            x = np.array([v for _, v in held])
            total = sum(int(np.sign(x[i + 1 :] - x[i]).sum()) for i in range(len(x) - 1))
            yield pd.DataFrame({"part": [held[0][0]], "s": [total], "values": [np.sort(x).tolist()]})

    blocks = runs.mapInPandas(inside, "part int, s long, values array<double>")
    total, now = 0, written(blocks)
    erased(ranked)
    total += now.agg(F.sum("s").alias("s")).first().s
    width, last = 1, now
    while width < parts:

        def merged(pdf: pd.DataFrame) -> pd.DataFrame:
            sides = {int(side): np.array(v) for side, v in zip(pdf["side"], pdf["values"], strict=True)}
            a, b = sides.get(0, np.zeros(0)), sides.get(1, np.zeros(0))
            s = int(np.searchsorted(a, b, "left").sum() - (len(a) - np.searchsorted(a, b, "right")).sum())
            return pd.DataFrame({"part": [int(pdf["pair"].iloc[0])], "s": [s], "values": [np.sort(np.concatenate([a, b])).tolist()]})

        now = now.withColumn("pair", F.floor(F.col("part") / 2).cast("int")).withColumn("side", F.col("part") % 2).groupBy("pair").applyInPandas(merged, "part int, s long, values array<double>")
        now, before = written(now), last
        erased(before)
        last = now
        total += now.agg(F.sum("s").alias("s")).first().s
        width *= 2
    erased(now)
    return n, int(total)


def mann_kendall(df: DataFrame, order: str, value: str) -> dict:
    """Trend statistic of a series: S, tau, variance without ties' correction, z, p and direction. Under four values
    there is no test."""
    n, s = signs(df, order, value)
    var = n * (n - 1) * (2 * n + 5) / 18
    z = 0.0 if s == 0 or var == 0 else (s - math.copysign(1, s)) / math.sqrt(var)
    p = normal_two_sided(z)
    return {"n": n, "s": s, "tau": s / (n * (n - 1) / 2) if n > 1 else None, "var": var, "z": z, "p": p if n >= 4 else None, "direction": "none" if n < 4 or p >= 0.05 else "up" if s > 0 else "down"}


class Dag:
    """A small directed graph on the driver, with d-separation."""

    def __init__(self, edges: list[tuple[str, str]]):
        self.edges = list(dict.fromkeys(edges))
        self.nodes = sorted({n for e in edges for n in e})
        if not self.acyclic():
            raise ValueError("[Dag] the edges hold a cycle")

    def parents(self, n: str) -> set[str]:
        return {a for a, b in self.edges if b == n}

    def children(self, n: str) -> set[str]:
        return {b for a, b in self.edges if a == n}

    def acyclic(self) -> bool:
        left = set(self.nodes)
        while left:
            free = {n for n in left if not (self.parents(n) & left)}
            if not free:
                return False
            left -= free
        return True

    def descendants(self, n: str) -> set[str]:
        seen, todo = set(), [n]
        while todo:
            for c in self.children(todo.pop()) - seen:
                seen.add(c)
                todo.append(c)
        return seen

    def separated(self, x: str, y: str, given: set[str], cut: set[tuple[str, str]] = frozenset()) -> bool:
        """No active path from x to y: a ball that bounces at colliders opened by what is given."""
        edges = [e for e in self.edges if e not in cut]
        up = {n: {a for a, b in edges if b == n} for n in self.nodes}
        down = {n: {b for a, b in edges if a == n} for n in self.nodes}
        opened, todo = set(given), list(given)
        while todo:
            for p in up[todo.pop()] - opened:
                opened.add(p)
                todo.append(p)
        seen, queue = set(), [(x, "up")]
        while queue:
            n, way = queue.pop()
            if (n, way) in seen:
                continue
            seen.add((n, way))
            if n == y:
                return False
            if way == "up" and n not in given:
                queue += [(p, "up") for p in up[n]] + [(c, "down") for c in down[n]]
            elif way == "down":
                if n not in given:
                    queue += [(c, "down") for c in down[n]]
                if n in opened:
                    queue += [(p, "up") for p in up[n]]
        return True

    def adjustment_set(self, exposure: str, outcome: str) -> list[str] | None:
        """The first of the smallest backdoor sets in sorted order; None if there is none."""
        allowed = [n for n in self.nodes if n not in {exposure, outcome} | self.descendants(exposure)]
        out = {(exposure, c) for c in self.children(exposure)}
        for size in range(len(allowed) + 1):
            for chosen in combinations(allowed, size):
                if self.separated(exposure, outcome, set(chosen), out):
                    return list(chosen)
        return None

    def with_edges(self, claimed: list[tuple[str, str, float]], least: float = 0.7) -> tuple[Dag, list[tuple[str, str]]]:
        """Claimed edges of enough confidence put in one after the other, as long as no cycle arises; and those that
        were left out. A claim without confidence is never put in."""
        edges, rejected = list(self.edges), []
        for a, b, confidence in claimed:
            if confidence is None or not confidence >= least or (a, b) in edges:
                continue
            try:
                Dag([*edges, (a, b)])
            except ValueError:
                rejected.append((a, b))
                continue
            edges.append((a, b))
        return Dag(edges), rejected
