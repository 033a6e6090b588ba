"""Which samples to take next: greedy batches, rankings, gates, designs and the learning loop."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.columns import finite, min_max_table
from loamwork.functions.storage import erased, written

#: Rows of a pool that the driver holds of the highest scores, and of the farthest ones, to pick several in a pass.
HELD = 512


def complete(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(finite(*[F.col(c).cast("double") for c in names]))


#: Numbers of a block of chosen vectors that is sent to all tasks.
BLOCK_NUMBERS = 1_000_000


def distance_to_set(pool: DataFrame, chosen: DataFrame, key: str, vector: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, distance of each pool row to the nearest of the chosen ones, however many these are; and the columns of keep.

    The chosen vectors come to the driver a block at a time and are sent to the tasks, which keep the least distance so
    far in a column: no row is paired with a row in a join, and no shuffle is made. A set of one block is one pass.
    """
    out, held, size = pool.select(*dict.fromkeys([key, vector, *keep])).withColumn("d_", F.lit(float("inf"))), [], 0
    spark = pool.sparkSession

    def nearer(rows: DataFrame, block: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            for pdf in batches:
                x = np.array(pdf[vector].tolist(), float) if len(pdf) else np.zeros((0, block.shape[1]))
                least = pdf["d_"].to_numpy(float)
                for i in range(0, len(x), 512):
                    part = x[i : i + 512]
                    # differences, not products: a vector is at distance 0 from itself
                    for j in range(0, len(sent.value), 256):
                        least[i : i + 512] = np.minimum(least[i : i + 512], np.sqrt(((part[:, None] - sent.value[None, j : j + 256]) ** 2).sum(axis=-1)).min(axis=1))
                yield pdf.assign(d_=least)

        return rows.mapInPandas(run, rows.schema)

    for r in chosen.select(vector).toLocalIterator():
        held.append([float(v) for v in r[0]])
        size += len(r[0])
        if size >= BLOCK_NUMBERS:
            out, held, size = nearer(out, np.array(held)), [], 0
    if held:
        out = nearer(out, np.array(held))
    return out.select(key, *keep, F.when(F.col("d_") < float("inf"), F.col("d_")).alias("distance"))


def rank_by(df: DataFrame, score: Column, key: str, n: int | None = None) -> DataFrame:
    """Rows by descending score, ties by key; with n the first n (a top-k, not a full sort)."""
    out = df.withColumn("score", score).orderBy(F.col("score").desc_nulls_last(), F.col(key))
    return out.limit(n) if n else out


def _euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _unit(d: np.ndarray | float, low: float, high: float):
    """d scaled to 0..1 between the pool's least and largest; 1 for all where these are one or there is no distance yet."""
    return (d - low) / (high - low) if np.isfinite(high) and high > low else np.ones_like(d, dtype=float)


def greedy_batch(
    pool: DataFrame, key: str, names: list[str], uncertainty: str, n: int, labelled: DataFrame | None = None, strategy: str = "hybrid", alpha: float = 0.7, cost: str | None = None, cost_weight: float = 0.3, held: int = HELD
) -> list:
    """Keys of n rows picked one by one: uncertainty, diverse, hybrid (alpha u + (1 - alpha) d) or cost (hybrid less the
    weighted cost). d is the distance, in z-scores of pool and labelled rows, to the nearest labelled or picked row,
    scaled to 0..1 in every round; ties go by key.

    The pool may be of any size: its rows keep their least distance so far in a column. A pass updates it by the picks
    since the last one, and brings the `held` rows of the highest scores and the farthest ones to the driver. Of these
    further picks are made there, as long as no other row can be better: distances only become less, so that another
    row's score is bounded by its last one and the change of scale. Only then is there another pass; each makes a pick
    at least.
    """
    pool = complete(pool, [*names, uncertainty, *([cost] if cost else [])])
    z_of = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in names])
    known = complete(labelled, names) if labelled is not None else None
    both = z_of(pool) if known is None else z_of(pool).unionByName(z_of(known))
    spread = both.agg(*[f(c).alias(f"{t}_{c}") for c in names for t, f in (("m", F.avg), ("s", F.stddev_samp))]).first()  # one row
    sd = {c: spread[f"s_{c}"] if spread[f"s_{c}"] and spread[f"s_{c}"] > 0 else 1.0 for c in names}
    z = F.array(*[(F.col(c).cast("double") - F.lit(spread[f"m_{c}"])) / F.lit(sd[c]) for c in names])
    parts = {"u_": F.col(uncertainty).cast("double"), "c_": F.col(cost).cast("double") if cost else F.lit(0.0)}
    ends = pool.select(*[v.alias(k) for k, v in parts.items()]).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{t}{c}") for c in parts for t, f in (("lo", F.min), ("hi", F.max))]).first()  # one row
    scaled = {k: (v - F.lit(ends[f"lo{k}"])) / F.lit(ends[f"hi{k}"] - ends[f"lo{k}"]) if ends.n and ends[f"hi{k}"] > ends[f"lo{k}"] else F.lit(1.0) for k, v in parts.items()}
    u, c = scaled["u_"], scaled["c_"]
    fixed, weight = {"uncertainty": (u, 0.0), "diverse": (F.lit(0.0), 1.0), "hybrid": (alpha * u, 1 - alpha), "cost": (alpha * u - cost_weight * c, 1 - alpha)}[strategy]
    rows = pool.select(key, z.alias("z_"), fixed.alias("fixed_"))
    if known is not None and not known.isEmpty():
        rows = distance_to_set(rows, known.select(z.alias("z_")), key, "z_", ("z_", "fixed_")).withColumnRenamed("distance", "d_")
    else:
        rows = rows.withColumn("d_", F.lit(float("inf")))
    table = written(rows.select(key, "z_", "fixed_", "d_").withColumn("taken_", F.lit(False)))

    def nearer(df: DataFrame, new: list[tuple]) -> DataFrame:
        keys, points = {k for k, _ in new}, [p for _, p in new]

        def run(batches):
            for pdf in batches:
                x, d = np.array(pdf["z_"].tolist(), float).reshape(len(pdf), len(names)), pdf["d_"].to_numpy(float)
                for p in points:
                    d = np.minimum(d, _euclid(x, p))
                yield pdf.assign(d_=d, taken_=pdf["taken_"] | pdf[key].isin(keys))

        return df.mapInPandas(run, df.schema)

    picked, new = [], []
    total = min(n, ends.n)
    while len(picked) < total:
        if new:
            table, old, new = written(nearer(table, new)), table, []
            erased(old)
        span = table.agg(F.min("d_").alias("lo"), F.max("d_").alias("hi")).first()  # one row
        unit = (F.col("d_") - span.lo) / (span.hi - span.lo) if np.isfinite(span.hi) and span.hi > span.lo else F.lit(1.0)
        free = table.filter(~F.col("taken_")).withColumn("score_", F.col("fixed_") + F.lit(weight) * unit)
        best = free.orderBy(F.col("score_").desc(), F.col(key)).limit(held).collect()
        far = free.orderBy(F.col("d_").desc(), F.col(key)).limit(held).collect()
        # no row that stays away has a score over `least` or a distance over `near`
        least, near = (best[-1].score_, far[-1].d_) if len(best) == held else (-np.inf, 0.0)
        rows_of = {r[key]: r for r in [*best, *far]}
        keys = sorted(rows_of)
        x, d, f = np.array([rows_of[k].z_ for k in keys], float), np.array([rows_of[k].d_ for k in keys], float), np.array([rows_of[k].fixed_ for k in keys], float)
        out, low, high = np.zeros(len(keys), bool), span.lo, span.hi
        while len(picked) < total and not out.all():
            score = np.where(out, -np.inf, f + weight * _unit(d, low, high))
            i = int(np.argmax(score))
            if new:
                gains = [float(_unit(np.array(v), low, high) - _unit(np.array(v), span.lo, span.hi)) for v in (span.lo, near)]
                if least > -np.inf and not score[i] > least + weight * max(0.0, *gains):
                    break
            picked.append(keys[i])
            new.append((keys[i], x[i]))
            out[i] = True
            d = np.minimum(d, _euclid(x, x[i]))
            low, high = 0.0, float(d.max())
            if least > -np.inf and not high >= near:
                break  # the largest distance may be elsewhere
    erased(table)
    return picked


def joint_variance_batch(pool: DataFrame, key: str, predictions: str, noise: float, n: int, held: int = HELD) -> list:
    """Keys of n rows, each of the greatest variance given those before it; predictions: an array of the members' answers
    a row, all of one length; ties go by key.

    A row's variance given the picks is its own less the squares of its entries in an incremental Cholesky factor, which
    it keeps in an array. The pool may be of any size: a pass brings the `held` rows of the greatest variances to the
    driver, where picks go on as long as the best is over all that stayed away, since variances only become less. Then
    the next pass gives all rows their entries of the new picks.
    """
    mean = F.aggregate("p_", F.lit(0.0), lambda a, v: a + v) / F.size("p_")
    rows = pool.select(key, F.col(predictions).cast("array<double>").alias("p_")).filter(F.size("p_") > 0)
    away = F.transform("p_", lambda v: (v - F.col("mean_")) / F.sqrt(F.greatest(F.lit(1), F.size("p_") - 1)))
    rows = rows.withColumn("mean_", mean).select(key, away.alias("a_"))
    rows = rows.withColumn("v_", F.aggregate("a_", F.lit(0.0), lambda s, v: s + v * v) + F.lit(float(noise)))
    table = written(rows.withColumns({"f_": F.array().cast("array<double>"), "taken_": F.lit(False)}))

    def entries(a: np.ndarray, f: np.ndarray, pick: tuple) -> np.ndarray:
        """What each row has in the pick's column of the factor."""
        _, of, before, v = pick
        return (a @ of - f[:, : len(before)] @ before) / np.sqrt(max(v, 1e-12))

    def told(df: DataFrame, new: list[tuple]) -> DataFrame:
        keys = {p[0] for p in new}

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    a, f, v = np.array(pdf["a_"].tolist(), float), np.array(pdf["f_"].tolist(), float).reshape(len(pdf), -1), pdf["v_"].to_numpy(float)
                    for p in new:
                        c = entries(a, f, p)
                        f, v = np.column_stack([f, c]), np.maximum(v - c**2, 1e-12)
                    yield pdf.assign(f_=f.tolist(), v_=v, taken_=pdf["taken_"] | pdf[key].isin(keys))

        return df.mapInPandas(run, df.schema)

    picked, new = [], []
    total = min(n, table.count())
    while len(picked) < total:
        if new:
            table, old, new = written(told(table, new)), table, []
            erased(old)
        top = table.filter(~F.col("taken_")).orderBy(F.col("v_").desc(), F.col(key)).limit(held).collect()
        least = top[-1].v_ if len(top) == held else -np.inf
        top = sorted(top, key=lambda r: r[key])
        a, f, v = np.array([r.a_ for r in top], float), np.array([r.f_ for r in top], float).reshape(len(top), -1), np.array([r.v_ for r in top], float)
        while len(picked) < total:
            i = int(np.argmax(v))
            if v[i] == -np.inf or new and least > -np.inf and not v[i] > least:
                break
            new.append((top[i][key], a[i], f[i], float(v[i])))
            picked.append(top[i][key])
            c = entries(a, f, new[-1])
            f, v = np.column_stack([f, c]), np.where(np.isfinite(v), np.maximum(v - c**2, 1e-12), v)
            v[i] = -np.inf
    erased(table)
    return picked


def range_gate(pred: Column, low: Column, high: Column, safety: float = 1.5, clip: tuple[float, float] | None = None) -> Column:
    """Whether a prediction lies in the envelope, widened by (safety - 1) of its span on either side."""
    span = F.greatest(F.abs(high - low), F.lit(1e-9))
    lo, hi = low - (safety - 1) * span, high + (safety - 1) * span
    if clip:
        lo, hi = F.greatest(lo, F.lit(clip[0])), F.least(hi, F.lit(clip[1]))
    return pred.between(lo, hi)


def grid_priority(cells: DataFrame, gain: str, sd: str, n: int, rule: str = "scaled", among: DataFrame | None = None) -> DataFrame:
    """Cells (row, col) by gain, gain * sd, or the product of both scaled to 0..1; only those among the candidates."""
    if rule == "scaled":
        unit = min_max_table(cells.withColumns({"g_": F.col(gain), "s_": F.col(sd)}), ["g_", "s_"], "zero")
        scored = unit.withColumn("score", F.col("g_") * F.col("s_")).drop("g_", "s_")
    else:
        scored = cells.withColumn("score", {"gain": F.col(gain), "product": F.col(gain) * F.col(sd)}[rule])
    if among is not None:
        scored = scored.join(among.select("row", "col").distinct(), ["row", "col"], "left_semi")
    return scored.orderBy(F.col("score").desc_nulls_last(), "col", "row").limit(n)


def latin_design(df: DataFrame, key: str, names: list[str], n: int, seed: int = 1, tries: int = 64) -> DataFrame:
    """n rows that cover the n strata (quantile ranges) of each column as evenly as can be found.

    A row is the tuple of its strata; of each tuple that occurs, n rows of lowest seeded hash are candidates, so what
    comes to the driver is bounded by the tuples, at most `tries` * n of them by hash. There rows are swapped as long as
    the strata that no row is in become fewer. Fewer complete rows than n are an error.
    """
    whole = complete(df, names)
    rows = whole.count()
    if rows < n:
        raise ValueError(f"[latin_design] {rows} complete rows for a design of {n}")
    cuts = whole.agg(*[F.percentile_approx(c, F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000).alias(c) for c in names]).first() if n > 1 else None
    stratum = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts[c])), lambda q: q < F.col(c))) if n > 1 else F.lit(0)
    placed = whole.select(key, F.xxhash64(key, F.lit(seed)).alias("h_"), F.array(*map(stratum, names)).alias("s_"))
    w = Window.partitionBy("s_").orderBy("h_", key)
    firsts = placed.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= n)
    few = firsts.orderBy("r_", "h_", key).limit(max(n, tries * n)).collect()
    strata, keys = np.array([r.s_ for r in few]), [r[key] for r in few]
    rng = np.random.default_rng(seed)

    def empty(chosen: list[int]) -> int:
        return sum(n - len(set(strata[chosen, c].tolist())) for c in range(len(names)))

    best = list(range(n))
    least = empty(best)
    for _ in range(tries * n):
        if not least:
            break
        # take out a row whose strata others have as well, put in one that fills an empty stratum
        counts = [np.bincount(strata[best, c], minlength=n) for c in range(len(names))]
        worth = [sum(counts[c][strata[i, c]] == 1 for c in range(len(names))) for i in best]
        out = int(rng.choice(np.flatnonzero(np.array(worth) == min(worth))))
        rest = best[:out] + best[out + 1 :]
        gains = sum((np.bincount(strata[rest, c], minlength=n)[strata[:, c]] == 0).astype(int) for c in range(len(names)))
        gains[rest] = -1
        new = [*rest, int(rng.choice(np.flatnonzero(gains == gains.max())))]
        if empty(new) <= least:
            best, least = new, empty(new)
    return whole.filter(F.col(key).isin([keys[i] for i in best]))


def learning_loop(labelled: DataFrame, pool: DataFrame, key: str, fit: Callable, query: Callable, oracle: Callable, budget: int, batch: int, stop_rmse: float | None = None) -> list[dict]:
    """fit(labelled) -> (model, rmse); query(model, pool, n) -> keys; oracle(rows) -> labelled rows. History by round."""
    history = []
    while True:
        model, rmse = fit(labelled)
        history.append({"iteration": len(history), "n_labelled": labelled.count(), "rmse": rmse})
        if budget <= 0 or stop_rmse is not None and rmse <= stop_rmse:
            return history
        keys = query(model, pool, min(batch, budget))
        if not keys:
            return history
        rows = pool.filter(F.col(key).isin(keys))
        labelled, pool, budget = labelled.unionByName(oracle(rows)), pool.filter(~F.col(key).isin(keys)), budget - len(keys)
