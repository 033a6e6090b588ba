"""Linear estimates from distributed cross-moments: one aggregate in Spark, a small solve on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.columns import finite
from loamwork.functions.storage import written
from loamwork.functions.tails import chi_square_upper, f_upper, t_quantile
from loamwork.operators.rows import numbered

MAX_COLUMNS = 200


def cross_moments(df: DataFrame, names: list[str], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """X'X of the columns with an intercept first, over rows in which all are finite, and the number of rows."""
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"[cross_moments] {len(names)} columns; at most {MAX_COLUMNS} are summed in one pass")
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(w * cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.filter(finite(*[F.col(c).cast("double") for c in names])).agg(F.count(F.lit(1)).alias("n"), *sums).first()
    out = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out, row["n"]


def ols(df: DataFrame, outcome: str, regressors: list[str], level: float = 0.95) -> dict:
    """Coefficients, standard errors and t intervals by name, residual sum of squares and degrees of freedom."""
    m, n = cross_moments(df, [*regressors, outcome])
    k = len(regressors) + 1
    if n <= k:
        raise ValueError(f"[ols] {n} complete rows for {k} coefficients")
    inverse = np.linalg.inv(m[:k, :k])
    beta = inverse @ m[:k, k]
    rss = float(m[k, k] - beta @ m[:k, k])
    se = np.sqrt(np.maximum(rss, 0) / (n - k) * np.diag(inverse))
    t = t_quantile(0.5 + level / 2, n - k)
    names = ["intercept", *regressors]
    return {"n": n, "df": n - k, "rss": rss, "beta": dict(zip(names, beta, strict=True)), "se": dict(zip(names, se, strict=True)), "interval": {c: (b - t * s, b + t * s) for c, b, s in zip(names, beta, se, strict=True)}}


def adjusted_effect(df: DataFrame, outcome: str, exposure: str, adjust: list[str]) -> dict:
    """The exposure's slope alone and given the adjustment set, with its interval."""
    naive, fit = ols(df, outcome, [exposure]), ols(df, outcome, [exposure, *adjust])
    return {"naive": naive["beta"][exposure], "adjusted": fit["beta"][exposure], "se": fit["se"][exposure], "interval": fit["interval"][exposure], "df": fit["df"], "n": fit["n"]}


def effects_by_group(df: DataFrame, by: str, outcome: str, exposure: str, adjust: list[str]) -> DataFrame:
    """by, naive, adjusted: the exposure's slopes in every group, from one pass; a group's moments are a row that an
    executor solves."""
    names = [exposure, *adjust, outcome]
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    p = len(cols)
    sums = [F.sum(cols[i] * cols[j]) for i in range(p) for j in range(p)]
    rows = df.filter(finite(*cols[1:])).groupBy(by).agg(F.array(*sums).alias("m_"))

    def solve(batches):
        for pdf in batches:
            out = []
            for v in pdf["m_"]:
                m = np.array(v).reshape(p, p)
                one = lambda k: float(np.linalg.lstsq(m[:k, :k], m[:k, -1], rcond=None)[0][1])
                out.append((one(2), one(p - 1)))
            yield pdf[[by]].assign(naive=[a for a, _ in out], adjusted=[b for _, b in out])

    return rows.mapInPandas(solve, f"`{by}` {dict(df.dtypes)[by]}, naive double, adjusted double")


def _first_stage(m: np.ndarray, n: int, at: dict[str, int], exposure: str, instruments: list[str], covariates: list[str]) -> dict:
    """The F test from a moment matrix that has all columns."""
    y = at[exposure]

    def rss(names: list[str]) -> float:
        x = [0, *[at[c] for c in names]]
        return float(m[y, y] - m[x, y] @ np.linalg.solve(m[np.ix_(x, x)], m[x, y]))

    q, df = len(instruments), n - len(covariates) - len(instruments) - 1
    full, reduced = rss([*covariates, *instruments]), rss(covariates)
    f = (reduced - full) / q / (full / df)
    return {"f": f, "p": f_upper(f, q, df), "partial_r2": (reduced - full) / reduced, "weak": f < 10}


def first_stage(df: DataFrame, exposure: str, instruments: list[str], covariates: list[str]) -> dict:
    """F test of the instruments in the exposure's regression, from one moment matrix; weak below 10."""
    names = [*covariates, *instruments, exposure]
    m, n = cross_moments(df, names)
    return _first_stage(m, n, {c: i + 1 for i, c in enumerate(names)}, exposure, instruments, covariates)


def two_stage(df: DataFrame, outcome: str, exposure: str, instruments: list[str], covariates: list[str] | None = None) -> dict:
    """Two-stage least squares from one moment matrix, with first stage and over-identification test."""
    covariates = covariates or []
    names = [*covariates, *instruments, exposure, outcome]
    m, n = cross_moments(df, names)
    at = {c: i + 1 for i, c in enumerate(names)}
    x = [0, *[at[c] for c in covariates], at[exposure]]
    z = [0, *[at[c] for c in covariates], *[at[c] for c in instruments]]
    y = at[outcome]
    zz, zx, zy = m[np.ix_(z, z)], m[np.ix_(z, x)], m[z, y]
    projected = zx.T @ np.linalg.solve(zz, zx)
    beta = np.linalg.solve(projected, zx.T @ np.linalg.solve(zz, zy))
    rss = float(m[y, y] - 2 * beta @ m[x, y] + beta @ m[np.ix_(x, x)] @ beta)
    se = math.sqrt(rss / (n - len(x)) * np.linalg.inv(projected)[-1, -1])
    ze = zy - zx @ beta  # instruments times residuals
    j = n * float(ze @ np.linalg.solve(zz, ze)) / rss
    df_over = len(instruments) - 1
    effect = float(beta[-1])
    return {
        "effect": effect, "se": se, "low": effect - 1.96 * se, "high": effect + 1.96 * se, "n": n, "df": n - len(x),
        "first_stage": _first_stage(m, n, at, exposure, instruments, covariates), "sargan": j if df_over else None, "sargan_df": df_over, "sargan_p": chi_square_upper(j, df_over) if df_over else None,
    }


def leverage(df: DataFrame, pool: DataFrame, regressors: list[str]) -> DataFrame:
    """pool with each row's leverage x'(X'X)^-1 x against df and the variance it would take away, lev / (1 + lev)."""
    m, _ = cross_moments(df, regressors)
    inverse = np.linalg.inv(m)
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in regressors]]
    lev = sum((F.lit(float(inverse[i, j])) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    return pool.withColumn("leverage", lev).withColumn("reduction", F.col("leverage") / (1 + F.col("leverage")))


def poisson_weight(key: Column, draw: Column, seed: int) -> Column:
    """How often a key counts in a draw: Poisson(1), fixed by the key, the draw and the seed alone."""
    u = (F.pmod(F.xxhash64(key, draw, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    steps, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    return sum(((u > s).cast("double") for s in steps), F.lit(0.0))


def resampled(df: DataFrame, cluster: str, draws: int, seed: int = 1) -> DataFrame:
    """draw, the cluster, times: in each draw as many clusters as there are, drawn with replacement; those that were not
    drawn have no row, so that times sum to the number of clusters in every draw.

    A pick is a hash of the seed, the draw and its number, so that picks are counted where they are made, whatever the
    partitions; clusters are numbered in their order. A missing cluster is none.
    """
    index = written(numbered(df.filter(F.col(cluster).isNotNull()).select(cluster).distinct(), [cluster], "k_"))
    n = index.count()
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("draw").cast("string"), (F.col("id") % max(1, n)).cast("string")))
    share = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
    picks = df.sparkSession.range(draws * n).withColumn("draw", F.floor(F.col("id") / max(1, n)))
    counts = picks.select("draw", (F.floor(share * n) + 1).alias("k_")).groupBy("draw", "k_").agg(F.count(F.lit(1)).alias("times"))
    return counts.join(index, "k_").select("draw", cluster, "times")


def bootstrap_effect(df: DataFrame, outcome: str, exposure: str, adjust: list[str], cluster: str, draws: int = 100, seed: int = 1) -> list[float]:
    """Slopes of a cluster bootstrap: each draw takes as many whole clusters as there are, with replacement. Rows are
    read once, for the moments of each cluster; draws weigh these."""
    names = [exposure, *adjust, outcome]
    rows = df.filter(finite(*[F.col(c).cast("double") for c in names]))
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    by_cluster = rows.groupBy(cluster).agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs])
    times = resampled(df, cluster, draws, seed)
    sums = times.join(by_cluster, cluster).groupBy("draw").agg(*[F.sum(F.col("times") * F.col(f"s{i}_{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    out = []
    k = len(cols) - 1
    for r in sums.orderBy("draw").collect():  # one small row a draw
        m = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        try:
            out.append(float(np.linalg.solve(m[:k, :k], m[:k, k])[1]))
        except np.linalg.LinAlgError:
            continue
    return out
