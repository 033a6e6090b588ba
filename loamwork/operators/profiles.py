"""Depth profiles: a first-order decay with depth, fitted per profile in grouped pandas functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.functions.columns import depth_curve


def curve(z: np.ndarray, y0: float, y_inf: float, rate: float, decay: float) -> np.ndarray:
    path = rate * z if abs(decay) < 1e-12 else rate * -np.expm1(-decay * z) / decay
    return y_inf + (y0 - y_inf) * np.exp(-path)


def simplex(f, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder-Mead minimum."""
    pts = [start, *[start + 0.1 * max(1.0, abs(start[i])) * np.eye(len(start))[i] for i in range(len(start))]]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) <= 1e-10 * (abs(val[0]) + 1e-10):
            break
        centre = np.mean(pts[:-1], axis=0)
        tries = {t: centre + t * (centre - pts[-1]) for t in (1.0, 2.0, -0.5)}
        at = f(tries[1.0])
        if at < val[0]:
            far = f(tries[2.0])
            pts[-1], val[-1] = (tries[2.0], far) if far < at else (tries[1.0], at)
        elif at < val[-2]:
            pts[-1], val[-1] = tries[1.0], at
        elif (near := f(tries[-0.5])) < val[-1]:
            pts[-1], val[-1] = tries[-0.5], near
        else:
            pts = [pts[0], *[(p + pts[0]) / 2 for p in pts[1:]]]
            val = [val[0], *[f(p) for p in pts[1:]]]
    return pts[int(np.argmin(val))]


def fit_profile(z: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> dict:
    ok = np.isfinite(z) & np.isfinite(y)
    z, y = z[ok], y[ok]
    if len(z) < 3:
        raise ValueError("[fit_profile] three depths at least are needed")

    def loss(t: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            e = y - curve(z, t[3], t[2], np.exp(t[0]), t[1])
            s = float((e**2).sum() + ridge * (t**2).sum())
        return s if np.isfinite(s) else 1e12

    t = simplex(loss, np.array([np.log(0.05), 0.01, y.min(), y[np.argmin(z)]]))
    return {"rate": float(np.exp(t[0])), "decay": float(t[1]), "y_inf": float(t[2]), "y0": float(t[3]), "sse": loss(t)}


def fit_profiles(df: DataFrame, key: str, depth: str, value: str) -> DataFrame:
    """key, rate, decay, y_inf, y0, sse, error of each profile; one that can't be fitted has the reason in error."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fit_profile(pdf[depth].to_numpy(float), pdf[value].to_numpy(float)) | {"error": None}
        except ValueError as e:
            out = {"rate": None, "decay": None, "y_inf": None, "y0": None, "sse": None, "error": str(e)}
        return pd.DataFrame([{key: pdf[key].iloc[0]} | out])

    return df.select(key, depth, value).groupBy(key).applyInPandas(one, f"{key} {dict(df.dtypes)[key]}, rate double, decay double, y_inf double, y0 double, sse double, error string")


def slope(z, y, y_inf: float, rate: float, decay: float):
    """dy/dz of the decay with depth."""
    return -rate * np.exp(-decay * z) * (y - y_inf)


NAMES = ("log_rate", "decay", "y_inf", "y0", "log_sd")


def default_prior(z: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Means and deviations of normal priors: the limit near the deepest value, the surface near the shallowest."""
    spread = max(float(np.std(y, ddof=1)) if len(y) > 1 else 1.0, 1e-3)
    mean = np.array([np.log(0.05), 0.01, y[np.argmax(z)], y[np.argmin(z)], np.log(spread / 2)])
    return {"mean": mean, "sd": np.array([1.0, 0.05, 2 * spread, 2 * spread, 1.0])}


def negative_log_posterior(t: np.ndarray, z: np.ndarray, y: np.ndarray, prior: dict[str, np.ndarray]) -> float:
    """Normal likelihood and normal priors of (log rate, decay, y_inf, y0, log sd); huge where it isn't finite."""
    with np.errstate(all="ignore"):
        e = (y - curve(z, t[3], t[2], np.exp(t[0]), t[1])) / np.exp(t[4])
        p = 0.5 * (e**2).sum() + len(y) * t[4] + 0.5 * (((t - prior["mean"]) / prior["sd"]) ** 2).sum()
    return float(p) if np.isfinite(p) else 1e12


def hessian(f, t: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Second derivatives by central differences."""
    n = len(t)
    h, e = np.zeros((n, n)), np.eye(n) * step * np.maximum(1.0, np.abs(t))
    for i in range(n):
        for j in range(i, n):
            v = f(t + e[i] + e[j]) - f(t + e[i] - e[j]) - f(t - e[i] + e[j]) + f(t - e[i] - e[j])
            h[i, j] = h[j, i] = v / (4 * e[i, i] * e[j, j])
    return h


def nearest_positive(a: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """The symmetric matrix with eigenvalues under the floor raised to it."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def posterior_mode(z: np.ndarray, y: np.ndarray, prior: dict[str, np.ndarray]) -> np.ndarray:
    start = fit_profile(z, y)
    sd = max(1e-3, float(np.sqrt(start["sse"] / max(1, len(z) - 4))))
    t = np.array([np.log(start["rate"]), start["decay"], start["y_inf"], start["y0"], np.log(sd)])
    f = lambda t: negative_log_posterior(t, z, y, prior)
    return simplex(f, simplex(f, t, 1_000), 1_000)  # once more from where it ended


def laplace_profile(z: np.ndarray, y: np.ndarray, draws: int = 2_000, seed: int = 1, prior: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Normal draws around the mode, with the inverse of the second derivatives there as covariance."""
    prior = prior or default_prior(z, y)
    t = posterior_mode(z, y, prior)
    cov = nearest_positive(np.linalg.inv(nearest_positive(hessian(lambda x: negative_log_posterior(x, z, y, prior), t), 1e-8)))
    return np.random.default_rng(seed).multivariate_normal(t, cov, draws, method="eigh")


def sample_profile(z: np.ndarray, y: np.ndarray, draws: int = 4000, seed: int = 1, prior: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Posterior draws (log rate, decay, y_inf, y0, log sd) by adaptive random-walk Metropolis: steps scaled by
    2.38^2 / d on the covariance so far, from max(100, draws / 20) on."""
    prior = prior or default_prior(z, y)
    t, d = posterior_mode(z, y, prior), 5
    rng = np.random.default_rng(seed)
    now, out, cov = -negative_log_posterior(t, z, y, prior), np.empty((draws, d)), np.diag((0.1 * prior["sd"]) ** 2) / d
    for i in range(draws):
        if i > max(100, draws // 20) and i % 50 == 0:
            cov = 2.38**2 / d * (np.cov(out[:i].T) + 1e-8 * np.eye(d))
        step = t + rng.multivariate_normal(np.zeros(d), cov, method="cholesky")
        then = -negative_log_posterior(step, z, y, prior)
        if np.log(rng.random()) < then - now:
            t, now = step, then
        out[i] = t
    return out


def bayes_profiles(df: DataFrame, key: str, depth: str, value: str, method: str = "laplace", draws: int = 500, burn: int = 500, seed: int = 1) -> DataFrame:
    """key, draw_id, log_rate, decay, y_inf, y0, log_sd, error: posterior draws of each profile; a profile is a group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z, y = pdf[depth].to_numpy(float), pdf[value].to_numpy(float)
        ok = np.isfinite(z) & np.isfinite(y)
        try:
            got = laplace_profile(z[ok], y[ok], draws, seed) if method == "laplace" else sample_profile(z[ok], y[ok], draws + burn, seed)[burn:]
        except (ValueError, np.linalg.LinAlgError) as e:
            return pd.DataFrame({key: [pdf[key].iloc[0]], "draw_id": [None], **{n: [None] for n in NAMES}, "error": [str(e)]})
        return pd.DataFrame(got, columns=list(NAMES)).assign(**{key: pdf[key].iloc[0], "draw_id": range(len(got)), "error": None})[[key, "draw_id", *NAMES, "error"]]

    return df.select(key, depth, value).groupBy(key).applyInPandas(one, f"{key} {dict(df.dtypes)[key]}, draw_id int, {', '.join(f'{n} double' for n in NAMES)}, error string")


def bayes_curves(draws: DataFrame, key: str, depths: list[float], noise: bool = False, seed: int = 1) -> DataFrame:
    """key, depth, draw_id, value: each draw's curve at the depths, by the closed form; with noise, of its deviation."""
    rows = draws.filter("error is null").withColumn("depth", F.explode(F.array(*[F.lit(float(d)) for d in depths])))
    y = depth_curve("depth", F.col("y0"), F.col("y_inf"), F.exp("log_rate"), F.col("decay"))
    if noise:
        u = lambda k: (F.pmod(F.xxhash64(key, "draw_id", "depth", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        y = y + F.exp("log_sd") * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))
    return rows.select(key, "depth", "draw_id", y.alias("value"))


def bayes_summary(draws: DataFrame, key: str) -> DataFrame:
    """key, name, mean, sd, q025, q500, q975 of each parameter."""
    long = draws.filter("error is null").select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in NAMES])))
    return long.groupBy(key, "name").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), *[F.percentile("v", F.lit(p)).alias(f"q{round(1000 * p):03d}") for p in (0.025, 0.5, 0.975)])


def curve_intervals(curves: DataFrame, key: str, level: float = 0.9) -> DataFrame:
    """key, depth, mean, low, high of curves' draws."""
    return curves.filter("value is not null").groupBy(key, "depth").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit((1 - level) / 2)).alias("low"), F.percentile("value", F.lit((1 + level) / 2)).alias("high"))
