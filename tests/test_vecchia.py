"""The spatial regression with near sites against the dense one."""

import numpy as np
import pytest

from loamwork.operators import neighbours, vecchia


def field(n, seed, phi=3.0, s2=2.0, t2=0.2):
    rng = np.random.default_rng(seed)
    place, x = rng.random((n, 2)), rng.normal(size=n)
    cov = s2 * np.exp(-phi * np.sqrt(((place[:, None] - place[None]) ** 2).sum(-1))) + t2 * np.eye(n)
    return place, x, 1.0 + 2.0 * x + np.linalg.cholesky(cov) @ rng.normal(size=n)


def table(spark, place, x, y, begin=0):
    return spark.createDataFrame([(begin + i, float(p[0]), float(p[1]), float(a), float(b)) for i, (p, a, b) in enumerate(zip(place, x, y, strict=True))], "id long, lon double, lat double, x double, y double")


def dense(place, x, y, phi, nugget):
    """Coefficients, scale and log density of the whole covariance."""
    n, design = len(y), np.column_stack([np.ones(len(y)), x])
    r = (1 - nugget) * np.exp(-phi * np.sqrt(((place[:, None] - place[None]) ** 2).sum(-1)))
    r[np.diag_indices(n)] = 1 + 1e-8
    inverse = np.linalg.inv(r)
    xx = design.T @ inverse @ design
    beta = np.linalg.solve(xx, design.T @ inverse @ y)
    rss = (y - design @ beta) @ inverse @ (y - design @ beta)
    shape, scale = vecchia.SHAPE + (n - 2) / 2, vecchia.SCALE + rss / 2
    return beta, scale, -0.5 * np.linalg.slogdet(r)[1] - 0.5 * np.linalg.slogdet(xx)[1] - shape * np.log(scale), r, inverse


GRID = {"ranges": (0.2, 0.5, 1.0), "nuggets": (0.1, 0.4)}


def test_all_sites_near_is_the_dense_fit(spark):
    place, x, y = field(200, 1)
    got = vecchia.fit(table(spark, place, x, y).repartition(4), "id", "lon", "lat", ["x"], "y", near=250, **GRID)
    for g, (phi, nugget) in enumerate(got.grid):
        beta, scale, value, *_ = dense(place, x, y, phi, nugget)
        assert np.allclose(got.beta[g], beta, atol=1e-6) and np.isclose(got.scale[g], scale, rtol=1e-6) and np.isclose(got.value[g], value, atol=1e-4)
    draws = got.draws(400)
    assert abs(draws["beta"][:, 1].mean() - 2) < 0.2 and 0 < draws["t2"].mean() < draws["s2"].mean()


def test_few_near_sites_are_close_to_the_dense_fit(spark):
    place, x, y = field(200, 2)
    df = table(spark, place, x, y)
    got = vecchia.fit(df, "id", "lon", "lat", ["x"], "y", near=25, **GRID)
    values = np.array([dense(place, x, y, *g)[2] for g in got.grid])
    assert got.best == int(np.argmax(values)) and np.abs(got.value - values).max() < 0.02 * np.abs(values).max()
    beta, scale, _, r, inverse = dense(place, x, y, *got.grid[got.best])
    doubt = np.sqrt(scale / (got.shape - 1) * np.diag(got.unit[got.best]))
    assert (np.abs(got.beta[got.best] - beta) < 0.25 * doubt).all()
    new = np.random.default_rng(3).random((40, 2))
    phi, nugget = got.grid[got.best]
    cross = (1 - nugget) * np.exp(-phi * np.sqrt(((new[:, None] - place[None]) ** 2).sum(-1)))
    want = beta[0] + cross @ inverse @ (y - beta[0] - beta[1] * x)
    sd = np.sqrt(scale / (got.shape - 1) * (1 - (cross @ inverse * cross).sum(1)))
    out = vecchia.predict(got, df, table(spark, new, np.zeros(40), np.zeros(40)), "id", "lon", "lat", ["x"], "y", near=25)
    rows = {r.id: r for r in out.collect()}
    assert np.abs([rows[i]["mean"] - want[i] for i in range(40)]).max() < 0.15 and np.allclose([rows[i].sd for i in range(40)], sd, rtol=0.05)


def test_near_sites_come_before(spark):
    place, x, y = field(300, 4)
    sites = vecchia._sites(table(spark, place, x, y), "id", "lon", "lat", ["x"], "y")
    rows = vecchia.conditioned(sites, 10).collect()
    at = {(r.px, r.py): r.s_ for r in rows}
    before = {r.s_: {at[n["px"], n["py"]] for n in r.near_} for r in rows}
    assert len(rows) == 300 and sum(len(v) == 0 for v in before.values()) == 1 and max(map(len, before.values())) <= 20
    todo = dict(before)
    while todo:  # an order exists: nobody waits for one who waits for them
        free = [s for s, v in todo.items() if not v & set(todo)]
        assert free
        for s in free:
            del todo[s]
    with pytest.raises(ValueError):
        vecchia.fit(table(spark, place[:4], x[:4], y[:4]), "id", "lon", "lat", ["x"], "y")


def test_nearest_of_another_table(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((60, 2)), rng.random((150, 2)) * [4, 1]
    zeros = np.zeros(150)
    got = {}
    for r in neighbours.knn(table(spark, a, zeros[:60], zeros[:60]), "lon", "lat", "id", 4, among=table(spark, b, zeros, zeros), same=True).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    for i, p in enumerate(a):
        d = np.sqrt(((b - p) ** 2).sum(-1))
        assert [j for _, j in sorted(got[i])] == np.argsort(d, kind="stable")[:4].tolist()
