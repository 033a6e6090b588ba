"""Exact small cases of the operators."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.functions import columns as C
from loamwork.functions import tails
from loamwork.operators import causal, docs, graph, grids, kernels, metrics, moments, neighbours, neural, posterior, profiles, rasters, selection, spatial
from loamwork.plans import queries


def one(df):
    return df.collect()[0]


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "observed double, predicted double")
    r = one(metrics.score(df, []))
    assert (r.n, r.rmse, r.mae, r.bias) == (4, pytest.approx(math.sqrt(0.5)), 0.5, 0.0)
    holes = spark.createDataFrame([(1.0, 1.0), (2.0, None), (float("nan"), 3.0), (4.0, 4.0), (float("inf"), 1.0)], "observed double, predicted double")
    assert one(metrics.score(holes, [])).rmse == 0
    assert one(metrics.score(holes.limit(0), [])).rmse is None
    assert one(metrics.score(holes.limit(1), [])).r2 is None


def test_intervals(spark):
    rows = list(zip(*[map(float, x) for x in ((1, 2, 3, 4, 5), (0, 1, 5, 3, 4), (2, 3, 6, 5, 6))], strict=True))
    df = spark.createDataFrame(rows, "y double, l double, u double")
    assert one(df.agg(metrics.coverage("y", "l", "u").alias("x"))).x == pytest.approx(0.8)
    two = spark.createDataFrame([(1.0, 0.0, 2.0), (5.0, 0.0, 2.0)], "y double, l double, u double")
    assert one(two.agg(metrics.interval_score("y", "l", "u", 0.1).alias("x"))).x == pytest.approx(32)


def test_crps_is_the_double_sum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)
    draws = spark.createDataFrame([(0, float(v)) for v in x], "query_id long, value double")
    truth = spark.createDataFrame([(0, 0.3)], "query_id long, observed double")
    want = np.abs(x - 0.3).mean() - 0.5 * np.abs(x[:, None] - x[None]).mean()
    assert one(posterior.crps(draws, truth)).crps == pytest.approx(want)


def test_gaussian_draws_are_calibrated(spark):
    q = spark.createDataFrame([(i, 0.0, 1.0) for i in range(60)], "id long, m double, s double")
    draws = posterior.from_gaussian(q, "id", "m", "s", 500)
    truth = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.random.default_rng(2).normal(size=60))], "query_id long, observed double")
    got = {r.level: r for r in posterior.interval_coverage(draws, truth).collect()}
    assert got[0.95].picp >= 0.85 and abs(got[0.95].mpiw - 3.92) < 0.2
    order = ["query_id", "draw_id"]
    assert draws.orderBy(*order).collect() == posterior.from_gaussian(q.repartition(7), "id", "m", "s", 500).orderBy(*order).collect()


def test_labels(spark):
    df = spark.createDataFrame([("Mean Annual Precipitation",), ("  soil--organic  C! ",), ("_x__y_",)], "s string")
    assert [r.x for r in df.select(C.node_label("s").alias("x")).collect()] == ["mean_annual_precipitation", "soil_organic_c", "x_y"]
    assert one(spark.createDataFrame([("MAP",)], "s string").select(docs.canonical("s").alias("x"))).x == "mean_annual_precipitation"


def test_robustness():
    r = causal.robustness_summary(1.0, 0.5, 100)
    assert r["rv"] == pytest.approx(0.1810, abs=1e-4)


def test_sensitivity_grid(spark):
    rows = causal.sensitivity_grid(spark, 1.0, 0.5, 100, 11, 0.3).collect()
    assert len(rows) == 121 and min(r.bias for r in rows) == 0


def test_tails():
    assert tails.chi_square_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138851964939, abs=1e-8)
    assert tails.f_upper(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_instruments_recover_the_effect(spark):
    rng = np.random.default_rng(3)
    z, u = rng.normal(size=(800, 3)), rng.normal(size=800)
    x = z @ [0.7, 0.5, 0.4] + 0.6 * u + rng.normal(size=800)
    y = 1.5 * x + 0.8 * u + rng.normal(size=800)
    df = spark.createDataFrame([(float(a), float(b), *map(float, c)) for a, b, c in zip(y, x, z, strict=True)], "y double, x double, z1 double, z2 double, z3 double")
    fit = moments.two_stage(df, "y", "x", ["z1", "z2", "z3"])
    assert abs(fit["effect"] - 1.5) < 0.15 and not fit["first_stage"]["weak"] and fit["sargan_p"] > 0.01 and fit["sargan_df"] == 2
    assert abs(moments.ols(df, "y", ["x"])["beta"]["x"] - 1.5) > abs(fit["effect"] - 1.5)
    inst, ones = np.column_stack([np.ones(800), z]), np.column_stack([np.ones(800), x])
    p = inst @ np.linalg.solve(inst.T @ inst, inst.T)
    assert fit["effect"] == pytest.approx(np.linalg.solve(ones.T @ p @ ones, ones.T @ p @ y)[1])


def test_leverage_is_the_hat_diagonal(spark):
    x = np.random.default_rng(4).normal(size=(30, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    m = np.column_stack([np.ones(30), x])
    hat = np.diag(m @ np.linalg.solve(m.T @ m, m.T))
    got = [r.leverage for r in moments.leverage(df, df, ["a", "b"]).orderBy("id").collect()]
    assert got == pytest.approx(list(hat))


def test_trend(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(12)], "t int, v double")
    r = causal.mann_kendall(df, "t", "v")
    assert r["tau"] == 1 and r["direction"] == "up" and r["var"] == pytest.approx(12 * 11 * 29 / 18)


def test_dag():
    g = causal.Dag([("c", "x"), ("c", "y"), ("x", "m"), ("m", "y"), ("x", "k"), ("y", "k")])
    assert g.adjustment_set("x", "y") == ["c"]
    more, left = g.with_edges([("y", "x", 0.9), ("c", "m", 0.8), ("c", "k", 0.1), ("m", "k", None)])
    assert left == [("y", "x")] and ("c", "m") in more.edges and ("c", "k") not in more.edges
    with pytest.raises(ValueError, match="cycle"):
        causal.Dag([("a", "b"), ("b", "a")])


CLAIMS = [("precipitation", "soc", "Jenny 1941", "e", 0.9, "1"), ("precipitation", "soc", "Minasny 2017", None, 0.85, "2"), ("precipitation", "soc", "Ferreira 2021", "e", 0.80, "3"), ("slope", "soc", "Jenny 1941", "e", 0.7, "1"), ("clay", "cec", "Random 2020", "e", 0.95, "1"), ("a", "A ", "x", "e", 1.0, "1")]
CLAIM_SCHEMA = "cause string, effect string, source string, evidence string, confidence double, timestamp string"


def test_graph(spark):
    claims = spark.createDataFrame(CLAIMS, CLAIM_SCHEMA)
    merged = {(r.cause, r.effect): r for r in graph.merge_edges(claims).collect()}
    assert len(merged) == 3 and merged["precipitation", "soc"].confidence == 0.9 and merged["precipitation", "soc"].timestamp == "3"
    assert merged["precipitation", "soc"].sources == "Ferreira 2021 | Jenny 1941 | Minasny 2017"
    ranked = [(r.cause, r.effect) for r in graph.rank_edges(claims.limit(5)).collect()]
    assert ranked[:2] == [("precipitation", "soc"), ("clay", "cec")]
    s = one(graph.graph_summary(claims.limit(5)))
    assert (s.n_nodes, s.n_edges, s.n_sources) == (5, 5, 4)
    vocabulary = spark.createDataFrame([("precipitation", "climate"), ("soc", "soil"), ("clay", "soil")], "term string, category string")
    support = {(r.cause, r.effect): r.support for r in graph.rank_edges(claims.limit(5), vocabulary).collect()}
    assert support == {("precipitation", "soc"): 1.0, ("slope", "soc"): 0.5, ("clay", "cec"): 0.5}
    text = "\n".join(r.value for r in graph.turtle(graph.merge_edges(claims)).collect())
    assert text.count(" a rdf:Statement") == 3 and '"0.900000"^^xsd:float' in text


def test_align(spark):
    labels = spark.createDataFrame([("soc",), ("mean_precipitation",), ("precipitaton",), ("zzzzzzzzzzzz",)], "label string")
    terms = spark.createDataFrame([("soc",), ("precipitation",), ("mean",)], "term string")
    got = {r.label: (r.target, r.method) for r in graph.align(labels, terms).collect()}
    assert got == {"soc": ("soc", "exact"), "mean_precipitation": ("precipitation", "substring"), "precipitaton": ("precipitation", "edit_distance")}


def test_hamming(spark):
    a = spark.createDataFrame([("x", "y"), ("y", "z"), ("a", "b")], "cause string, effect string")
    b = spark.createDataFrame([("y", "x"), ("y", "z"), ("c", "d")], "cause string, effect string")
    r = one(graph.hamming(a, b))
    assert (r.only_a, r.only_b, r.turned, r.distance) == (1, 1, 1, 3)


def test_dedupe_and_index(spark):
    df = spark.createDataFrame([(1, "10.1/same", "a"), (2, " 10.1/SAME", "b"), (3, "10.1/other", "c"), (4, None, "T  x"), (5, None, "t x "), (6, None, None), (7, None, None)], "id int, doi string, title string")
    assert sorted(r.id for r in docs.dedupe_corpus(df, [F.col("id")]).collect()) == [1, 3, 4, 6, 7]
    text = spark.createDataFrame([(1, "A B  A C")], "id int, text string")
    assert one(docs.from_inverted_index(docs.inverted_index(text, "id", "text"), "id")).text == "A B  A C"


def test_index_of_one_row_a_document(spark, tmp_path):
    # ids may be repeated, texts null, empty, of blanks or of one word; no word leaves its row
    texts = ["A B  A C", "", " ", "a", None, "b\na b", "é e " * 500, " ".join(map(str, range(2000)))]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.inverted_index_roundtrip(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted((i // 2, hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(texts) if t is not None)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    index = docs.with_index(df, "text")
    assert [tuple(x) for x in index.first()["index"]] == [("", [2]), ("A", [0, 3]), ("B", [1]), ("C", [4])]
    assert sorted(str(r.t) for r in index.select(docs.text_of("index").alias("t")).collect()) == sorted(map(str, texts))
    given = spark.createDataFrame([([("C", [4]), ("A", [0]), ("B", [2])],), ([],), (None,)], "i array<struct<word:string,positions:array<int>>>")
    assert [r.t for r in given.select(docs.text_of("i").alias("t")).collect()] == ["A B C", None, None]


def test_claims_and_votes(spark):
    df = spark.createDataFrame([(1, 'x {"claims":[{"cause":" Rain ","effect":"SOC","confidence":0.5},{"cause":"a","effect":"A"}]} y'), (2, "no json"), (3, None)], "id int, answer string")
    assert [(r.id, r.cause, r.effect) for r in docs.parse_claims(df, "answer").collect()] == [(1, "rain", "soc")]
    rows = [("v1", "a", "b", 0.9, 1), ("v1", "a", "b", 0.1, 2), ("v2", "a", "b", 0.5, 1), ("v3", "c", "d", 1.0, 1)]
    claims = spark.createDataFrame(rows, "voter string, cause string, effect string, confidence double, ord int")
    assert [(r.cause, r.mean_confidence) for r in docs.vote(claims, "majority").collect()] == [("a", pytest.approx(0.7))]
    assert docs.vote(claims, "intersection").count() == 0
    assert [r.cause for r in docs.vote(claims, "weighted", {"v1": 1.0, "v2": 1.0, "v3": 3.0}).collect()] == ["c"]


def test_many_raters_and_voters(spark):
    marks = spark.createDataFrame([(k, f"r{i:03}") for i in range(103) for k in range(4) if (i + k) % 3], "k long, rater string")
    got = {(r.rater_a, r.rater_b): r.kappa for r in docs.kappa(marks, ["k"]).collect()}
    keys = {f"r{i:03}": {k for k in range(4) if (i + k) % 3} for i in range(103)}
    assert len(got) == 103 * 102 // 2
    for (a, b), kappa in got.items():
        n = len(keys[a] | keys[b])
        pa, pb = len(keys[a]) / n, len(keys[b]) / n
        chance = pa * pb + (1 - pa) * (1 - pb)
        want = None if abs(1 - chance) < 1e-10 else (len(keys[a] & keys[b]) / n - chance) / (1 - chance)
        assert kappa == want or abs(kappa - want) < 1e-9
    claims = [(f"v{i:04}", c, "e", 0.5, i) for i in range(1100) for c in ("all", "some", "few") if c == "all" or c == "some" and i < 1000 or i < 520]
    claims = spark.createDataFrame(claims, "voter string, cause string, effect string, confidence double, ord long")
    assert {r.cause for r in docs.vote(claims, "intersection").collect()} == {"all"}
    assert {r.cause for r in docs.vote(claims, "majority").collect()} == {"all", "some"}


def test_matching(spark):
    p = spark.createDataFrame([(1, "precipitation", "soc", 1), (1, "temperature", "soc", 2), (1, "slope", "erosion", 3)], "abstract_id int, cause string, effect string, ord int")
    g = spark.createDataFrame([(1, "Precipitaton", "SOC", 1), (1, "slope", "erosion", 2)], "abstract_id int, cause string, effect string, ord int")
    assert sorted(r.outcome for r in docs.match_greedy(p, g).collect()) == ["fp", "tp", "tp"]
    assert sorted(r.outcome for r in docs.match_exact(p, g).collect()) == ["fn", "fp", "fp", "tp"]
    outcomes = spark.createDataFrame([("A", "tp"), ("A", "fp"), ("A", "fn"), ("B", "tp")], "abstract string, outcome string")
    total = [r for r in docs.precision_recall(outcomes, "abstract").collect() if r.abstract is None][0]
    assert total.precision == total.recall == total.f1 == pytest.approx(2 / 3)


def test_annotations(spark):
    schema = "abstract_id string, abstract_text string, claims array<struct<cause:string,effect:string,polarity:string,confidence:double,status:string>>"
    df = spark.createDataFrame([("1", "t", [("a", "b", "+", 0.5, "accepted"), ("a", "c", "-", 0.5, "draft")]), (None, "t", [("a", "b", "?", 2.0, None)])], schema)
    errors = [r.errors for r in docs.validate_annotations(df, ["a", "b", "c"]).collect()]
    assert errors[0] == [] and len(errors[1]) == 3
    assert [len(r.claims) for r in docs.export_annotations(df).collect()] == [1, 1]


def test_knn_is_brute_force(spark):
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.normal(size=(150, 2)), 50 + rng.normal(size=(5, 2)), [[0, 0]] * 4])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    got = {}
    for r in neighbours.knn(df, "x", "y", "id", 6).collect():
        got.setdefault(r.src, []).append((r["rank"], r.distance))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(xy)):
        assert [x for _, x in sorted(got[i])] == pytest.approx(list(np.sort(d[i])[:6]))
    w = neighbours.edge_weights(neighbours.knn(df, "x", "y", "id", 6)).groupBy("src").agg(F.sum("weight").alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in w.collect())


def test_knn_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_CELL", 60)
    rng = np.random.default_rng(19)
    xy = np.vstack([1e-3 * rng.normal(size=(300, 2)), 100 * rng.uniform(size=(60, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=-1))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in neighbours.knn(df, "x", "y", "id", 4).collect():
        got.setdefault(r.src, []).append(r.distance)
    assert all(sorted(got[i]) == pytest.approx(list(np.sort(d[i])[:4])) for i in range(len(xy)))


def test_attention(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, -1.0)], "src int, dst int, s double")
    a = {r.dst: r.alpha for r in neighbours.attention(e, "s").collect()}
    assert a[1] == pytest.approx(1 / (1 + math.exp(-1.2))) and sum(a.values()) == pytest.approx(1)
    nodes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 2.0])], "node int, h array<double>")
    out = {r.node: r.h for r in neighbours.gather(neighbours.attention(e, "s"), nodes, 2).collect()}
    assert out[1] == [0.0, 1.0] and out[0][1] == pytest.approx(a[1] + 2 * a[2])


def test_selection(spark):
    pool = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(12)], "id long, a double, u double")
    assert selection.greedy_batch(pool, "id", ["a"], "u", 3, strategy="uncertainty")[0] == 2
    assert set(selection.greedy_batch(pool, "id", ["a"], "u", 2, strategy="diverse")) == {0, 11}
    p = spark.createDataFrame([(0, [0.0, 10.0, 0.0]), (1, [0.1, 10.1, 0.0]), (2, [5.0, 5.0, -5.0])], "id long, p array<double>")
    assert selection.joint_variance_batch(p, "id", "p", 0.01, 2) == [1, 2]
    assert selection.latin_design(pool, "id", ["a"], 4).count() == 4
    vectors = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, v array<double>")
    assert [r.distance for r in selection.distance_to_set(vectors, vectors.limit(1), "id", "v").orderBy("id").collect()] == [0, 5]
    history = selection.learning_loop(pool.limit(2), pool.filter("id >= 2"), "id", lambda rows: (None, 1.0 / rows.count()), lambda m, p, n: [r.id for r in p.orderBy("id").limit(n).collect()], lambda rows: rows, 4, 2)
    assert [h["n_labelled"] for h in history] == [2, 4, 6]


def test_gate_and_taper(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.4,), (3.0,)], "p double")
    assert [r.g for r in df.select(selection.range_gate(F.col("p"), F.lit(1.0), F.lit(2.0), 1.5).alias("g")).collect()] == [False, True, True, False]
    t = [r.taper for r in grids.taper_table(spark, 2.0, 10).orderBy("distance").collect()]
    assert t[0] == 1 and t[-1] == 0 and all(a >= b for a, b in zip(t, t[1:], strict=False))


def test_assimilation_moves_to_the_observation(spark):
    rng = np.random.default_rng(6)
    rows = [(m, r, c, float(v)) for m in range(50) for (r, c), v in np.ndenumerate(rng.normal(size=(6, 6)))]
    ens = spark.createDataFrame(rows, "member int, row int, col int, value double")
    obs = spark.createDataFrame([(5, 5, 3.0, 0.1)], "row int, col int, observed double, sd double")
    analysis, gain = grids.assimilate(ens, obs, 3.0)
    got = one(analysis.filter("row = 5 and col = 5").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")))
    assert got.m > 2.5 and got.s < 0.3
    far = one(gain.filter("row = 0 and col = 0"))
    assert far.gain == 0


def test_cube_folds_and_gaps(spark):
    cube = grids.synthetic_cube(spark, 3, 4, 5)
    assert cube.count() == 60 and one(cube.agg(F.min("soc").alias("m"))).m >= 5
    z, table = grids.scaled(cube, ["precip", "soc"])
    assert abs(one(z.agg(F.avg("soc").alias("m"))).m) < 1e-9 and table.count() == 2
    f = grids.round_robin_folds(spark.range(23).withColumn("c", F.col("id") % 2), "c", "id")
    assert {r.n for r in f.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()} <= {4, 5, 6}
    df = spark.createDataFrame([(1, t, v) for t, v in ((0, None), (1, 1.0), (2, None), (3, 3.0), (4, None))], "g int, t int, v double")
    assert [r.filled for r in docs.fill_gaps(df, ["g"], "t", "v").orderBy("t").collect()] == [1, 1, 2, 3, 3]


def test_kernels():
    x = kernels.encode(np.random.default_rng(7).normal(size=(12, 3)))
    k = kernels.quantum_gram(x)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9 and np.allclose(np.diag(k), 1)
    one_d = np.array([[0.3], [1.1]])
    assert kernels.quantum_gram(one_d, reps=1)[0, 1] == pytest.approx(math.cos(0.8) ** 2)
    y = x[:, 0]
    r = kernels.Ridge(k, y, 1e-6)
    assert np.allclose(r.predict(k), y, atol=1e-3) and r.variance(k).max() < 1e-3
    assert kernels.ground_energy({"Z": 1.0}) == -1 and kernels.variational_energy(kernels.ising_chain(2), 1, 120) == pytest.approx(kernels.ground_energy(kernels.ising_chain(2)), abs=0.05)
    assert 1 <= kernels.effective_rank(k) <= 12
    z, _ = kernels.reduce_embeddings(np.random.default_rng(8).normal(size=(20, 5)), 2)
    assert z.min() >= -math.pi and z.max() < math.pi


def test_profiles(spark):
    z = np.array([5.0, 15, 30, 60, 100])
    y = profiles.curve(z, 20, 3, 0.05, 0.02)
    assert profiles.curve(np.array([60.0]), 20, 3, 0.05, 0.02)[0] == pytest.approx(5.96, abs=0.01)
    assert profiles.fit_profile(z, y)["sse"] < 1e-3
    draws = profiles.sample_profile(z, y + 0.1, 1500)
    assert draws.shape == (1500, 5) and np.isfinite(draws).all()
    df = spark.createDataFrame([("a", float(d), float(v)) for d, v in zip(z, y, strict=True)] + [("b", 1.0, 1.0)], "id string, depth double, soc double")
    got = {r.id: r for r in profiles.fit_profiles(df, "id", "depth", "soc").collect()}
    assert got["a"].error is None and got["b"].error is not None


def test_spatial_and_neural():
    rng = np.random.default_rng(9)
    place, x = rng.uniform(size=(60, 2)), rng.normal(size=(60, 1))
    y = 2 * x[:, 0] + rng.normal(size=60) * 0.3
    fit = spatial.gibbs(x, y, place, 200, 100)
    assert abs(fit["beta"][:, 1].mean() - 2) < 0.3
    assert spatial.predict(fit, x, place).shape == (200, 60) and (spatial.site_variance(fit, place) > 0).all()
    p = rng.normal(size=(16, 3))
    curves = p[:, :1] + np.linspace(0, 1, 10)[None]
    net = neural.OperatorNet(p, curves, np.linspace(0, 100, 10))
    assert np.sqrt(((net.predict(p) - curves) ** 2).mean()) < 0.5
    s = neural.cosine_schedule(50)
    assert (np.diff(s["alphabar"]) <= 0).all()
    d = neural.Diffusion(rng.normal(5, 1, size=(30, 4, 4)), 20)
    assert abs(d.sample(40).mean() - 5) < 1.5
    src, dst = np.repeat(np.arange(30), 2), rng.integers(0, 30, 60)
    g = neural.GraphNet(rng.normal(size=(30, 4)), src, dst, np.full(60, 0.5))
    assert np.isfinite(g.predict(rng.normal(size=30), np.arange(20))).all()


def test_rasters_align(spark):
    fine, coarse = rasters.Grid(0.0, 4.0, 1.0, 1.0, 4, 4), rasters.Grid(1.0, 4.0, 2.0, 2.0, 2, 2)
    plane = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "row int, col int, value double")
    assert rasters.template([fine, coarse], 0.5) == rasters.Grid(0.0, 4.0, 0.5, 0.5, 8, 10)
    same = rasters.resample(plane, fine, fine).collect()
    assert len(same) == 16 and all(r.value == 10 * r.row + r.col for r in same)
    half = {(r.row, r.col): r.value for r in rasters.resample(plane, fine, rasters.Grid(0.0, 4.0, 0.5, 0.5, 8, 8)).collect()}
    assert half[3, 3] == pytest.approx(10 * 1.25 + 1.25) and half[0, 0] == 0 and half[7, 7] == 33 and half[0, 3] == pytest.approx(1.25)  # edges hold the nearest
    gap = rasters.resample(plane.filter("row <> 1 or col <> 1"), fine, rasters.Grid(0.0, 4.0, 0.5, 0.5, 8, 8)).collect()
    got = {(r.row, r.col): r.value for r in gap}
    assert got[3, 3] == pytest.approx((3 * 12 + 3 * 21 + 22) / 7)  # of (1, 2), (2, 1) and (2, 2)
    bands, grid = rasters.align({"a": (plane, fine), "b": (plane.filter("row < 2 and col < 2"), coarse)}, 1.0, method="near")
    rows = {(r.band, r.row, r.col): r.value for r in bands.collect()}
    assert grid.cols == 5 and rows["b", 3, 4] == 11 and ("b", 0, 0) not in rows and ("a", 0, 4) not in rows and rows["a", 2, 3] == 23
