"""Graphs that grow on disk, graphs with cycles, resampled clusters."""

import random

import pytest
from pyspark.sql import functions as F

from loamwork.operators import graph, moments
from loamwork.sources import snapshots
from loamwork.sources.files import CLAIMS


def claims(spark, n, seed, nodes=12):
    rng = random.Random(seed)
    name = lambda: f"Node {rng.randrange(nodes)}"
    return spark.createDataFrame([(name(), name(), rng.choice(["s1", "s2", "s 3", None]), rng.choice(["e1", "e2", None]), rng.choice([0.1, 0.5, None]), f"2024-01-0{rng.randrange(1, 9)}") for _ in range(n)], CLAIMS)


def told(df):
    return sorted(map(str, map(tuple, df.select("cause", "effect", "n_claims", "sources", "evidence", "confidence", "timestamp").collect())))


def test_small_merges_equal_one(spark, tmp_path):
    root = f"file://{tmp_path}/graph"
    batches = [claims(spark, n, i) for i, n in enumerate((30, 1, 50, 2))]
    every = batches[0]
    for i, b in enumerate(batches):
        every = every.unionByName(b) if i else b
        assert snapshots.merge(b, root, parts=7) == i + 1
        assert told(snapshots.load(spark, root)) == told(graph.merge_edges(every))
    assert told(snapshots.load(spark, root, 1)) == told(graph.merge_edges(batches[0]))
    assert snapshots.merge(batches[0].limit(0), root) == 4 and snapshots.versions(spark, root) == [1, 2, 3, 4]
    one, three = (snapshots._manifest(spark, root, v)["folders"] for v in (1, 2))
    assert sum(one.get(p) != f for p, f in three.items()) <= 1  # one claim touches one part
    snapshots.vacuum(spark, root, keep=1)
    assert snapshots.versions(spark, root) == [4] and told(snapshots.load(spark, root)) == told(graph.merge_edges(every))
    with pytest.raises(ValueError):
        snapshots.load(spark, root, 2)


def test_a_merge_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/graph"
    first, more = claims(spark, 40, 1), claims(spark, 40, 2)
    snapshots.merge(first, root, parts=4)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            snapshots.merge(more, root)
    assert snapshots.versions(spark, root) == [1] and told(snapshots.load(spark, root)) == told(graph.merge_edges(first))
    before = snapshots._manifest(spark, root)
    snapshots.merge(more, root)
    with pytest.raises(snapshots.Conflict):  # a writer that began at version 1 as well
        snapshots._publish(spark, root, before | {"version": 2})
    snapshots.vacuum(spark, root)
    assert told(snapshots.load(spark, root)) == told(graph.merge_edges(first.unionByName(more)))
    assert len([p for p in (tmp_path / "graph").iterdir() if p.name.startswith("merge-")]) == 2
    assert snapshots.load(spark, f"{root}-none").count() == 0


def plain_cycles(edges):
    edges = set(edges)
    while True:
        fed, feeding = {b for _, b in edges}, {a for a, _ in edges}
        now = {(a, b) for a, b in edges if a in fed and b in feeding}
        if now == edges:
            return now
        edges = now


def test_cycle_edges(spark):
    rng = random.Random(3)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    for edges in (chain, chain + [("c4", "c2")], [("a", "a")], [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "a"), ("d", "y"), ("p", "q")], [(f"{rng.randrange(30)}", f"{rng.randrange(30)}") for _ in range(40)], []):
        df = spark.createDataFrame(edges + edges[:2] + [(None, "a"), ("a", None)], "cause string, effect string")
        got = [tuple(r) for r in graph.cycle_edges(df).collect()]
        assert sorted(got) == sorted(plain_cycles(edges)) and graph.acyclic(df) == (not got)


def test_resampled_clusters_sum_to_their_number(spark):
    df = spark.range(900).select((F.col("id") % 37).alias("c"), F.lit(1.0).alias("x")).unionByName(spark.createDataFrame([(None, 1.0)], "c long, x double"))
    times = moments.resampled(df, "c", 40, seed=3)
    by_draw = times.groupBy("draw").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    assert len(by_draw) == 40 and {r.n for r in by_draw} == {37} and 20 < sum(r.kinds for r in by_draw) / 40 < 27  # 63 % are drawn
    assert sorted(map(tuple, times.collect())) == sorted(map(tuple, moments.resampled(df.repartition(5), "c", 40, seed=3).collect()))
    assert abs(sum(r.times for r in times.filter("c = 5").collect()) - 40) < 25
    assert moments.resampled(df.limit(0), "c", 3).count() == 0


def test_bootstrap_takes_whole_clusters(spark):
    """One cluster's slope is 5, the others' 1: the draws without it have slope 1."""
    rows = [(c, float(x), (5.0 if c == 0 else 1.0) * x) for c in range(6) for x in range(8)]
    df = spark.createDataFrame(rows, "c int, x double, y double")
    slopes = moments.bootstrap_effect(df, "y", "x", [], "c", 60)
    held = {r.draw: r.times for r in moments.resampled(df, "c", 60).filter("c = 0").collect()}
    assert len(slopes) == 60
    for draw, slope in enumerate(slopes):
        assert slope == pytest.approx(1 + 4 * held.get(draw, 0) / 6)
