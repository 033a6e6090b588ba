"""Exact quantiles of large groups against a sort."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators.quantiles import quantiles
from loamwork.plans import oracle, queries

PROBS = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("held", [10_000, 40])
def test_quantiles(spark, held):
    rng = np.random.default_rng(1)
    values = {"even": rng.random(900), "tail": np.exp(rng.normal(size=500) * 20), "ties": rng.integers(0, 4, 700) * 0.5, "same": np.full(300, 2.5), "one": np.array([7.0]), "huge": np.array([1.7e308, -1.7e308, 0.0, 1.0] * 30), None: rng.normal(size=200), "few": rng.normal(size=3)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in quantiles(df, ["k"], "v", PROBS, [F.count(F.lit(1)).alias("n")], held=held, parts=64).collect()}
    assert set(got) == {*values, "none"} and got["none"].q is None and got["even"].n == 902
    for k, vs in values.items():
        want = np.quantile(vs, PROBS) if k != "huge" else [-1.7e308, -1.7e308, -4.25e307, 0.5, 1.7e308, 1.7e308]
        assert np.allclose(got[k].q, want, rtol=1e-12), k


def test_quantiles_of_a_table(spark):
    df = spark.range(5_000).select((F.col("id") * 7 % 5_000).cast("double").alias("v"))
    assert quantiles(df, [], "v", [0.0, 0.5, 1.0], held=200, parts=16).first().q == [0.0, 2499.5, 4999.0] == quantiles(df, [], "v", [0.0, 0.5, 1.0]).first().q
    two = df.withColumns({"a": F.col("v") % 2, "b": F.lit(None).cast("int")})
    assert {r.a: r.q for r in quantiles(two, ["a", "b"], "v", [0.5], held=50).collect()} == {0.0: [2499.0], 1.0: [2500.0]}
    assert quantiles(df.limit(0), ["v"], "v", [0.5]).count() == 0


def test_a_quantile_between_equal_values_is_that_value(spark):
    # 1 to 3 values of each group lie under the ties, so every position is tried
    values = [x / 10 for x in range(9000, 9060)]
    rows = [(v, k, w) for v in values for k in (1, 2, 3) for w in [v - 1] * k + [v] * 54 + [v + 1]]
    df = spark.createDataFrame(rows, "v double, k int, w double")
    got = quantiles(df, ["v", "k"], "w", [0.1, 0.3, 0.9], held=20, parts=8).collect()
    assert len(got) == 3 * len(values) and [r for r in got if set(r.q) != {r.v}] == []


@pytest.mark.parametrize("below", [1735, 1869])
def test_calibration_of_repeated_prices(spark, tmp_path, below):
    # 2035 or 2169 of 20,000 rows: a share or its gap on a half of the last digit; and prices that tie at every quantile of a group over HELD
    one = spark.range(17_000).select(F.lit("a").alias("p_brand"), F.when(F.col("id") < below, 1.0).otherwise(2.0).alias("p_retailprice"))
    two = spark.range(3_000).select(F.lit("b").alias("p_brand"), (F.lit(3.0) + F.col("id")).alias("p_retailprice"))
    tied = spark.range(12_007).select(F.lit("c").alias("p_brand"), ((9000 + F.floor(F.col("id") / 50)) / 10).alias("p_retailprice"))
    for name, df in {"halves": one.union(two), "ties": tied}.items():
        df.write.parquet(f"{tmp_path}/{name}/part.parquet")
        c = duckdb.connect()
        c.sql(f"create view part as select * from '{tmp_path}/{name}/part.parquet/*.parquet'")
        want = sorted(c.sql(oracle.SQL["ece_levels"]).fetchall())
        assert sorted(tuple(r) for r in queries.ece_levels(spark, f"{tmp_path}/{name}").collect()) == want, name
