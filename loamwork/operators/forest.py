"""Quantile forests on Spark ML: leaves as a join key, quantiles from the leaves' training rows."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class QuantileForest:
    """A forest whose trees also answer with the distribution of their leaves: a training row weighs 1 / leaf size in
    each tree, and a quantile is where the summed weights reach it."""

    def __init__(self, df: DataFrame, target: str, names: list[str], trees: int = 50, depth: int = 8, seed: int = 1):
        self.names, self.target = names, target
        self.assembler = VectorAssembler(inputCols=names, outputCol="features_", handleInvalid="skip")
        train = self.assembler.transform(df)
        self.model = RandomForestRegressor(featuresCol="features_", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed, leafCol="leaves_").fit(train)
        rows = self._leaves(train.withColumn("y_", F.col(target).cast("double")), ["y_"])
        sizes = rows.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("size"))
        #: tree, leaf, y, weight: as many rows as training rows and trees, summed up by value
        self.leaves = rows.join(sizes, ["tree", "leaf"]).groupBy("tree", "leaf", "y_").agg(F.sum(1 / F.col("size")).alias("weight"))

    @staticmethod
    def assembled(df: DataFrame, names: list[str]) -> DataFrame:
        return VectorAssembler(inputCols=names, outputCol="features_", handleInvalid="skip").transform(df)

    def _paths(self, df: DataFrame, keep: list[str]) -> DataFrame:
        scored = self.model.transform(df) if "features_" in df.columns else self.model.transform(self.assembler.transform(df))
        return scored.select(*keep, vector_to_array("leaves_").alias("path"))

    def _leaves(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return self._paths(df, keep).select(*keep, F.posexplode("path").alias("tree", "leaf"))

    def quantiles(self, df: DataFrame, key: str, probs: list[float]) -> DataFrame:
        """key, mean and an array of the quantiles of each row."""
        # rows that fall into the same leaves share one distribution
        rows = self._paths(df, [key])
        paths = rows.select("path").distinct()
        met = paths.select("path", F.posexplode("path").alias("tree", "leaf")).join(self.leaves, ["tree", "leaf"]).groupBy("path", "y_").agg(F.sum("weight").alias("w"))
        w = Window.partitionBy("path").orderBy("y_")
        line = met.withColumns({"run": F.sum("w").over(w), "total": F.sum("w").over(Window.partitionBy("path"))})
        at = [F.min(F.when(F.col("run") >= p * F.col("total") - 1e-9, F.col("y_"))) for p in probs]
        answers = line.groupBy("path").agg((F.sum(F.col("y_") * F.col("w")) / F.sum("w")).alias("mean"), F.array(*at).alias("quantiles"))
        return rows.join(answers, "path").drop("path")
