"""Resumable ingest of documents into claims, and event-time views of a stream."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resume(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Documents that no earlier run has finished."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def stream_claims(spark: SparkSession, folder: str, schema: str, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, least: float = 0.0) -> object:
    """Reads new JSON lines of a folder, extracts claims and appends them; the checkpoint makes it resumable.

    extract gives answers with claims rows (cause, effect, evidence, confidence). A run takes what is there and stops.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = extract(batch).filter(F.col("confidence") >= least).withColumn("batch", F.lit(batch_id))
        # a batch that is run again overwrites what it wrote before
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, ts: str, width: str = "1 hour", late: str = "2 hours", by: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window with a watermark; the same plan for batch and stream. With `slide` windows
    begin that often and overlap: an event is counted in each that it is in."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, width, slide), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *(by or []), "n", "total")


def session_totals(events: DataFrame, ts: str, gap: str = "30 minutes", late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Counts and sums per session: events of a key with less than `gap` from one to the next; the same plan for batch
    and stream.

    In a stream an event that comes late, but within the watermark, joins the session that it touches, and one between
    two sessions makes them one; a session is told once the watermark has passed its end. Sessions are merged where their
    rows are before they are shuffled, so that a key with very many events sends few rows.
    """
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = stamped.groupBy(F.session_window(ts, gap), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *(by or []), "n", "total")


def sequential_ensemble(events: DataFrame, key: str, value: str, noise: float = 1.0, members: int = 32, spread: float = 10.0, seed: int = 1) -> DataFrame:
    """An ensemble per key, updated by each value in order of arrival (streaming only): the state is the members, the
    first drawn with that spread around the first value; observations are perturbed, so that the spread stays right."""

    def update(k: tuple, batches, state):
        x, count = state.get if state.exists else ([], 0)
        x = np.array(x)
        for pdf in batches:
            for v in pdf[value]:
                rng = np.random.default_rng([seed, count])
                if not len(x):
                    x = v + spread * rng.normal(size=members)
                var = float(x.var(ddof=1))
                x = x + var / (var + noise**2) * (v + noise * rng.normal(size=members) - x)
                count += 1
        state.update((x.tolist(), count))
        yield pd.DataFrame([(k[0], float(x.mean()), float(x.std(ddof=1)), count)], columns=[key, "mean", "sd", "n"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, mean double, sd double, n long", "members array<double>, n long", "update", "NoTimeout")


def sequential_mean(events: DataFrame, key: str, value: str, noise: float = 1.0) -> DataFrame:
    """A scalar filter per key, updated in order of arrival: state is mean and variance (streaming only)."""

    def update(k: tuple, batches, state):
        mean, var = state.get if state.exists else (0.0, 1e6)
        for pdf in batches:
            for v in pdf[value]:
                gain = var / (var + noise)
                mean, var = mean + gain * (v - mean), (1 - gain) * var
        state.update((mean, var))
        yield pd.DataFrame([(k[0], mean, var)], columns=[key, "mean", "variance"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, mean double, variance double", "mean double, variance double", "update", "NoTimeout")
