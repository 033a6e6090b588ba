"""Operator 12: whitening by a tree of QR factors, without a covariance matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import materialize

#: An entry c becomes the whole number floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components that are returned at most.
COMPONENTS = 8
#: Rows that are factored at a time.
ROWS = 4096
#: Factors that one task merges.
FAN_IN = 32
MAX_WIDTH = 4096


def finite_rows(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has neither null nor non-finite entries; the vector as doubles."""
    usable = F.col(column).isNotNull() & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(usable, F.lit(False))).withColumn(column, F.col(column).cast("array<double>"))


def whole_vectors(vectors: DataFrame, scale: int, offset: int, column: str = "embedding", least_width: int = 0) -> tuple[DataFrame, int, int]:
    """The usable rows with x, their vectors in whole numbers, all of one width; the width and the number of rows.

    Vectors of different widths end in entries 0. Entries too large for exact whole numbers are an error.
    """
    rows = finite_rows(vectors, column)
    largest = F.array_max(F.transform(column, lambda c: F.abs(c)))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.max(F.size(column)), F.lit(least_width)).alias("width"), F.coalesce(F.max(largest), F.lit(0.0)).alias("largest")).first()  # one row
    if told.width > MAX_WIDTH:
        raise ValueError(f"[whole_vectors] {told.width} entries a vector; at most {MAX_WIDTH}")
    if (scale * told.largest + offset + 1) * max(1, told.n) >= 2**62:
        raise ValueError(f"[whole_vectors] entries up to {told.largest} in {told.n} rows don't fit whole numbers of 64 bits")
    full = F.concat(F.col(column), F.array_repeat(F.lit(0.0), F.lit(told.width) - F.size(column)))
    x = F.transform(full, lambda c: F.floor(c * scale) + F.lit(offset).cast("long"))
    return rows.withColumn("x", x), told.width, told.n


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def merged_factors(factors: np.ndarray) -> np.ndarray:
    """The R factor of factors that stand below each other."""
    return np.linalg.qr(factors, mode="r")


def merged_moments(moments: np.ndarray) -> np.ndarray:
    """One row (count, means, products of deviations) from several: deviations move to the common mean before they are
    multiplied."""
    k = int(round((-1 + np.sqrt(1 + 4 * (moments.shape[1] - 1))) / 2))
    n, means, products = moments[:, 0], moments[:, 1 : k + 1], moments[:, k + 1 :].reshape(-1, k, k)
    mean = n @ means / n.sum()
    away = means - mean
    return np.concatenate([[n.sum()], mean, (products.sum(0) + (away * n[:, None]).T @ away).ravel()])[None, :]


def tree_merged(parts: DataFrame, width: int, merge, fan_in: int = FAN_IN) -> np.ndarray | None:
    """What `merge` makes of all matrices in parts (node long, m array<double>, of `width` columns), merged in a tree:
    `fan_in` of them a task, written down level by level, so that neither a task nor the driver holds many."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        m = merge(np.concatenate([np.asarray(v).reshape(-1, width) for v in group.sort_values("node").m]))
        return pd.DataFrame({"node": [group.node.min() // fan_in], "m": [m.ravel()]})

    level = materialize(parts)
    last = level.agg(F.max("node").alias("n")).first().n
    while last:
        level = materialize(level.groupBy(F.floor(F.col("node") / fan_in).alias("parent")).applyInPandas(join, "node long, m array<double>"))
        last //= fan_in
    return None if last is None else np.asarray(level.first().m).reshape(-1, width)


@dataclass
class Whitening:
    """What all rows are projected with: width, number of rows, exact sums by dimension, unit right vectors (a row a
    component), their variances, the trace of the covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once: the difference is made in whole numbers."""
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.variances > 0, np.sqrt(np.maximum(self.variances, 0)), np.nan)
        return self.centred(x) @ self.vectors.T / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sums)^2, exact; null where 64 bits don't hold one."""
        away = self.n * x - self.sums
        most = int(np.abs(away).max(initial=0))
        if most * most * max(1, away.shape[1]) < 2**63:
            return (away * away).sum(1).tolist()
        exact = (away.astype(object) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def fit(rows: DataFrame, width: int, n: int, components: int = COMPONENTS, fan_in: int = FAN_IN) -> Whitening:
    """The whitening of rows (x array<long>).

    Sums by dimension are exact. Each task centres its rows by them and keeps one R factor of what it has seen; the
    factors are merged in a tree to one, whose right singular vectors are the components. A component whose variance is
    nothing but rounding has variance 0.
    """
    by_place = rows.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("s")).collect()  # one row a dimension
    sums = np.array([r.s for r in sorted(by_place, key=lambda r: r.place)], dtype=np.int64)
    centre = Whitening(n, sums, np.zeros((0, width)), np.zeros(0), 0.0)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                r = merged_factors(np.concatenate([r, centre.centred(matrix(batch.slice(i, ROWS), "x", width))]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"m": pa.array([r.ravel()], pa.list_(pa.float64()))})

    parts = rows.select("x").mapInArrow(factor, "m array<double>").withColumn("node", F.spark_partition_id().cast("long")).select("node", "m")
    r = tree_merged(parts, width, merged_factors, fan_in)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    s = np.where(s <= s.max(initial=0) * max(n, width) * np.finfo(float).eps, 0.0, s)
    variances, vt = s**2 / n, vt * np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(1)] < 0, -1, 1)[:, None]
    k = min(components, width)
    # fewer rows than components: those without any variance are filled up
    short = max(0, k - len(s))
    return Whitening(n, sums, np.concatenate([vt[:k], np.full((short, width), np.nan)]), np.concatenate([variances[:k], np.zeros(short)]), float(variances.sum()))


def identity_error(rows: DataFrame, model: Whitening, fan_in: int = FAN_IN) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over the components that vary."""
    width, live = rows.select(F.size("x").alias("w")).first().w, model.variances > 0
    k = int(live.sum())
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 1 + k + k * k))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(matrix(batch, "x", width))[:, live]
                away = w - w.mean(0)
                held = merged_moments(np.concatenate([held, np.concatenate([[len(w)], w.mean(0), (away.T @ away).ravel()])[None, :]]))
        if len(held):
            yield pa.RecordBatch.from_pydict({"m": pa.array([held.ravel()], pa.list_(pa.float64()))})

    parts = rows.select("x").mapInArrow(moments, "m array<double>").withColumn("node", F.spark_partition_id().cast("long")).select("node", "m")
    total = tree_merged(parts, 1 + k + k * k, merged_moments, fan_in)[0]
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, offset: int = OFFSET, components: int = COMPONENTS, fan_in: int = FAN_IN) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row of vectors and
    each of the first `components` components.

    Three passes over the rows, of which none shuffles them: exact sums; one R factor a task, merged in a tree;
    projection. A component's sign makes its largest entry positive, the same for all rows.

    Rows without a vector, or with a null or non-finite entry, are dropped. Rows that repeat are rows, and so are those
    without an id. Shorter vectors end in entries 0; vectors that are all empty have no component and give no rows.
    Equal eigenvalues come in the order of the decomposition. A component without variance (a constant table, fewer
    rows than components) has explained 0, whitened null, and no part in identity_error. A deviation that 64 bits can't
    hold is null; entries too large for whole numbers are an error. An empty table gives no rows; other columns are
    ignored.
    """
    rows, width, n = whole_vectors(vectors, scale, offset, column)
    if not n or not width:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    rows = materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x"))
    model = fit(rows, width, n, components, fan_in)
    error = identity_error(rows, model, fan_in)
    k = len(model.variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, "x", width)
            whitened = pa.array(model.whitened(x).ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), whitened)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(x), pa.int64()), lists], ["vec_id", "deviation", "w"])

    projected = rows.mapInArrow(project, "vec_id long, deviation long, w array<double>")
    explained = model.variances / model.trace if model.trace > 0 else np.zeros(k)
    share: Column = F.element_at(F.array(*[F.lit(float(v)) for v in explained]), F.col("component"))
    out = projected.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened")).withColumn("component", F.col("place") + 1)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
