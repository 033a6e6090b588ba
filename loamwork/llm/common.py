"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are Python objects at one time.
SLICE = 256
#: Rows of a run that is numbered by one task.
RUN_ROWS = 100_000

#: Bytes of a row group of an intermediate table.
ROW_GROUP_BYTES = 32 * 1024 * 1024

#: Paths of the intermediate tables that are still there, in the order in which they were written.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none and everything runs in this process (a local test) a temporary folder is made
    and named; on a cluster that is an error, since each executor would write to a disk of its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loamwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Cuts the lineage by files that outlive any executor; columns stay prunable. The files go when the
    application ends, or with released().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loamwork-{uuid.uuid4().hex}"
    # a writer holds a row group in memory: small ones, as rows here can be long
    writer = df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP_BYTES))
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    hadoop_path, files = _file_system(spark, path)
    files.deleteOnExit(hadoop_path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession):
    """Within: keep(df) writes df down. Afterwards all intermediate tables that were written inside are deleted, but
    for those kept; what is returned must not read any other."""
    first = len(_written)
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        out = materialize(df)
        kept.add(_written[-1])
        return out

    try:
        yield keep
    finally:  # also of a stage that has failed
        for path in [p for p in _written[first:] if p not in kept]:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path, files = _file_system(spark, path)
    files.delete(hadoop_path, True)
    _written.remove(path)


def last_written() -> str:
    return _written[-1]


def numbered_runs(df: DataFrame, order: list[Column], sums: dict[str, Column], run_rows: int = RUN_ROWS) -> DataFrame:
    """df with, for each name in sums, the sum of that column over all rows before this one in the order.

    Rows are cut into sorted runs of about run_rows; sums go inside each run and, from one row a run, between them. So
    no task sees all rows, and what is joined is a row for each run.
    """
    n = max(1, -(-df.count() // run_rows))
    before = Window.partitionBy("run_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    runs = df.withColumns(sums)
    runs = materialize((runs.repartitionByRange(n, *order) if n > 1 else runs.coalesce(1)).withColumn("run_", F.spark_partition_id()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("run_").agg(*[F.sum(c).alias(f"{c}_run_") for c in sums])
    carried = totals.select("run_", *[F.coalesce(F.sum(f"{c}_run_").over(earlier), F.lit(0)).alias(f"{c}_carried_") for c in sums])
    inside = runs.withColumns({f"{c}_before_": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
    return inside.join(carried, "run_").select(*[c for c in df.columns if c not in sums], *[(F.col(f"{c}_before_") + F.col(f"{c}_carried_")).alias(c) for c in sums])


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most `size` rows, so that long texts are Python objects a few at a time. What Arrow has
    freed by then goes back to the system at the end, as the worker waits for its next task with it."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)
    pa.default_memory_pool().release_unused()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
