"""Tables written down in between, so that what follows neither computes nor plans what was before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it (spark.checkpoint.dir); a temporary one only
    where all runs in this process and none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("[shared_folder] spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='loamwork-')}")
    return shared_folder(spark)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again; the files go with erased(), or else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def erased(*tables: DataFrame) -> None:
    """Deletes tables that written() gave; nothing may read them any more."""
    for df in tables:
        place, files = _place(df.sparkSession, df._written_at)
        files.delete(place, True)
