"""Files: JSON lines, versioned snapshots, graph text, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAIMS = T.StructType([T.StructField(n, t) for n, t in (("cause", T.StringType()), ("effect", T.StringType()), ("source", T.StringType()), ("evidence", T.StringType()), ("confidence", T.DoubleType()), ("timestamp", T.StringType()))])
VERSION = 1


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = CLAIMS, strict: bool = True) -> DataFrame:
    """One object a line; a bad line is an error, or is left out where not strict. Blank lines don't count."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "error").option("ignoreNullFields", "false").json(path)


def save_snapshot(edges: DataFrame, path: str) -> None:
    edges.withColumn("snapshot_version", F.lit(VERSION)).write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if "snapshot_version" not in df.columns:
        raise ValueError(f"[load_snapshot] {path} is no snapshot\nHint: write it with save_snapshot()")
    other = df.filter(F.col("snapshot_version") != VERSION).limit(1).count()
    if other:
        raise ValueError(f"[load_snapshot] {path} has another version than {VERSION}")
    return df.drop("snapshot_version")


def write_lines(lines: DataFrame, path: str) -> None:
    """A DataFrame with a string column value as text."""
    lines.select("value").write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, bytes, sha256 of the files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def release(df: DataFrame, lines: DataFrame, metadata: dict, path: str) -> DataFrame:
    """Records as JSON lines, graph text and metadata in one folder, with a manifest beside them."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{path}/records")
    write_lines(lines, f"{path}/graph")
    meta = spark.createDataFrame([tuple(map(str, metadata.values()))], list(metadata)).select(F.to_json(F.struct("*")).alias("value"))
    write_lines(meta.coalesce(1), f"{path}/metadata")
    out = manifest(spark, path, "part-*")
    out.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}_manifest")
    return out


def bundle(folder: str, out: str) -> dict[str, str]:
    """A zip of a release's files on the driver, with a README that lists them; name and sha256 of each.

    Spark writes the folder; what is bundled is small and local to the driver.
    """
    import hashlib
    import zipfile
    from pathlib import Path

    files = sorted(p for p in Path(folder).rglob("part-*") if p.is_file())
    sums = {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in files}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(p.relative_to(folder)))
        z.writestr("README.md", "\n".join(["# Release", "", *[f"- `{n}` {s}" for n, s in sums.items()], ""]))
    return sums


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """id, name of the terms of an ontology file: stanzas apart by blank lines."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).filter(F.col("value").contains("[Term]"))
    rows = stanzas.select(F.regexp_extract("value", "(?m)^id: *(\\S+)", 1).alias("id"), F.regexp_extract("value", "(?m)^name: *(.+)$", 1).alias("name"))
    return rows.filter("id <> '' and name <> ''")
