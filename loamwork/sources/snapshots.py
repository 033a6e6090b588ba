"""A claim graph on disk that grows by small merges: versions, and only the touched parts written again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.columns import node_label

#: Parts into which edges are dealt by a hash of their ends; fixed when the snapshot is made.
PARTS = 64
FORMAT = "claim-graph/2"
STATE = "cause string, effect string, n_claims long, sources array<string>, evidence array<string>, confidence double, timestamp string"
JOINER = " | "


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    place, fs = _fs(spark, f"{root}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    known = _versions(spark, root)
    if version is None:
        version = known[-1] if known else 0
    if version == 0:
        return {"version": 0, "format": FORMAT, "parts": PARTS, "folders": {}}
    if version not in known:
        raise ValueError(f"[snapshot] {root} has no version {version}\nHint: known are {known}")
    told = json.loads("".join(r.value for r in spark.read.text(f"{root}/_versions/{version:012d}.json", wholetext=True).collect()))
    if told.get("format") != FORMAT:
        raise ValueError(f"[snapshot] {root} has the format {told.get('format')}, not {FORMAT}")
    return told


def _publish(spark: SparkSession, root: str, manifest: dict) -> None:
    """The pointer to a version appears whole or not at all: it is written aside and renamed. Two writers can't both
    make a version, since a name is taken once."""
    text = json.dumps(manifest, sort_keys=True)
    aside, fs = _fs(spark, f"{root}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    name, _ = _fs(spark, f"{root}/_versions/{manifest['version']:012d}.json")
    if fs.exists(name) or not fs.rename(aside, name):
        fs.delete(aside, False)
        raise Conflict(f"[merge] version {manifest['version']} of {root} is there already\nHint: merge again on top of it")


def _of(state: DataFrame) -> DataFrame:
    """One row an edge from rows of state: counts add up, sets are united, confidence and time are the largest."""
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    return state.groupBy("cause", "effect").agg(F.sum("n_claims").alias("n_claims"), united("sources").alias("sources"), united("evidence").alias("evidence"), F.max("confidence").alias("confidence"), F.max("timestamp").alias("timestamp"))


def merge(claims: DataFrame, root: str, parts: int = PARTS, normalise: bool = True) -> int:
    """Merges claims (cause, effect, source, evidence, confidence, timestamp) into the snapshot at root; the new version.

    Edges are dealt to parts by a hash of their ends. The claims' own edges tell which parts they touch; only these are
    read, united and written anew, beside the old ones, and the new version's manifest names them instead. Until it is
    there readers see the version before, so a merge that dies leaves nothing but files that no version names
    (vacuum). A merge without edges makes no version.
    """
    spark = claims.sparkSession
    now = _manifest(spark, root)
    parts = now["parts"] if now["folders"] else parts
    c, e = (node_label("cause"), node_label("effect")) if normalise else (F.col("cause"), F.col("effect"))
    rows = claims.withColumns({"cause": c, "effect": e}).filter("cause <> effect and cause <> '' and effect <> ''")
    state = rows.groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("n_claims"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("evidence")).alias("evidence"), F.max("confidence").alias("confidence"), F.max("timestamp").alias("timestamp"))
    part = F.pmod(F.xxhash64("cause", "effect"), F.lit(parts)).cast("int")
    folder = f"{root}/merge-{uuid.uuid4().hex}"
    added = state.withColumn("part", part)
    added.write.partitionBy("part").parquet(f"{folder}/added")
    added = spark.read.schema(f"{STATE}, part int").parquet(f"{folder}/added")
    touched = sorted(r.part for r in added.select("part").distinct().collect())  # at most `parts` rows
    if not touched:
        _drop(spark, folder)
        return now["version"]
    old = [now["folders"][str(p)] for p in touched if str(p) in now["folders"]]
    both = added.drop("part")
    if old:
        both = both.unionByName(spark.read.schema(STATE).parquet(*[f"{root}/{f}" for f in old]))
    _of(both).withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/parts")
    _drop(spark, f"{folder}/added")
    name = folder.removeprefix(f"{root}/")
    folders = now["folders"] | {str(p): f"{name}/parts/part={p}" for p in touched}
    _publish(spark, root, {"version": now["version"] + 1, "format": FORMAT, "parts": parts, "folders": folders})
    return now["version"] + 1


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The edges of the last version, or of an earlier one, as merge_edges gives them."""
    folders = _manifest(spark, root, version)["folders"]
    rows = spark.read.schema(STATE).parquet(*[f"{root}/{f}" for f in folders.values()]) if folders else spark.createDataFrame([], STATE)
    return rows.withColumns({c: F.array_join(c, JOINER) for c in ("sources", "evidence")})


def versions(spark: SparkSession, root: str) -> list[int]:
    return _versions(spark, root)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes what only versions before the last `keep` name, and what none does. No merge may run meanwhile."""
    known = _versions(spark, root)
    used = {f.split("/")[0] for v in known[-keep:] for f in _manifest(spark, root, v)["folders"].values()}
    place, fs = _fs(spark, root)
    for s in fs.listStatus(place):
        if s.getPath().getName().startswith("merge-") and s.getPath().getName() not in used:
            fs.delete(s.getPath(), True)
    for v in known[:-keep]:
        fs.delete(_fs(spark, f"{root}/_versions/{v:012d}.json")[0], False)


def _drop(spark: SparkSession, path: str) -> None:
    place, fs = _fs(spark, path)
    fs.delete(place, True)
