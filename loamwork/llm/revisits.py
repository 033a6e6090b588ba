"""Operator 9: not-modified revisit records of web archives, resolved by an as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import materialize

#: Headers that a not-modified response may renew; all others stay as the full response had them.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't identify a page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)$"
#: Records of a range partition, about; of few records it is less, down to LEAST, so that all cores have one.
RUN_RECORDS, LEAST = 200_000, 4_096


def canonical_url(url: Column) -> Column:
    """Scheme and www dropped, host in lower case, no port 80/443, no fragment, tracking parameters or trailing slash;
    the other parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)https?://(www\\.)?", "")
    path, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, "\\?(.*)$", 1)
    host, rest = F.lower(F.regexp_extract(path, "^[^/]*", 0)), F.regexp_replace(F.regexp_extract(path, "/.*$", 0), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).rlike(TRACKING)))
    return F.concat(F.regexp_replace(host, ":(80|443)$", ""), rest, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, run_records: int = RUN_RECORDS) -> DataFrame:
    """Each record of `records`, with the full response that stands for a revisit.

    records: record_id, url, ts (any orderable type), kind (`response` or `revisit`), etag, last_modified, headers
    (map<string,string>). Returns record_id, canonical, kind, refers_to, status, headers. A revisit refers to the
    latest response of the same canonical url that is earlier by (ts, record_id); status is

    - `full` for a response, `unresolved` for a revisit with no earlier response (or no url or ts),
    - `validated` where the revisit's etag, or else its last-modified, equals the response's,
    - `mismatch` where they differ, `unchecked` where either side has no validator.

    A resolved revisit (validated, unchecked) has the response's headers with the permitted ones renewed by its own; a
    mismatch and an unresolved one keep their own. Header names are compared in lower case. Records without url or ts
    come last in no order: they resolve nothing. Repeated record_ids are rows of their own, ordered by their kind.
    An empty table gives no rows; other columns are ignored.

    The as-of join is a forward fill in two levels: sorted by (url, ts) over range partitions, so that a url with a
    third of all records is many runs; the last response is filled inside each run, and between the runs of a url from
    one summary row a run.
    """
    base = records.select(
        F.col("record_id").cast("long"), canonical_url(F.col("url").cast("string")).alias("canonical"), F.col("ts"), F.lower(F.col("kind").cast("string")).alias("kind"),
        F.col("etag").cast("string"), F.col("last_modified").cast("string"),
        F.transform_keys(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)).alias("headers"),
    )
    known = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    usable = base.filter(known)
    total, cores = base.count(), records.sparkSession.sparkContext.defaultParallelism
    n = max(1, total // run_records, min(2 * cores, total // LEAST))
    # the range partitions are written down with their numbers: what follows doesn't depend on cutting them again
    runs = materialize(usable.repartitionByRange(n, "canonical", "ts", "record_id", "kind").withColumn("run", F.spark_partition_id()))
    response = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    order = [F.col("ts"), F.col("record_id").asc_nulls_first(), F.col("kind")]
    in_run = Window.partitionBy("run", "canonical").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = runs.withColumn("inside", F.last(response, True).over(in_run))
    summary = runs.groupBy("canonical", "run").agg(F.max(F.when(F.col("kind") == "response", F.struct("ts", F.coalesce("record_id", F.lit(-1 << 62)).alias("r"), "kind", "record_id", "etag", "last_modified", F.to_json("headers").alias("headers")))).alias("top"))
    before = Window.partitionBy("canonical").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("carried", F.last("top", True).over(before)).filter("carried is not null")
    carried = carried.select(F.col("canonical").alias("c_canonical"), F.col("run").alias("c_run"), F.struct("carried.record_id", "carried.etag", "carried.last_modified", F.from_json("carried.headers", "map<string,string>").alias("headers")).alias("carried"))
    filled = inside.join(carried, (F.col("canonical") == F.col("c_canonical")) & (F.col("run") == F.col("c_run")), "left")
    asof = filled.select(*base.columns, F.coalesce("inside", "carried").alias("base"))
    asof = asof.unionByName(base.filter(~known).withColumn("base", F.lit(None).cast(asof.schema["base"].dataType)))

    same = F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), F.col("etag") == F.col("base.etag")).when(F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull(), F.col("last_modified") == F.col("base.last_modified"))
    status = F.when(F.col("kind") != "revisit", "full").when(F.col("base").isNull(), "unresolved").when(same, "validated").when(~same, "mismatch").otherwise("unchecked")
    out = asof.withColumn("status", F.coalesce(status, F.lit("full")))
    resolved = F.col("status").isin("validated", "unchecked")
    renewed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("base.headers", lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    return out.select("record_id", "canonical", "kind", F.when(resolved | (F.col("status") == "mismatch"), F.col("base.record_id")).alias("refers_to"), "status", F.when(resolved, F.map_concat(kept, renewed)).otherwise(F.col("headers")).alias("headers"))
