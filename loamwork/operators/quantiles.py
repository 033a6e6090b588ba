"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.storage import erased, written

#: Values of a group, or of a part of one, that are sorted in one place; groups over this are counted in parts.
HELD = 10_000
#: Parts into which the range of a part is cut in one pass.
PARTS = 1_024
#: Groups over HELD whose parts may be sent to all tasks; more are joined by shuffles.
MAX_SENT = 2_000
LARGEST = 1.7976931348623157e308


def _fraction(v: Column, lo: Column, hi: Column) -> Column:
    """Where v lies from lo to hi, 0..1; it never falls as v rises. Halves don't overflow."""
    clamp = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x)) / 2
    return (clamp(v) - clamp(lo)) / (clamp(hi) - clamp(lo))


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], also: list[Column] | None = None, held: int = HELD, parts: int = PARTS) -> DataFrame:
    """by, the aggregates of `also`, and q: the quantiles at probs of each group, on the line between the two order
    statistics (type 7). Nulls and NaN don't count; infinite values are the largest that there are. A group without
    values has a null q.

    A group of at most `held` values is one percentile aggregate, whose state is its values. A larger one is counted in
    `parts` equal cuts of its range, of which only those that hold a wanted order statistic are cut again between their
    least and largest value, until they are one value or `held` at most; those are then sorted. So no state grows with a
    group, and each pass is a partial aggregate over the rows.
    """
    also = also or []
    g = F.struct(*by) if by else F.lit(0)
    v = F.col(value).cast("double")
    known = F.when(~F.isnan(v), v)
    sizes = df.groupBy(g.alias("g_")).agg(F.count(known).alias("n")).filter(F.col("n") > held)
    large = written(sizes)
    count = large.count()
    whole = lambda rows: rows.groupBy(*by).agg(*also, F.percentile(known, F.array(*map(F.lit, probs))).alias("q"))
    if not count:
        erased(large)
        return whole(df)
    sent = lambda t: F.broadcast(t) if count <= MAX_SENT else t
    rest = df.withColumn("g_", g).join(sent(large.select("g_")), "g_", "left_anti").drop("g_")

    # the two order statistics of each quantile, from 0
    position = lambda p: (F.col("n") - 1) * F.lit(float(p))
    low = lambda p: F.floor(position(p))
    high = lambda p: F.ceil(position(p))
    wanted = large.select("g_", "n", F.array_sort(F.array_distinct(F.array(*[f(p) for p in probs for f in (low, high)]))).alias("ranks"))
    rows = df.select(g.alias("g_"), known.alias("v")).filter("v is not null").join(sent(wanted.select("g_")), "g_", "left_semi")
    ends = rows.groupBy("g_").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("size"))
    # part: a range of a group between two of its values, with `below` values under it and the ranks that it holds
    open_ = written(wanted.join(ends, "g_").select("g_", "lo", "hi", "size", F.lit(0).cast("long").alias("below"), "ranks"))
    found, small, tables = [], [], [open_]

    def placed(ranges: DataFrame) -> DataFrame:
        """The rows that lie in one of the parts of their group: parts don't overlap."""
        spans = ranges.groupBy("g_").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "below", "ranks"))).alias("spans"))
        return rows.join(sent(spans), "g_").withColumn("at", F.get(F.filter("spans", lambda s: F.col("v").between(s["lo"], s["hi"])), F.lit(0))).filter("at is not null").select("g_", "v", "at.*")

    while True:
        found.append(open_.filter("lo = hi").select("g_", F.explode("ranks").alias("rank"), F.col("lo").alias("v")))
        small.append(open_.filter(F.col("size") <= held).filter("lo < hi"))
        again = open_.filter(F.col("size") > held).filter("lo < hi")
        if again.isEmpty():
            break
        cut = F.least(F.floor(_fraction(F.col("v"), F.col("lo"), F.col("hi")) * parts), F.lit(parts - 1))
        counts = placed(again).groupBy("g_", F.col("below").alias("under"), "ranks", cut.alias("cut")).agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = Window.partitionBy("g_", "under").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
        below = counts.withColumn("below", F.col("under") + F.coalesce(F.sum("size").over(before), F.lit(0)))
        held_ranks = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("size")))
        open_ = written(below.withColumn("ranks", held_ranks).filter(F.size("ranks") > 0).select("g_", "lo", "hi", "size", "below", "ranks"))
        tables.append(open_)

    last = small[0]
    for t in small[1:]:
        last = last.unionByName(t)
    sorted_ = placed(last).groupBy("g_", "below", "ranks").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    picked = sorted_.select("g_", "below", "vs", F.explode("ranks").alias("rank")).select("g_", "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
    for t in found:
        picked = picked.unionByName(t)
    values = written(picked.groupBy("g_").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of")))
    # between equal values the line is that value, to the last bit: rounding may put the weighted sum under it
    level = lambda p: (low(p) == high(p)) | (F.col("of")[low(p)] == F.col("of")[high(p)])
    line = lambda p: F.when(level(p), F.col("of")[low(p)]).otherwise((high(p) - position(p)) * F.col("of")[low(p)] + (position(p) - low(p)) * F.col("of")[high(p)])
    q = values.join(large, "g_").select("g_", F.array(*[line(p) for p in probs]).alias("q"))
    others = df.withColumn("g_", g).join(sent(large.select("g_")), "g_", "left_semi").groupBy("g_").agg(*also, F.count(F.lit(1)).alias("rows_")).drop("rows_")
    names = [F.col("g_")[b].alias(b) for b in by]
    joined = others.join(q, "g_").select(*names, *[c for c in others.columns if c != "g_"], "q")
    erased(*tables)
    # a table of one group has no other
    return joined if not by else joined.unionByName(whole(rest))
