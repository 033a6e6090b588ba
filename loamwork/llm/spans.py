"""Regular expression matches with their offsets, by DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are summed up in one fold; more are folded block by block, so that many matches stay cheap.
FOLD = 256

SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,hit:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: elsewhere an expression is computed wherever it stands."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(F.array().cast("array<bigint>").alias("sums"), F.lit(0).cast("bigint").alias("last"))
    step = lambda acc, x: let(add(acc["last"], x), lambda total: F.struct(F.concat(acc["sums"], F.array(total)).alias("sums"), total.alias("last")))
    return F.aggregate(values, start, step)["sums"]


def _in_blocks(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD).cast("int")), lambda b: _running(F.slice(values, b * FOLD + 1, FOLD), add))

    def moved(inner: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("bigint")), _running(F.transform(inner, lambda s: F.element_at(s, -1)), add))
        both = F.arrays_zip(inner.alias("s"), F.slice(ends, 1, F.size(inner)).alias("e"))
        return F.flatten(F.transform(both, lambda z: F.transform(z["s"], lambda x: add(x, z["e"]))))

    return let(blocks, moved)


def running(values: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums of longs from 0 on, or running maxima with F.greatest; arrays longer than FOLD in blocks, each folded
    on its own and moved by the blocks before it."""
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).when(F.size(v) <= FOLD, _running(v, add)).otherwise(_in_blocks(v, add)))


def matches(text: Column, pattern: str, kind: str, kind_no: int) -> Column:
    """All leftmost non-overlapping matches of a text as array of (start, kind_no, end, kind, hit), in code points.

    split() gives what stands between the matches that regexp_extract_all() gives, so their lengths, one after the
    other, are the offsets. Texts without a match take one search.
    """

    def spans(hits: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"))
        ends = running(F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("bigint")))
        return F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(kind_no).alias("kind_no"), e.alias("end"), F.lit(kind).alias("kind"), h.alias("hit")))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans).cast(f"array<{SPAN}>")).otherwise(none)


def told(spans: Column) -> Column:
    """kind:start:end of spans, by start and then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
