"""Positions of rows: numbering without one task for all, and tables laid side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.storage import written

#: Rows of a run that one task numbers.
RUN_ROWS = 200_000


def numbered(df: DataFrame, order: list[Column | str], name: str = "position", run_rows: int = RUN_ROWS) -> DataFrame:
    """df with positions 1, 2, .. in the order. Sorted runs are numbered by themselves and moved by the sizes of the runs
    before them, of which there is a row each. The order must tell all rows apart, or equal rows may change places."""
    n = max(1, -(-df.count() // run_rows))
    runs = (df.repartitionByRange(n, *order) if n > 1 else df.coalesce(1)).withColumn("run_", F.spark_partition_id())
    runs = written(runs)  # the runs must not be cut again differently
    sizes = runs.groupBy("run_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select("run_", F.coalesce(F.sum("n_").over(Window.orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b_"))
    inside = F.row_number().over(Window.partitionBy("run_").orderBy(*order))
    return runs.withColumn("i_", inside).join(F.broadcast(before), "run_").select(*df.columns, (F.col("b_") + F.col("i_")).alias(name))


def side_by_side(a: DataFrame, b: DataFrame, order_a: list[Column | str], order_b: list[Column | str]) -> DataFrame:
    """Columns of both tables, row by row in their orders. Tables of different length, or with a common name, are an
    error."""
    common = set(a.columns) & set(b.columns)
    if common:
        raise ValueError(f"[side_by_side] both tables have {', '.join(sorted(common))}")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"[side_by_side] {n} rows beside {m}")
    return numbered(a, order_a, "position_").join(numbered(b, order_b, "position_"), "position_").drop("position_")


def carried_through(df: DataFrame, key: str, needed: list[str], work) -> DataFrame:
    """work(complete rows) joined back to all rows by their key: rows that lack a value keep their place with nulls.

    work gives the key and new columns; it may drop rows, but may not repeat them.
    """
    from loamwork.operators.selection import complete

    made = work(complete(df, needed))
    if key not in made.columns:
        raise ValueError(f"[carried_through] the result lacks the key {key}")
    return df.join(made.select(key, *[c for c in made.columns if c not in df.columns]), key, "left")
