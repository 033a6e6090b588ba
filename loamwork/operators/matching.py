"""Labels that are few edits apart, and claims that pair up one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.columns import col
from loamwork.functions.storage import erased, written
from loamwork.operators.graph import near_terms

#: Labels up to this length meet by what is left of them after deletions, longer ones by pieces.
LONG = 48


def transposing_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance in which two neighbours that change places count once, and no part is edited twice; null if either
    is. Expressions only: a fold over the letters of a keeps the last two rows of the table."""
    a, b = col(a), col(b)
    x, y, n = F.split(a, ""), F.split(b, ""), F.length(b)

    def next_row(s: Column, i: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            swap = (i > 1) & (j > 1) & (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
            here = F.least(F.element_at(row, -1) + 1, s["row"][j] + 1, s["row"][j - 1] + F.when(x[i - 1] == y[j - 1], 0).otherwise(1), F.when(swap, s["before"][j - 2] + 1))
            return F.concat(row, F.array(here))

        return F.struct(s["row"].alias("before"), F.aggregate(F.sequence(F.lit(1), n), F.array(i), cell).alias("row"))

    start = F.struct(F.array(F.lit(0)).alias("before"), F.sequence(F.lit(0), n).alias("row"))
    table = F.aggregate(F.sequence(F.lit(1), F.length(a)), start, next_row)
    return F.when(F.length(a) == 0, n).when(n == 0, F.length(a)).otherwise(F.element_at(table["row"], -1))


def deletions(label: Column | str, most: int) -> Column:
    """Hashes of the label with up to `most` letters deleted. Two labels that are so many edits apart, neighbours that
    change places being one, have one in common: an edit is undone by a deletion on either side or both."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    every = last = F.array(col(label))
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda s: F.when(F.length(s) > 0, one(s)).otherwise(F.array(s)))))
        every = F.array_union(every, last)
    return F.array_distinct(F.transform(every, lambda s: F.xxhash64(s)))


def near_labels(labels: DataFrame, terms: DataFrame, most: int = 2, long: int = LONG) -> DataFrame:
    """label, term, distance of all pairs at most `most` edits apart, neighbours that change places being one edit.

    Pairs meet by equality of what is left after deletions. A label over `long` letters would leave too many of these:
    such pairs meet by pieces, as two edits without changes of places stand for one with. No pair is made that isn't
    near in one of the two ways, and all are verified.
    """
    words, known = labels.select("label").filter("label is not null").distinct(), terms.select("term").filter("term is not null").distinct()
    short = lambda df, c: df.filter(F.length(c) <= long).select(c, F.explode(deletions(c, most)).alias("left"))
    met = short(words, "label").join(short(known, "term"), "left").select("label", "term").distinct()
    over = near_terms(words.filter(F.length("label") > long - most), known.filter(F.length("term") > long - most), 2 * most).select("label", "term")
    close = met.unionByName(over.filter(F.greatest(F.length("label"), F.length("term")) > long)).filter(F.levenshtein("label", "term", 2 * most) >= 0)
    return close.withColumn("distance", transposing_distance("label", "term")).filter(F.col("distance") <= most)


def greedy_pairs(left: DataFrame, right: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """left_id, right_id: in each group the left rows in order each take their first free right row in order, among
    those of a kind that `edges` joins to their own. left, right: group, id, ord, kind (id unique, ties of ord by id);
    edges: group, left_kind, right_kind.

    That is a greedy matching by the pairs' order, so it can be made in rounds in which all pairs that nobody can
    contest are made at once. Left rows of kinds with the same neighbours want the same right rows: in a round the k-th
    of them proposes to the k-th right row that is left. A proposal holds if no left row of other kinds before it wants
    that right row, and the earlier proposals of its own hold. The first row of all that are left always succeeds; rows
    that want the same are done together, so rounds are few unless wants overlap in long chains. Each round is written
    down, and that of the one before is deleted.
    """
    # kinds with the same neighbours are one
    wants = edges.groupBy(group, "left_kind").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("right_kind"))), 256).alias("want"))
    near = written(edges.join(wants, [group, "left_kind"]).select(group, "want", "right_kind").distinct())
    at = F.struct("ord", "id")
    lefts = written(left.join(wants, (left[group] == wants[group]) & (left["kind"] == wants["left_kind"])).select(left[group], "want", at.alias("at")))
    rights = written(right.join(near.select(group, F.col("right_kind").alias("kind")).distinct(), [group, "kind"], "left_semi").select(group, F.col("kind").alias("right_kind"), at.alias("to")))
    by_want, made = [group, "want"], []
    while True:
        proposing = lefts.withColumn("rank", F.row_number().over(Window.partitionBy(*by_want).orderBy("at")))
        free = near.join(rights, [group, "right_kind"]).withColumn("rank", F.row_number().over(Window.partitionBy(*by_want).orderBy("to")))
        first = lefts.groupBy(*by_want).agg(F.min("at").alias("at"))
        two = F.slice(F.array_sort(F.collect_list(F.struct("at", "want"))), 1, 2)
        rivals = near.join(first, by_want).groupBy(group, "right_kind").agg(two.alias("rivals"))
        proposals = proposing.join(free, [*by_want, "rank"]).join(rivals, [group, "right_kind"])
        # the first left row of another want that could take it before
        other = F.when(F.get("rivals", F.lit(0))["want"] == F.col("want"), F.get("rivals", F.lit(1))).otherwise(F.get("rivals", F.lit(0)))["at"]
        contested = F.when(other < F.col("at"), F.col("rank"))
        held = proposals.withColumn("until", F.min(contested).over(Window.partitionBy(*by_want))).filter(F.col("until").isNull() | (F.col("rank") < F.col("until")))
        pairs = written(held.select("at", "to"))
        if pairs.isEmpty():
            break
        made.append(pairs)
        lefts, old_lefts = written(lefts.join(pairs.select("at"), "at", "left_anti")), lefts
        rights, old_rights = written(rights.join(pairs.select("to"), "to", "left_anti")), rights
        erased(old_lefts, old_rights)
    erased(pairs, lefts, rights, near)
    out = left.sparkSession.createDataFrame([], f"left_id {dict(left.dtypes)['id']}, right_id {dict(right.dtypes)['id']}")
    for pairs in made:
        out = out.unionByName(pairs.select(F.col("at.id").alias("left_id"), F.col("to.id").alias("right_id")))
    return out
