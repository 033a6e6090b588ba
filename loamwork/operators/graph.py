"""Claim graphs: edges with sources, evidence, confidence and time; ranking, alignment, export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.columns import curie, node_label, turtle_text
from loamwork.functions.storage import erased, written
from loamwork.operators.quantiles import quantiles

JOINER = " | "


def merge_edges(claims: DataFrame, normalise: bool = True) -> DataFrame:
    """One row per (cause, effect): confidence the highest, sources and evidence as sorted sets, the last timestamp.

    Claims whose ends are equal, or empty, are no edges. claims: cause, effect, source, evidence, confidence, timestamp.
    """
    c, e = (node_label("cause"), node_label("effect")) if normalise else (F.col("cause"), F.col("effect"))
    rows = claims.withColumns({"cause": c, "effect": e}).filter("cause <> effect and cause <> '' and effect <> ''")
    return rows.groupBy("cause", "effect").agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.array_join(F.array_sort(F.collect_set("source")), JOINER).alias("sources"),
        F.array_join(F.array_sort(F.collect_set("evidence")), JOINER).alias("evidence"),
        F.max("confidence").alias("confidence"),
        F.max("timestamp").alias("timestamp"),
    )


def rank_edges(claims: DataFrame, vocabulary: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """Edges by number of different sources, then mean confidence, then name. With a vocabulary (term, category) the
    share of known ends is `support` and edges without are ranked behind."""
    grouped = claims.groupBy("cause", "effect").agg(F.count_distinct("source").alias("n_sources"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence"))
    order: list[Column] = [F.col("n_sources").desc_nulls_last(), F.col("mean_confidence").desc_nulls_last(), F.col("cause"), F.col("effect")]
    if vocabulary is not None:
        for end in ("cause", "effect"):
            known = vocabulary.select(F.col("term").alias(end), F.col("category").alias(f"{end}_category"))
            grouped = grouped.join(known, end, "left")
        grouped = grouped.withColumn("support", (F.col("cause_category").isNotNull().cast("double") + F.col("effect_category").isNotNull().cast("double")) / 2)
        order.insert(0, F.col("support").desc())
    ranked = grouped.orderBy(*order)
    return ranked.limit(top) if top else ranked


def rename_nodes(claims: DataFrame, names: DataFrame) -> DataFrame:
    """claims with node labels mapped by names (label, target); what becomes a self-loop is dropped."""
    out = claims
    for end in ("cause", "effect"):
        out = out.join(names.select(F.col("label").alias(end), F.col("target").alias(f"{end}_to")), end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
    return out.filter("cause <> effect")


#: Terms that may be sent to all tasks; more are joined by shuffles.
MAX_TERMS = 100_000


def _sent(terms: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What is no larger than the terms is broadcast, if these are few: they are counted once."""
    few = terms.count() <= MAX_TERMS
    return lambda df: F.broadcast(df) if few else df


def _parts(c: str) -> Column:
    """All runs of a label's underscore-separated words."""
    words = F.split(c, "_")
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), "_")))))


def _cuts(c: str, most: int) -> Column:
    """`most` + 1 pieces of a text and where they may stand in one that is at most so many edits away: (piece, number)."""
    n = most + 1
    at = lambda k: F.floor(F.length(c) * k / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(F.substring(c, at(k) + 1, at(k + 1) - at(k)).alias("piece"), at(k).alias("place")))


def near_terms(labels: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """label, term, distance of all pairs at most `most` edits apart.

    A term is cut into most + 1 pieces, of which so few edits leave one whole, moved by at most that many places: pairs
    meet by equality of a piece and only then are compared. Terms too short to be cut meet all short labels by length.
    """
    words, known, sent = labels.select("label").distinct(), terms.select("term").distinct(), _sent(terms)
    long, short = known.filter(F.length("term") > most), known.filter(F.length("term") <= most)
    pieces = sent(long).select("term", F.length("term").alias("n"), F.inline(_cuts("term", most)))
    sizes = long.select(F.length("term").alias("n")).distinct()
    # for every length of a term that a label may have, the pieces that stand at the places it would be cut at
    asked = words.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(most + 1), F.length("label") - most), F.length("label") + most))).join(sent(sizes), "n", "left_semi")
    cut = lambda k: F.floor(F.col("n") * k / (most + 1)).cast("int")
    spots = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.transform(F.sequence(F.greatest(F.lit(0), cut(k) - most), cut(k) + most), lambda s: F.struct(F.substring("label", s + 1, cut(k + 1) - cut(k)).alias("piece"), cut(k).alias("place")))))
    met = asked.select("label", "n", F.inline(F.array_distinct(spots))).join(pieces, ["n", "piece", "place"]).select("label", "term").distinct()
    tiny = words.filter(F.length("label") <= 2 * most).join(sent(short), F.abs(F.length("label") - F.length("term")) <= most).select("label", "term")
    both = met.unionByName(tiny).distinct().withColumn("distance", F.levenshtein("label", "term", most))
    return both.filter("distance >= 0")


def align(labels: DataFrame, vocabulary: DataFrame, max_distance: int = 4) -> DataFrame:
    """label, target, method: equal terms first, then the longest term that is part of the label (or the other way
    round) at underscores, then the nearest by edit distance up to max_distance; ties by term.

    Only labels that are left go to the next step; each step is an equality of labels, of their parts, or of pieces.
    """
    # both are used in every step
    words = written(labels.select("label").distinct())
    terms = written(vocabulary.select(F.col("term")).distinct())
    sent = _sent(terms)
    exact = words.join(terms, F.col("label") == F.col("term")).select("label", F.col("term").alias("target"), F.lit("exact").alias("method"))
    left = words.join(exact.select("label"), "label", "left_anti")
    inside = left.withColumn("part", F.explode(_parts("label"))).join(sent(terms), F.col("part") == F.col("term")).select("label", "term")
    around = left.join(sent(terms).withColumn("part", F.explode(_parts("term"))), F.col("part") == F.col("label")).select("label", "term")
    part = inside.unionByName(around).groupBy("label").agg(F.min_by("term", F.struct(-F.length("term"), F.col("term"))).alias("target")).withColumn("method", F.lit("substring"))
    rest = written(left.join(part.select("label"), "label", "left_anti"))
    near = near_terms(rest, terms, max_distance).groupBy("label").agg(F.min_by("term", F.struct("distance", "term")).alias("target")).withColumn("method", F.lit("edit_distance"))
    return exact.unionByName(part).unionByName(near)


def nearest_term(labels: DataFrame, terms: DataFrame, max_distance: int = 4) -> DataFrame:
    """label, term, distance: the nearest term by edit distance, ties by term."""
    return near_terms(labels, terms, max_distance).groupBy("label").agg(F.min(F.struct("distance", "term")).alias("b")).select("label", "b.term", "b.distance")


def graph_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, distinct sources and the spread of confidence."""
    nodes = edges.select(F.col("cause").alias("n")).union(edges.select("effect")).distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    spread = quantiles(edges, [], "confidence", probs).select(*[F.col("q")[i].alias(f"confidence_{round(100 * p)}") for i, p in enumerate(probs)])
    one = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("source").alias("n_sources"))
    return nodes.join(one).join(spread)


def cycle_edges(edges: DataFrame) -> DataFrame:
    """The edges (cause, effect) that lie on a cycle, or on a way from one cycle to another; none if and only if the
    graph has no cycle.

    A node without causes, or without effects, is on no such way: its edges are taken away, and then those of the nodes
    that have become so, in rounds from both sides at once. A round is two semi-joins by node, written down; the one
    before is deleted. Rounds are at most half the longest way that leads into or out of a cycle. Self-loops are cycles;
    edges without an end are none.
    """
    left = written(edges.select("cause", "effect").filter("cause is not null and effect is not null").distinct())
    n = left.count()
    while n:
        fed, feeding = left.select(F.col("effect").alias("cause")).distinct(), left.select(F.col("cause").alias("effect")).distinct()
        now = written(left.join(fed, "cause", "left_semi").join(feeding, "effect", "left_semi").select("cause", "effect"))
        erased(left)
        left, before, n = now, n, now.count()
        if n == before:
            break
    return left


def acyclic(edges: DataFrame) -> bool:
    return cycle_edges(edges).isEmpty()


def hamming(a: DataFrame, b: DataFrame) -> DataFrame:
    """Structural distance of two edge sets (cause, effect): edges only in a, only in b, and reversed ones, once."""
    e = a.select("cause", "effect").distinct().withColumn("side", F.lit("a")).unionByName(b.select("cause", "effect").distinct().withColumn("side", F.lit("b")))
    pair = e.groupBy(F.least("cause", "effect").alias("x"), F.greatest("cause", "effect").alias("y")).agg(
        F.array_sort(F.collect_set(F.when(F.col("side") == "a", F.concat_ws(">", "cause", "effect")))).alias("in_a"), F.array_sort(F.collect_set(F.when(F.col("side") == "b", F.concat_ws(">", "cause", "effect")))).alias("in_b")
    )
    only_a, only_b = F.size("in_b") == 0, F.size("in_a") == 0
    turned = ~only_a & ~only_b & (F.col("in_a") != F.col("in_b"))
    return pair.agg(F.count_if(only_a).alias("only_a"), F.count_if(only_b).alias("only_b"), F.count_if(turned).alias("turned"), F.count_if(only_a | only_b | turned).alias("distance"))


def dag_text(edges: DataFrame, least: float = 0.7) -> DataFrame:
    """Edges of enough confidence as lines of graph text."""
    return edges.filter(F.col("confidence") >= least).select(F.concat_ws(" -> ", "cause", "effect").alias("value")).distinct()


def turtle(edges: DataFrame, base: str = "http://example.org/kg#", namespaces: dict[str, str] | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """RDF Turtle lines (column value) of merged edges: a reified statement each. Further prefixes, and statements about
    the graph itself (predicate: text), may be given."""
    name = F.concat(F.lit("edge:"), curie("cause"), F.lit("__"), curie("effect"))
    sources = F.array_join(F.transform(F.split(F.coalesce("sources", F.lit("")), " \\| "), turtle_text), ", ")
    body = F.concat(
        name, F.lit(" a rdf:Statement ; rdf:subject node:"), curie("cause"), F.lit(" ; rdf:predicate edge:causes ; rdf:object node:"), curie("effect"),
        F.lit(' ; edge:confidence "'), F.format_string("%.6f", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))), F.lit('"^^xsd:float ; edge:source '), sources, F.lit(" ; edge:evidence "), turtle_text("evidence"), F.lit(" ."),
    )
    spark = edges.sparkSession
    head = ["@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", f"@prefix node: <{base}node/> .", f"@prefix edge: <{base}edge/> ."]
    head += [f"@prefix {k}: <{v}> ." for k, v in (namespaces or {}).items()]
    quoted = lambda t: '"' + t.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    head += [f"<{base}> {k} {quoted(v)} ." for k, v in (metadata or {}).items()]
    return spark.createDataFrame([(h,) for h in head], "value string").unionByName(edges.select(body.alias("value")))


def annotated_turtle(records: DataFrame, order: list[Column | str], base: str = "http://example.org/kg#") -> DataFrame:
    """RDF Turtle lines of annotated records (claims: cause, effect, polarity, confidence): a numbered statement for each
    claim, in the records' order."""
    from loamwork.operators.rows import numbered

    lined = numbered(records, order, "record_").select("record_", F.posexplode("claims").alias("place_", "c"))
    told = numbered(lined, ["record_", "place_"], "n_").select(
        "n_",
        F.concat(
            F.format_string("edge:stmt_%06d", F.col("n_")), F.lit(" a rdf:Statement ; rdf:subject node:"), curie("c.cause"), F.lit(" ; rdf:predicate edge:causes ; rdf:object node:"), curie("c.effect"),
            F.lit(" ; edge:polarity "), turtle_text("c.polarity"), F.lit(' ; edge:confidence "'), F.format_string("%.3f", F.coalesce("c.confidence", F.lit(0.0))), F.lit('"^^xsd:float .'),
        ).alias("value"),
    )
    return told.orderBy("n_").select("value")


def first_rows(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. Which one stays is fixed by the order, unlike with dropDuplicates; of rows that are
    equal in it, by all columns.

    A partial aggregate keeps one row a key in each task before anything is shuffled, so a key with very many rows is no
    single task; and the key itself travels as two hashes (128 bits), however long it is.
    """
    names = [f"k{i}_" for i in range(len(key))]
    text = F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("\u0000")) for k in key])
    row = F.struct(*[F.struct(*order).alias("order_"), F.struct(*df.columns).alias("row_")])
    firsts = df.select(F.xxhash64(text).alias(names[0]), F.hash(text, F.lit(1)).alias("k_h"), F.xxhash64(text, F.lit(2)).alias("k_x"), row.alias("r_")).groupBy(names[0], "k_h", "k_x").agg(F.min("r_").alias("r_"))
    return firsts.select("r_.row_.*")
