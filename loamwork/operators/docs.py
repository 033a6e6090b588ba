"""Corpora and extracted claims: dedupe, parsing, voting, annotation, matching, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.columns import col
from loamwork.functions.storage import written
from loamwork.operators.graph import JOINER, first_rows, near_terms
from loamwork.operators.matching import greedy_pairs

CLAIM = "struct<cause:string,effect:string,evidence:string,confidence:double>"

#: Labels that mean the same when claims are matched.
SYNONYMS = {
    "map": "mean_annual_precipitation",
    "mat": "mean_annual_temperature",
    "tmean": "mean_annual_temperature",
    "t2m": "mean_annual_temperature",
    "rainfall": "precipitation",
    "som": "soc",
    "toc": "soc",
    "corg": "soc",
    "organic_carbon": "soc",
    "bdod": "bulk_density",
    "clay_content": "clay",
    "sand_content": "sand",
    "tree_cover": "vegetation",
    "native_vegetation": "vegetation",
    "forest_cover": "vegetation",
}


def normalise_corpus(df: DataFrame) -> DataFrame:
    """source, title, abstract, year, doi, url; what is missing is null; rows without an abstract go."""
    kinds = {"source": "string", "title": "string", "abstract": "string", "year": "int", "doi": "string", "url": "string"}
    out = df.select(*[(F.expr(f"try_cast(`{c}` as {k})") if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])
    return out.filter(F.length(F.trim("abstract")) > 0)


def dedupe_corpus(df: DataFrame, order: list[Column], doi: str = "doi", title: str = "title") -> DataFrame:
    """The first row of each key: the doi in lower case, or else the title in lower case with blanks squeezed. Rows with
    neither all stay."""
    bare = F.lower(F.trim(F.col(doi)))
    key = F.when(F.length(bare) > 0, bare).otherwise(F.lower(F.trim(F.regexp_replace(F.col(title), "\\s+", " "))))
    keyed = df.withColumn("key_", key)
    kept = first_rows(keyed.filter("key_ is not null"), [F.col("key_")], order)
    return kept.unionByName(keyed.filter("key_ is null")).drop("key_")


def with_index(df: DataFrame, text: str, name: str = "index") -> DataFrame:
    """df with the inverted index of each text split at single blanks: an array of word and positions, null of a null
    text. A text's words are sorted and cut into runs in place; nothing is shuffled."""
    words = F.array_sort(F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))
    first = F.filter(F.transform("w_", lambda x, i: F.when((i == 0) | (F.get("w_", i - 1)["word"] != x["word"]), i)), lambda i: i.isNotNull())
    runs = F.zip_with("f_", F.concat(F.slice("f_", 2, F.size("f_")), F.array(F.size("w_"))), lambda a, b: F.struct(F.get("w_", a)["word"].alias("word"), F.transform(F.slice("w_", a + 1, b - a), lambda x: x["pos"]).alias("positions")))
    return df.withColumn("w_", words).withColumn("f_", first).withColumn(name, runs).drop("w_", "f_")


def text_of(index: Column | str) -> Column:
    """The text of an array of word and positions: words in the order of their positions, gaps dropped; null of none."""
    placed = F.transform(col(index), lambda e: F.transform(e["positions"], lambda p: F.struct(p.alias("pos"), e["word"].alias("word"))))
    return F.when(F.size(col(index)) > 0, F.array_join(F.transform(F.array_sort(F.flatten(placed)), lambda x: x["word"]), " "))


def inverted_index(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, word, positions of each text: the rows of with_index."""
    return with_index(df, text, "i_").select(doc, F.inline("i_"))


def from_inverted_index(index: DataFrame, doc: str) -> DataFrame:
    """Texts again from rows of doc, word, positions, which are shuffled to their document; text_of takes an index that
    is still one row a document."""
    # a text's words are gathered before they are shuffled, and laid out in place
    gathered = index.groupBy(doc).agg(F.collect_list(F.struct("word", "positions")).alias("i_"))
    return gathered.select(doc, text_of("i_").alias("text"))


def parse_claims(df: DataFrame, answer: str) -> DataFrame:
    """Claims in model answers: the outermost braces parsed as JSON {"claims": [...]}; ends trimmed in lower case; blank
    ends and self-loops go. Answers that can't be parsed give no rows."""
    parsed = F.from_json(F.regexp_extract(answer, "(?s)\\{.*\\}", 0), f"struct<claims:array<{CLAIM}>>")
    rows = df.withColumn("p_", parsed).select(*df.columns, F.inline("p_.claims"))
    rows = rows.withColumns({"cause": F.lower(F.trim("cause")), "effect": F.lower(F.trim("effect"))})
    return rows.filter("cause <> '' and effect <> '' and cause <> effect")


def vote(claims: DataFrame, rule: str, weights: dict[str, float] | None = None, voters: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Edges on which voters agree; claims: voter, cause, effect, evidence (if there is one), confidence, ord, and further
    key columns.

    Of each voter the first claim of an edge counts; its different pieces of evidence are joined in the claims' order. majority: at least half of the voters; weighted: the weighted
    confidences reach half of all weights; intersection: all voters.
    """
    key = key or []
    n = voters or (len(weights) if weights else claims.select("voter").distinct().count())
    weight = F.lit(1.0) if not weights else F.coalesce(F.create_map(*[F.lit(x) for v, w in weights.items() for x in (v, w)])[F.col("voter")], F.lit(0.0))
    total = sum(weights.values()) if weights else float(n)
    firsts = first_rows(claims, [*map(F.col, key), F.col("voter"), F.col("cause"), F.col("effect")], [F.col("ord")])
    said = F.col("evidence") if "evidence" in claims.columns else F.lit(None).cast("string")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("voter", "ord", said.alias("e")))), lambda x: x["e"])
    grouped = firsts.groupBy(*key, "cause", "effect").agg(
        F.count(F.lit(1)).alias("n_voters"), F.avg("confidence").alias("mean_confidence"), F.sum(weight * F.col("confidence")).alias("weighted"),
        F.array_join(F.array_sort(F.collect_list("voter")), JOINER).alias("voters"), F.array_join(F.array_distinct(F.array_compact(in_order)), JOINER).alias("evidence"),
    )
    keep = {"majority": F.col("n_voters") >= -(-n // 2), "weighted": F.col("weighted") >= 0.5 * total, "intersection": F.col("n_voters") == n}[rule]
    return grouped.filter(keep)


def canonical(c: Column | str) -> Column:
    """A label for matching: lower case, blanks to one underscore, other signs (hyphens too) dropped, synonyms made one."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "\\s+", "_"), "[^a-z0-9_]", "")
    return F.coalesce(F.create_map(*[F.lit(v) for kv in SYNONYMS.items() for v in kv])[x], x)


def match_exact(predicted: DataFrame, gold: DataFrame, doc: str = "abstract_id") -> DataFrame:
    """doc, cause, effect, outcome (tp, fp, fn): equal claims of a document pair up one to one."""
    p = predicted.groupBy(doc, canonical("cause").alias("cause"), canonical("effect").alias("effect")).agg(F.count(F.lit(1)).alias("np"))
    g = gold.groupBy(doc, canonical("cause").alias("cause"), canonical("effect").alias("effect")).agg(F.count(F.lit(1)).alias("ng"))
    both = p.join(g, [doc, "cause", "effect"], "full").fillna(0, ["np", "ng"])
    out = both.select(doc, "cause", "effect", F.explode(F.map_from_arrays(F.array(F.lit("tp"), F.lit("fp"), F.lit("fn")), F.array(F.least("np", "ng"), F.greatest(F.col("np") - F.col("ng"), F.lit(0)), F.greatest(F.col("ng") - F.col("np"), F.lit(0))))).alias("outcome", "n"))
    return out.filter("n > 0")


def match_greedy(predicted: DataFrame, gold: DataFrame, doc: str = "abstract_id", slack: int = 2) -> DataFrame:
    """As match_exact, but a predicted claim, in order, takes the first free gold claim that is equal or whose ends are
    `slack` edits away in all. Claims: doc, cause, effect, ord; of claims with one ord any order holds.

    Labels that are near are found once, over all documents, and claims meet by equality of them; documents of any
    number of claims are paired up in rounds. A claim without a document or an end meets none.
    """
    rows = lambda df: written(df.select(F.col(doc).alias("doc"), "ord", canonical("cause").alias("cause"), canonical("effect").alias("effect"), F.monotonically_increasing_id().alias("id")).withColumn("kind", F.struct("cause", "effect")))
    p, g = rows(predicted), rows(gold)

    def near(end: str) -> DataFrame:
        found = near_terms(p.select(F.col(end).alias("label")).filter("label is not null"), g.select(F.col(end).alias("term")).filter("term is not null"), slack)
        return found.select(F.col("label").alias(end), F.col("term").alias(f"g_{end}"), F.col("distance").alias(f"{end}_edits"))

    kinds = p.select("doc", "cause", "effect").distinct().join(near("cause"), "cause").join(near("effect"), "effect").filter(F.col("cause_edits") + F.col("effect_edits") <= slack)
    golds = g.select("doc", F.col("cause").alias("g_cause"), F.col("effect").alias("g_effect")).distinct()
    kind = lambda c, e: F.struct(F.col(c).alias("cause"), F.col(e).alias("effect"))
    edges = kinds.join(golds, ["doc", "g_cause", "g_effect"]).select("doc", kind("cause", "effect").alias("left_kind"), kind("g_cause", "g_effect").alias("right_kind"))
    pairs = written(greedy_pairs(p.select("doc", "id", "ord", "kind"), g.select("doc", "id", "ord", "kind"), edges, "doc"))
    told = lambda df, outcome: df.select(F.col("doc").alias(doc), "cause", "effect", outcome.alias("outcome"))
    met = p.join(pairs.select(F.col("left_id").alias("id"), F.lit(True).alias("met")), "id", "left")
    missed = g.join(pairs.select(F.col("right_id").alias("id")), "id", "left_anti")
    return told(met, F.when(F.col("met"), "tp").otherwise("fp")).unionByName(told(missed, F.lit("fn")))


def precision_recall(outcomes: DataFrame, by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of each group and, with a null group, of all: one pass over grouping sets."""
    one = F.col("n") if "n" in outcomes.columns else F.lit(1)
    counts = outcomes.rollup(by).agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == k, one)), F.lit(0)).cast("long").alias(k) for k in ("tp", "fp", "fn")])
    p, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def kappa(marks: DataFrame, key: list[str], rater: str = "rater") -> DataFrame:
    """Cohen's kappa of each pair of raters over the union of the keys that they mark; null if chance alone agrees."""
    held = marks.select(*key, F.col(rater).alias("r")).filter("r is not null").distinct()
    counts = held.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    a, b = (counts.select(F.col("r").alias(f"rater_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    marked = held.groupBy(*key).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    after = F.transform("rs", lambda x, i: F.transform(F.slice("rs", i + 2, F.size("rs")), lambda y: F.struct(x.alias("rater_a"), y.alias("rater_b"))))
    same = marked.select(F.inline(F.flatten(after))).groupBy("rater_a", "rater_b").agg(F.count(F.lit(1)).alias("n_both"))
    pairs = a.join(b, F.col("rater_a") < F.col("rater_b")).join(same, ["rater_a", "rater_b"], "left").fillna(0, ["n_both"])
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    agreed, pa, pb = F.col("n_both") / either, F.col("n_a") / either, F.col("n_b") / either
    chance = pa * pb + (1 - pa) * (1 - pb)
    return pairs.select("rater_a", "rater_b", F.when(F.abs(1 - chance) >= 1e-10, (agreed - chance) / (1 - chance)).alias("kappa"))


def token_cost(df: DataFrame, n: str, price_in: str, price_out: str, tokens_in: int = 700, tokens_out: int = 110) -> DataFrame:
    return df.withColumn("cost", F.col(n) * (tokens_in * F.col(price_in) + tokens_out * F.col(price_out)) / 1e6)


def validate_annotations(df: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Records (abstract_id, abstract_text, claims) with an array `errors`; none where all holds."""
    c = lambda f: F.exists(F.coalesce("claims", F.array().cast(df.schema["claims"].dataType)), f)
    checks = {
        "abstract_id is missing": F.col("abstract_id").isNull(),
        "abstract_text is missing": F.col("abstract_text").isNull(),
        "a claim lacks an end": c(lambda x: x["cause"].isNull() | x["effect"].isNull()),
        "a polarity isn't + or -": c(lambda x: ~F.coalesce(x["polarity"].isin("+", "-"), F.lit(False))),
        "a confidence isn't in 0..1": c(lambda x: ~F.coalesce(x["confidence"].between(0, 1), F.lit(False))),
    }
    if vocabulary:
        checks["a label isn't in the vocabulary"] = c(lambda x: ~x["cause"].isin(vocabulary) | ~x["effect"].isin(vocabulary))
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()])))


def export_annotations(df: DataFrame) -> DataFrame:
    """Records with the claims that are accepted; a claim without a status is."""
    return df.withColumn("claims", F.filter("claims", lambda x: ~F.coalesce(x["status"].isin("rejected", "draft"), F.lit(False)))).withColumn("claims", F.transform("claims", lambda x: x.dropFields("status")))


def fill_gaps(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """value with gaps filled on the line between their neighbours; the ends hold the nearest value."""
    w = Window.partitionBy(*by).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    a = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = F.first(known, True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    line = a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["t"]) / (b["t"] - a["t"])
    return df.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line))
