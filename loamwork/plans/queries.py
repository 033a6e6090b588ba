"""The operators as queries on the star schema: each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.functions import columns as C
from loamwork.operators import active, adapters, causal, docs, graph, grids, kernels, matching, metrics, moments, neighbours, posterior, rasters, rows, selection, structure
from loamwork.operators.quantiles import quantiles
from loamwork.streaming import assimilation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def one_row(spark: SparkSession, **values) -> DataFrame:
    return rounded(spark.createDataFrame([tuple(None if v is None else float(v) if isinstance(v, float) or hasattr(v, "dtype") else v for v in values.values())], list(values)), 4)


# metrics and posterior


def predictions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    unit = li.groupBy("l_returnflag").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    p = li.join(unit, "l_returnflag").withColumn("predicted", F.col("l_quantity") * F.col("unit"))
    return p.select("l_returnflag", F.col("l_extendedprice").alias("observed"), "predicted", (0.8 * F.col("predicted")).alias("lower"), (1.2 * F.col("predicted")).alias("upper"))


def metrics_by_flag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.score(predictions(spark, d), ["l_returnflag"], lower="lower", upper="upper", interval=0.9))


def ece_levels(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_brand", "p_retailprice")
    levels = [0.1, 0.25, 0.5, 0.75, 0.9]
    q = quantiles(part, ["p_brand"], "p_retailprice", levels)
    out = metrics.calibration_error(part.join(q, "p_brand"), "p_retailprice", "q", levels)
    # shares of repeated rows lie on halves of the last digit; these go as SQL rounds them, by the product
    return out.select("level", *[(F.round(F.col(c) * 1e4) / 1e4).alias(c) for c in ("share", "gap")])


def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of prices by flag: groups so large that they are counted in parts."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    out = quantiles(li, ["l_returnflag"], "l_extendedprice", [0.0, 0.05, 0.5, 0.999, 1.0], [F.count(F.lit(1)).alias("n")], held=500)
    return rounded(out.select("l_returnflag", "n", *[F.col("q")[i].alias(f"q{i}") for i in range(5)]))


def supplier_draws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_extendedprice").alias("value"))


def supplier_truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_acctbal") * 4 + 10000).alias("observed"))


def posterior_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(posterior.summary(supplier_draws(spark, d)))


def crps_by_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(posterior.crps(supplier_draws(spark, d), supplier_truth(spark, d)))


def picp_mpiw(spark: SparkSession, d: str) -> DataFrame:
    return rounded(posterior.interval_coverage(supplier_draws(spark, d), supplier_truth(spark, d)).withColumn("mpiw", F.round("mpiw", 1)))


def interval_reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(posterior.reliability(posterior.interval_coverage(supplier_draws(spark, d), supplier_truth(spark, d))))


def minmax_constant_rules(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("v"))
    of = {r: C.min_max("v", ["p_size"], r) for r in ("one", "zero", "middle")}
    return rounded(part.select("p_partkey", *[x.alias(f"scaled_{r}") for r, x in of.items()]), 6)


# linear effects


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("w1"), F.col("l_tax").alias("w2"))


def ols_slope_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.effects_by_group(lines(spark, d), "l_returnflag", "y", "x", ["w1"]), 3)


def ols_by_group(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    return rounded(li.groupBy("l_returnflag").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2")), 3)


def iv_2sls(spark: SparkSession, d: str) -> DataFrame:
    fit = moments.two_stage(lines(spark, d), "y", "x", ["w1"])
    return one_row(spark, effect=round(fit["effect"], 2), n=fit["n"])


def iv_first_stage_f(spark: SparkSession, d: str) -> DataFrame:
    fit = moments.first_stage(lines(spark, d), "y", ["x"], [])
    return one_row(spark, f=round(fit["f"], 1), partial_r2=fit["partial_r2"])


def iv_sargan(spark: SparkSession, d: str) -> DataFrame:
    fit = moments.two_stage(lines(spark, d), "y", "x", ["w1", "w2"])
    return one_row(spark, sargan_df=fit["sargan_df"], sargan=fit["sargan"])


def sensitivity_grid(spark: SparkSession, d: str) -> DataFrame:
    """Discounts and taxes of the lines stand for a confounder's shares."""
    cases = table(spark, d, "lineitem").select(F.col("l_discount").alias("r2_outcome"), F.col("l_tax").alias("r2_exposure"))
    out = causal.confounded(cases.groupBy("r2_outcome", "r2_exposure").agg(F.count(F.lit(1)).alias("n")), 1.0, 0.5, 100)
    return rounded(out, 6)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("value").alias("y"), (F.col("user_id") % 17).cast("double").alias("x"))


def rolling_effect(spark: SparkSession, d: str) -> DataFrame:
    return rounded(causal.rolling_effect(daily(spark, d), "day", "y", "x", window=12, step=3), 4)


def mann_kendall(spark: SparkSession, d: str) -> DataFrame:
    days = daily(spark, d).groupBy("day").agg(F.round(F.avg("y"), 6).alias("v"))
    fit = causal.mann_kendall(days, "day", "v")
    return one_row(spark, n=fit["n"], s=float(fit["s"]), tau=float(fit["tau"]), var=float(fit["var"]))


def leverage_topk(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"))
    lev = moments.leverage(li, li, ["x1", "x2"]).withColumn("leverage", F.round(F.col("leverage") * 1e4, 5))
    return rounded(lev.orderBy(F.col("leverage").desc(), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", "leverage"), 5)


# documents and graphs


def corpus_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("doi"), F.col("text").alias("title"))
    return docs.dedupe_corpus(rows, [F.col("doc_id")]).select("doc_id")


def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.node_label(F.concat_ws(" - ", "p_name", "p_brand", "p_type")).alias("label"))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = ev.select(F.lag("event_type").over(w).alias("cause"), F.col("event_type").alias("effect"), F.concat(F.lit("user "), (F.col("user_id") % 10).cast("string")).alias("source"), F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string")).alias("evidence"), F.round(F.col("value") / (1 + F.abs("value")), 6).alias("confidence"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return rows.filter("cause is not null")


def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_edges(transitions(spark, d)).withColumn("confidence", F.round("confidence", 6))


def edge_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.rank_edges(transitions(spark, d)).select("cause", "effect", "n_sources", "mean_confidence", "max_confidence"), 4)


def edge_rename(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("click", "act"), ("view", "act"), ("purchase", "buy")], "label string, target string")
    return graph.rename_nodes(transitions(spark, d), names).groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("n"))


#: A small vocabulary against which part types are aligned.
TERMS = ["standard", "large_brass", "promo_burnished_copper", "economy", "small_plated_tin", "medium_polished_steal", "copper", "nickle"]


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


def part_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(C.node_label("p_type").alias("label"))


def align_cascade(spark: SparkSession, d: str) -> DataFrame:
    return graph.align(part_labels(spark, d), terms(spark))


def align_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(x,) for x in ("econmy", "stndard", "promo", "medum", "smal")], "term string")
    return rounded(graph.nearest_term(part_labels(spark, d), t, 4))


def voters(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select("doc_id", "source")
    rows = ids.select("doc_id", "source", F.explode(F.array(*[F.struct(F.lit(v).alias("voter"), F.lit(k).alias("k")) for k, v in enumerate(("a", "b", "c"), 1)])).alias("v"))
    rows = rows.select("doc_id", F.col("v.voter").alias("voter"), F.col("source").alias("cause"), F.concat(F.lit("e"), ((F.col("doc_id") * F.col("v.k")) % 4).cast("string")).alias("effect"), (((F.col("doc_id") * 7 + F.col("v.k") * 3) % 10) / 10.0).alias("confidence"), F.col("doc_id").alias("ord"))
    return rows


def _vote(spark: SparkSession, d: str, rule: str) -> DataFrame:
    rows = voters(spark, d).withColumn("k", (F.col("doc_id") / 40).cast("long"))
    w = {"a": 1.0, "b": 2.0, "c": 0.5} if rule == "weighted" else None
    return rounded(docs.vote(rows.drop("doc_id"), rule, w, 3, ["k"]).select("k", "cause", "effect", "n_voters", "mean_confidence", "voters"))


def vote_majority(spark: SparkSession, d: str) -> DataFrame:
    return _vote(spark, d, "majority")


def vote_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _vote(spark, d, "weighted")


def vote_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _vote(spark, d, "intersection")


def claim_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lb = table(spark, d, "labels")
    p = lb.select((F.col("doc_id") % 20).alias("abstract_id"), F.concat(F.lit("Node "), (F.col("doc_id") % 7).cast("string")).alias("cause"), F.concat(F.lit("Effect "), F.col("quality").cast("string")).alias("effect"), F.col("doc_id").alias("ord"))
    g = lb.select((F.col("doc_id") % 20).alias("abstract_id"), F.concat(F.lit("node_"), (F.col("doc_id") % 7).cast("string")).alias("cause"), F.concat(F.lit("effect_"), F.greatest("quality", "toxic").cast("string")).alias("effect"), F.col("doc_id").alias("ord"))
    return p, g


def claim_match_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(docs.match_exact(*claim_sets(spark, d)))


def claim_match_greedy(spark: SparkSession, d: str) -> DataFrame:
    return docs.match_greedy(*claim_sets(spark, d))


def swapped_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of parts against the same with two neighbours swapped and, of the longer ones, a letter lost."""
    labels = part_labels(spark, d).select("label").distinct()
    swapped = F.concat(F.substring("label", 1, 2), F.substring("label", 4, 1), F.substring("label", 3, 1), F.substr("label", F.lit(5)))
    terms = labels.select(F.when(F.length("label") > 20, F.left(swapped, F.length(swapped) - 1)).otherwise(swapped).alias("term"))
    return rounded(matching.near_labels(labels, terms, 2))


def prf1(spark: SparkSession, d: str) -> DataFrame:
    out = docs.precision_recall(docs.match_exact(*claim_sets(spark, d)), "abstract_id")
    return rounded(out.withColumn("abstract_id", F.coalesce("abstract_id", F.lit(-1))), 4)


def kappa(spark: SparkSession, d: str) -> DataFrame:
    lb = table(spark, d, "labels")
    marks = lb.filter("quality = 1").select("doc_id", F.lit("quality").alias("rater")).unionByName(lb.filter("toxic = 0").select("doc_id", F.lit("clean").alias("rater"))).unionByName(lb.filter("doc_id % 2 = 0").select("doc_id", F.lit("even").alias("rater")))
    return rounded(docs.kappa(marks, ["doc_id"]), 4)


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("small", 0.15, 0.6), ("large", 3.0, 15.0), ("local", 0.0, 0.0)], "model string, price_in double, price_out double")
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return rounded(docs.token_cost(prices.join(F.broadcast(n)), "n", "price_in", "price_out").select("model", "n", "cost"), 4)


def json_claims(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", F.concat(F.lit('Sure: {"claims":[{"cause":" '), F.col("event_type"), F.lit('","effect":"X'), (F.col("user_id") % 3).cast("string"), F.lit('","evidence":"e","confidence":0.5},{"cause":"","effect":"y"}]} done')).alias("answer"))
    return docs.parse_claims(ev, "answer").select("event_id", "cause", "effect", "confidence")


def inverted_index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    back = docs.with_index(t, "text").select("doc_id", docs.text_of("index").alias("text"))
    return back.select("doc_id", F.md5("text").alias("text_md5"))


def shd_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "nation").select(F.col("n_name").alias("cause"), F.lag("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("effect"), "n_nationkey").filter("effect is not null")
    b = li.select(F.when(F.col("n_nationkey") % 3 == 0, F.col("effect")).otherwise(F.col("cause")).alias("cause"), F.when(F.col("n_nationkey") % 3 == 0, F.col("cause")).otherwise(F.col("effect")).alias("effect"), "n_nationkey").filter("n_nationkey % 4 <> 1")
    return rounded(graph.hamming(li, b))


# neighbours, selection, grids


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.knn(points(spark, d), "x", "y", "vec_id", 8).select("src", "dst", F.col("rank").cast("long").alias("rank")))


def knn_weights(spark: SparkSession, d: str) -> DataFrame:
    e = neighbours.edge_weights(neighbours.knn(points(spark, d), "x", "y", "vec_id", 8))
    return rounded(e.select("src", "dst", "weight"), 4)


def attention_softmax(spark: SparkSession, d: str) -> DataFrame:
    e = neighbours.edge_weights(neighbours.knn(points(spark, d), "x", "y", "vec_id", 8)).withColumn("s", ((F.col("src") * 3 + F.col("dst") * 5) % 11 - 5) / 2.0)
    return rounded(neighbours.attention(e, "s", "weight").select("src", "dst", "alpha"), 4)


def min_distance_select(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    far = selection.distance_to_set(p, p.filter("label = 0"), "vec_id", "embedding")
    return rounded(selection.rank_by(far.withColumn("d", F.round("distance", 4)), F.col("d"), "vec_id", 25).select("vec_id", F.col("score").alias("distance")), 4)


def part_grid(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.groupBy(F.col("p_size").cast("int").alias("row"), F.substring("p_brand", 7, 2).cast("int").alias("col")).agg(F.round(F.avg("p_retailprice"), 4).alias("gain"), F.round(F.coalesce(F.stddev_samp("p_retailprice"), F.lit(0.0)), 4).alias("sd"))


def topk_priority(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.grid_priority(part_grid(spark, d), "gain", "sd", 25, "product").select("row", "col", "score"), 2)


def semi_join_candidates(spark: SparkSession, d: str) -> DataFrame:
    among = table(spark, d, "part").filter("p_retailprice % 10 < 1").select(F.col("p_size").cast("int").alias("row"), F.substring("p_brand", 7, 2).cast("int").alias("col"))
    return rounded(selection.grid_priority(part_grid(spark, d), "gain", "sd", 25, "gain", among).select("row", "col", "score"), 2)


def lag_mass_balance(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "value")
    return rounded(grids.lag_loss(ev, ["user_id"], "o", "value", 0.1, 5.0), 3)


def gap_fill_linear(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_type", F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("t"), "value")
    hourly = ev.groupBy("event_type", "t").agg(F.avg("value").alias("value"))
    span = ev.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    calendar = ev.select("event_type").distinct().join(F.broadcast(span)).select("event_type", F.explode(F.sequence("a", "b", F.lit(3600).cast("long"))).alias("t"))
    holes = calendar.join(hourly, ["event_type", "t"], "left")
    return rounded(docs.fill_gaps(holes, ["event_type"], "t", "value").select("event_type", "t", "filled"), 6)


def topsoil_first_row(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_quantity >= 10 and l_discount <= 0.05").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(graph.first_rows(li, [F.col("l_orderkey")], [F.col("l_linenumber"), F.col("l_quantity")]))


def folds(spark: SparkSession, d: str) -> DataFrame:
    cu = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return grids.round_robin_folds(cu, "c_nationkey", "c_custkey")


def fold_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return rounded(folds(spark, d).select("c_custkey", F.col("fold").cast("long").alias("fold")))


def cv_summary(spark: SparkSession, d: str) -> DataFrame:
    by = folds(spark, d).groupBy("c_nationkey", "fold").agg(F.avg("c_acctbal").alias("score"))
    return rounded(grids.fold_summary(by, "c_nationkey", ["score"]), 3)


# kernels and curves


def rbf_gram(spark: SparkSession, d: str) -> DataFrame:
    # the dense kernel is over the labelled prototypes, one mean vector a class
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    proto = e.groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))
    return rounded(kernels.rbf_pairs(proto, "label", "x", 0.5), 5)


def kernel_1qubit(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return rounded(p.select("vec_id", kernels.one_qubit(F.col("x"), F.col("y")).alias("k")), 6)


def cosine_schedule(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("t"))
    return rounded(steps.select("p_partkey", "t", C.noise_schedule("t", 50).alias("alphabar")), 6)


def profile_closed_form(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.explode(F.array(*[F.lit(float(z)) for z in (0, 5, 15, 30, 60, 100)])).alias("depth"))
    y = C.depth_curve("depth", F.col("p_retailprice"), F.lit(100.0), F.lit(0.05), F.col("p_size") / 1000.0)
    return rounded(part.select("p_partkey", "depth", y.alias("y")), 3)


def taper_gaspari_cohn(spark: SparkSession, d: str) -> DataFrame:
    cu = table(spark, d, "customer").select("c_custkey", (F.abs("c_acctbal") / 2000).alias("distance"))
    return rounded(cu.withColumn("taper", C.taper("distance", 2.0)), 9)


def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.z_score(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"], fill=0.0), 5)


def robustness_values(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("t"))
    return rounded(sup.select("s_suppkey", C.robustness("t", F.lit(100.0)).alias("rv")), 6)


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.graph_summary(transitions(spark, d).filter("cause <> effect")), 4)


def window_event_counts(spark: SparkSession, d: str) -> DataFrame:
    from loamwork.streaming.ingest import windowed_counts

    out = windowed_counts(table(spark, d, "events"), "ts", "1 day", by=["event_type"])
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), 3)


def sliding_event_totals(spark: SparkSession, d: str) -> DataFrame:
    from loamwork.streaming.ingest import windowed_counts

    out = windowed_counts(table(spark, d, "events"), "ts", "6 hours", by=["event_type"], slide="2 hours")
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total"), 3)


def session_events(spark: SparkSession, d: str) -> DataFrame:
    from loamwork.streaming.ingest import session_totals

    out = session_totals(table(spark, d, "events"), "ts", "6 hours", by=["user_id"])
    return rounded(out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n", "total"), 3)


def cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers that name the one of twice their number: chains that run into cycles."""
    cu = table(spark, d, "customer").select("c_custkey")
    n = cu.agg(F.max("c_custkey").alias("m"))
    edges = cu.join(F.broadcast(n)).select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("cause"), F.concat(F.lit("n"), (F.col("c_custkey") * 2 % (F.col("m") + 1)).cast("string")).alias("effect"))
    return graph.cycle_edges(edges)


def snapshot_merges(spark: SparkSession, d: str) -> DataFrame:
    """The claims of the event stream, merged into a snapshot a third at a time."""
    from loamwork.functions.storage import scratch
    from loamwork.sources import snapshots

    claims, root = transitions(spark, d), scratch(spark, "graph")
    for k in range(3):
        snapshots.merge(claims.filter(F.pmod(F.xxhash64("source", "evidence"), F.lit(3)) == k), root, parts=8)
    return rounded(snapshots.load(spark, root), 6)


def resumable_ingest(spark: SparkSession, d: str) -> DataFrame:
    from loamwork.streaming.ingest import resume

    rows = table(spark, d, "documents").select("doc_id", "source")
    return resume(rows, table(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id")


def turtle_lines(spark: SparkSession, d: str) -> DataFrame:
    return graph.turtle(graph.merge_edges(transitions(spark, d))).select(F.md5("value").alias("line_md5"))


def assimilated_cells(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 12).cast("int").alias("member"), F.pmod("l_partkey", F.lit(4)).cast("int").alias("row"), F.pmod("l_suppkey", F.lit(4)).cast("int").alias("col"), "l_quantity")
    ens = li.groupBy("member", "row", "col").agg(F.avg("l_quantity").alias("value"))
    obs = spark.createDataFrame([(2, 3, 30.0, 0.5), (0, 1, 20.0, 0.5)], "row int, col int, observed double, sd double")
    analysis, gain = grids.assimilate(ens, obs, 2.0, perturb=False)
    return rounded(analysis.groupBy("row", "col").agg(F.avg("value").alias("mean")).join(gain, ["row", "col"]), 4)


def aligned_bands(spark: SparkSession, d: str) -> DataFrame:
    """Prices of parts and balances of customers, rasters of different cells over one area, on a third grid."""
    part = table(spark, d, "part").groupBy((F.col("p_size") - 1).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col")).agg(F.sqrt(F.avg("p_retailprice")).alias("value"))
    cu = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("int").alias("row"), (F.col("c_custkey") % 20).cast("int").alias("col")).agg(F.sqrt(F.avg("c_acctbal") + 1000).alias("value"))
    bands = {"price": (part, rasters.Grid(0.0, 50.0, 1.0, 1.0, 50, 40)), "balance": (cu, rasters.Grid(0.0, 50.0, 2.0, 2.0, 25, 20))}
    return rounded(rasters.align(bands, 0.8)[0], 6)


def tile_steps(spark: SparkSession, d: str) -> DataFrame:
    """Each return flag is a tile; what two kinds of lines hold on average is observed on two days."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tile"), (F.col("l_orderkey") % 12).cast("int").alias("member"), (F.col("l_partkey") % 3).cast("int").alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("col"), "l_quantity", "l_linenumber")
    ens = li.groupBy("tile", "member", "row", "col").agg(F.avg("l_quantity").alias("value"))
    day = F.make_date(F.lit(2024), F.lit(1), F.col("l_linenumber").cast("int"))
    obs = li.filter("l_linenumber <= 2").groupBy("tile", "l_linenumber").agg(F.avg("l_quantity").alias("observed")).select("tile", day.cast("timestamp").alias("t"), (F.col("l_linenumber") - 1).cast("int").alias("row"), F.lit(2).alias("col"), "observed", F.lit(0.5).alias("sd"))
    return rounded(assimilation.batch_tiles(obs, ens, 2.0, seed=None).withColumn("t", F.date_format("t", "yyyy-MM-dd")), 4)


def profile_fits(spark: SparkSession, d: str) -> DataFrame:
    """Curves fitted to depths with a little noise give back what the rows were made of."""
    from loamwork.operators.profiles import fit_profiles

    z = F.array(*[F.lit(float(x)) for x in (0, 3, 6, 10, 15, 22, 30, 45, 60, 80, 100, 140)])
    y0, rate = 20.0 + F.col("s_suppkey") % 7, 0.03 + 0.01 * (F.col("s_suppkey") % 3)
    sup = table(spark, d, "supplier").select("s_suppkey", y0.alias("y0"), rate.alias("rate"), F.explode(z).alias("depth"))
    noise = 1e-4 * F.sin(F.col("s_suppkey") * 12.9898 + F.col("depth") * 78.233)
    rows = sup.select("s_suppkey", "depth", (C.depth_curve("depth", F.col("y0"), F.lit(3.0), F.col("rate"), F.lit(0.01)) + noise).alias("y"))
    fits = fit_profiles(rows, "s_suppkey", "depth", "y")
    return fits.select("s_suppkey", F.round("y0", 1).alias("y0"), F.round("y_inf", 1).alias("y_inf"), F.round("rate", 3).alias("rate"), F.round("decay", 3).alias("decay"))


def forest_quantiles(spark: SparkSession, d: str) -> DataFrame:
    from loamwork.operators.forest import QuantileForest

    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("a"), F.length("c_mktsegment").cast("double").alias("b"), "c_acctbal")
    out = QuantileForest(rows, "c_acctbal", ["a", "b"], trees=8, depth=4).quantiles(rows, "c_custkey", [0.05, 0.5, 0.95])
    return rounded(out.select("c_custkey", "mean", F.col("quantiles")[0].alias("q05"), F.col("quantiles")[1].alias("q50"), F.col("quantiles")[2].alias("q95")), 4)


def bootstrap_slope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_nationkey", F.col("c_acctbal").alias("y"), (F.col("c_custkey") % 13).cast("double").alias("x"))
    draws = moments.bootstrap_effect(rows, "y", "x", [], "c_nationkey", 50)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(draws)], "draw long, slope double"), 5)


def resampled_orders(spark: SparkSession, d: str) -> DataFrame:
    """How often each customer's orders are taken in three draws."""
    return moments.resampled(table(spark, d, "orders"), "o_custkey", 3, seed=7)


def greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("n"), F.abs("s_acctbal").alias("u"))
    picked = selection.greedy_batch(sup, "s_suppkey", ["s_acctbal", "n"], "u", 10)
    return spark.createDataFrame([(i, int(k)) for i, k in enumerate(picked)], "pick long, s_suppkey long")


def joint_picks(spark: SparkSession, d: str) -> DataFrame:
    """Groups of parts whose mean prices by line number vary most together."""
    li = table(spark, d, "lineitem").select(F.pmod("l_partkey", F.lit(60)).alias("k"), "l_linenumber", "l_extendedprice").filter("l_linenumber <= 4")
    means = li.groupBy("k", "l_linenumber").agg(F.avg(F.col("l_extendedprice") / 1000).alias("m"))
    rows = means.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "m"))), lambda s: s["m"]).alias("p")).filter(F.size("p") == 4)
    picked = selection.joint_variance_batch(rows, "k", "p", 0.01, 6)
    return spark.createDataFrame([(i, int(k)) for i, k in enumerate(picked)], "pick long, k long")


# small operators of the pillars


def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.record_hash("doc_id", F.coalesce("text", F.lit(""))).alias("hash"))


def dag_lines(spark: SparkSession, d: str) -> DataFrame:
    return graph.dag_text(transitions(spark, d).filter("cause <> effect"), 0.99).withColumnRenamed("value", "line")


def curie_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.curie("p_name").alias("curie"), C.turtle_text("p_name").alias("literal"))


def median_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.median_deviation(table(spark, d, "part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice"), 3)


def monthly_means(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    return rounded(o.groupBy("o_orderstatus", "month").agg(F.avg("o_totalprice").alias("mean")), 7)


#: A concave polygon around a part of the points.
CORNERS = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (0.0, 0.1), (-1.0, 1.0)]


def points_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).filter(C.in_polygon("x", "y", CORNERS)).select("vec_id")


def quality_range(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("v"))
    return ev.filter(C.in_range("v", 10, 50)).select("event_id")


def top_values(spark: SparkSession, d: str) -> DataFrame:
    return metrics.frequencies(table(spark, d, "part"), "p_type", 5)


def physics_gate(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    ok = selection.range_gate(F.col("p_retailprice"), 900 + F.col("p_size") * 2.0, 950 + F.col("p_size") * 4.0, 1.25)
    return part.filter(ok).select("p_partkey")


def annotation_checks(spark: SparkSession, d: str) -> DataFrame:
    lb = table(spark, d, "labels")
    claim = F.struct(F.lit("a").alias("cause"), F.lit("b").alias("effect"), F.when(F.col("quality") == 1, "+").otherwise("?").alias("polarity"), (F.col("doc_id") % 4 / 2.0).alias("confidence"))
    rows = lb.select(F.col("doc_id").cast("string").alias("abstract_id"), F.when(F.col("toxic") == 0, "text").alias("abstract_text"), F.array(claim).alias("claims"))
    return docs.validate_annotations(rows).select("abstract_id", F.size("errors").cast("long").alias("n_errors"))


def dag_adjustment(spark: SparkSession, d: str) -> DataFrame:
    g = causal.Dag([("l_discount", "l_quantity"), ("l_discount", "l_extendedprice"), ("l_quantity", "l_extendedprice"), ("l_tax", "l_quantity")])
    chosen = g.adjustment_set("l_quantity", "l_extendedprice")
    fit = moments.adjusted_effect(table(spark, d, "lineitem").select("l_discount", "l_quantity", "l_extendedprice", "l_tax"), "l_extendedprice", "l_quantity", chosen)
    return rounded(spark.createDataFrame([(",".join(chosen), float(fit["adjusted"]))], "adjusted_for string, effect double"), 2)


def prototype_kernel(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    rows = points(spark, d).groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("label").collect()  # one row a class
    k = kernels.quantum_gram(kernels.encode(np.array([[r.x, r.y] for r in rows])))
    return rounded(spark.createDataFrame([(int(rows[i].label), int(rows[j].label), float(k[i, j])) for i in range(len(rows)) for j in range(i)], "i long, j long, k double"), 5)


def covering_design(spark: SparkSession, d: str) -> DataFrame:
    cu = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    design = selection.latin_design(cu, "c_custkey", ["c_acctbal", "n"], 8).withColumn("chosen", F.lit(True))
    # how many of the eight ranges of each column the eight rows lie in
    cuts = cu.agg(*[F.percentile_approx(c, F.array(*[F.lit(i / 8) for i in range(1, 8)]), 10_000).alias(c) for c in ("c_acctbal", "n")]).first()
    stratum = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts[c])), lambda q: q < F.col(c)))
    return design.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(stratum("c_acctbal")).alias("balance_ranges"), F.count_distinct(stratum("n")).alias("nation_ranges"))


def effect_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    r = structure.sensitivity_of_fit(lines(spark, d).filter("l_returnflag = 'A'"), "y", "w1", ["x"])
    return one_row(spark, t=float(r["t"]), rv=float(r["rv"]))


def edge_origins(spark: SparkSession, d: str) -> DataFrame:
    t = transitions(spark, d).filter("cause <> effect")
    return structure.origin_of_edges(t.filter("confidence >= 0.994"), t)


def covariance_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = ["l_quantity", "l_discount", "l_tax"]
    cov, n = structure.covariances(table(spark, d, "lineitem"), names)[0]
    pairs = [(names[i], names[j], float(cov[i, j]) * 1e4, int(n)) for i in range(3) for j in range(i, 3)]
    return rounded(spark.createDataFrame(pairs, "a string, b string, covariance double, n long"), 4)


def sample_priority(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", "value")
    cells = ev.groupBy((F.col("event_id") % 6).alias("sample"), (F.col("user_id") % 7).alias("row"), (F.floor(F.col("user_id") / 7) % 5).alias("col")).agg(F.round(F.avg("value"), 6).alias("value"))
    return rounded(active.query_samples(cells, 10), 4)


def unit_table(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(C.min_max_table(part, ["p_size", "p_retailprice"]), 6)


def posterior_parts(spark: SparkSession, d: str) -> DataFrame:
    draws = supplier_draws(spark, d).withColumn("draw_id", F.lit(0))
    return rounded(adapters.Posterior(draws, aleatoric=100.0).summary().select("query_id", "mean", "epistemic_sd", "aleatoric_sd", "total_sd"), 4)


def posterior_overview(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.Posterior(supplier_draws(spark, d).withColumn("draw_id", F.lit(0)))
    return rounded(p.overview(), 4)


def posterior_rmse(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.Posterior(supplier_draws(spark, d).withColumn("draw_id", F.lit(0)))
    return rounded(p.calibrate(supplier_truth(spark, d))["point_rmse"], 4)


def numbered_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return rows.numbered(o, ["o_orderdate", "o_orderkey"], run_rows=4_000).select("o_orderkey", F.col("position").cast("long").alias("position"))


def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return rounded(rows.side_by_side(n.select("n_nationkey"), n.select(F.col("n_name").alias("name")), ["n_nationkey"], ["name"]))


def annotated_lines(spark: SparkSession, d: str) -> DataFrame:
    claim = F.struct(F.lit("rain").alias("cause"), F.concat(F.lit("soil "), (F.col("doc_id") % 3).cast("string")).alias("effect"), F.when(F.col("quality") == 1, "+").otherwise("-").alias("polarity"), (F.col("doc_id") % 4 / 4.0).alias("confidence"))
    records = table(spark, d, "labels").select("doc_id", F.array(claim).alias("claims"))
    return graph.annotated_turtle(records, ["doc_id"]).select(F.md5("value").alias("line_md5"))


def terrain_slopes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grids.terrain_slope(part_grid(spark, d).select("row", "col", "gain"), "gain", 10.0).select("row", "col", "slope"), 4)


def synthetic_cube(spark: SparkSession, d: str) -> DataFrame:
    """A cell for each supplier, by region of its nation's number; columns as z-scores."""
    n = table(spark, d, "supplier").count()
    cube, _ = grids.scaled(grids.synthetic_cube(spark, 5, max(1, -(-n // 5)), 12), ["precip", "soc"])
    return rounded(cube, 5)


ALL = [
    metrics_by_flag, ece_levels, posterior_summary, crps_by_query, picp_mpiw, interval_reliability, minmax_constant_rules, ols_slope_adjusted, ols_by_group, iv_2sls, iv_first_stage_f, iv_sargan,
    sensitivity_grid, rolling_effect, mann_kendall, leverage_topk, corpus_dedupe, label_normalise, edge_merge, edge_rank, edge_rename, align_cascade, align_edit_distance, vote_majority, vote_weighted,
    vote_intersection, claim_match_exact, claim_match_greedy, swapped_labels, prf1, kappa, token_cost, json_claims, inverted_index_roundtrip, shd_edges, knn_graph, knn_weights, attention_softmax, min_distance_select,
    topk_priority, semi_join_candidates, lag_mass_balance, gap_fill_linear, topsoil_first_row, fold_round_robin, cv_summary, rbf_gram, kernel_1qubit, cosine_schedule, profile_closed_form,
    taper_gaspari_cohn, zscore_features, robustness_values, graph_stats, window_event_counts, sliding_event_totals, session_events, cycle_edges, snapshot_merges, resumable_ingest, turtle_lines, assimilated_cells, tile_steps, aligned_bands, price_quantiles, profile_fits, forest_quantiles, bootstrap_slope, resampled_orders, greedy_selection, joint_picks,
    record_hashes, dag_lines, curie_names, median_scale, monthly_means, points_in_polygon, quality_range, top_values, physics_gate, annotation_checks, dag_adjustment, prototype_kernel, covering_design, synthetic_cube,
    effect_sensitivity, edge_origins, covariance_pairs, sample_priority, unit_table, posterior_parts, posterior_overview,
    posterior_rmse, numbered_orders, side_by_side, annotated_lines, terrain_slopes,
]

