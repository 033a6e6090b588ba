"""Causal structure: known graphs, graphs learned from covariances, and estimates with their posteriors and sensitivity."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.columns import finite
from loamwork.functions.tails import normal_two_sided
from loamwork.operators.causal import Dag, robustness_summary
from loamwork.operators.moments import MAX_COLUMNS, adjusted_effect, bootstrap_effect, ols, poisson_weight, two_stage

Edge = tuple[str, str]


def _edges(text: str) -> list[Edge]:
    return [tuple(x.strip() for x in line.split("->")) for line in text.strip().splitlines()]


#: The graphs of soil forming factors, of the schematic columns and of the case study's columns.
SOIL_FACTORS = _edges("""
Climate -> Organisms
Climate -> Weathering
Climate -> SOC
Relief -> TWI
Relief -> Erosion
ParentMaterial -> Weathering
ParentMaterial -> Clay
Organisms -> SOC
Weathering -> Clay
Weathering -> pH
Clay -> CEC
SOC -> CEC
TWI -> SOC
Erosion -> SOC
Time -> Weathering
Time -> SOC
""")
SCHEMATIC = _edges("""
elev -> slope
elev -> map_mm
slope -> twi
map_mm -> twi
elev -> twi
twi -> ndvi
slope -> ndvi
map_mm -> ndvi
elev -> soc
slope -> soc
twi -> soc
map_mm -> soc
ndvi -> soc
""")
CASE_STUDY = _edges("""
elev -> wc_bio_01
elev -> wc_bio_12
elev -> slope
wc_bio_01 -> wc_landcover_trees
wc_bio_12 -> wc_landcover_trees
wc_bio_01 -> wc_landcover_grassland
wc_bio_12 -> wc_landcover_grassland
wc_bio_01 -> wc_landcover_cropland
wc_bio_12 -> wc_landcover_cropland
slope -> soilgrids_clay
slope -> soilgrids_sand
soilgrids_clay -> soilgrids_bdod
soilgrids_sand -> soilgrids_bdod
wc_bio_01 -> soc_topsoil_gkg
wc_bio_12 -> soc_topsoil_gkg
soilgrids_clay -> soc_topsoil_gkg
soilgrids_sand -> soc_topsoil_gkg
soilgrids_bdod -> soc_topsoil_gkg
slope -> soc_topsoil_gkg
wc_landcover_trees -> soc_topsoil_gkg
wc_landcover_grassland -> soc_topsoil_gkg
wc_landcover_cropland -> soc_topsoil_gkg
""")

EDGE_COLUMNS = "cause string, effect string, source string, evidence string, confidence double, timestamp string"


def empty_graph(spark: SparkSession) -> DataFrame:
    """A graph without edges, with the columns of claims."""
    return spark.createDataFrame([], EDGE_COLUMNS)


def edge_table(spark: SparkSession, edges: Iterable[Edge]) -> DataFrame:
    return spark.createDataFrame(list(edges), "cause string, effect string")


def origin_of_edges(base: DataFrame, augmented: DataFrame) -> DataFrame:
    """cause, effect, origin: `base` for edges of the base graph, `graph` for those that were put in."""
    known = base.select("cause", "effect").distinct().withColumn("known_", F.lit(True))
    return augmented.select("cause", "effect").distinct().join(known, ["cause", "effect"], "left").select("cause", "effect", F.when(F.col("known_"), "base").otherwise("graph").alias("origin"))


# covariances, in one pass


def _pairs(names: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names) + 1) for j in range(i, len(names) + 1)]


def _covariance(row, names: list[str]) -> tuple[np.ndarray, float]:
    p = len(names)
    m = np.zeros((p + 1, p + 1))
    for i, j in _pairs(names):
        m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    n = m[0, 0]
    if n <= p + 1:
        raise ValueError(f"[structure] {n:.0f} complete rows for {p} columns")
    mean = m[0, 1:] / n
    return m[1:, 1:] / n - np.outer(mean, mean), n


def covariances(df: DataFrame, names: list[str], draws: int = 0, seed: int = 1) -> list[tuple[np.ndarray, float]]:
    """Covariance matrix and rows of the complete rows, and of `draws` bootstrap replicates, in which a row counts a
    Poisson(1) number of times by a hash of its values: all are sums over partial aggregates."""
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"[structure] {len(names)} columns; at most {MAX_COLUMNS}")
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    rows = df.filter(finite(*cols[1:]))
    sums = lambda w: [F.sum(w * cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in _pairs(names)]
    out = [_covariance(rows.agg(*sums(F.lit(1.0))).first(), names)]
    if draws:
        keyed = rows.withColumn("row_", F.xxhash64(*names)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        by_draw = keyed.groupBy("draw").agg(*sums(poisson_weight(F.col("row_"), F.col("draw"), seed))).orderBy("draw").collect()  # one small row a draw
        out += [_covariance(r, names) for r in by_draw]
    return out


def _score(cov: np.ndarray, n: float, child: int, parents: tuple[int, ...]) -> float:
    """Gaussian BIC of a column given its parents: half the log-likelihood's scale, higher is better."""
    left = cov[child, child]
    if parents:
        at = np.ix_(parents, parents)
        left = left - cov[child, parents] @ np.linalg.solve(cov[at] + 1e-12 * np.eye(len(parents)), cov[parents, child])
    return -0.5 * n * math.log(max(left, 1e-300)) - 0.5 * math.log(n) * (len(parents) + 2)


def _reaches(parents: list[set[int]], a: int, b: int) -> bool:
    """Whether a is b or an ancestor of b."""
    seen, todo = set(), [b]
    while todo:
        x = todo.pop()
        if x == a:
            return True
        if x not in seen:
            seen.add(x)
            todo.extend(parents[x])
    return False


def climb(cov: np.ndarray, n: float, keep: set[tuple[int, int]] = frozenset(), never: set[tuple[int, int]] = frozenset(), tabu: int = 0, among: set[frozenset] | None = None, rounds: int = 500) -> set[tuple[int, int]]:
    """Edges found by adding, dropping and turning single edges as long as the score rises; with tabu, up to so many
    steps down in a row may be taken, without going back to a graph that was there."""
    p = len(cov)
    parents: list[set[int]] = [set() for _ in range(p)]
    for a, b in keep:
        parents[b].add(a)
    memory: dict = {}

    def score(b: int, ps: set[int]) -> float:
        key = (b, tuple(sorted(ps)))
        if key not in memory:
            memory[key] = _score(cov, n, *key)
        return memory[key]

    graph = lambda: frozenset((a, b) for b in range(p) for a in parents[b])
    total = sum(score(b, parents[b]) for b in range(p))
    best, best_graph, seen, down = total, graph(), {graph()}, 0
    for _ in range(rounds):
        moves = []
        for a in range(p):
            for b in range(p):
                if a == b or among is not None and frozenset((a, b)) not in among:
                    continue
                if a in parents[b]:
                    if (a, b) in keep:
                        continue
                    drop = score(b, parents[b] - {a}) - score(b, parents[b])
                    moves.append((drop, "drop", a, b))
                    if (b, a) not in never:
                        parents[b].discard(a)
                        if not _reaches(parents, a, b):
                            moves.append((drop + score(a, parents[a] | {b}) - score(a, parents[a]), "turn", a, b))
                        parents[b].add(a)
                elif (a, b) not in never and b not in parents[a] and not _reaches(parents, b, a):
                    moves.append((score(b, parents[b] | {a}) - score(b, parents[b]), "add", a, b))
        done = False
        for gain, kind, a, b in sorted(moves, key=lambda m: (-m[0], m[1:])):
            if gain <= 1e-9 and down >= tabu:
                break
            before = [set(x) for x in parents]
            if kind != "add":
                parents[b].discard(a)
            if kind == "add":
                parents[b].add(a)
            if kind == "turn":
                parents[a].add(b)
            if graph() in seen:
                parents[:] = before
                continue
            seen.add(graph())
            total, down, done = total + gain, down + 1 if gain <= 1e-9 else down, True
            if total > best + 1e-9:
                best, best_graph, down = total, graph(), 0
            break
        if not done:
            break
    return set(best_graph)


def _independent(cov: np.ndarray, n: float, a: int, b: int, given: tuple[int, ...], alpha: float) -> bool:
    """Partial correlation by Fisher's z."""
    at = [a, b, *given]
    inverse = np.linalg.inv(cov[np.ix_(at, at)] + 1e-12 * np.eye(len(at)))
    r = float(np.clip(-inverse[0, 1] / math.sqrt(inverse[0, 0] * inverse[1, 1]), -0.9999999, 0.9999999))
    return normal_two_sided(math.atanh(r) * math.sqrt(max(1.0, n - len(given) - 3))) > alpha


def skeleton(cov: np.ndarray, n: float, alpha: float = 0.05, most: int = 4) -> tuple[set[frozenset], dict[frozenset, tuple[int, ...]]]:
    """Pairs that no set of neighbours makes independent, and the separating sets of the others. Neighbours are those at
    the start of each size of sets, so that the order of the columns plays no part."""
    p = len(cov)
    near = {a: set(range(p)) - {a} for a in range(p)}
    apart: dict[frozenset, tuple[int, ...]] = {}
    for size in range(min(most, p - 2) + 1):
        fixed = {a: sorted(near[a]) for a in near}
        for a, b in combinations(range(p), 2):
            if b not in near[a]:
                continue
            for x, y in ((a, b), (b, a)):
                found = next((s for s in combinations([c for c in fixed[x] if c != y], size) if _independent(cov, n, a, b, s, alpha)), None)
                if found is not None:
                    near[a].discard(b)
                    near[b].discard(a)
                    apart[frozenset((a, b))] = found
                    break
    return {frozenset((a, b)) for a in near for b in near[a]}, apart


def constraint_edges(cov: np.ndarray, n: float, alpha: float = 0.05) -> tuple[set[tuple[int, int]], set[frozenset]]:
    """Directed edges and undirected pairs: colliders first, then what follows from no new colliders and no cycles."""
    p = len(cov)
    pairs, apart = skeleton(cov, n, alpha)
    directed: set[tuple[int, int]] = set()
    linked = lambda a, b: frozenset((a, b)) in pairs
    for c in range(p):
        for a, b in combinations([x for x in range(p) if linked(x, c)], 2):
            if not linked(a, b) and c not in apart.get(frozenset((a, b)), ()):
                directed |= {e for e in ((a, c), (b, c)) if e[::-1] not in directed}
    changed = True
    while changed:
        changed = False
        for pair in sorted(pairs, key=sorted):
            for a, b in (sorted(pair), sorted(pair)[::-1]):
                if (a, b) in directed or (b, a) in directed:
                    continue
                away = any((c, a) in directed and not linked(c, b) for c in range(p) if c != b)
                chain = any((a, c) in directed and (c, b) in directed for c in range(p))
                if away or chain:
                    directed.add((a, b))
                    changed = True
    return directed, {x for x in pairs if tuple(x) not in directed and tuple(x)[::-1] not in directed}


METHODS = ("climb", "tabu", "constraints", "hybrid")


def _learn(cov: np.ndarray, n: float, method: str, keep: set, never: set, alpha: float) -> set[tuple[int, int]]:
    if method == "constraints":
        directed, open_ = constraint_edges(cov, n, alpha)
        # an open pair counts both ways, unless a list decides
        both = directed | {e for pair in open_ for e in (tuple(pair), tuple(pair)[::-1])}
        return {(a, b) for a, b in both if (a, b) not in never and (b, a) not in keep} | set(keep)
    among = skeleton(cov, n, alpha)[0] | {frozenset(e) for e in keep} if method == "hybrid" else None
    return climb(cov, n, keep, never, 10 if method == "tabu" else 0, among)


def learn_structure(df: DataFrame, names: list[str] | None = None, method: str = "climb", keep: list[Edge] = (), never: list[Edge] = (), alpha: float = 0.05, draws: int = 0, seed: int = 1) -> DataFrame:
    """Claims (cause, effect, source, evidence, confidence, timestamp) of a graph learned from complete rows.

    Scores and tests need the covariance matrix only, so the rows are read once; the search is on the driver. With
    bootstrap draws an edge's confidence is the share of replicates in which its ends are joined; it stays from a half
    on, in the way that at least half of them have.
    """
    if method not in METHODS:
        raise ValueError(f"[learn_structure] method is one of {', '.join(METHODS)}")
    names = names or [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    at = {c: i for i, c in enumerate(names)}
    fixed, barred = {(at[a], at[b]) for a, b in keep}, {(at[a], at[b]) for a, b in never}
    first, *rest = covariances(df, names, draws, seed)
    if not rest:
        found = {e: 1.0 for e in _learn(*first, method, fixed, barred, alpha)}
    else:
        graphs = [_learn(c, n, method, fixed, barred, alpha) for c, n in rest]
        found = {}
        for a, b in combinations(range(len(names)), 2):
            there, back = sum((a, b) in g for g in graphs), sum((b, a) in g for g in graphs)
            joined = sum((a, b) in g or (b, a) in g for g in graphs)
            if joined >= 0.5 * len(graphs):
                found[(a, b) if there >= back else (b, a)] = joined / len(graphs)
    rows = [(names[a], names[b], method, None, float(s), None) for (a, b), s in sorted(found.items())]
    return df.sparkSession.createDataFrame(rows, EDGE_COLUMNS)


def discover_with_embeddings(features: DataFrame, embeddings: DataFrame, key: str, names: list[str], most: int = 8, **learn) -> DataFrame:
    """Edges between features of a graph learned from them and the first columns of node embeddings (key, h)."""
    extra = [f"embedding_{i}" for i in range(min(most, len(embeddings.first()["h"])))]
    wide = features.select(key, *names).join(embeddings.select(key, *[F.col("h")[i].alias(c) for i, c in enumerate(extra)]), key)
    learned = learn_structure(wide, [*names, *extra], **learn)
    return learned.filter(F.col("cause").isin(names) & F.col("effect").isin(names))


# estimates


def sensitivity_of_fit(df: DataFrame, outcome: str, exposure: str, adjust: list[str], q: float = 1.0, alpha: float = 0.05) -> dict:
    """How strong a confounder would have to be, for the exposure's coefficient in a least-squares fit."""
    fit = ols(df, outcome, [exposure, *adjust])
    return robustness_summary(fit["beta"][exposure], fit["se"][exposure], fit["df"], q, alpha)


def sensitivity_of_instruments(fit: dict, q: float = 1.0, alpha: float = 0.05) -> dict:
    """The same for an instrumented effect: fit is what two_stage() gives."""
    return robustness_summary(fit["effect"], fit["se"], fit["df"], q, alpha)


def principal_instruments(df: DataFrame, vector: str, size: int, components: int = 5) -> DataFrame:
    """df with columns pc_1.. of a vector's principal components: its varying elements, centred and scaled.

    Moments in one pass; the rotation is a constant of at most MAX_COLUMNS columns. A component's sign is set by its
    greatest loading.
    """
    wide = df.withColumns({f"e{i}_": F.col(vector)[i].cast("double") for i in range(size)})
    names = [f"e{i}_" for i in range(size)]
    cov, n = covariances(wide, names)[0]
    sd = np.sqrt(np.diag(cov) * n / (n - 1))
    used = np.flatnonzero(sd**2 > 1e-12)
    mean = wide.agg(*[F.avg(c).alias(c) for c in names]).first()
    values, vectors = np.linalg.eigh((cov * n / (n - 1))[np.ix_(used, used)] / np.outer(sd[used], sd[used]))
    vectors = vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    part = lambda k: sum((F.lit(float(vectors[j, k] / sd[i])) * (F.col(names[i]) - F.lit(float(mean[names[i]]))) for j, i in enumerate(used)), F.lit(0.0))
    return wide.withColumns({f"pc_{k + 1}": part(k) for k in range(vectors.shape[1])}).drop(*names)


def instruments_from_embeddings(df: DataFrame, vector: str, size: int, outcome: str, exposure: str, covariates: list[str] | None = None, components: int = 5) -> dict:
    """The instrumented effect with an embedding's principal components as instruments."""
    wide = principal_instruments(df, vector, size, components)
    return two_stage(wide, outcome, exposure, [c for c in wide.columns if c.startswith("pc_")], covariates)


def instrument_draws(df: DataFrame, outcome: str, exposure: str, instruments: list[str], covariates: list[str] | None = None, cluster: str | None = None, draws: int = 200, seed: int = 1) -> list[float]:
    """Instrumented effects of a bootstrap over rows or clusters; draws without a solution are left out.

    Each replicate is a weighted moment matrix, summed in Spark; rows are told apart by a hash of their values.
    """
    covariates = covariates or []
    names = [*covariates, *instruments, exposure, outcome]
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    rows = df.filter(finite(*cols[1:]))
    key = F.xxhash64(cluster) if cluster else F.xxhash64(*names)
    long = rows.withColumn("row_", key).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    weight = poisson_weight(F.col("row_"), F.col("draw"), seed)
    sums = long.groupBy("draw").agg(*[F.sum(weight * cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in _pairs(names)]).orderBy("draw").collect()  # one small row a draw
    at = {c: i + 1 for i, c in enumerate(names)}
    x, z, y = [0, *[at[c] for c in [*covariates, exposure]]], [0, *[at[c] for c in [*covariates, *instruments]]], at[outcome]
    out = []
    for r in sums:
        m = np.zeros((len(cols), len(cols)))
        for i, j in _pairs(names):
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        try:
            first = np.linalg.solve(m[np.ix_(z, z)], m[np.ix_(z, [*x, y])])
            zx = m[np.ix_(z, x)]
            out.append(float(np.linalg.solve(zx.T @ first[:, :-1], zx.T @ first[:, -1])[-1]))
        except np.linalg.LinAlgError:
            continue
    return out


def effect_draws(df: DataFrame, dag: Dag, exposure: str, outcome: str, cluster: str, draws: int = 200, seed: int = 1) -> list[float]:
    """Adjusted effects of a cluster bootstrap, the adjustment set taken from the graph."""
    chosen = dag.adjustment_set(exposure, outcome)
    if chosen is None:
        raise ValueError("[effect_draws] no set of measured columns closes the back doors")
    return bootstrap_effect(df, outcome, exposure, chosen, cluster, draws, seed)


def estimate_effect(df: DataFrame, dag: Dag, exposure: str, outcome: str) -> dict:
    """Naive and adjusted effect with the graph's adjustment set."""
    chosen = dag.adjustment_set(exposure, outcome)
    if chosen is None:
        raise ValueError("[estimate_effect] no set of measured columns closes the back doors")
    return adjusted_effect(df, outcome, exposure, chosen) | {"adjusted_for": chosen}
