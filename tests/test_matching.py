"""Near labels, one-to-one matching and greedy batches against plain versions."""

import random

import numpy as np
import pytest

from loamwork.operators import docs, matching, selection


def edits(a, b, swaps=False):
    """Edit distance by the whole table, with neighbours that change places as one edit if asked for."""
    t = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
    return t[-1][-1]


def test_transposing_distance(spark):
    rng = random.Random(1)
    pairs = [("ab", "ba"), ("abc", "ca"), ("ca", "abc"), ("", "xy"), ("xy", ""), ("", ""), (None, "x"), ("x", None), ("é😀", "😀é")]
    pairs += [("".join(rng.choice("abc") for _ in range(rng.randrange(9))), "".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", matching.transposing_distance("a", "b").alias("d")).collect()
    assert all(r.d == (None if r.a is None or r.b is None else edits(r.a, r.b, True)) for r in got)


@pytest.mark.parametrize(("most", "long"), [(1, 48), (2, 48), (2, 5), (3, 6)])
def test_near_labels(spark, most, long):
    rng = random.Random(most)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10))) for _ in range(160)})
    a, b = names[::2] + [None, "ab", "ba"], names[1::2] + [None, "ba"]
    df = matching.near_labels(spark.createDataFrame([(x,) for x in a], "label string"), spark.createDataFrame([(x,) for x in b], "term string"), most, long)
    got = [(r.label, r.term, r.distance) for r in df.collect()]
    assert sorted(got) == sorted({(x, y, d) for x in a for y in b if x is not None and y is not None and (d := edits(x, y, True)) <= most})
    assert "Python" not in df._jdf.queryExecution().toString()


def plain_match(predicted, gold, slack):
    """One document after the other, one predicted claim after the other."""
    out = []
    for d in {r[0] for r in predicted + gold} - {None}:
        p, g = (sorted((r for r in rows if r[0] == d), key=lambda r: r[3]) for rows in (predicted, gold))
        free = [True] * len(g)
        for _, c, e, _ in p:
            hit = next((j for j, r in enumerate(g) if free[j] and edits(c, r[1]) + edits(e, r[2]) <= slack), None)
            if hit is not None:
                free[hit] = False
            out.append((d, c, e, "fp" if hit is None else "tp"))
        out += [(d, r[1], r[2], "fn") for j, r in enumerate(g) if free[j]]
    return out + [(None, r[1], r[2], k) for rows, k in ((predicted, "fp"), (gold, "fn")) for r in rows if r[0] is None]


CLAIMS = "abstract_id int, cause string, effect string, ord int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_matching(spark, seed):
    """Few letters, so that wants overlap in chains; one document with most claims; repeated claims."""
    rng = random.Random(seed)
    label = lambda: "".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 4, 6])))
    made = lambda n: [(rng.choice([1, 1, 1, 2, 3, None]), label(), rng.choice(["x", "yy", "zzzz"]), i) for i in range(n)]
    predicted, gold = made(90), made(70)
    p, g = (spark.createDataFrame(rows, CLAIMS).repartition(3) for rows in (predicted, gold))
    for slack in (0, 2):
        assert sorted(map(str, map(tuple, docs.match_greedy(p, g, slack=slack).collect()))) == sorted(map(str, plain_match(predicted, gold, slack)))


def test_greedy_matching_of_equal_claims_takes_few_rounds(spark, monkeypatch):
    rounds, keep = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: rounds.append(df.columns) or keep(df))
    rows = [(1, "a cause", "b", i) for i in range(500)]
    p = spark.createDataFrame(rows, CLAIMS)
    got = docs.match_greedy(p, p.filter("ord < 400")).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == {"tp": 400, "fp": 100}
    assert rounds.count(["at", "to"]) == 2  # the second finds nothing left
    assert docs.match_greedy(p.limit(0), p).groupBy("outcome").count().collect()[0]["count"] == 500
    assert docs.match_greedy(p.limit(0), p.limit(0)).count() == 0


def plain_batch(rows, labelled, n, strategy, alpha=0.7, cost_weight=0.3):
    """The whole pool at once; rows: key, a, b, u, c."""
    unit = lambda v: (v - v.min()) / (v.max() - v.min()) if np.isfinite(v).all() and v.max() > v.min() else np.ones(len(v))
    rows = sorted(rows)
    x = np.array([r[1:3] for r in rows], float)
    both = np.vstack([x, np.array(labelled, float).reshape(-1, 2)])
    sd = both.std(axis=0, ddof=1)
    sd[~(sd > 0)] = 1
    x, lab = (x - both.mean(axis=0)) / sd, (both[len(x) :] - both.mean(axis=0)) / sd
    u, c = unit(np.array([r[3] for r in rows])), unit(np.array([r[4] for r in rows]))
    d, picked = np.full(len(x), np.inf), []
    for row in lab:
        d = np.minimum(d, np.sqrt(((x - row) ** 2).sum(axis=1)))
    for _ in range(min(n, len(x))):
        far = unit(d)
        s = {"uncertainty": u, "diverse": far, "hybrid": alpha * u + (1 - alpha) * far, "cost": alpha * u + (1 - alpha) * far - cost_weight * c}[strategy].copy()
        s[picked] = -np.inf
        picked.append(int(np.argmax(s)))
        d = np.minimum(d, np.sqrt(((x - x[picked[-1]]) ** 2).sum(axis=1)))
    return [rows[i][0] for i in picked]


POOL = "k int, a double, b double, u double, c double"


@pytest.mark.parametrize("strategy", ["uncertainty", "diverse", "hybrid", "cost"])
def test_greedy_batch_equals_the_whole_pool(spark, monkeypatch, strategy):
    """With few rows held, most picks need bounds or another pass."""
    rng = np.random.default_rng(5)
    rows = [(int(i), *map(float, rng.normal(size=2)), float(rng.random()), float(rng.random())) for i in rng.permutation(400)]
    passes, keep = [], selection.written
    monkeypatch.setattr(selection, "written", lambda df: passes.append(1) or keep(df))
    pool = spark.createDataFrame(rows + [(900, None, 1.0, 9.0, 0.0)], POOL).repartition(5)
    labelled = [(0.0, 0.0), (1.0, 1.0)]
    known = spark.createDataFrame(labelled, "a double, b double")
    more = {"strategy": strategy, "cost": "c" if strategy == "cost" else None}
    assert selection.greedy_batch(pool, "k", ["a", "b"], "u", 30, known, held=24, **more) == plain_batch(rows, labelled, 30, strategy)
    assert len(passes) < 20  # several picks a pass
    assert selection.greedy_batch(pool, "k", ["a", "b"], "u", 6, held=3, **more) == plain_batch(rows, [], 6, strategy)


def test_greedy_batch_of_few_and_equal_rows(spark):
    rows = [(i, 1.0, 2.0, 3.0, 0.0) for i in range(5)] + [(9, 4.0, 2.0, 3.0, 0.0)]
    pool = spark.createDataFrame(rows, POOL)
    for strategy in ("hybrid", "diverse"):
        assert selection.greedy_batch(pool, "k", ["a", "b"], "u", 9, strategy=strategy, held=2) == plain_batch(rows, [], 9, strategy)
    assert selection.greedy_batch(pool.limit(0), "k", ["a", "b"], "u", 3) == []


def plain_joint(p, noise, n):
    """The next row is the one whose joint covariance with those before has the largest determinant."""
    a = (p - p.mean(axis=1, keepdims=True)) / np.sqrt(max(1, p.shape[1] - 1))
    cov, picked = a @ a.T + noise * np.eye(len(p)), []
    while len(picked) < min(n, len(p)):
        left = [i for i in range(len(p)) if i not in picked]
        gain = [np.linalg.slogdet(cov[np.ix_([*picked, i], [*picked, i])])[1] for i in left]
        picked.append(left[int(np.argmax(np.round(gain, 9)))])
    return picked


def test_joint_variance_equals_the_determinants(spark, monkeypatch):
    rng = np.random.default_rng(7)
    p = rng.normal(size=(150, 9)) * np.exp(rng.normal(size=(150, 1)))
    passes, keep = [], selection.written
    monkeypatch.setattr(selection, "written", lambda df: passes.append(1) or keep(df))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(p)] + [(999, [])], "k int, p array<double>").repartition(5)
    want = plain_joint(p, 0.05, 20)
    assert selection.joint_variance_batch(df, "k", "p", 0.05, 20, held=12) == want and len(passes) < 15
    assert selection.joint_variance_batch(df, "k", "p", 0.05, 20) == want
    assert selection.joint_variance_batch(df, "k", "p", 0.05, 5, held=1) == want[:5]
    assert selection.joint_variance_batch(df.limit(0), "k", "p", 0.05, 3) == []
    assert sorted(selection.joint_variance_batch(df.filter("k < 4"), "k", "p", 0.05, 9)) == [0, 1, 2, 3]
