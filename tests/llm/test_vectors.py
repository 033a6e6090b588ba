"""Hard negatives, whitening and exact duplicates against plain versions, on small and odd inputs."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.llm import exact_dedup, hard_negatives, registry, whitening
from tests.llm.test_operators import ODD, SCHEMA, table, words

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("x", "row_id", "rank", "place", "score", "n", "m", "node", "largest", "is_anchor", "component") if extra else ():
        df = df.withColumn(c, F.lit("own"))
    return df


def usable(rows):
    return [(i, [float(np.float32(c)) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


# op 11


def plain_negatives(rows, anchor=lambda i: i is not None and i % 100 == 0, top=5, least=80, most=100):
    """Every anchor against every row, in Python's whole numbers."""
    held = [(i, [math.floor(256 * c) for c in v], y) for i, v, y in usable(rows) if y is not None]
    out = []
    for k, (a, x, y) in enumerate(held):
        if not anchor(a):
            continue
        others = sorted(((-sum(p * q for p, q in zip(x, v, strict=False)), i is None, i or 0, i, z) for n, (i, v, z) in enumerate(held) if n != k), key=lambda t: t[:3])
        for p in [o for o in others if o[4] == y][:top]:
            near = [o for o in others if o[4] != y and least * -p[0] <= -100 * o[0] <= most * -p[0]]
            out += [(a, p[3], r + 1, o[3], -p[0], -o[0]) for r, o in enumerate(near[:top])]
    return sorted(out, key=str)


def mined(df, **more):
    return sorted(map(tuple, hard_negatives.mine(df, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), **more).collect()), key=str)


def drawn(n, width, seed, labels=4, step=20):
    """Vectors around a few centres with falling variances; ids by `step`, so that many are anchors."""
    rng = np.random.default_rng(seed)
    centres, scale = rng.normal(size=(5, width)), 1 / (1 + np.arange(width))
    return [(i * step, [float(c) for c in (centres[i % 5] + rng.normal(size=width)) * scale], int(rng.integers(labels))) for i in range(n)]


def test_negatives_equal_all_pairs(spark, monkeypatch):
    rows = drawn(240, 24, 1)
    want = plain_negatives(rows)
    assert len(want) > 300
    assert mined(vectors(spark, rows, extra=True).repartition(5)) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8 * 24 * 10)  # blocks of ten anchors
    monkeypatch.setattr(hard_negatives, "PAIRS", 1 << 10)
    assert mined(vectors(spark, rows).repartition(3)) == want
    few = [(100 * i, v, y) for i, (_, v, y) in enumerate(rows[:8])]
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8 * 24)  # as many blocks as anchors: some get none
    assert mined(vectors(spark, few)) == plain_negatives(few)


def test_negatives_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    some = [(100 * i, [float(v) for v in rng.integers(-1, 2, 6) / 4], i % 3) for i in range(30)]  # coarse: very many equal scores
    odd = [(7, None, 1), (8, [NAN] * 6, 1), (9, [INF] + [0.0] * 5, 0), (10, [0.25] * 6, None), (11, [0.25, None, 0.25, 0.25, 0.25, 0.25], 1), (None, [0.25] * 6, 1), (12, [], 2), (13, [1.0, -0.0], 0), (300, [0.25] * 6, 0), (300, [0.25] * 6, 0), (300, [0.25] * 6, 1)]
    assert mined(vectors(spark, some + odd)) == plain_negatives(some + odd)
    assert mined(vectors(spark, some).limit(0)) == [] and mined(vectors(spark, odd[:2])) == [] and mined(vectors(spark, [(0, [1.0], 1)])) == []
    assert mined(vectors(spark, [(0, [], 1), (1, [], 1), (2, [], 0)])) == plain_negatives([(0, [], 1), (1, [], 1), (2, [], 0)]) == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError):
        mined(vectors(spark, [(0, [1e30], 1), (1, [1.0], 1)]))


def test_bounds_discard_and_lose_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(400, 32)) / (1 + np.arange(32)) ** 2).astype(np.int64)
    turn = hard_negatives.fit_rotation(x[:100], 32)
    y, rest = turn.turned(x.astype(float))
    exact = x @ x.T
    lo = np.sort(exact, axis=1)[:, -8].astype(float)
    i, j, score = hard_negatives.near_pairs(turn, y, rest, x, y, rest, x, lo, np.full(400, exact.max() + 1.0), np.ones((400, 400), bool))
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(a, b) for a, b in zip(*np.nonzero(exact >= lo[:, None]), strict=True)}
    assert want <= got and len(got) < 1.01 * len(want) and (score == exact[i, j]).all()


def test_negatives_of_the_given_rows(spark):
    got = registry.op11_hard_negatives(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, got), key=str) == plain_negatives(rows)


# op 12


def plain_whitening(rows, k=8):
    """deviation, whitened and explained by the covariance itself."""
    held = [(i, v) for i, v, _ in usable(rows)]
    width = max(len(v) for _, v in held)
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in held]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in held], deviation, centred @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def check_whitening(got, rows, k=8):
    ids, deviation, w, explained = plain_whitening(rows, k)
    by = collections.defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert len(got) == len(ids) * w.shape[1] and set(by) == set(ids)
    for c in range(w.shape[1]):
        column = np.array([by[i][c + 1].whitened for i in ids])
        sign = np.sign((column * w[:, c]).sum())
        assert np.abs(column - sign * w[:, c]).max() < 1e-6
        assert {by[i][c + 1].explained for i in ids} == {got_e := by[ids[0]][c + 1].explained} and abs(got_e - explained[c]) < 1e-9
    assert [by[i][1].deviation for i in ids] == deviation and {r.n for r in got} == {len(ids)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_whitening_equals_the_covariance(spark):
    rows = drawn(300, 12, 4, step=1)
    got = whitening.whiten(vectors(spark, rows, extra=True).repartition(11), fan_in=3).collect()
    check_whitening(got, rows)
    odd = [(900, None, 1), (901, [NAN] * 12, 1), (902, [None] * 12, 0), (903, [INF] * 12, 1), (904, [0.5], None), (905, [], 2)]
    check_whitening(whitening.whiten(vectors(spark, rows + odd)).collect(), rows + odd)
    check_whitening(registry.op12_whitening(spark, "/root/testdata/sf0.001").collect(), [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()])


def test_whitening_of_few_and_equal_rows(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 1), (2, [NAN], 1)])).count() == 0 == whitening.whiten(vectors(spark, [(1, [], 1)])).count()
    same = whitening.whiten(vectors(spark, [(1, [0.5, 0.25, 1.0], 1)] * 3 + [(None, [0.5, 0.25, 1.0], 1)])).collect()
    assert len(same) == 12 and {(r.deviation, r.whitened, r.explained, r.identity_error, r.n) for r in same} == {(0, None, 0.0, 0.0, 4)}
    two = whitening.whiten(vectors(spark, [(1, [0.0, 0.0, 0.0], 1), (2, [1.0, 1.0, 1.0], 1)])).collect()
    assert {(r.component, abs(r.whitened) if r.whitened is not None else None) for r in two if r.component > 1} == {(2, None), (3, None)}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in two if r.component == 1)
    narrow = drawn(40, 3, 5, step=1)
    check_whitening(whitening.whiten(vectors(spark, narrow)).collect(), narrow)


def test_large_deviations_are_exact_or_null():
    x = np.array([[3_000_000_000, 0], [-3_000_000_000, 1]], dtype=np.int64)
    model = whitening.Whitening(1, np.zeros(2, np.int64), np.zeros((0, 2)), np.zeros(0), 0.0)
    assert model.deviations(x) == [9 * 10**18, 9 * 10**18 + 1] and model.deviations(x * 2) == [None, None]


# op 13


def plain_dedup(rows):
    groups = collections.defaultdict(list)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for t, ids in groups.items():
        sha, keep = hashlib.sha256(t.encode()).hexdigest(), max((i for i in ids if i is not None), default=None)
        first = ids.index(keep)
        out += [(i, keep, len(ids), n == first, sha) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def deduplicated(df, **more):
    return sorted(map(tuple, exact_dedup.exact_dedup(df, **more).collect()), key=str)


def test_dedup_equals_plain(spark):
    texts = [*ODD, *ODD[3:9], "ONE", "One", "É", "é", "İ", "K", "k", "K", *[words(30, 9)] * 60, *[words(30, 9).upper()] * 40]
    rows = list(enumerate(texts))
    df = table(spark, texts, extra=True).repartition(7)
    want = plain_dedup(rows)
    assert deduplicated(df) == want == deduplicated(df, salts=3, hot_parts=4) == deduplicated(df, hot_parts=1)
    # digests of one byte and of none: different texts share them, and are told apart by their whole texts
    assert deduplicated(df, digest=lambda sha: F.substring(sha, 1, 1)) == want == deduplicated(df, digest=lambda sha: F.substring(sha, 1, 0), hot_parts=1)


def test_dedup_of_repeated_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (2, "A"), (2, "a"), (None, "a"), (None, "b"), (None, "b"), (3, "c"), (None, None), (4, ""), (4, None)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    assert deduplicated(df) == plain_dedup(rows) == deduplicated(df, digest=lambda sha: F.substring(sha, 1, 0))
    assert deduplicated(df.limit(0)) == []


def test_dedup_uses_no_python(spark):
    plan = registry.op13_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
