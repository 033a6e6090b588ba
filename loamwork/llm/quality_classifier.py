"""Operator 4: naive Bayes support vectors for text quality."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import materialize, slices
from loamwork.llm.language_id import in_fold

#: Labelled rows that are fitted at most, bytes of their features, and hash buckets of n-grams: the bounds of the model.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 128 * 1024 * 1024
BUCKETS = 1 << 18
SMOOTHING = 1.0
#: Share of the fitted weight in a weight; the rest is the mean size, which leaves the n-gram its plain log-count vote.
FITTED = 0.75
ROUNDS = 12


class _Classes(dict):
    """str.translate table of character classes: upper, lower and other letters, digits, the rest; blanks stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = c if c.isspace() else "A" if c.isupper() else "a" if c.islower() else "l" if c.isalpha() else "0" if c.isdigit() else "#"
        return kind


CLASSES = _Classes()


#: Numbers of the classes, blanks 0, and the bucket of each three of them: ^ and $ are a word's ends.
LETTERS = "^Aal0#"
NUMBERS = np.array([LETTERS.index(chr(i)) if i and chr(i) in LETTERS[1:] else 0 for i in range(128)], np.int64)
THREES = ["c" + LETTERS[i // 36] + LETTERS[i // 6 % 6] + ("$" if i % 6 == 0 else LETTERS[i % 6]) for i in range(216)]


def _number(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass"))


def _pairs(first: np.ndarray, second: np.ndarray, family: int, buckets: int) -> np.ndarray:
    """Distinct buckets of pairs of numbers."""
    x = (first * np.uint64(0x9E3779B97F4A7C15) + np.uint64(family)) * np.uint64(0xBF58476D1CE4E5B9) + second * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return np.unique(((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)) % np.uint64(buckets))


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted distinct buckets of a text's n-grams: words, pairs of neighbouring words, words' endings, threes of
    character classes in a word, pairs of words' shapes (runs of one class as one letter), and which of three
    neighbouring words are equal. Indicators only; a text without words has none."""
    line = (text or "").lower().split()
    if not line:
        return np.zeros(0, np.int64)
    known = {w: _number(w) for w in set(line)}
    low = np.fromiter(map(known.get, line), np.uint64, len(line))
    out = [np.fromiter(known.values(), np.uint64, len(known)) % np.uint64(buckets), np.array([_number("e" + e) % buckets for e in {w[-2:] for w in known}], np.uint64)]
    # classes of all characters at once, with a blank at either end
    classes = np.frombuffer(text.translate(CLASSES).encode("utf-32-le", "surrogatepass"), np.uint32)
    z = np.concatenate(([0], np.where(classes < 128, NUMBERS[classes & 127], 0), [0]))
    threes = np.unique((z[:-2] * 36 + z[1:-1] * 6 + z[2:])[z[1:-1] > 0])
    out.append(np.array([_number(THREES[i]) % buckets for i in threes], np.uint64))
    y = z[np.concatenate(([True], z[1:] != z[:-1]))]
    place = np.arange(len(y)) - np.maximum.accumulate(np.where(y == 0, np.arange(len(y)), 0))
    spelled = (y * 131 + place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spelled = np.where(y > 0, (spelled ^ (spelled >> np.uint64(31))) * np.uint64(0x94D049BB133111EB), np.uint64(0))
    shape = np.add.reduceat(spelled, np.flatnonzero(y[:-1] == 0))
    out += [_pairs(low[:-1], low[1:], 1, buckets), _pairs(shape[:-1], shape[1:], 2, buckets)]
    if len(line) > 2:
        equal = (low[:-2] == low[1:-1]) * 4 + (low[1:-1] == low[2:]) * 2 + (low[:-2] == low[2:]) * 1
        kinds = np.unique(equal[equal > 0]).astype(np.uint64)
        out.append(_pairs(kinds, kinds, 3, buckets))
    return np.unique(np.concatenate(out)).astype(np.int64)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, buckets: int, rounds: int, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the linear hinge-loss model by dual coordinate descent: one dual variable a
    row, held to 0..cost, visited in seeded order; the bias is a feature of every row."""
    w, bias = np.zeros(buckets), 0.0
    alpha, norms = np.zeros(len(y)), np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias, alpha


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, c: float = 0.1, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and log-count ratios of the model on indicators scaled by log-count ratios; rows have unit length
    but for the bias, and their cost is weighed by class."""
    y = np.where(labels > 0, 1.0, -1.0)
    counts = np.full((2, buckets), SMOOTHING)
    for x, label in zip(rows, labels, strict=True):
        counts[int(label), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [(ratio[x] / max(1e-9, float(np.linalg.norm(ratio[x])))).astype(np.float32) for x in rows]
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    w, bias, _ = descend(rows, values, y, cost, buckets, rounds, seed)
    mean = float(np.abs(w).sum()) / max(1, int((w != 0).sum()))
    return (1 - FITTED) * mean + FITTED * w, bias, ratio


def margin(x: np.ndarray, w: np.ndarray, bias: float, ratio: np.ndarray) -> float:
    v = ratio[x]
    return float(w[x] @ v) / max(1e-9, float(np.linalg.norm(v))) + bias


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid from margins to the share of label 1, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        q = p * (1 - p)
        g = np.array([((p - labels) * margins).sum() + 1e-2 * a, (p - labels).sum() + 1e-2 * b])
        h = np.array([[(q * margins * margins).sum() + 1e-2, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float, np.ndarray, float, float]:
    """Fitted on at most `sample_rows` labelled rows outside the held-out fifth, lowest by a hash of their id, and on at
    most `sample_bytes` of their features (of very long texts fewer rows).

    Which rows: the labels are counted, and those under a hash threshold that lets about the bound through are joined
    with their texts. Their features are made by the executors; the driver gets sparse rows only.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    marked = marked.filter(~in_fold(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = marked.count()
    below = min(1.0, 1.1 * sample_rows / max(1, n))
    few = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int(below * (1 << 30))).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [features(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], ["doc_id", "label", "x"])

    made = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x binary")
    # one row an id, however often it is repeated: what the driver gets is bounded by the sample
    made = materialize(made.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("x").alias("x")).withColumn("h", F.xxhash64("doc_id", F.lit(29))))
    sizes = made.select("doc_id", "h", F.octet_length("x").alias("n")).orderBy("h", "doc_id").collect()  # at most sample_rows
    last = max((r for r, n in zip(sizes, accumulate(s.n for s in sizes), strict=True) if n <= sample_bytes), key=lambda r: (r.h, r.doc_id), default=None)
    within = (F.col("h") < last.h) | (F.col("h") == last.h) & (F.col("doc_id") <= last.doc_id) if last else F.lit(False)
    rows = made.filter(within).orderBy("doc_id").collect()
    xs = [np.frombuffer(r.x, np.int32) for r in rows]  # the rows' own bytes, no copy
    y = np.array([r.label for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 1.0, math.log((share + 0.01) / (1.01 - share))
    # the sigmoid is fitted on margins of rows that their model hasn't seen
    part = np.arange(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):
        seen = [i for i in range(len(y)) if part[i] != k]
        if y[seen].min() == y[seen].max():
            continue
        w, bias, ratio = fit([xs[i] for i in seen], y[seen], rounds=6)
        for i in np.flatnonzero(part == k):
            margins[i] = margin(xs[i], w, bias, ratio)
    a, b = platt(margins, y)
    w, bias, ratio = fit(xs, y)
    return w.astype(np.float32), bias, ratio.astype(np.float32), a, b


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    score is the calibrated share of label 1, also for null and empty texts (which have no n-grams, so that the bias
    alone speaks); without labels of both kinds it is the labels' share, 0.5 without any. Texts of any length count whole. Repeated rows and null ids keep their rows (a null
    id isn't held out and isn't learned from); repeated labels of a document count once, the higher; an empty table
    gives no rows; other columns are ignored. Scoring doesn't shuffle; the model (2 x 2^18 floats) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, ratio, a, b = sent.value
        for batch in slices(batches):
            z = np.array([margin(features(t), w, bias, ratio) for t in batch.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    score = F.round("score", 6)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
