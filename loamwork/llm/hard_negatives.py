"""Operator 11: hard negatives by exact search in rotated vectors, leading components first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import last_written, materialize
from loamwork.llm.whitening import matrix, whole_vectors

#: A component x becomes the whole number floor(SCALE * x).
SCALE = 256
#: Positives of an anchor, and negatives of an anchor and positive.
TOP = 5
#: A negative's score is between these parts of the positive's, in hundredths.
LEAST, MOST = 80, 100
#: Bytes of the vectors of a block of anchors, which goes to all tasks as a broadcast.
BLOCK_BYTES = 4 * 1024 * 1024
#: Pairs that are scored at a time.
PAIRS = 1 << 20
#: Bytes of the rows that the rotation is fitted on.
SAMPLE_BYTES = 4 * 1024 * 1024
#: Components that are added between two looks at the bound, as parts of all.
STEPS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)
#: From this part of a slice's pairs on they are added as a matrix, below pair by pair.
DENSE = 0.1

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Rotation:
    """An orthogonal matrix of principal components, the cuts between steps, and what rounding can do to a product."""

    axes: np.ndarray  # a column a component
    cuts: list[int]
    slack: float  # of the product of two vectors of length 1

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rotated rows, and the length of what is left of each after each cut."""
        y = x @ self.axes
        rest = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
        return y, np.sqrt(np.column_stack([rest[:, c] if c < y.shape[1] else np.zeros(len(y)) for c in self.cuts]))


def fit_rotation(sample: np.ndarray, width: int) -> Rotation:
    """Principal axes of the sample, in falling order. Any orthogonal matrix gives exact results: the sample decides only
    how early a pair is discarded. Products are about the origin, so the axes are too."""
    # by way of the R factor, which has no more rows than columns
    axes = np.linalg.svd(np.linalg.qr(sample.astype(float), mode="r"), full_matrices=True)[2].T if len(sample) else np.eye(width)
    cuts = sorted({max(1, round(width * s)) for s in STEPS})
    eps = np.finfo(float).eps
    return Rotation(axes, cuts, float(np.abs(axes.T @ axes - np.eye(width)).sum(1).max()) + 64 * width * eps)


def near_pairs(rotation: Rotation, ya, rest_a, xa, yr, rest_r, xr, lo, hi, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and exact scores of the allowed pairs with a score from lo to hi of the anchor, and maybe of others.

    The partial product of the leading components can be off by no more than the lengths of both rests allow
    (Cauchy-Schwarz) and rounding; a pair goes as soon as that keeps it out of its anchor's range. What is left after
    all components is told by the product of the whole numbers.
    """
    slack = rotation.slack * np.linalg.norm(xa.astype(float), axis=1)[:, None] * np.linalg.norm(xr.astype(float), axis=1)[None, :]
    partial, alive, begin = np.zeros((len(ya), len(yr))), allowed, 0
    i = j = p = None
    for k, cut in enumerate(rotation.cuts):
        if i is None:
            partial += ya[:, begin:cut] @ yr[:, begin:cut].T
            bound = rest_a[:, k, None] * rest_r[None, :, k] + slack
            alive = alive & (partial + bound >= lo[:, None]) & (partial - bound <= hi[:, None])
            if alive.sum() < DENSE * alive.size:
                i, j = np.nonzero(alive)
                p = partial[i, j]
        else:
            p = p + np.einsum("ij,ij->i", ya[i, begin:cut], yr[j, begin:cut])
            bound = rest_a[i, k] * rest_r[j, k] + slack[i, j]
            stay = (p + bound >= lo[i]) & (p - bound <= hi[i])
            i, j, p = i[stay], j[stay], p[stay]
        begin = cut
    if i is None:
        i, j = np.nonzero(alive)
    scores = np.empty(len(i), dtype=np.int64)
    for a in range(0, len(i), PAIRS // 16):
        at = slice(a, a + PAIRS // 16)
        scores[at] = np.einsum("ij,ij->i", xa[i[at]], xr[j[at]])
    return i, j, scores


@dataclass
class Best:
    """The first rows of each of several ranges by falling score and then by id: ranges are lo to hi, both included."""

    lo: np.ndarray
    hi: np.ndarray
    top: int
    slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    vec_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        fits = (score >= self.lo[slot]) & (score <= self.hi[slot])
        if not fits.any():
            return
        slot, score, vec_id = (np.concatenate(x) for x in ((self.slot, slot[fits]), (self.score, score[fits]), (self.vec_id, vec_id[fits])))
        order = np.lexsort((vec_id, -score, slot))
        slot, score, vec_id = slot[order], score[order], vec_id[order]
        first = np.searchsorted(slot, slot)
        held = np.arange(len(slot)) - first < self.top
        self.slot, self.score, self.vec_id = slot[held], score[held], vec_id[held]
        # from the last of a full range on, lower scores don't count any more; equal ones may, by their id
        last = np.arange(len(self.slot)) - np.searchsorted(self.slot, self.slot) == self.top - 1
        self.lo[self.slot[last]] = np.maximum(self.lo[self.slot[last]], self.score[last])


#: Range of an anchor that takes nothing.
NEVER = (np.iinfo(np.int64).max, np.iinfo(np.int64).min)


@dataclass
class Anchors:
    """A block of anchors as arrays. positives: the ids and scores of each anchor's positives, in order."""

    row_id: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    positives: list[list[tuple[int | None, int]]]


def _columns(batch: pa.RecordBatch, width: int):
    ids = batch.column(batch.schema.get_field_index("vec_id"))
    # a row without an id comes after all others
    vec_id = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    return vec_id, batch.column(batch.schema.get_field_index("row_id")).to_numpy(), batch.column(batch.schema.get_field_index("label")).to_numpy(), matrix(batch, "x", width)


def _id(v: int) -> int | None:
    return None if v == np.iinfo(np.int64).max else int(v)


def _search(rows: DataFrame, block: Anchors, rotation: Rotation, width: int, same: bool, top: int, least: int, most: int) -> DataFrame:
    """Of one block: each task's first rows of each anchor (same label), or of each anchor and positive (others)."""
    sent = rows.sparkSession.sparkContext.broadcast((block, rotation))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, turn = sent.value
        ya, rest_a = turn.turned(a.x.astype(float))
        n = len(a.x)
        if same:
            slots, best = np.arange(n)[:, None], Best(np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max), top)
        else:
            ranges = np.full((n, top, 2), NEVER, dtype=np.int64)
            for i, found in enumerate(a.positives):
                for j, (_, p) in enumerate(found):
                    lo, hi = -(-least * p // 100), most * p // 100
                    if lo <= hi:
                        ranges[i, j] = lo, hi
            slots, best = np.arange(n * top).reshape(n, top), Best(ranges[:, :, 0].ravel().copy(), ranges[:, :, 1].ravel().copy(), top)
        for batch in batches:
            for begin in range(0, batch.num_rows, max(64, PAIRS // max(1, n))):
                vec_id, row_id, label, x = _columns(batch.slice(begin, max(64, PAIRS // max(1, n))), width)
                yr, rest_r = turn.turned(x.astype(float))
                # positives are looked for label by label, negatives among all rows at once
                for one in np.intersect1d(label, a.label) if same else [None]:
                    of, to = (np.nonzero(a.label == one)[0], np.nonzero(label == one)[0]) if same else (np.arange(n), np.arange(len(x)))
                    allowed = a.row_id[of, None] != row_id[None, to] if same else a.label[of, None] != label[None, to]
                    lo, hi = best.lo[slots[of]].min(1).astype(float), best.hi[slots[of]].max(1).astype(float)
                    i, j, score = near_pairs(turn, ya[of], rest_a[of], a.x[of], yr[to], rest_r[to], x[to], lo, hi, allowed)
                    for s in slots.T:
                        best.add(s[of[i]], score, vec_id[to[j]])
        anchor, place = np.divmod(best.slot, slots.shape[1])
        told = [a.positives[i][j] if not same else (None, None) for i, j in zip(anchor, place, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.row_id[anchor]), pa.array([_id(v) for v in a.vec_id[anchor]], pa.int64()), pa.array(place, pa.int32()), pa.array([p for p, _ in told], pa.int64()), pa.array([s for _, s in told], pa.int64()), pa.array([_id(v) for v in best.vec_id], pa.int64()), pa.array(best.score)],
            ["row_id", "anchor_id", "place", "positive_id", "positive_score", "other_id", "score"],
        )

    return rows.mapInArrow(run, "row_id long, anchor_id long, place int, positive_id long, positive_score long, other_id long, score long")


def _first(found: DataFrame, top: int) -> DataFrame:
    """The tasks' first rows merged, with their rank from 1 in each range. Each task sends `top` of a range at most, and
    a partial limit goes before the shuffle."""
    # rows of one score and one id are the same in the result, in any order
    order = Window.partitionBy("row_id", "place").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(anchors: DataFrame, width: int) -> Iterator[DataFrame]:
    """The anchors in blocks of about BLOCK_BYTES, dealt by a hash of the row."""
    n = anchors.count()
    blocks = -(-n * 8 * width // BLOCK_BYTES)
    if blocks <= 1:
        yield from [anchors] * bool(n)
        return
    dealt = materialize(anchors.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")), partition_by="block")
    for b in range(blocks):
        yield dealt.filter(F.col("block") == b)


def _held(block: DataFrame, width: int) -> Anchors | None:
    """A block on the driver, which sends it to all tasks; None if the hash has dealt it no row."""
    rows = block.select("vec_id", "row_id", "label", "x").orderBy("row_id").toArrow()
    if not rows.num_rows:
        return None
    batch = rows.combine_chunks().to_batches()[0]
    vec_id, row_id, label, x = _columns(batch, width)
    return Anchors(row_id, vec_id, label, x, [])


def mine(vectors: DataFrame, is_anchor: Column, column: str = "embedding", scale: int = SCALE, top: int = TOP, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    `top` positives the first `top` negatives.

    A score is the inner product with the anchor in whole numbers; higher ones come first, ties by the smaller vec_id.
    Positives are other rows of the anchor's label. Negatives are rows of another label whose score is from least to
    most hundredths of the positive's.

    Anchors pass over all rows in blocks: a block of bounded bytes is broadcast, and each task keeps the first rows of
    each range while it reads its own, so rows are not shuffled and memory doesn't grow with them. Vectors are rotated
    to principal axes of a sample of at most SAMPLE_BYTES; pairs are discarded as soon as the rest can't matter, and
    those that stay are verified. The work is the pairs of an anchor and a row, less what is discarded.

    Rows without a label or vector, or with a null or non-finite entry, take no part. Rows that repeat are rows of
    their own: they are each other's positives, and an anchor that repeats is answered once for each. A row without an
    id comes after all others of its score. Shorter vectors end in entries 0. Anchors without positives, and positives
    without negatives in reach (all those with a score under 0), give no rows, as do empty tables. Entries whose
    products don't fit 64 bits are an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, width, n = whole_vectors(vectors.filter(F.col("label").isNotNull()), scale, 0, column, least_width=1)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x", is_anchor.alias("is_anchor"), F.monotonically_increasing_id().alias("row_id"))
    rows = materialize(rows)
    largest = rows.agg(F.coalesce(F.max(F.array_max(F.transform("x", lambda c: F.abs(c)))), F.lit(0)).alias("m")).first().m  # one row
    if width * largest * largest >= 2**62:
        raise ValueError(f"[mine] products of {width} entries up to {largest} don't fit 64 bits")
    sample = rows.select("x", "row_id").orderBy(F.xxhash64("row_id"), "row_id").limit(max(1, SAMPLE_BYTES // (8 * width))).select("x").toArrow()
    rotation = fit_rotation(np.concatenate([matrix(b, "x", width) for b in sample.to_batches()]), width)

    paths = []
    for block in _blocks(rows.filter("is_anchor"), width):
        held = _held(block, width)
        if held is None:
            continue
        found: dict[int, list[tuple[int | None, int]]] = {}
        # at most `top` rows of each anchor of the block
        for r in _first(_search(rows, held, rotation, width, True, top, least, most), top).orderBy("row_id", "rank").toLocalIterator():
            found.setdefault(r.row_id, []).append((r.other_id, r.score))
        held.positives = [found.get(int(r), []) for r in held.row_id]
        out = _first(_search(rows, held, rotation, width, False, top, least, most), top)
        names = {"other_id": "negative_id", "score": "negative_score"}
        materialize(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "other_id", "positive_score", "score").withColumnsRenamed(names))
        paths.append(last_written())
    return spark.read.schema(SCHEMA).parquet(*paths).select(*COLUMNS) if paths else spark.createDataFrame([], SCHEMA)
