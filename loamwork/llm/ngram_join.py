"""Operator 6: n-gram Jaccard self-join by universe partitions with one-deletion neighbourhoods.

Two sets with Jaccard similarity >= t differ in at most (1 - t) / (1 + t) * (sum of sizes) shingles. Sizes fall into
bands whose ends are 1/t apart, so a similar pair lies in one band or in two neighbouring ones; every set works under the
tag of its own band and, where near enough, of the next. Under a tag with at most H differences

- H <= 2: the whole set is one segment, indexed with all sets that H deletions leave;
- H <= 7: the universe of shingles is hashed into (H + 2) / 2 + slack segments. In slack + 1 of them similar sets differ
  in at most one shingle: each is indexed with its one-deletion neighbourhood;
- else into H + 1 + slack segments, of which slack + 1 at least are equal in both sets. A segment's key is the hash
  of its part of the set. One-deletion neighbourhoods cost a key for every shingle, plain segments a key for every four
  or so, but are selective only in larger sets.

Allocation by cost, set by set: a segment is left out where it can hold nothing that both sets have (it is empty, or one
deletion empties it), and where one of its keys turns out to join many sets that aren't similar. A set may leave out
`slack` segments: then one in which a similar set agrees is left, whatever that set leaves out. Sets that would have to
leave out more (most of them made of passages that many documents share) are compared among one another in an exact other
way: by the first (1 - t) * size + 1 of their shingles, rarest first, of which similar sets share one. So nothing is
dropped.

Candidates are verified exactly on whole texts. A key's sets are joined to the smallest of them, first in each map task
and then over all, so that a group of near copies, however large, gives a number of candidates in proportion; only sets
that are not connected by then are compared further.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import materialize, numbered_runs, slices

WORDS = 5
#: Percent of the union that the intersection must have.
PERCENT = 80
#: Keys that a map task holds before it sorts and sends them; characters of text behind a bucket of keys.
HELD_KEYS = 1_500_000
BUCKET_CHARS = 8_000_000
MIN_BUCKETS = 64
#: Buckets that one map task sends keys to; with more, keys go to so many groups of buckets first.
COARSE = 16_384
#: A key's code is its tag times this, and its segment where neighbourhoods of segments are indexed.
SEGMENTS = 8
#: Differences up to which one-deletion neighbourhoods are indexed.
HALVED = 7
#: The cost that a key may have: sets outside its largest component, each compared with all its sets. Beyond it the
#: segment is left out.
OUTSIDERS = 16
#: Ids that may be broadcast (8 MB).
MAX_BROADCAST_IDS = 1_000_000
SKETCH = 256
#: Pairs of one head that one task compares.
HEAD_PAIRS = 64

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31, S32 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; of all its words if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - size + 1 + i]
    out = np.sort(mixed(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class Scheme:
    """Bands, tags, differences and segments for a similarity in percent."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.low = [1]
        while self.low[-1] < 1 << 34:
            self.low.append(100 * self.low[-1] // percent + 1)

    def tags(self, size: int) -> list[int]:
        own = bisect_right(self.low, size) - 1
        return [own, own + 1] if 100 * size >= self.percent * self.low[own + 1] else [own]

    def differences(self, tag: int) -> int:
        return (100 - self.percent) * 2 * (self.low[tag + 1] - 1) // (100 + self.percent)

    def halved(self, tag: int) -> bool:
        """Whether one-deletion neighbourhoods are indexed, of the whole set or of its segments."""
        return self.differences(tag) <= HALVED

    def slack(self, tag: int) -> int:
        h = self.differences(tag)
        return 0 if h <= 2 else 1 if self.halved(tag) else math.ceil(0.15 * (h + 1)) + 1

    def segments(self, tag: int) -> int:
        h = self.differences(tag)
        return 1 if h <= 2 else ((h + 2) // 2 if self.halved(tag) else h + 1) + self.slack(tag)

    def keys(self, x: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys of a set under a tag, their codes, and how many of its segments can't be used because too little is in
        them. What leaves nothing over is no key."""
        h, code = self.differences(tag), np.uint16(tag * SEGMENTS)
        if h <= 2:
            total = np.add.reduce(x, keepdims=True)
            sums = [total]
            if h >= 1:
                sums.append(total - x)
            if h == 2:
                a, b = np.triu_indices(len(x), 1)
                sums.append(total - x[a] - x[b])
            every = self.named(np.concatenate(sums), tag, np.uint64(0))
            return every, np.full(len(every), code), 0
        m = self.segments(tag)
        seg = (mixed(x ^ np.uint64(tag + 1)) >> S32) % np.uint64(m)
        seg = seg.astype(np.uint16) if m < 1 << 16 else seg
        order = np.argsort(seg, kind="stable")
        y, seg = x[order], seg[order].astype(np.uint64)
        begin = np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1))
        sums = np.add.reduceat(y, begin)
        if not self.halved(tag):
            return self.named(sums, tag, seg[begin]), np.full(len(begin), code), m - len(begin)
        size = np.diff(np.concatenate((begin, [len(y)])))
        some = np.repeat(size > 1, size)
        every, of = np.concatenate((sums, (np.repeat(sums, size) - y)[some])), np.concatenate((seg[begin], seg[some]))
        return self.named(every, tag, of), code + of.astype(np.uint16), m - int((size > 1).sum())

    @staticmethod
    def named(sums: np.ndarray, tag: int, seg: np.ndarray) -> np.ndarray:
        return mixed(mixed(sums + seg * np.uint64(0xD6E8FEB86659FD93)) + np.uint64(tag))


INDEX = "what int, doc_id long, n long, fp1 long, fp2 long, sketch binary, tag int, empty int, tag2 int, empty2 int, bucket int, key long, blob binary"


def _pack(key: np.ndarray, code: np.ndarray, doc: np.ndarray, whole: bool) -> bytes:
    """Keys, codes and documents as bytes; of a key that is in its bucket 48 bits are enough."""
    named = key.tobytes() if whole else key.astype(np.uint32).tobytes() + (key >> np.uint64(48)).astype(np.uint16).tobytes()
    return named + code.tobytes() + doc.tobytes()


def _unpack(blob: bytes, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = 8 if whole else 6
    n = len(blob) // (width + 10)
    if whole:
        key = np.frombuffer(blob, np.uint64, n)
    else:
        key = np.frombuffer(blob, np.uint32, n).astype(np.uint64) | np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(48)
    return key, np.frombuffer(blob, np.uint16, n, width * n), np.frombuffer(blob, np.int64, n, (width + 2) * n)


def _blobs(key: np.ndarray, code: np.ndarray, doc: np.ndarray, bucket: np.ndarray, whole: bool) -> tuple[np.ndarray, list[bytes]]:
    """The buckets and what goes to each."""
    order = np.lexsort((doc, bucket))
    key, code, doc, bucket = key[order], code[order], doc[order], bucket[order]
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return bucket[begin].astype(np.int32), [_pack(key[a:b], code[a:b], doc[a:b], whole) for a, b in zip(begin, np.r_[begin[1:], len(bucket)], strict=True)]


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> S32) % np.uint64(buckets)


def _finer(buckets: int):
    """Blobs of groups of buckets, sorted anew into their buckets, some keys at a time."""

    def flush(held: list[bytes]) -> pa.RecordBatch:
        key, code, doc = map(np.concatenate, zip(*(_unpack(b, True) for b in held), strict=True))
        bucket, blobs = _blobs(key, code, doc, _bucket_of(key, buckets), False)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in slices(batches):
            for blob in batch.column(1).to_pylist():
                held.append(blob)
                size += len(blob) // 18
                if size >= HELD_KEYS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _index(docs: DataFrame, scheme: Scheme, buckets: int, coarse: int | None) -> DataFrame:
    """what 0: a document's size, fingerprints, sketch, tags and unusable segments. what 1: the keys and documents of a
    bucket, or of one of `coarse` groups of buckets. what 2: documents that share a key in this task (key, doc_id, tag:
    the key's code). what 3: candidates (doc_id, key: another)."""
    fields = [f.split() for f in INDEX.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, arrow[t]) for n, t in fields])

    def rows(n_rows: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[f], type=schema.field(f).type) if f in given else pa.nulls(n_rows, schema.field(f).type) for f in schema.names], schema=schema)

    def flush(keys: list[np.ndarray], codes: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        key, code = np.concatenate(keys), np.concatenate(codes)
        doc = np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
        order = np.lexsort((doc, key))
        key, doc, code = key[order], doc[order], code[order]
        again = np.r_[False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])]
        key, doc, code = key[~again], doc[~again], code[~again]
        bucket = _bucket_of(key, buckets)
        first, shared, head = _runs(key)
        # 48 bits of a key and its bucket name it: what falls together by chance is told apart by the verification
        name = named_key(key, bucket)
        for i in range(0, int(shared.sum()), 50_000):
            part = slice(i, i + 50_000)
            k, d, t = name[shared][part], doc[shared][part], code[shared][part].astype(np.int32)
            yield rows(len(k), what=np.full(len(k), 2, np.int32), key=k.view(np.int64), doc_id=d, tag=t)
        a, b = _stars(doc, shared, head)
        yield rows(len(a), what=np.full(len(a), 3, np.int32), doc_id=a, key=b)
        # of documents that share a key only the first goes on
        to = bucket[first] if coarse is None else bucket[first] % np.uint64(coarse)
        numbers, blobs = _blobs(key[first], code[first], doc[first], to, coarse is not None)
        yield rows(len(blobs), what=np.full(len(blobs), 1, np.int32), bucket=numbers, blob=blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        ids: list[int] = []
        held = 0
        copies: dict[tuple[int, int], int] = {}
        for batch in slices(batches):
            twins: list[tuple[int, int]] = []
            out: dict[str, list] = {f: [] for f in ("doc_id", "n", "fp1", "fp2", "sketch", "tag", "empty", "tag2", "empty2")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = shingles(text)
                mine = scheme.tags(len(x)) if len(x) and doc_id is not None else []
                empties = []
                prints = _sum(x), _sum(mixed(x + M1))
                twin = copies.setdefault(prints, doc_id) if mine else None
                for t in mine:
                    k, code, empty = scheme.keys(x, t)
                    empties.append(empty)
                    if twin == doc_id:
                        keys.append(k)
                        codes.append(code)
                        ids.append(doc_id)
                        held += len(k)
                if twin != doc_id and mine:
                    twins.append((twin, doc_id))
                sketch = np.minimum(np.bincount((x >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes() if mine else None
                both = [*zip(mine, empties, strict=True), (None, None), (None, None)][:2]
                for f, v in zip(out, (doc_id, len(x), *prints, sketch, *both[0], *both[1]), strict=True):
                    out[f].append(v)
                if held >= HELD_KEYS:
                    yield from flush(keys, codes, ids)
                    keys, codes, ids, held = [], [], [], 0
                    copies.clear()
            if twins:
                yield rows(len(twins), what=np.full(len(twins), 3, np.int32), doc_id=[a for a, _ in twins], key=[b for _, b in twins])
            yield rows(batch.num_rows, what=np.zeros(batch.num_rows, np.int32), **out)
        if held:
            yield from flush(keys, codes, ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


def _sum(x: np.ndarray) -> int:
    return int(np.add.reduce(x).astype(np.uint64).view(np.int64)) if len(x) else 0


def named_key(key: np.ndarray, bucket: np.ndarray | np.uint64) -> np.ndarray:
    return (key & np.uint64(0xFFFF0000FFFFFFFF)) | ((bucket & np.uint64(0xFFFF)) << S32)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each begins, which ones aren't alone, and for each row where its key begins."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    return first, np.repeat(size > 1, size), np.repeat(first, size)


def _stars(doc: np.ndarray, shared: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of each key's first document and another."""
    pairs = np.stack([doc[head[shared]], doc[shared]], axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _bucket_shares(table: pa.Table) -> pa.Table:
    """Of one bucket's keys, those that several map tasks sent: (what 2, key, doc_id, tag) and candidates (what 3)."""
    bucket = table.column("bucket")[0].as_py()
    key, tag, doc = map(np.concatenate, zip(*(_unpack(blob, False) for chunk in table.column("blob").chunks for blob in chunk.to_pylist()), strict=True))
    order = np.lexsort((doc, key))
    key, doc, tag = key[order], doc[order], tag[order]
    _, shared, head = _runs(key)
    name = named_key(key[shared], np.uint64(bucket)).view(np.int64)
    a, b = _stars(doc, shared, head)
    what = np.r_[np.full(len(name), 2), np.full(len(a), 3)].astype(np.int32)
    other = np.r_[tag[shared], np.zeros(len(a), np.uint16)].astype(np.int32)
    return pa.table([pa.array(what), pa.array(np.r_[name, b]), pa.array(np.r_[doc[shared], a]), pa.array(other)], ["what", "key", "doc_id", "tag"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that is reachable, for each node of edges (a, b).

    Large-star and small-star rounds, each written down, until nothing changes. Minima are summed up before they are
    shuffled; the joins can be split where a node has very many edges.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = materialize(large)
        small = large.join(least(large), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least(large).select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        now = materialize(small)
        # done when every node has one edge, to a node that has none
        if now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty() and now.join(now.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


class NgramJoin:
    """The join over one table of documents."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT):
        self.spark, self.scheme = docs.sparkSession, Scheme(percent)
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        chars = self.docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
        buckets = max(MIN_BUCKETS, math.ceil(chars / BUCKET_CHARS))
        coarse = COARSE if buckets > COARSE else None
        index = materialize(_index(self.docs, self.scheme, buckets, coarse))
        self.sizes = index.filter("what = 0").select("doc_id", "n", "fp1", "fp2", "sketch", "tag", "empty", "tag2", "empty2")
        sent = index.filter("what = 1").select("bucket", "blob")
        if coarse:
            sent = sent.repartition("bucket").mapInArrow(_finer(buckets), "bucket int, blob binary")
        over = materialize(sent.groupBy("bucket").applyInArrow(_bucket_shares, "what int, key long, doc_id long, tag int"))
        all_rows = index.select("what", "key", "doc_id", "tag").filter("what >= 2").unionByName(over)
        #: (key, doc_id, tag: code) of keys that several documents have; the first of a map task may be there twice.
        self.shares = all_rows.filter("what = 2").select("key", "doc_id", "tag")
        self.stars = all_rows.filter("what = 3").select(F.col("doc_id").alias("a"), F.col("key").alias("b"))

    def texts(self, ids: DataFrame) -> DataFrame:
        """doc_id, text of the given ids (column doc_id, distinct)."""
        return self.docs.join(_small(ids), "doc_id", "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) the similar ones. Equal fingerprints (128 bits of the sets) are similar; the rest
        must be near in size and in their sketches (bins of shingles differ by less than the sets do), and are then
        compared as sets."""
        percent = self.scheme.percent
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        sizes = materialize(self.sizes.join(_small(ids), "doc_id", "left_semi"))
        of = lambda x: sizes.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "fp1", "fp2", "sketch")])
        met = pairs.join(of("a"), "a").join(of("b"), "b")
        near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("n_a") > 0)
        equal = (F.col("n_a") == F.col("n_b")) & (F.col("fp1_a") == F.col("fp1_b")) & (F.col("fp2_a") == F.col("fp2_b"))
        met = met.filter(near).select("a", "b", equal.alias("equal"), (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b")

        def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 4096):
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for i in (4, 5))
                apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
                n = batch.column(3).to_numpy(zero_copy_only=False)
                keep = batch.column(2).to_numpy(zero_copy_only=False) | (apart * (100 + percent) <= n * (100 - percent))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:3]], ["a", "b", "equal"])

        close = materialize(met.mapInArrow(sketched, "a long, b long, equal boolean").distinct())
        ask = close.filter("not equal").select("a", "b")
        ids = materialize(ask.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        texts = materialize(self.texts(ids))
        # a head's text is sent once for so many of its pairs, not for each: a large group has one head
        heads = ask.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        dealt = materialize(ask.join(materialize(heads), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / HEAD_PAIRS)).alias("part")))
        first = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
        others = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
        lined = first.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now: tuple[int, int] | None = None
            known: dict[tuple[int, int], np.ndarray] = {}
            for batch in slices(batches):
                found: list[tuple[int, int]] = []
                for a, part, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if (a, part) != now:
                        now, known = (a, part), {}
                    x = shingles(text)
                    if b is None:  # rows with one id are one head, with all its different sets
                        known[len(x), _sum(x)] = x
                        continue
                    for y in known.values():
                        both = len(x) + len(y) - len(np.union1d(x, y))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            found.append((a, b))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        same = lined.mapInArrow(compared, "a long, b long")
        return materialize(close.filter("equal").select("a", "b").unionByName(same).distinct())

    @staticmethod
    def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()

    def labelled(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """rows with each document's component so far."""
        return rows.join(found, rows["doc_id"] == found["node"], "left").select(*rows.columns, F.coalesce("component", "doc_id").alias("component"))

    def rarest(self, few: DataFrame) -> DataFrame:
        """(key, doc_id, n, place): of each set (doc_id) its first shingles in order of how many of these sets have them, as
        many as similar sets must share one of. Shingles of one set only are left out."""
        percent = self.scheme.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 64):
                sets = [shingles(t) for t in batch.column(1).to_pylist()]
                counts = [len(x) for x in sets]
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(ids, counts)), pa.array(np.repeat(np.array(counts, np.int64), counts))], ["key", "doc_id", "n"])

        all_rows = materialize(self.texts(few).mapInArrow(run, "key long, doc_id long, n long"))
        common = materialize(all_rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
        # shingles that one set only has come first: their number is what the others leave of the set's size
        shared = all_rows.join(common, "key")
        in_set = Window.partitionBy("doc_id")
        place = F.col("n") - F.count(F.lit(1)).over(in_set) + F.row_number().over(in_set.orderBy("df", "key"))
        first = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
        return materialize(shared.withColumn("place", place).filter(F.col("place") <= first).select("key", "doc_id", "n", "place"))

    def compare_rest(self, few: DataFrame, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links and components with those among the sets `few`: first each key's sets against its smallest, of which
        the others are the likeliest to be similar, then those that aren't in one component yet."""
        keys = self.rarest(few)
        # written down, so that the join's both sides are plain shuffles and a hot key can be split
        heads = materialize(keys.groupBy("key").agg(F.min(F.struct("n", "doc_id")).alias("head")))
        near = 100 * F.col("head.n") >= self.scheme.percent * F.col("n")
        stars = self.ordered(keys.join(heads, "key").filter(near).select(F.col("head.doc_id").alias("x"), F.col("doc_id").alias("y")), "x", "y")
        links, found = self.with_links(links, found, stars)
        held = materialize(self.labelled(keys, found))
        parts = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")).filter("n > top.n").select("key", F.col("top.component").alias("main"))
        rows = materialize(held.join(materialize(main), "key"))
        outside = rows.filter("component <> main").alias("p")
        like = (100 * F.col("p.n") >= self.scheme.percent * F.col("q.n")) & (100 * F.col("q.n") >= self.scheme.percent * F.col("p.n"))
        # if this is the first shingle that both have, they can have no more than this and what stands behind it
        most = 1 + F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place"))
        like = like & ((100 + self.scheme.percent) * most >= self.scheme.percent * (F.col("p.n") + F.col("q.n")))
        met = outside.join(rows.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.component") != F.col("q.component")) & like)
        return self.with_links(links, found, self.ordered(met.select(F.col("p.doc_id").alias("x"), F.col("q.doc_id").alias("y")), "x", "y"))

    def with_links(self, links: DataFrame, found: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = self.verified(materialize(pairs.join(links, ["a", "b"], "left_anti")))
        if more.isEmpty():
            return links, found
        links = materialize(links.unionByName(more).distinct())
        return links, materialize(components(links))

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Verified links (a, b) that connect all that is connected, and (node, component)."""
        links = self.verified(materialize(self.ordered(self.stars, "a", "b")))
        found = materialize(components(links))

        # keys whose documents aren't in one component yet; two documents alone have been compared already
        held = materialize(self.labelled(self.shares, found))
        parts = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), (F.min("doc_id") < F.max("doc_id")).alias("several"))
        largest = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("components"), F.bool_or("several").alias("several"))
        open_keys = largest.filter("components > 2 or components = 2 and several").select("key", F.col("top.component").alias("main"), (F.col("n") - F.col("top.n")).alias("outside"))
        used = materialize(held.join(materialize(open_keys), "key"))
        rows = used.filter(F.col("outside") <= OUTSIDERS)
        outside = rows.filter("component <> main").alias("p")
        met = outside.join(rows.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.component") != F.col("q.component")))
        pairs = self.ordered(met.select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b")), "a", "b")

        # sets that leave out more segments than the slack; a plain segment has one key, a neighbourhood's is told by its code
        tags = range(len(self.scheme.low) - 1)
        tag_of, halved = F.floor(F.col("tag") / SEGMENTS).cast("int"), F.array(*[F.lit(self.scheme.halved(t)) for t in tags])
        segment = F.when(halved[tag_of], F.col("tag").cast("long")).otherwise(F.col("key"))
        unused = used.filter(F.col("outside") > OUTSIDERS).groupBy("doc_id", tag_of.alias("tag")).agg(F.count_distinct(segment).alias("unused"))
        entries = self.sizes.filter("doc_id is not null").select("doc_id", F.explode(F.array(F.struct("tag", "empty"), F.struct(F.col("tag2").alias("tag"), F.col("empty2").alias("empty")))).alias("e")).select("doc_id", "e.tag", "e.empty").filter("tag is not null")
        slack = F.array(*[F.lit(self.scheme.slack(t)) for t in tags])
        counted = entries.join(unused, ["doc_id", "tag"], "left").filter(F.col("empty") + F.coalesce("unused", F.lit(0)) > slack[F.col("tag")])
        few = materialize(counted.select("doc_id").distinct())

        links, found = self.with_links(links, found, pairs)
        return (links, found) if few.isEmpty() else self.compare_rest(few, links, found)


def ngram_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of docs.

    n_shingles is the set's size, 0 for a null text or one without words, which links with nothing. component_id is the
    smallest doc_id reachable by links, itself included. n_links counts the document's verified links: enough of them to
    connect every component, not all pairs of copies. Rows with one doc_id are one node, linked by any of its texts; a
    null doc_id has a null component; an empty table gives no rows; other columns are ignored.
    """
    join = NgramJoin(docs, percent)
    links, found = join.run()
    degree = links.select(F.explode(F.array("a", "b")).alias("l_node")).groupBy("l_node").agg(F.count(F.lit(1)).alias("l_n"))
    out = join.sizes.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("node"), "left").join(degree, F.col("doc_id") == F.col("l_node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("l_n", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component.

    Rows are judged by their texts: those that share an id, or have none, take part as rows of their own, behind all rows
    with an id of their own, and of those with equal texts one stays. Texts without words, null or empty, link with
    nothing and stay; texts of any length are compared whole; an empty table stays empty; columns may have any names.
    """
    ids, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    twice = materialize(docs.filter("doc_id is not null").groupBy(ids.alias("__twice")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__twice"))
    shared = docs.join(_small(twice), ids == F.col("__twice"), "left_semi").unionByName(docs.filter("doc_id is null"))
    worded = F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    shared = shared.withColumns({"__id": ids, "__hash": F.xxhash64(text), "__sha": F.sha1(text)}).filter(worded)
    kinds = materialize(shared.select("__id", "__hash", "__sha").distinct())
    if kinds.isEmpty():
        _, found = NgramJoin(docs, percent).run()
        # found has the nodes that aren't the smallest of their component
        return docs.join(found.select(F.col("node").alias("__node")), ids == F.col("__node"), "left_anti")
    after = docs.agg(F.max(ids).alias("m")).first().m or 0
    numbered = numbered_runs(kinds, [F.col("__id").asc_nulls_last(), F.col("__hash"), F.col("__sha")], {"__node": F.lit(1).cast("long")})
    numbered = materialize(numbered.withColumn("__node", F.col("__node") + F.lit(after + 1)))
    numbered = numbered.withColumnsRenamed({c: f"{c}_of" for c in ("__id", "__hash", "__sha")})
    same = F.col("__id").eqNullSafe(F.col("__id_of")) & (F.col("__hash") == F.col("__hash_of")) & (F.col("__sha") == F.col("__sha_of"))
    shared = materialize(shared.join(numbered, same).select(*docs.columns, "__node").dropDuplicates(["__node"]))
    own = docs.filter("doc_id is not null").join(_small(twice), ids == F.col("__twice"), "left_anti").withColumn("__node", ids)
    every = own.unionByName(shared)
    _, found = NgramJoin(every.select(F.col("__node").alias("doc_id"), "text"), percent).run()
    kept = every.join(found.select(F.col("node").alias("__gone")), F.col("__node") == F.col("__gone"), "left_anti").select(*docs.columns)
    # rows without words that share an id or have none
    bare = docs.filter("doc_id is null").unionByName(docs.join(_small(twice), ids == F.col("__twice"), "left_semi")).filter(~worded)
    return kept.unionByName(bare)
