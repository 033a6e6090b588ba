"""Operator 10: benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import materialize, slices

WINDOW = 10
#: Characters of benchmark text that make one automaton, and so the size of what is broadcast: some 100 MB in a task.
MAX_CHARS = 8_000_000

#: Bytes 0-9, a-z and all from 0x80 are parts of words, A-Z become a-z, all others separate words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class Windows:
    """The benchmark's windows in one automaton over words (numbers of the benchmark's words; 0 is any other word).

    A window of WINDOW words holds a whole block of half as many that begins at a multiple of that in its item. So the
    automaton has the items' blocks, and an item of fewer words as a whole: a state or so for each word of the
    benchmark, not one for each letter of every window. Where a block occurs the item is followed to both sides; a run
    as long as a window is a hit.
    """

    def __init__(self, items: list[tuple[int, str | None]], size: int = WINDOW):
        self.size, self.number, self.items = size, {}, []
        half = max(1, size // 2)
        owners: dict[tuple[int, ...], list[tuple[int, int, bool]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            at = len(self.items)
            self.items.append((item_id, array("i", ids)))
            if len(ids) < size:
                owners.setdefault(tuple(ids), []).append((at, 0, True))
            else:
                for i in range(0, len(ids) - half + 1, half):
                    owners.setdefault(tuple(ids[i : i + half]), []).append((at, i, False))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, at in owners.items():
            self.automaton.add_word(key, (len(key), at))
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The runs of words that are hit (first, after the last), merged, and the items found."""
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        if not self.items or not words:
            return runs, found
        line = tuple(map(self.number.get, words, repeat(0)))
        reached: dict[tuple[int, int], int] = {}  # by item and diagonal: how far the text is known to run along it
        for end, (length, places) in self.automaton.iter(line):
            first = end + 1 - length
            for at, i, whole in places:
                item_id, ids = self.items[at]
                if whole:
                    runs.append((first, end + 1))
                    found.add(item_id)
                    continue
                if reached.get((at, first - i), -1) > end:
                    continue
                a, b = first, end + 1
                while a > 0 and a - (first - i) > 0 and line[a - 1] == ids[a - 1 - first + i]:
                    a -= 1
                while b < len(line) and b - (first - i) < len(ids) and line[b] == ids[b - first + i]:
                    b += 1
                reached[at, first - i] = b
                if b - a >= self.size:
                    runs.append((a, b))
                    found.add(item_id)
        return merged(runs), found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of runs of words."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass").translate(NORMAL)
    bounds, at = [], 0
    for w in raw.split():
        at = raw.index(w, at)
        bounds.append((at, at := at + len(w)))
    points = sorted({x for a, b in runs for x in (bounds[a][0], bounds[b - 1][1])})
    source, chars, at = text.encode("utf-8", "surrogatepass"), {}, 0
    n = 0
    for p in points:
        n += len(source[at:p].decode("utf-8", "surrogatepass"))
        chars[p], at = n, p
    return [(chars[bounds[a][0]], chars[bounds[b - 1][1]]) for a, b in runs]


def benchmark_parts(benchmark: DataFrame, max_chars: int = MAX_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in parts of at most max_chars (or one item), one after the other; always one part at least.

    Its size is measured first: one that fits is collected; a larger one comes to the driver a partition at a time.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    part: list[tuple[int, str]] = []
    held = 0
    for r in rows.toLocalIterator() if total > max_chars else rows.collect():
        if held + len(r.text) > max_chars and part:
            yield part
            part, held = [], 0
        part.append((r.item_id, r.text))
        held += len(r.text)
    yield part


HITS = "n_words long, hit_runs array<struct<first:long,last:long>>, hit_items array<long>"


def _scanned(docs: DataFrame, part: list[tuple[int, str]], window: int) -> DataFrame:
    """docs with n_words, hit_runs and hit_items by one part of the benchmark."""
    sent, at, names = docs.sparkSession.sparkContext.broadcast(part), docs.columns.index("text"), docs.columns
    runs_of = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sent.value, window)
        for batch in slices(batches):
            n, runs, items = [], [], []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                hit, found = windows.scan(words)
                n.append(len(words))
                runs.append([{"first": a, "last": b} for a, b in hit])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(runs, runs_of), pa.array(items, pa.list_(pa.int64()))], [*names, "n_words", "hit_runs", "hit_items"])

    return docs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], HITS]))


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """docs (a column text, of strings) with n_words, hit_runs and hit_items.

    A benchmark of one part is one pass without a shuffle. Of a larger one each part is a pass of its own, so that no
    task holds more than one automaton; the hits, of few texts, are written down by text and joined at the end.
    """
    parts = benchmark_parts(benchmark, max_chars)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return _scanned(docs, first, window)
    texts = docs.select("text").filter("text is not null")
    key = [F.xxhash64("text").alias("__hash"), F.sha1("text").alias("__sha")]
    hits = None
    for part in chain([first, second], parts):
        found = materialize(_scanned(texts, part, window).filter(F.size("hit_runs") > 0).select(*key, "hit_runs", "hit_items"))
        hits = found if hits is None else hits.unionByName(found)
    some = hits.groupBy("__hash", "__sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_runs")))).alias("hit_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    keyed = _scanned(docs, [], window).drop("hit_runs", "hit_items").withColumns({"__hash": F.xxhash64("text"), "__sha": F.sha1("text")})
    joined = keyed.join(materialize(some), ["__hash", "__sha"], "left").drop("__hash", "__sha")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(dict(hits.dtypes)[c])) for c in ("hit_runs", "hit_items")})


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit spans of each document.

    A window is `window` consecutive words of an item (all words of a shorter one); a document's word inside any
    occurrence is hit. spans are start:end code points in the original text. A null or empty text has no words and no
    hits; items without words or ids are ignored, and items that are equal are all reported; repeated rows and null
    ids keep their rows; texts of any length are scanned whole; an empty benchmark hits nothing, an empty table gives no
    rows; other columns are ignored.
    """
    hits = scanned(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, window, max_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, runs, items in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                joined = merged([(r["first"], r["last"]) for r in runs])
                ids = ",".join(sorted(map(str, items)))
                out.append((sum(b - a for a, b in joined), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(joined), ",".join(f"{a}:{b}" for a, b in original_spans(text, joined))))
            hit, found, sha, bad, spans = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(hit, pa.int64()), pa.array(found, pa.int64()), pa.array(sha), pa.array(bad), pa.array(spans)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"],
            )

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans string"
    return hits.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs.

    A null or empty text is clean; repeated rows and null ids are judged row by row; an empty table stays empty. Columns
    may have any names but n_words, hit_runs and hit_items, which are set aside while the texts are scanned.
    """
    free = "_" * (1 + max(map(len, docs.columns)))  # no column begins like that
    aside = {c: free + c for c in ("n_words", "hit_runs", "hit_items") if c in docs.columns}
    rows = docs.withColumnsRenamed(aside).withColumn("text", F.col("text").cast("string"))
    clean = scanned(rows, benchmark, window, max_chars).filter(F.size("hit_runs") == 0).drop("n_words", "hit_runs", "hit_items")
    return clean.withColumnsRenamed({v: k for k, v in aside.items()}).select(*[F.col(c).cast(t).alias(c) if c == "text" else F.col(c) for c, t in docs.dtypes])
