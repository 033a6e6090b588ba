"""Operator 2: language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import slices

#: Bounds of the model: bytes of a language's dictionary, documents it is cut from, bytes of one document.
DICTIONARY_BYTES = 48 * 1024
SAMPLE_DOCS = 240
SAMPLE_CHARS = 400
#: Texts from this length on are learned first, shorter ones only where a language has too few of them.
LONG_CHARS = 100
#: Languages that may be learned; with more the column isn't one of languages, which is an error.
MAX_LANGS = 1_000
#: Texts are compressed in blocks of so many bytes: a long text must not become its own dictionary.
BLOCK = 4_096
LEVEL, MIN_MATCH = 6, 3
#: The second-best language must cost so much more, relative to the best, for a text to be accepted.
MIN_MARGIN = 0.005
#: Lower-case ASCII letters and all bytes beyond ASCII; what else there is separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters_of(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "replace").translate(LETTERS).split())


def in_fold(doc_id, k: int, fold: int):
    """crc32 of the id's text mod k is the fold; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % k == fold, F.lit(False))


def train(docs: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, sample_docs: int = SAMPLE_DOCS, holdout: bool = True, sample_chars: int | None = SAMPLE_CHARS) -> dict[str, bytes]:
    """Raw-content dictionaries by language.

    A bounded, seeded sample: of each language the `sample_docs` documents lowest by hash of their id (folds of
    the held-out third never), of each `sample_chars` characters (all, if it is None) from a place that its id's hash gives,
    so that common headers don't make up a dictionary. Texts under `LONG_CHARS` characters fill up the sample of a language that has
    fewer than `sample_docs` longer ones. Two passes: counts by language, then a hash threshold that lets about three
    times as many through, so that no task sees a language's rows together.
    """
    pool = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).filter("lang is not null and text is not null and doc_id is not null")
    if holdout:
        pool = pool.filter(~in_fold(F.col("doc_id"), 3, 1))
    share = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    pool = pool.filter(F.col("text").rlike("\\p{L}")).withColumns({"u": share(17), "short": F.length("text") < LONG_CHARS})
    by = pool.groupBy("lang").agg(F.count_if(~F.col("short")).alias("n_long"), F.count_if("short").alias("n_short"))
    counts = {r.lang: (r.n_long, r.n_short) for r in by.limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} different values of lang: these are no languages")
    if not counts:
        return {}
    through = lambda n: min(1.0, 3.0 * sample_docs / max(1, n))
    by_lang = lambda of: F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, of(*n))])[F.col("lang")]
    below = F.when(F.col("short"), by_lang(lambda n_long, n_short: through(n_short) if n_long < sample_docs else 0.0)).otherwise(by_lang(lambda n_long, n_short: through(n_long)))
    place = F.floor(share(18) * F.greatest(F.length("text") - F.lit(sample_chars or 0) + 1, F.lit(1))).cast("int") + 1
    cut = F.col("text") if sample_chars is None else F.substring("text", place, F.lit(sample_chars))
    few = pool.filter(F.col("u") < below).select("lang", "short", "u", "doc_id", cut.alias("cut"))
    # one row an id, however often it is repeated: what the driver gets is bounded by the sample
    few = few.groupBy("lang", "short", "u", "doc_id").agg(F.min("cut").alias("cut"))
    found: dict[str, list] = {lang: [] for lang in counts}
    for r in few.collect():  # at most about three times the sample, of long texts and of short ones
        found[r.lang].append((r.short, r.u, r.doc_id, r.cut))
    model = {}
    for lang, rows in sorted(found.items()):
        cuts = [letters_of(cut) for *_, cut in sorted(rows)[:sample_docs]]
        if any(cuts):
            model[lang] = b" ".join(cuts)[:dictionary_bytes]
    return model


class Compressors:
    """One compressor a language, with its dictionary digested once."""

    def __init__(self, model: dict[str, bytes]):
        self.langs = sorted(model)
        self.each = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(model[lang]), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
        """Language, score (0 to 1) and whether the margin is wide enough."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        raw = letters_of(text)
        sizes = [0] * len(self.each)
        for i in range(0, len(raw), BLOCK):
            part = raw[i : i + BLOCK]
            for k, c in enumerate(self.each):
                sizes[k] += len(c.compress(part))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], self.langs[k]))
        best = max(1, sizes[order[0]])
        if len(order) == 1:
            return self.langs[order[0]], 1.0, True
        margin = (sizes[order[1]] - best) / best
        # compressed lengths are code lengths; per block of text, so that long texts don't saturate
        bits = [-8 * math.log(2) * (s - best) / max(1.0, len(raw) / 256) for s in sizes]
        return self.langs[order[0]], 1 / sum(map(math.exp, bits)), margin >= min_margin


def classify(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, accepted of each row; no shuffle. The model (a bounded dictionary a language) travels with the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(sent.value)
        for batch in slices(batches):
            rows = [compressors.predict(t, min_margin) for t in batch.column(1).to_pylist()]
            lang, score, accepted = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told by a wide enough margin; all rows where no
    language was learned, and else no null texts, empty ones and others without a letter. Repeated rows and null ids are
    judged row by row, long texts whole; an empty table stays empty; columns may have any names."""
    if not model:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(sent.value)
        for batch in slices(batches):
            keep = pa.array([compressors.predict(t, min_margin)[2] for t in batch.column(at).to_pylist()], pa.bool_())
            yield pc.filter(batch, keep)

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of each document.

    Trained on text and lang of the documents that aren't held out. lang_pred is the learned language whose
    dictionary compresses the text smallest (ties: first by name), `und` with score 0 where the text is null or has
    no letter, or where no language was learned. score is the softmax of the code lengths per 256 bytes. accepted is
    false for `und` and for narrow margins. Repeated rows and null ids keep their rows (a null id isn't held out and
    isn't learned from); an empty table gives no rows; other columns are ignored.
    """
    out = classify(docs, train(docs), min_margin)
    return out.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "accepted")

