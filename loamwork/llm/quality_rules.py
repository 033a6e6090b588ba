"""Operator 1: host-level quality rules with an empirical beta prior."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import materialize, slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Hosts that may be broadcast: their rows are a name and a few numbers.
MAX_BROADCAST_HOSTS = 100_000
SALTS = 32
#: Correlation inside a host that is held possible: the prior is worth 1 document at least and 9,999 at most.
LEAST_RHO, MOST_RHO = 1e-4, 0.5

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(SPACES):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0  # words before this one are counted already
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines, repeated


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [text_counts(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))],
            ["doc_id", "host", *(c.split()[0] for c in COUNTS.split(", "))],
        )


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Each document's counts and whether it fails the base rules. One pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string"))
    counted = rows.mapInArrow(_count_batches, f"doc_id long, host string, {COUNTS}")
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def beta_prior(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and strength (a + b) of each rule's beta prior over hosts, from one aggregate row.

    Moments of the beta-binomial: the mean is the failures' share of all documents; of the hosts' weighted variance
    around it, what documents of one rate would show by chance (the binomial noise) is taken out, and the rest is the
    correlation rho = 1 / (a + b + 1). Where nothing is left, or cannot be told (every host has one document, there is
    one host, no or all documents fail), rho is LEAST_RHO: hosts are held to be alike.
    """
    sums = [f(k).alias(f"{k}_{n}") for k in rules for n, f in (("k", lambda k: F.sum(f"host_{k}")), ("kk", lambda k: F.sum(F.col(f"host_{k}") * F.col(f"host_{k}") / F.col("host_docs"))))]
    seen = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("host_docs").alias("n"), F.sum(F.col("host_docs").cast("double") * F.col("host_docs")).alias("nn"), *sums).first()  # one row
    out = {}
    for rule in rules:
        mean = (seen[f"{rule}_k"] or 0) / max(1, seen.n or 0)
        spread, room = mean * (1 - mean), (seen.n or 0) - (seen.nn or 0) / max(1, seen.n or 0) - (seen.h - 1)
        rho = ((seen[f"{rule}_kk"] - seen.n * mean * mean) / spread - (seen.h - 1)) / room if spread > 0 and room > 0 else 0.0
        out[rule] = mean, 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1
    return out


def host_verdicts(counts: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row per host: documents, failures by rule, each rule's shrunk failure rate, verdict.

    A host's rate by a rule is (failures + mean * strength) / (documents + strength), so a host of few documents stays
    near the mean of all hosts. A host is kept if no rule's rate is above max_rate.
    """
    fails = {"short": F.col("n_words") < 50, "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words")}
    hosts = materialize(counts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *[F.count_if(c).alias(f"host_{k}") for k, c in fails.items()]))
    rate = {k: (F.col(f"host_{k}") + F.lit(mean) * F.lit(strength)) / (F.col("host_docs") + F.lit(strength)) for k, (mean, strength) in beta_prior(hosts, list(fails)).items()}
    return hosts.withColumns({f"{k}_rate": r for k, r in rate.items()}).withColumn("host_kept", F.greatest(*[F.col(f"{k}_rate") for k in fails]) <= max_rate)


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = 0.5, max_broadcast: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """Documents with base counts, base_failed, the host's shrunk failure rates and `kept`.

    kept is false where the document fails the base rules or its host's shrunk failure rate by a rule is above max_rate.
    A null text has no words (it fails); a null host is a host of its own; null or repeated doc_ids keep their
    rows; texts of any length are counted whole; an empty table gives no rows; further columns are ignored. The verdicts
    are broadcast only up to max_broadcast hosts, and joined with salted keys beyond, so a host with a third of all rows
    is no single task.
    """
    counts = materialize(rule_counts(docs, host))
    verdicts = materialize(host_verdicts(counts, max_rate)).withColumnRenamed("host", "v_host")
    same = F.col("host").eqNullSafe(F.col("v_host"))
    if verdicts.count() <= max_broadcast:
        joined = counts.join(F.broadcast(verdicts), same)
    else:
        salted = verdicts.withColumn("v_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("v_salt")))
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return joined.select("doc_id", *names, "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), *[F.round(c, 6).alias(f"host_{c}") for c in ("short_rate", "repeats_rate")])
