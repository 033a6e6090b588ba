"""Operator 7: personal data, with contextual extraction bootstrapped from it. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import materialize
from loamwork.llm.spans import FOLD, SPAN, let, matches, running, told

#: The base kinds, in their order. Possessive loops stand for the plain ones (nothing that follows could take a part
#: back), so that matching is linear and never recursive, also on very long runs.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9]){11,}+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"

#: A blank between groups of digits, and what stands for it while words are told apart: as long, but not a blank.
BETWEEN, JOINED = "(?<=[0-9)])\\x20(?=[0-9(])", "\u00a0"
#: A label before a value: one of the contexts from which patterns are induced. The other is two words beside a value.
LABELLED = "(?<![A-Za-z0-9_])[A-Za-z][A-Za-z_]++\\x20?[:=#]\\x20?[\"']?[A-Za-z0-9+(][A-Za-z0-9@._+()/\u00a0-]{4,}+"
#: What a word has around it that is not of its value; a bracket that opens a group of digits is.
BEFORE, AFTER = "^(?:[\\[{<\"']|\\((?![0-9]))++", "[.,;:!?)\\]}>\"']++$"
WORD = "\\S++"
LABEL, VALUE = "^([A-Za-z_]+)", "[:=#]\\x20?[\"']?(.*)$"
#: What a word that stands beside words must have to be an identifier; all other words there speak against the pattern.
SHAPE = "[0-9@_]|[A-Za-z]\\.[A-Za-z]"

#: A pattern is trusted from this confidence on, and from so many different instances. SHARE asks besides for a part of
#: all different base values; it is none, so that what is trusted doesn't hang on how much else there is.
CONFIDENCE = 0.7
SUPPORT = 5
SHARE = 0.0
#: Scores have settled when no pattern's confidence moves by more than this; beyond so many rounds it is an error.
SETTLED, ROUNDS = 0.001, 30
#: What a pattern without evidence has: so many instances of score 0.
DOUBT = 1.0
#: Texts that are looked at first for words that speak against patterns.
FIRST_LOOK = 20_000
#: Patterns that may be sent to all tasks as literals; more are joined.
MAX_LABELS = 10_000

CANDIDATE = "array<struct<label:string,start:bigint,end:bigint,value:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _part(p: Column) -> Column:
    bare = F.regexp_replace(p, "^0+", "")
    return (F.length(bare) <= 2) | (F.length(bare) == 3) & (bare <= "255")


def base_spans(text: Column) -> list[Column]:
    """email, ip, card, phone of a text, the failing matches dropped."""
    return [
        matches(text, EMAIL, "email", 0),
        F.filter(matches(text, IP, "ip", 1), lambda s: F.forall(F.split(s["hit"], "\\."), _part)),
        F.filter(matches(text, CARD, "card", 2), lambda s: (F.length(_digits(s["hit"])) <= 19) & _luhn(_digits(s["hit"]))),
        F.filter(matches(text, PHONE, "phone", 3), lambda s: F.length(_digits(s["hit"])).between(9, 15)),
    ]


def _joined(text: Column) -> Column:
    return F.regexp_replace(text, BETWEEN, JOINED)


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, BEFORE, ""), AFTER, "")


def _is_base(value: Column) -> Column:
    """Whether a value holds an entity of the base kinds."""
    return F.when(value.rlike("[0-9@]"), let(F.translate(value, JOINED, " "), lambda v: F.size(F.concat(*base_spans(v))) > 0)).otherwise(F.lit(False))


def _threes(array: Column) -> Column:
    """Each three neighbours of an array as (a, b, c); none of fewer."""

    def of(words: Column) -> Column:
        n = F.greatest(F.size(words) - 2, F.lit(0))
        return F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, F.least(F.lit(2), n + 1), n).alias("b"), F.slice(words, F.least(F.lit(3), n + 1), n).alias("c"))

    return let(array, of)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(_joined(text), "\\s++", " ")), " ")


def _after(t: Column) -> Column:
    """The pattern of the third of three words: it stands after the first two."""
    return F.concat(t["a"], F.lit(" "), t["b"], F.lit(" *"))


def _ahead(t: Column) -> Column:
    """The pattern of the first of three words: it stands before the last two."""
    return F.concat(F.lit("* "), t["b"], F.lit(" "), t["c"])


def signed(text: Column) -> Column:
    """Values with a label and a sign before them, as candidates."""

    def candidate(m: Column) -> Column:
        value = F.regexp_extract(m["hit"], VALUE, 1)
        return F.struct(F.lower(F.regexp_extract(m["hit"], LABEL, 1)).alias("label"), (m["end"] - F.length(value)).alias("start"), m["end"].alias("end"), value.alias("value"))

    found = let(_joined(text), lambda t: matches(t, LABELLED, "context", 4))
    return F.filter(F.transform(found, candidate).cast(CANDIDATE), lambda c: c["value"] != "")


def worded(text: Column) -> Column:
    """Words that are shaped like identifiers, once by the two words before them and once by the two after, as candidates."""

    def candidate(label: Column, word: Column) -> Column:
        start = word["start"] + F.length(word["hit"]) - F.length(F.regexp_replace(word["hit"], BEFORE, ""))
        bare = _bare(word["hit"])
        return F.struct(label.alias("label"), start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("value"))

    low = lambda t: {k: F.lower(t[k]["hit"]) for k in "abc"}
    third = lambda t: F.transform(F.filter(t, lambda x: x["c"]["hit"].rlike(SHAPE)), lambda x: candidate(_after(low(x)), x["c"]))
    first = lambda t: F.transform(F.filter(t, lambda x: x["a"]["hit"].rlike(SHAPE)), lambda x: candidate(_ahead(low(x)), x["a"]))
    words = let(_joined(text), lambda t: matches(t, WORD, "word", 5))
    both = let(_threes(words), lambda t: F.concat(third(t), first(t))).cast(CANDIDATE)
    return F.filter(both, lambda c: c["value"].rlike(SHAPE))


def _none() -> Column:
    return F.array().cast(CANDIDATE)


def beside(rows: DataFrame, labels: DataFrame, shaped: bool) -> DataFrame:
    """(label, value): the words of rows (text) that stand beside the given labels' words and are shaped like identifiers,
    or those that are not; in lower case, with repeats."""
    fits = lambda w: w.rlike(SHAPE) if shaped else ~w.rlike(SHAPE)
    after = lambda t, of: F.transform(F.filter(t, lambda x: fits(x["c"]) & of(_after(x))), lambda x: F.struct(_after(x).alias("label"), x["c"].alias("word")))
    ahead = lambda t, of: F.transform(F.filter(t, lambda x: fits(x["a"]) & of(_ahead(x))), lambda x: F.struct(_ahead(x).alias("label"), x["a"].alias("word")))
    said = lambda of: let(_threes(_words(F.lower("text"))), lambda t: F.concat(after(t, of), ahead(t, of)))
    known = few_of(labels)
    if known is None:
        found = rows.select(F.inline(said(lambda x: F.lit(True)))).join(labels, "label", "left_semi")
    else:
        found = rows.select(F.inline(said(lambda x: x.isin(known))))
    return found.select("label", _bare(F.col("word")).alias("value")).filter("value <> ''")


def few_of(labels: DataFrame, most: int | None = None) -> list[str] | None:
    """The labels, if they are at most MAX_LABELS; their number is checked first."""
    most = MAX_LABELS if most is None else most
    return None if labels.count() > most else sorted(r.label for r in labels.select("label").collect())


def evidence(rows: DataFrame, support: int, share: float, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame, int]:
    """The graph of patterns and instances: edges (label, value_hash, seed), the number of different words that speak
    against each pattern of words (label, against), and the least support.

    One pass over the texts finds what stands after labels and beside base entities; patterns of words are induced from
    `support` different base entities on. A second pass tells all identifiers beside them, which are few. Most patterns
    have very many other words beside them: a first look at some texts already shows more than all their identifiers
    could outweigh, whatever else there is, and these can't be trusted. For the rest a third pass counts all other words.
    """
    text = F.col("text")
    candidate = lambda c, seed: F.struct(c["label"].alias("label"), F.xxhash64(F.lower(c["value"])).alias("value_hash"), seed.alias("seed"))
    seeds = F.when(F.size(F.concat(*base_spans(text))) > 0, F.filter(worded(text), lambda c: _is_base(c["value"]))).otherwise(_none())
    found = rows.select(F.inline(F.concat(F.transform(signed(text), lambda c: candidate(c, _is_base(c["value"]))), F.transform(seeds, lambda c: candidate(c, F.lit(True))))))
    first = materialize(found.groupBy("label", "value_hash").agg(F.max("seed").alias("seed")))
    values = first.filter("seed").agg(F.count_distinct("value_hash").alias("n")).first().n
    least = max(support, math.ceil(share * values))
    of_words = F.col("label").contains(" ")
    labels = materialize(first.filter(of_words).groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("label"))
    if labels.isEmpty():
        return first.filter(~of_words), labels.withColumn("against", F.lit(0).cast("long")), least
    few = lambda of: F.broadcast(of) if of.count() <= MAX_LABELS else of
    different = lambda texts, of, shaped: beside(texts, of, shaped).select("label", F.xxhash64("value").alias("value_hash")).distinct()
    counted = lambda words: words.groupBy("label").agg(F.count(F.lit(1)).alias("against"))
    induced = first.filter(of_words).join(few(labels), "label", "left_semi")
    said = materialize(induced.unionByName(different(rows, labels, True).withColumn("seed", F.lit(False))).groupBy("label", "value_hash").agg(F.max("seed").alias("seed")))
    # any sample gives the same result: what it shows is there, so that no pattern goes that could be trusted
    some = rows.filter(F.rand(5) < FIRST_LOOK / max(1, rows.count()))
    most = said.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(counted(different(some, labels, False)), "label", "left")
    open_ = materialize(most.filter(F.col("n") >= confidence * (F.col("n") + F.coalesce("against", F.lit(0)) + DOUBT)).select("label"))
    against = materialize(counted(different(rows, open_, False)))
    return first.filter(~of_words).unionByName(said.join(few(open_), "label", "left_semi")), against, least


def trusted_labels(edges: DataFrame, against: DataFrame, support: int, confidence: float = CONFIDENCE, settled: float = SETTLED, rounds: int = ROUNDS) -> DataFrame:
    """Labels whose values are personal data, from the bipartite graph of patterns (labels) and instances (values).

    Seeds score 1 and stay; a pattern's confidence is its instances' mean score, with DOUBT instances of score 0
    besides, and with those words that speak against it; another instance's score is the best confidence of its patterns
    that is trusted. Scores only rise, so the rounds go on until they have settled; each round is written down.
    """
    edges = materialize(edges.groupBy("label", "value_hash").agg(F.max("seed").alias("seed")))
    scores = edges.groupBy("value_hash").agg(F.max(F.col("seed").cast("double")).alias("score"))
    before = None
    for _ in range(rounds):
        known = edges.select("label", "value_hash").join(scores, "value_hash").groupBy("label").agg(F.sum("score").alias("good"), F.count(F.lit(1)).alias("support"))
        share = F.col("good") / (F.col("support") + F.coalesce("against", F.lit(0)) + DOUBT)
        patterns = materialize(known.join(against, "label", "left").select("label", "support", share.alias("confidence")))
        trusted = patterns.filter((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("label", "confidence")
        if before is not None:
            moved = patterns.join(before, "label").agg(F.max(F.col("confidence") - F.col("old")).alias("most")).first().most
            if moved is None or moved <= settled:
                return trusted.select("label")
        before = patterns.select("label", F.col("confidence").alias("old"))
        best = edges.join(trusted, "label", "left").groupBy("value_hash").agg(F.max(F.col("seed").cast("double")).alias("seed"), F.max("confidence").alias("confidence"))
        scores = materialize(best.select("value_hash", F.greatest("seed", F.coalesce("confidence", F.lit(0.0))).alias("score")))
    raise RuntimeError(f"the patterns' scores didn't settle in {rounds} rounds")


def added_spans(text: Column, of_signs: Callable[[Column], Column] | None, of_words: Callable[[Column], Column] | None) -> Column:
    """Candidates of a text whose label is trusted (told by the two functions) and that hold no base entity."""
    found = []
    if of_signs is not None:
        found.append(F.filter(signed(text), lambda c: of_signs(c["label"])))
    if of_words is not None:
        # offsets are counted only in texts that have such words at all
        said = F.exists(_threes(_words(F.lower(text))), lambda t: of_words(_after(t)) | of_words(_ahead(t)))
        found.append(F.when(said, F.filter(worded(text), lambda c: of_words(c["label"]))).otherwise(_none()))
    return F.filter(F.concat(*found) if found else _none(), lambda c: ~_is_base(c["value"]))


def with_spans(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """docs with `__base` and `__spans` (base and added spans by start) of each row's text.

    The trusted patterns go to all tasks as literals, and a last pass finds their values where the text is: no text is
    shuffled. With more than MAX_LABELS of them all candidates are joined with the patterns, and found spans with docs.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"))
    edges, against, least = evidence(rows, support, share, confidence)
    trusted = materialize(trusted_labels(edges, against, least, confidence))
    based = docs.withColumn("__base", F.array_sort(F.concat(*base_spans(text))))
    span = lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("kind_no"), c["end"].alias("end"), F.lit("context").alias("kind"), c["value"].alias("hit"))
    known = few_of(trusted)
    if known is not None:
        signs, words = [x for x in known if " " not in x], [x for x in known if " " in x]
        added = added_spans(text, (lambda x: x.isin(signs)) if signs else None, (lambda x: x.isin(words)) if words else None)
        return based.withColumn("__added", F.array_distinct(F.transform(added, span)).cast(f"array<{SPAN}>")).withColumn("__spans", F.array_sort(F.concat("__base", "__added"))).drop("__added")
    every = lambda x: F.lit(True)
    texts = rows.select("text", F.xxhash64("text").alias("__hash"), F.sha1("text").alias("__sha"))
    found = texts.select("__hash", "__sha", F.inline(added_spans(F.col("text"), every, every))).join(trusted, "label", "left_semi")
    found = found.select("__hash", "__sha", F.explode(F.array(span({c: F.col(c) for c in ("start", "end", "value")}))).alias("s")).distinct()
    found = materialize(found.groupBy("__hash", "__sha").agg(F.collect_list("s").cast(f"array<{SPAN}>").alias("__added")))
    keyed = based.withColumns({"__hash": F.xxhash64(text), "__sha": F.sha1(text)})
    joined = keyed.join(found, ["__hash", "__sha"], "left").withColumn("__spans", F.when(F.col("__added").isNull(), F.col("__base")).otherwise(F.array_sort(F.concat("__base", "__added"))))
    return joined.drop("__hash", "__sha", "__added")


def find_pii(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document.

    Base spans always stay. Values with a label before them (`label: value`), and words with two words before or after
    them, whose label or two words are trusted, because most values beside them in the corpus are base entities, are
    added as `context`. A label may be of any length. Two words are a pattern from `support` different base entities on
    (and from `share` of all different ones, if it is over 0); words beside them must be shaped like identifiers; blanks in a value stand between groups of digits
    or brackets. Offsets are code points, end exclusive. A null text is empty; repeated rows and null ids keep their
    rows; texts of any length are searched whole; an empty table gives no rows; other columns are ignored.
    """
    of = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text")), confidence, support, share)
    return out.select("doc_id", of("email"), of("ip"), of("card"), of("phone"), F.sha2(told(F.col("__base")), 256).alias("base_sha256"), told(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """docs, all rows and columns, with each span of personal data in text replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the first's kind. Rows without spans, null texts among them, stay as they
    are, whatever other columns there are; an empty table stays empty. The pieces between the spans are joined once.
    """
    text = F.col("text").cast("string")

    def replaced(spans: Column) -> Column:
        def pieces(until: Column, cut: Callable[[Column, Column], Column]) -> Column:
            mark = lambda s, p: F.when(s["start"] >= p, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
            gap = lambda s, p: F.when(s["start"] > p, cut(p, s["start"])).otherwise(F.lit(""))
            each = F.zip_with(spans, F.slice(until, 1, F.size(spans)), lambda s, p: F.concat(gap(s, p), mark(s, p)))
            return F.concat(F.array_join(each, ""), cut(F.element_at(until, -1), F.length(text).cast("bigint")))

        # a substring is counted from the text's beginning: with many spans the text is cut into characters once
        plain = lambda u: pieces(u, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
        cut_up = lambda u, chars: pieces(u, lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), (b - a).cast("int")), ""))
        until = F.concat(F.array(F.lit(0).cast("bigint")), running(F.transform(spans, lambda s: s["end"]), F.greatest))
        return let(until, lambda u: F.when(F.size(spans) > FOLD, let(F.split(text, ""), lambda chars: cut_up(u, chars))).otherwise(plain(u)))

    out = with_spans(docs, confidence, support, share)
    done = F.when(F.size("__spans") == 0, F.col("text")).otherwise(let(F.col("__spans"), replaced))
    return out.select(*[done.alias("text") if c == "text" else F.col(c) for c in docs.columns])
