"""Operator 5: secret scanning with multipart credential linking. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import materialize
from loamwork.llm.spans import SPAN, let, matches, running, told

#: Between parts of one credential lie so many code points at most, and no blank line. None: a paragraph alone decides.
REACH = 240


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base kinds, in their order.
ASSIGN = f"({_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run that is too short has no longer part
HEX = "[0-9a-f]{32,}"

#: Weak candidates: alone they say little. A keyword may stand anywhere in its name; the first look is whether a sign
#: follows the name at all, so that long runs are read once.
SIGN = "[\"']?\\x20*[:=]\\x20*[\"']?"
NAME = "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]++[\"']?\\x20*[:=])"
NO_ID = f"(?![A-Za-z0-9_]*(?:{_either('id')}|{_either('name')})(?![A-Za-z0-9_]))"


def _named(words: list[str], value: str, guard: str = "") -> str:
    return f"{NAME}{guard}[A-Za-z0-9_]*?(?:{'|'.join(words)})[A-Za-z0-9_]*+{SIGN}{value}"


WEAK_ID = _named([_either("user"), _either("login"), f"{_either('client')}_?{_either('id')}", _either("account"), f"{_either('access')}_?(?:{_either('key')}_?)?{_either('id')}"], "[A-Za-z0-9@._-]{3,}+")
WEAK_SECRET = _named(
    [_either("pass"), _either("pwd"), _either("pw"), f"{_either('auth')}(?!{_either('or')}{_either('s')}?(?![A-Za-z]))", _either("credential"), _either("secret"), _either("token"), f"(?:{_either('private')}|{_either('access')}|{_either('account')}|{_either('api')}|{_either('shared')})_?{_either('key')}"],
    "[A-Za-z0-9+/_.=!@#-]{6,}+", NO_ID,
)
ENDPOINT = f"(?:[a-z][a-z0-9+]{{1,15}}://[A-Za-z0-9.-]+(?::[0-9]{{1,5}})?|{_named([_either('host'), _either('endpoint'), _either('server')], '[A-Za-z0-9.-]{4,}+')})"
#: A run without a name, from so many bits a character on.
RUN, BITS = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", 3.5
BLANK = "\\n[\\x20\\t\\r]*\\n"


def base_spans(text: Column) -> list[Column]:
    value = lambda s: F.regexp_extract(s["hit"], ASSIGN, 2)
    return [F.filter(matches(text, ASSIGN, "assign", 0), lambda s: F.length(value(s)) >= 8), matches(text, ACCESS, "access", 1), matches(text, HEX, "hex", 2)]


def _bits(hit: Column) -> Column:
    """Shannon entropy of a text's characters, by one fold over them in order: equal ones are runs."""
    part = lambda k: k * F.log2(k)
    start = F.struct(F.lit("").alias("last"), F.lit(1.0).alias("k"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        same = a["last"] == c
        return F.struct(c.alias("last"), F.when(same, a["k"] + 1.0).otherwise(F.lit(1.0)).alias("k"), F.when(same, a["sum"]).otherwise(a["sum"] + part(a["k"])).alias("sum"))

    n = F.length(hit).cast("double")
    return F.log2(n) - F.aggregate(F.array_sort(F.split(hit, "")), start, step, lambda a: a["sum"] + part(a["k"])) / n


def _outside(found: Column, taken: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The spans w of which keep(w, reach) holds, where reach is the furthest end of the taken spans that begin before w
    ends. Both in one sorted line, so that many spans in a text are no pairs."""
    span = lambda w: F.struct(*[w[f].alias(f) for f in ("start", "kind_no", "end", "kind", "hit")])
    here = F.transform(found, lambda w: F.struct(w["end"].alias("at"), F.lit(0).alias("late"), span(w).alias("w"), F.lit(0).cast("bigint").alias("reach")))
    there = F.transform(taken, lambda t: F.struct(t["start"].alias("at"), F.lit(1).alias("late"), span(t).alias("w"), t["end"].alias("reach")))

    def told(line: Column) -> Column:
        reached = F.zip_with(line, running(F.transform(line, lambda x: x["reach"]), F.greatest), lambda x, r: F.struct(x["w"].alias("w"), x["late"].alias("late"), r.alias("r")))
        return F.transform(F.filter(reached, lambda x: (x["late"] == 0) & keep(x["w"], x["r"])), lambda x: x["w"])

    # w ends before what begins there: it sorts first
    return F.when((F.size(found) == 0) | (F.size(taken) == 0), found).otherwise(let(F.array_sort(F.concat(here, there)), told).cast(f"array<{SPAN}>"))


def weak_spans(rows: DataFrame) -> DataFrame:
    """rows with `weak`: weak secrets, identifiers, endpoints and high-entropy runs, none within another or a base span."""
    text, taken = F.col("text"), F.col("base")
    mixed = lambda h: h.rlike("[A-Za-z]") & (h.rlike("[0-9]") | h.rlike("[a-z][A-Z]"))
    runs = F.filter(F.filter(matches(text, RUN, "weak_run", 6), lambda s: mixed(s["hit"])), lambda s: _bits(s["hit"]) >= BITS)
    out = rows.withColumns({"w_secret": matches(text, WEAK_SECRET, "weak_secret", 4), "w_id": matches(text, WEAK_ID, "weak_id", 3), "w_end": matches(text, ENDPOINT, "endpoint", 5), "w_run": runs})
    # a named part counts if its end, that is its value, is in no other span; a run if it touches none
    apart, free = lambda w, reach: reach < w["end"], lambda w, reach: reach <= w["start"]
    out = out.withColumn("w_secret", _outside(F.col("w_secret"), taken, apart))
    out = out.withColumn("w_id", _outside(F.col("w_id"), F.concat("base", "w_secret"), apart))
    out = out.withColumn("w_end", _outside(F.col("w_end"), F.concat("base", "w_secret", "w_id"), apart))
    out = out.withColumn("w_run", _outside(F.col("w_run"), F.concat("base", "w_secret", "w_id", "w_end"), free))
    return out.withColumn("weak", F.concat("w_id", "w_secret", "w_end", "w_run")).drop("w_id", "w_secret", "w_end", "w_run")


def linked(parts: DataFrame, reach: int | None = REACH) -> DataFrame:
    """Of rows (doc_id, text_hash, text_sha, start, kind_no, end, kind), the weak ones whose complements lie in reach and in scope.

    An interval join that asks whether there is a match: two parts of one scope (a stretch without a blank line) meet
    where the gap between their intervals is at most `reach` code points (any, if it is None). Of the parts that begin before this one, the
    furthest end tells whether one of a kind reaches it; of those that begin after it, the nearest start does. So both
    sides are running extremes in one sorted pass, and no pairs are made, however many parts a scope has. A weak secret
    needs an identifier or an endpoint, a run without a name an identifier, a weak identifier a secret or a run, an
    endpoint both.
    """
    text, reach = ["doc_id", "text_hash", "text_sha"], 1 << 40 if reach is None else reach
    in_text = Window.partitionBy(*text).orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scoped = parts.withColumn("scope", F.count_if(F.col("kind") == "blank").over(in_text)).filter("kind <> 'blank'")
    in_scope = Window.partitionBy(*text, "scope").orderBy("start")
    earlier, later = in_scope.rangeBetween(Window.unboundedPreceding, Window.currentRow), in_scope.rangeBetween(Window.currentRow, Window.unboundedFollowing)

    def here(*kinds: str) -> Column:
        of = F.col("kind").isin(*kinds)
        before, after = F.max(F.when(of, F.col("end"))).over(earlier), F.min(F.when(of, F.col("start"))).over(later)
        return F.coalesce(before >= F.col("start") - reach, F.lit(False)) | F.coalesce(after <= F.col("end") + reach, F.lit(False))

    met = scoped.withColumns({"ids": here("access", "weak_id"), "secrets": here("assign", "hex", "weak_secret", "weak_run"), "endpoints": here("endpoint")})
    kind, ids, secrets, endpoints = map(F.col, ("kind", "ids", "secrets", "endpoints"))
    needs = (kind == "weak_secret") & (ids | endpoints) | (kind == "weak_run") & ids | (kind == "weak_id") & secrets | (kind == "endpoint") & ids & secrets
    return met.filter(needs).select(*text, "start", "kind_no", "end", "kind")


def find_secrets(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document.

    Base spans always stay; weak identifiers, weak secrets, unnamed runs and endpoints are added where they complete one
    another: in one paragraph, with at most `reach` code points between them.
    Offsets are code points, end exclusive. A null text is empty; repeated rows and null ids keep their rows (equal
    texts of one id have equal spans); an empty table gives no rows; other columns are ignored. The texts are searched
    once, whole, however long; only documents with weak candidates are shuffled, by text, as a row for each part.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    searched = weak_spans(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.unhex(F.sha1("text")).alias("text_sha"), F.array_sort(F.concat(*base_spans(F.col("text")))).alias("base"), "text"))
    some = F.size("weak") > 0
    slim = F.transform("base", lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"]))
    parts = F.when(some, F.transform(F.concat("base", "weak", matches(F.col("text"), BLANK, "blank", 7)), lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"])))
    found = materialize(searched.select("doc_id", "text_hash", "text_sha", slim.alias("base"), parts.alias("parts")))
    added = linked(found.filter("parts is not null").dropDuplicates(["doc_id", "text_hash", "text_sha"]).select("doc_id", "text_hash", "text_sha", F.inline("parts")), reach)
    added = added.groupBy("doc_id", "text_hash", "text_sha").agg(F.collect_list(F.struct("start", "kind_no", "end", "kind")).alias("added")).withColumnsRenamed({"doc_id": "a_id", "text_hash": "a_hash", "text_sha": "a_sha"})
    joined = found.select("doc_id", "text_hash", "text_sha", "base").join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash")) & (F.col("text_sha") == F.col("a_sha")), "left")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return joined.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"))

