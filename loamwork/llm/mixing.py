"""Operator 8: mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import materialize, numbered_runs

#: Words of a block, the unit that is apportioned. Small, so that a small source comes near its target too.
BLOCK = 8
#: A document is taken so many times at most.
REPEATS = 3
#: Blocks of a shard of a source's line: the unit in which blocks are chosen by seed.
SHARD_BLOCKS = 4096
SEED = "mix-1"
#: Divisors that are tried in one pass over the sources, and passes at most: from there on only ties are left.
TRIED, PASSES = 32, 14
#: Equal rows that are written out by one task, and rows of a run of the lines.
CHUNK, RUN_ROWS = 10_000, 20_000
MAX_BROADCAST_SOURCES = 100_000
#: Fixed primes by which the blocks of a shard are strewn; larger than any shard's number of blocks.
STREWN = (2654435761, 2246822519, 3266489917, 668265263, 374761393)

WORD = "[^\\x20\\x09-\\x0D]+"


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def seeded_rows(sizes: DataFrame) -> DataFrame:
    """The rows of sizes with `seeded`, an order that reruns and other partitionings repeat.

    Rows that are equal can change places: they are counted, numbered and written out again, those with very many
    copies (a null id, say) by many tasks. So no id, and no lack of one, brings many rows into one shard.
    """
    counted = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    few = counted.filter(F.col("copies") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    many = counted.filter(F.col("copies") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))))
    many = many.repartition(F.xxhash64("doc_id", "source", "size", "chunk")).withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least((F.col("chunk") + 1) * CHUNK, F.col("copies")))))
    rows = few.unionByName(many.drop("chunk"))
    name = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null-"), F.col("size").cast("string"))), F.col("copy").cast("string"))
    return rows.select("doc_id", "source", "size", F.md5(name).alias("seeded"))


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target, place (from 0), line_start (words of earlier sources): one row per source.

    Sources by code point, null last, weigh 1, 2, 3 and again. The targets share the sum of all sizes by weight and
    stop at `repeats` times the source's size; what is over is shared again. That is the level L with
    sum(min(repeats * size, weight * L)) = total; sources sorted by size / weight are capped up to the first whose
    cap the level of it and those after it doesn't reach. Of sources that tie there the level is that of the first:
    none of them is capped, and the later ones' sums leave some out. Places and running sums go over runs of sources,
    of any number.
    """
    by_source = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = numbered_runs(by_source.withColumn("own", F.col("source_size")), [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long"), "line_start": F.col("own")})
    weighed = materialize(placed.select("source", "source_size", "place", "line_start", (1 + F.col("place") % 3).alias("weight")))
    cap, ratio = repeats * F.col("source_size"), F.col("source_size") / F.col("weight")
    order = [ratio.asc(), F.col("place").asc()]
    levels = numbered_runs(weighed, order, {"capped_size": cap, "capped_weight": F.col("weight").cast("long")})
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()  # one row
    left_size, left_weight = F.lit(total.t) - F.col("capped_size"), F.lit(total.w) - F.col("capped_weight")
    # uncapped if the level over it and all later ones is within its cap
    fits = left_size * F.col("weight") <= cap * left_weight
    level = levels.filter(fits).agg(F.min(F.struct(ratio.alias("r"), "place", left_size.alias("s"), left_weight.alias("w"))).alias("l")).first().l  # one row
    share = F.col("weight") * F.lit(level.s if level else 0) / F.lit(level.w if level else 1)
    return weighed.select("source", "source_size", "place", "line_start", F.least(cap.cast("double"), share.cast("double")).alias("target"))


def sainte_lague(parties: DataFrame, seats: int) -> DataFrame:
    """Adds `seats_won` to parties (place, votes, cap; a written table): the seats go one by one to the highest quotient
    votes / (2 * won + 1) among the parties that have won less than their cap; ties go by `place`, which no two share.

    Without a loop over seats, and for any number of parties. A party has won the seats whose quotient is at least a
    divisor, so the divisor is looked for: each pass over the parties tries several, and only their counts of seats
    come back. At the last one that gives no more than the seats, each party asks for its next seat only, and these are
    dealt by rank. Votes up to 2^52 are exact. Seats beyond all caps stay empty.
    """
    votes, cap = F.col("votes").cast("double"), F.col("cap").cast("double")

    def won(d: Column) -> Column:
        """Seats with a quotient of at least d, told by the quotients themselves: rounding can't part equal ones."""
        n = F.floor((votes / d + 1) / 2).cast("double")
        n = n + F.when(votes / (2 * n + 1) >= d, F.lit(1.0)).otherwise(F.lit(0.0)) - F.when((n > 0) & (votes / (2 * n - 1) < d), F.lit(1.0)).otherwise(F.lit(0.0))
        return F.least(n, cap)

    held = parties.filter("votes > 0 and cap > 0")
    # below `lo` all caps are reached, from `hi` on nothing is won
    ends = held.agg(F.min(votes / (2 * cap + 1)).alias("lo"), F.max(votes).alias("hi"), F.sum(cap).alias("most")).first()  # one row
    if ends.lo is None or seats <= 0 or ends.most <= seats:
        full = F.lit(0.0) if ends.lo is None or seats <= 0 else F.when((votes > 0) & (cap > 0), cap).otherwise(F.lit(0.0))
        return parties.withColumn("seats_won", full.cast("long"))
    lo, hi, dealt = ends.lo / 2, ends.hi * 2, 0.0
    for _ in range(PASSES):
        tried = sorted({lo * (hi / lo) ** (i / (TRIED + 1)) for i in range(1, TRIED + 1)} - {lo, hi})
        tried = [d for d in tried if lo < d < hi]
        if not tried or dealt == seats:
            break
        counts = held.select("votes", "cap", F.explode(F.array(*map(F.lit, tried))).alias("d")).groupBy("d").agg(F.sum(won(F.col("d"))).alias("n")).collect()  # one row a divisor
        for r in sorted(counts, key=lambda r: -r.d):
            if r.n > seats:
                lo = r.d
                break
            hi, dealt = r.d, r.n
    base = F.when((votes > 0) & (cap > 0), won(F.lit(hi))).otherwise(F.lit(0.0))
    based = materialize(parties.withColumn("base_", base.cast("long")))
    quotient = votes / (2 * F.col("base_") + 1)
    asking = based.filter((votes > 0) & (F.col("base_") < cap) & (quotient >= lo)).withColumn("quotient_", quotient)
    ranked = numbered_runs(asking, [F.col("quotient_").desc(), F.col("place").asc()], {"rank_": F.lit(1).cast("long")})
    more = materialize(ranked.filter(F.col("rank_") < seats - int(dealt)).drop("quotient_", "rank_").withColumn("seats_won", F.col("base_") + 1))
    rest = based.join(more.select(F.col("place").alias("place_")), F.col("place") == F.col("place_"), "left_anti").withColumn("seats_won", F.col("base_"))
    return more.unionByName(rest).drop("base_")


def mix(docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS, shard_blocks: int = SHARD_BLOCKS, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs.

    A source's documents stand on its line in seeded order, and the line is cut into blocks of `block` words; only its
    last one may be shorter. A source's votes are the blocks that its target asks for; all sources compete at once for
    all blocks by their quotients, none beyond `repeats` times what it has. So a source is off by rounding once, however
    thin it is. Its quota is `passes` over the whole line and a rest, which its shards (runs of `shard_blocks` blocks)
    share with carried remainders, so that each gets an integer quota and they add up; in a shard blocks are chosen by
    seed. taken counts the words of a document in chosen blocks. Reruns choose the same.

    A null text has size 0 and nothing is taken of it; a null source is a source, the last; rows with the same id or
    none are mixed as rows; an empty table gives no rows; sources without words have target 0; sources may be any
    number, and of any size each; other columns are ignored. A very long text is many blocks, of several shards. Rows
    are dealt by ranges of the lines: no task holds more than a run of about `run_rows` rows, whatever a source or an id
    has.
    """
    sizes = materialize(sizes_of(docs))
    targets = source_targets(sizes, repeats).withColumn("blocks", F.ceil(F.col("source_size") / block))
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    parties = materialize(targets.withColumns({"votes": votes, "cap": repeats * F.col("blocks")}))
    # summed as decimals: the sum must not depend on the order in which rows arrive
    seats = parties.agg(F.coalesce(F.round(F.sum(F.round("votes", 6).cast("decimal(28,6)"))), F.lit(0)).cast("long").alias("n")).first().n  # one row
    quotas = materialize(sainte_lague(parties, seats))
    dim = quotas.select(F.col("source").alias("of"), "source_size", "target", "place", "line_start", F.greatest("blocks", F.lit(1)).alias("n"), F.col("seats_won").alias("quota"))
    # one row a source: broadcast below a checked size, else AQE splits the hot side of the join
    dim = F.broadcast(dim) if quotas.count() <= MAX_BROADCAST_SOURCES else dim
    lined = numbered_runs(seeded_rows(sizes).withColumn("words", F.col("size")), [F.col("source").asc_nulls_last(), F.col("seeded").asc()], {"before": F.col("words")}, run_rows)
    joined = lined.join(dim, F.col("source").eqNullSafe(F.col("of")))

    n, begin = F.col("n"), F.col("before") - F.col("line_start")
    end, passes, rest = begin + F.col("size"), F.floor(F.col("quota") / n), F.col("quota") % n
    first, last = F.floor(begin / block), F.floor((end - 1) / block)
    carried = lambda at: F.floor(at.cast("decimal(19,0)") * rest.cast("decimal(19,0)") / n.cast("decimal(19,0)")).cast("long")
    stop = lambda s: F.least(s * shard_blocks, n)

    def shard(s: Column) -> Column:
        m = stop(s + 1) - stop(s)
        factor = F.element_at(F.array(*[F.lit(p) for p in STREWN]), ((s + F.col("place")) % len(STREWN) + 1).cast("int"))
        return F.struct((s * shard_blocks).alias("from"), m.alias("m"), (carried(stop(s + 1)) - carried(stop(s))).alias("quota"), (factor % m).alias("factor"), ((s * 104_729 + F.col("place") * 7_919) % m).alias("shift"))

    # block b of a shard is chosen if its seeded place among all m is one of the first `quota`: places don't repeat,
    # since the factor is a prime larger than m
    def words(h: Column) -> Column:
        chosen = lambda b: ((b - h["from"]) * h["factor"] + h["shift"]) % h["m"] < h["quota"]
        own = F.sequence(F.greatest(first, h["from"]), F.least(last, h["from"] + h["m"] - 1))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + F.when(chosen(b), F.least((b + 1) * block, end) - F.greatest(b * block, begin)).otherwise(F.lit(0).cast("long")))

    shards = F.transform(F.sequence(F.floor(first / shard_blocks), F.floor(last / shard_blocks)), shard)
    part = F.when((F.col("size") > 0) & (rest > 0), F.aggregate(shards, F.lit(0).cast("long"), lambda a, h: a + words(h))).otherwise(F.lit(0).cast("long"))
    return joined.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (passes * F.col("size") + part).cast("long").alias("taken"))
