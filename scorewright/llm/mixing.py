"""Operator 11: mixing sources to target weights by Sainte-Lague apportionment.

The mix is as long as the corpus and made of seats of ``block`` words.  Sources
share it by weight, none beyond ``most`` times its own words.  Each seat goes to
the source with the highest quotient target / (2 * seats so far + 1); the first
seats make the first shard, the next ones the second, so every shard has whole
quotas and every run of shards is an apportionment of its own.

The words of a source stand in a seeded order of its documents and are cut into
blocks of ``block`` words.  A source fills its seats lap by lap over its blocks
in a seeded order: whole laps take every word equally often, and the last lap
takes the blocks that come first.

Only sizes, 16-byte keys and block numbers are shuffled, never texts.  The
driver gets totals (words, weights, seats of a shard), not sources.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .ordinal import with_position
from .running import with_running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, BLOCK, SHARDS, SEED = (1, 2, 3), 3, 64, 8, 11
#: Width of the margin by which seats are looked at on both sides of a level.
MARGIN = 1e-9


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written once in the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _big(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def document_sizes(docs: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, key): words of each whole text and the seeded key
    of its place in its source.  Rows that agree in the key are alike."""
    t = F.coalesce(docs[text], F.lit(""))
    own = docs[doc_id].cast("long")
    key = F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit("")), F.lit(":"), F.md5(t))))
    return docs.select(own.alias("doc_id"), docs[source].cast("string").alias("source"),
                       F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """(one row per source: source, rank, source_size, weight, target,
    words_before) and the corpus' words.

    Sources in code-point order, null last, weigh ``weights``, repeating.  With
    the sources in the order of size over weight, those whose cap lies below
    their share are a prefix; the others share the rest by weight."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_running(totals, [F.col("source").asc_nulls_last()], ["source_size"], "op11-sources")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("at") % len(weights)).cast("int")).cast("long")
    ranked = ranked.select("source", F.col("at").alias("rank"), "source_size", F.col("source_size_before").alias("words_before"), weight.alias("weight"))
    common = lcm(*weights)
    ranked = ranked.withColumn("cap", F.lit(most).cast("long") * F.col("source_size")).withColumn("ratio", _big("cap") * F.expr(f"cast({common} div weight as decimal(10,0))"))
    filled = with_running(ranked, ["ratio", "rank"], ["cap", "weight"], "op11-fill")
    total, weigh = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weigh = total or 0, weigh or 0
    rest, left = F.lit(total) - F.col("cap_before"), F.lit(weigh) - F.col("weight_before")
    open_ = filled.withColumns({"rest": rest, "left": left}).filter(_big("rest") * _big("weight") <= _big("cap") * _big("left"))
    at, rest, left = open_.agg(F.min_by(F.struct("at", "rest", "left"), "at").alias("x")).select("x.*").first()
    share = F.lit(float(rest or 0)) * F.col("weight").cast("double") / F.lit(float(left or 1))
    target = F.when(F.col("at") < F.lit(at or 0), F.col("cap").cast("double")).otherwise(share)
    return _kept(filled.select("source", "rank", "source_size", "weight", "cap", target.alias("target"), "words_before"), "op11-targets"), total


def apportion(targets: DataFrame, houses: list[int], total: int, block: int = BLOCK) -> DataFrame:
    """Adds ``seats``: for each number of seats in ``houses``, how many of them
    the source gets by highest quotients (ties: the lower rank), at most the
    blocks that its cap holds.

    With n sources, the seats above the level total / (houses - n) are sure to
    be in, and those below total / (houses + n) out unless a cap holds a source
    back (then the level is halved until the seats suffice); the few seats
    between are put in order."""
    n, room = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(f"cap div {block}")), F.lit(0))).first()
    cap = F.expr(f"cap div {block}")

    def above(level):  # seats of a source with a quotient of at least level / 2
        return F.least(cap, F.floor(F.col("target") / F.lit(level) + F.lit(0.5))) if level else F.lit(0).cast("long")

    sure = [total / (h - n) * (1 + MARGIN) if h > n else None for h in houses]
    last = [max(total, 1) / max(h + n, 1) for h in houses]
    while n:
        sums = targets.agg(*[F.sum(above(x)).alias(f"s{i}") for i, x in enumerate(last)]).first()
        short = [s < min(h, room) for s, h in zip(sums, houses, strict=True)]
        if not any(short):
            break
        last = [x / 2 if few else x for x, few in zip(last, short, strict=True)]
    base = [f"b{i}" for i in range(len(houses))]
    targets = targets.withColumns({b: above(x) for b, x in zip(base, sure, strict=True)})
    house = F.array(*[F.struct(F.lit(i).alias("house"), F.col(b).alias("from"), above(x * (1 - MARGIN)).alias("to"))
                      for i, (b, x) in enumerate(zip(base, last, strict=True))])
    seats = targets.select("rank", "target", F.inline(house)).filter("from < to")
    seats = seats.select("rank", "house", "target", F.explode(F.expr("sequence(from, to - 1)")).alias("k"))
    seats = seats.select("rank", "house", (F.col("target") / (2 * F.col("k") + 1)).alias("quotient"))
    put = with_position(seats, ["house", F.col("quotient").desc(), "rank"], "place", "op11-seats")
    taken = targets.agg(*[F.coalesce(F.sum(b), F.lit(0)) for b in base]).first()
    free = F.get(F.array(*[F.lit(h - t).cast("long") for h, t in zip(houses, taken, strict=True)]), F.col("house"))
    first = put.groupBy("house").agg(F.min("place").alias("first"))  # one row per shard
    won = put.join(F.broadcast(first), "house").filter(F.col("place") - F.col("first") < free)
    won = won.groupBy("rank").agg(*[F.count_if(F.col("house") == i).alias(f"w{i}") for i in range(len(houses))])
    seats = F.array(*[F.col(b) + F.coalesce(F.col(f"w{i}"), F.lit(0)) for i, b in enumerate(base)])
    return targets.join(won, "rank", "left").select("source", "rank", "source_size", "target", "words_before", seats.alias("seats"))


def mix_plan(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """One row per source: rank, source_size, target, ``seats`` (blocks of the
    shards so far, shard by shard), ``quota`` (its last), the words and blocks
    before it.  The mix has total / block seats, rounded."""
    targets, total = source_targets(sizes, weights, most)
    count = (total + block // 2) // block
    plan = apportion(targets, [count * (i + 1) // shards for i in range(shards)], total, block)
    plan = plan.withColumns({"quota": F.element_at("seats", -1), "blocks": F.expr(f"(source_size + {block - 1}) div {block}")})
    numbered = with_running(plan, ["rank"], ["blocks"], "op11-plan")
    return _kept(numbered.drop("at"), "op11-quotas")


def _placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with its source's plan and ``start``, its first word in the source."""
    put = with_running(sizes, [F.col("source").asc_nulls_last(), "key"], ["size"], "op11-rows")
    put = put.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return put.withColumn("start", F.col("size_before") - F.col("words_before")).drop("_source", "size_before", "words_before")


def pieces(placed: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """What the mix takes: (at, doc_id, source, shard, lap, place, first_word,
    n_words), where ``place`` is the first word's place among the source's words
    in the mix.  ``at`` is the row; a row without words has no piece."""
    part = placed.filter("size > 0 and quota > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block).cast("long"))
    part = part.select("at", "doc_id", "source", "rank", "block", "start", "source_size", "quota", "seats", low.alias("low"), high.alias("high"))
    # every block has its first word in one row; a source's short block comes last in its laps
    key = F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.col("rank").cast("string"), F.lit(":"), F.col("block").cast("string"))))
    whole = (F.col("block") + 1) * block <= F.col("source_size")
    heads = placed.filter("size > 0 and quota > 0").select("rank", "source_size", "blocks_before", F.explode(F.expr(
        f"filter(sequence(start div {block}, (start + size - 1) div {block}), b -> b * {block} >= start)")).alias("block"))
    order = with_position(heads.select("rank", "block", "blocks_before", (~whole).alias("short"), key.alias("key")), ["rank", "short", "key", "block"], "place", "op11-blocks")
    # only the blocks of sources with seats are numbered, so places are taken from the source's first one
    first = order.groupBy("rank").agg(F.min("place").alias("first"))
    order = order.join(first, "rank").select("rank", "block", (F.col("place") - F.col("first")).alias("turn"))
    part = part.join(order, ["rank", "block"])
    words = F.col("quota") * block
    part = part.withColumn("lap", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((words - 1) / F.col("source_size")))))
    ahead = F.col("lap") * F.col("source_size") + F.col("turn") * block
    part = part.withColumns({"from": ahead + F.col("low"), "to": F.least(ahead + F.col("high"), words)}).filter(F.col("from") < F.col("to"))

    def shard(word):
        return F.size(F.filter("seats", lambda s: s * block <= word))

    part = part.withColumn("shard", F.explode(F.sequence(shard(F.col("from")), shard(F.col("to") - 1))))
    begin = F.greatest(F.col("from"), F.coalesce(F.get("seats", F.col("shard") - 1), F.lit(0)) * block)
    end = F.least(F.col("to"), F.get("seats", F.col("shard")) * block)
    word = F.col("block") * block - F.col("start") + F.col("low") + begin - F.col("from")
    return part.select("at", "doc_id", "source", "shard", "lap", begin.alias("place"), word.alias("first_word"), (end - begin).alias("n_words")).filter("n_words > 0")


def mix_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED,
                  doc_id: str = "doc_id", text: str = "text", source: str = "source", with_pieces: bool = False):
    """One row per input row: doc_id, size, source_size, target, taken, quota
    (seats of its source); with ``with_pieces`` also the frame of ``pieces``.

    A null text has no words, as an empty one: size and taken are 0.  A null
    source is a source of its own, the last.  Repeated rows (and a null or
    repeated doc_id) each have their own place, size and words; rows alike in
    doc_id and text are told apart by their place alone.  A very long text lies
    in many blocks and may be taken in part.  An empty table gives no rows, a
    table without words takes none.  Other columns are not read.  The words
    taken from a source are its quota times ``block``: they miss its target by
    about half a block, and by less than a block more where the cap (``most``
    times its words) holds no further block.  No row is taken more than ``most``
    times its size.  Order and blocks hang on the seed, ids and texts alone."""
    sizes = _kept(document_sizes(docs, seed, doc_id, text, source), "op11-sizes")
    placed = _kept(_placed(sizes, mix_plan(sizes, weights, most, block, shards)), "op11-placed")
    found = pieces(placed, block, seed)
    taken = found.groupBy("at").agg(F.sum("n_words").alias("taken"))
    out = placed.join(taken, "at", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "quota")
    return (out, found) if with_pieces else out


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
                  md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) k FROM documents),
s AS (SELECT *, r % 3 + 1 w FROM (SELECT source, sum(size)::BIGINT sz, row_number() OVER (ORDER BY source NULLS LAST) - 1 r FROM d GROUP BY source)),
f AS (SELECT *, sum(sz) OVER () - coalesce(sum({MOST} * sz) OVER o, 0) rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) lft, row_number() OVER (ORDER BY sz * (6 // w), r) n
      FROM s WINDOW o AS (ORDER BY sz * (6 // w), r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT n, rest, lft FROM f WHERE rest * w <= {MOST} * sz * lft ORDER BY n LIMIT 1),
t AS (SELECT f.source, f.sz, r, CASE WHEN f.n < j.n THEN ({MOST} * sz)::DOUBLE ELSE j.rest::DOUBLE * w::DOUBLE / j.lft::DOUBLE END target FROM f, j),
seat AS (SELECT r, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, r) place
         FROM (SELECT r, target, unnest(range(0, {MOST} * sz // {BLOCK})) i FROM t)),
q AS (SELECT t.*, (SELECT count(*) FROM seat WHERE seat.r = t.r AND place <= (SELECT (sum(sz) + {BLOCK // 2}) // {BLOCK} FROM t)) quota FROM t),
p AS (SELECT doc_id, size, q.sz, target, quota, r, row_number() OVER (ORDER BY r, k) me, sum(size) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT - size st
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT r, i, row_number() OVER (PARTITION BY r ORDER BY (i + 1) * {BLOCK} > sz, md5(concat('{SEED}:', r, ':', i)), i) - 1 turn
      FROM (SELECT r, sz, unnest(range(0, (sz + {BLOCK - 1}) // {BLOCK})) i FROM q)),
e AS (SELECT *, unnest(range(st // {BLOCK}, (st + size - 1) // {BLOCK} + 1)) i FROM p WHERE size > 0),
g AS (SELECT me, greatest(st - e.i * {BLOCK}, 0) lo, least(st + size - e.i * {BLOCK}, {BLOCK}) hi, quota * {BLOCK} // sz laps, quota * {BLOCK} % sz - turn * {BLOCK} upto
      FROM e JOIN b ON e.r = b.r AND e.i = b.i),
x AS (SELECT me, sum(laps * (hi - lo) + greatest(least(hi, upto) - lo, 0)) taken FROM g GROUP BY me)
SELECT doc_id, size, sz source_size, target, coalesce(taken, 0)::BIGINT taken, quota::BIGINT quota FROM p LEFT JOIN x ON p.me = x.me
"""
