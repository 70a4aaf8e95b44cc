"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_rows, running_total
from ..session import cut

WORD = r"[^\x20\x09-\x0D]+"
# Primes for the seeded walk through a source's blocks; none divides a number of blocks below it.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579)


def words(text: str = "text") -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _sum(df: DataFrame, column: str) -> Column:
    return F.coalesce(df.agg(F.sum(column)).scalar(), F.lit(0))


def targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Per source: rank, source_size and its target, by weights in turn over the sources in order.

    The targets share ``share[0] / share[1]`` of all sizes by weight. None is above ``most`` times
    its source's size; the excess goes to the others by weight until none is above. Sources come
    by code point, null last. In order of size per weight, those up to some place are full, which
    is where filling them leaves the rest a level below their own caps.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    order = [F.col("cap") / F.col("weight"), F.col("rank")]
    upto = running_total(running_total(ranked, order, "cap", "caps"), order, "weight", "weights")
    upto = cut(upto, "mix-caps")
    total = _sum(upto, "source_size") * share[0] / share[1]
    left, heavy = total - (F.col("caps") - F.col("cap")), _sum(upto, "weight") - (F.col("weights") - F.col("weight"))
    # Full when, with all before it full, its share of the rest is its cap or more.
    full = F.col("weight") * left >= F.col("cap") * heavy
    upto = cut(upto.withColumn("full", full), "mix-full")
    done = upto.where("full")
    level = (total - _sum(done, "cap")) / F.greatest(_sum(upto, "weight") - _sum(done, "weight"), F.lit(1))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return cut(upto.select("source", "rank", "source_size", target.alias("target")), "mix-targets")


def shard_quotas(goals: DataFrame, block: int, per_shard: int, most: int = 2) -> DataFrame:
    """Blocks of each source in each shard: shard, rank, quota.

    All quotients target / (2k - 1) are ranked once, the highest first, ties to the lower source;
    shard s takes the places from s * ``per_shard`` on. The last of all seats may be for less than
    a block, so that a table of few words is mixed too. As more seats never take a seat away from
    a source, any run of shards has the mix that apportioning its seats at once would give. No
    source gets more blocks than ``most`` times its size holds. A source's seats differ from its
    rounded share by half the number of sources at most, so quotients beyond that aren't made.
    """
    seats = F.ceil(_sum(goals, "target") / block)
    n = goals.agg(F.count(F.lit(1))).scalar()
    far = F.ceil(F.col("target") / block + n / 2 + 1)
    most_k = F.least(far, F.ceil(F.col("source_size") * most / block)).cast("long")
    quotients = (
        goals.where("target > 0")
        .withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), most_k)))
        .select("rank", (F.col("target") / (2 * F.col("k") - 1)).alias("quotient"))
    )
    placed = number_rows(quotients, [F.col("quotient").desc(), F.col("rank")], "seat")
    won = placed.where(F.col("seat") < seats)
    shard = F.floor(F.col("seat") / per_shard).alias("shard")
    return won.groupBy(shard, "rank").agg(F.count(F.lit(1)).alias("quota"))


def mix(docs: DataFrame, block: int = 64, per_shard: int = 4096, seed: str = "mix", **how) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Every source is one stream of words, its documents in an order drawn by ``seed``, cut into
    blocks of ``block`` words. Its quota, added over the shards, goes once round all its blocks
    for every full turn; the rest falls on the blocks that a seeded walk reaches first. A document
    takes part in each block by the words that it has there, so none is taken over twice its size
    (the quota stops at twice the source's size) and hot sources cost no more than others.

    A null or blank text has no words and takes none. A null source is a source, the last. Rows
    with a repeated or null id are documents of their own. An empty table gives no rows. Other
    columns are not looked at. Returns doc_id, size, source_size, target, taken, row.
    """
    placed, taken = _placed(docs.withColumn("row", F.monotonically_increasing_id()), block, per_shard, seed, **how)
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "row")


def _first(block: Column, of: str = "") -> Column:
    """Does a source's rest, the part of a turn left beside the full ones, fall on this block?"""
    step, rank, blocks, rest = (F.col(of + c) for c in ("step", "rank", "blocks", "rest"))
    return (block * step + rank) % blocks < rest


def _placed(docs: DataFrame, block: int = 64, per_shard: int = 4096, seed: str = "mix", **how) -> tuple[DataFrame, Column]:
    """Each ``row`` of ``docs`` with its place among its source's words and how often those are
    taken, and the column of its words taken."""
    sized = cut(docs.select("doc_id", "source", words().alias("size"), "row"), "mix-sized")
    goals = targets(sized, **how)
    quotas = cut(shard_quotas(goals, block, per_shard), "mix-quotas")
    total = quotas.groupBy(F.col("rank").alias("_rank")).agg(F.sum("quota").alias("quota"))
    goals = goals.join(total, F.col("rank") == F.col("_rank"), "left").drop("_rank")
    goals = cut(goals.fillna(0, ["quota"]), "mix-goals")
    far = goals.select(F.col("source").alias("_source"), "rank", "source_size", "target", "quota")
    met = sized.join(far, F.col("source").eqNullSafe(F.col("_source")))
    drawn = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("rank"), F.col("drawn"), F.col("doc_id"), F.col("row")]
    placed = running_total(met.drop("_source", "source").withColumn("drawn", drawn), order, "size", "upto")
    before = running_total(goals.select("rank", "source_size"), [F.col("rank")], "source_size", "ends")
    before = before.select("rank", (F.col("ends") - F.col("source_size")).alias("begins"))
    placed = placed.join(before.withColumnRenamed("rank", "_rank"), F.col("rank") == F.col("_rank"))
    end = F.col("upto") - F.col("begins")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    placed = placed.withColumns({"end": end, "start": end - F.col("size"), "blocks": blocks})
    placed = placed.withColumns(
        {
            "turns": F.floor(F.col("quota") / F.col("blocks")),
            "rest": F.col("quota") % F.col("blocks"),
            "step": F.element_at(F.array(*map(F.lit, STEPS)), (F.col("rank") % len(STEPS) + 1).cast("int")) % F.col("blocks"),
        }
    )

    def part(b: Column) -> Column:
        inside = F.least(F.col("end"), (b + 1) * block) - F.greatest(F.col("start"), b * block)
        return inside * (F.col("turns") + F.when(_first(b), 1).otherwise(0))

    span = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    taken = F.aggregate(F.transform(span, part), F.lit(0).cast("long"), lambda a, x: a + x)
    taken = F.when(F.col("size") > 0, taken).otherwise(0).cast("long")
    return placed, taken


def mixed(docs: DataFrame, block: int = 64, **how) -> DataFrame:
    """The words that ``mix`` takes, one row for each document that it takes any of.

    ``text`` is the whole text once for every full turn, then the words of the blocks that the
    rest falls on, with the white space behind each; a line feed is between two of these. So the
    words of a source are as many as ``taken`` says. Other columns are as they came.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    rows = cut(docs.select(record, F.monotonically_increasing_id().alias("row")), "mix-rows")
    placed, taken = _placed(rows.select("record.doc_id", "record.source", "record.text", "row"), block, **how)
    part = taken - F.col("size") * F.col("turns")
    chosen = placed.select(
        F.col("row").alias("_row"),
        F.struct("start", "size", "rank", "blocks", "turns", "rest", "step", part.alias("part")).alias("_mix"),
    )
    chosen = cut(chosen.where((F.col("_mix.size") > 0) & (F.col("_mix.turns") + F.col("_mix.part") > 0)), "mix-chosen")
    met = rows.join(chosen, F.col("row") == F.col("_row"))
    return met.select(*[_taken_text(block).alias("text") if c == "text" else F.col(f"record.`{c}`") for c in docs.columns])


def _taken_text(block: int) -> Column:
    """The text by full turns and chosen blocks; ``_mix`` says which."""
    text = F.col("record.text")
    start, size, turns, part = (F.col(f"_mix.{c}") for c in ("start", "size", "turns", "part"))
    pieces = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    inside = F.filter(pieces, lambda _, i: _first(F.floor((start + i) / block), "_mix."))
    rest = F.when(part == 0, F.array().cast("array<string>")).when(part == size, F.array(text))
    rest = rest.otherwise(F.array(F.array_join(inside, "")))
    return F.array_join(F.concat(F.array_repeat(text, turns.cast("int")), rest), "\n")


# The same in DuckDB's SQL.
SQL = r"""WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size FROM documents),
ranked AS (
  SELECT source, sum(size) AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS weight, source_size * 2 AS cap FROM ranked),
upto AS (
  SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS weights,
    sum(source_size) OVER () * 3 / 2.0 AS total, sum(weight) OVER () AS heavy
  FROM weighed WINDOW o AS (ORDER BY cap / weight, rank)),
filled AS (
  SELECT *, weight * (total - (caps - cap)) >= cap * (heavy - (weights - weight)) AS is_full FROM upto),
level AS (
  SELECT (any_value(total) - coalesce(sum(cap) FILTER (WHERE is_full), 0))
    / greatest(any_value(heavy) - coalesce(sum(weight) FILTER (WHERE is_full), 0), 1) AS v FROM filled),
goals AS (
  SELECT source, rank, CAST(source_size AS BIGINT) AS source_size,
    CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (SELECT v FROM level) AS DOUBLE) END AS target
  FROM filled),
quotients AS (
  SELECT rank, target / (2 * k - 1) AS quotient FROM (
    SELECT rank, target, unnest(range(1, 1 + CAST(ceil(source_size * 2 / 64.0) AS BIGINT))) AS k
    FROM goals WHERE target > 0)),
quotas AS (
  SELECT rank, count(*) AS quota FROM (
    SELECT rank, row_number() OVER (ORDER BY quotient DESC, rank) - 1 AS seat FROM quotients)
  WHERE seat < (SELECT ceil(sum(target) / 64) FROM goals) GROUP BY rank),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.rank, coalesce(q.quota, 0) AS quota,
    CAST(ceil(g.source_size / 64.0) AS BIGINT) AS blocks,
    CAST(sum(s.size) OVER (PARTITION BY g.rank ORDER BY md5('mix' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ends
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN quotas q ON q.rank = g.rank)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE CAST(list_sum(list_transform(
    range((ends - size) // 64, (ends - 1) // 64 + 1), lambda b:
    (least(ends, (b + 1) * 64) - greatest(ends - size, b * 64)) * (quota // blocks
      + CASE WHEN (b * ([2147483647, 2147483629, 2147483587, 2147483579][rank % 4 + 1] % blocks) + rank) % blocks
        < quota % blocks THEN 1 ELSE 0 END))) AS BIGINT) END AS taken
FROM placed"""
