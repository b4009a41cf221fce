"""Mixing sources to target weights along a time-varying curriculum.

Targets: each source gets its share of all words by its weight; a source that
would be taken more than ``most`` times stops there, and its excess is shared
out again by weight until none is above. A source's documents are put into a
fixed random order (by a digest), and the words before each are summed. From
these a document's ``taken`` follows: whole passes over the source, and in the
last, partial pass the documents in order until the target is met, the last of
them in part.

Curriculum: each source's weight schedule over training time [0, 1] is
integrated; a document whose words begin at share u of its source's taken
words stands at the time by which that share of the source's demand is due
(the inverse of the integral). Documents are range-sorted by this position.

A source may hold any share of the rows: sums run over hashed blocks of a
source first, then over the blocks' totals, then within blocks.

Defined cases: a null or blank text has size 0, is never taken and stands at
its place; a null source is a source of its own, after all others; ties and
repeated rows are equal in the order and interchangeable; if no source has a
word all targets are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbase.llm.common import staged, words

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
#: Rows of a source that a block of its order holds, about.
BLOCK_ROWS = 4096

#: Sources up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Schedule:
    """A source's weight over time, linear from ``first`` to ``last`` (not negative, not both 0)."""

    first: float = 1.0
    last: float = 1.0

    def time(self, share: Column) -> Column:
        """The time by which ``share`` of the whole demand is due: the inverse of its integral.

        Demand until t: first*t + (last - first)*t*t/2; the whole: (first + last)/2.
        """
        a, b = float(self.first), float(self.last)
        if a == b:
            return share
        return (F.sqrt(F.lit(a * a) + (b * b - a * a) * share) - a) / (b - a)

    def sql(self, share: str) -> str:
        a, b = float(self.first), float(self.last)
        return share if a == b else f"(sqrt({a * a}::DOUBLE + ({b * b - a * a})::DOUBLE * {share}) - {a}::DOUBLE) / ({b - a})::DOUBLE"


#: The weight of each third source falls, stays or rises over training, by its rank.
SCHEDULES = (Schedule(2.0, 1.0), Schedule(1.0, 1.0), Schedule(1.0, 2.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, source_size).

    Only two numbers a round come to the driver; there are fewer rounds than sources.
    """
    # Each source is one row here; ranks need them in one order.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    ranked = staged(ranked.withColumn("most", most * F.col("source_size")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words a unit of weight; a source at or under its bound there is capped
    while True:
        capped = F.lit(False) if level is None else F.col("most") < F.col("weight") * level
        row = ranked.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight")))).first()
        fixed, weight = row[0] or 0, row[1] or 0
        new = (total - fixed) / weight if weight else level or 0.0
        if new == level or not weight:
            break
        level = new
    level = float(level or 0.0)
    return ranked.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))).drop("most")


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, schedules: tuple[Schedule, ...] = SCHEDULES) -> DataFrame:
    """A row for every document, sorted by ``position`` over all partitions.

    (id_col, size, source, source_size, target, taken, position, positions,
    text_hash): ``positions`` holds the training time of each taking,
    ``position`` the first (null if there is none).
    """
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    sized = df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), digest.alias("at"), F.xxhash64(text).alias("text_hash"))
    sized = staged(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(sources, weights, most).select(F.col("source").alias("of"), "source_size", "rows", "rank", "target")

    # Blocks: the leading 32 bits of the digest, cut into as many ranges as the source's rows ask for.
    lead = F.conv(F.substring("at", 1, 8), 16, 10).cast("long")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    small = targets.count() <= BROADCAST_ROWS
    joined = sized.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumn("block", F.floor(lead * blocks / (1 << 32)))
    totals = joined.groupBy("rank", "block").agg(F.sum("size").alias("words"))
    # A source's blocks in one window: one row for 4096 of its documents.
    before = totals.select(F.col("rank"), F.col("block"), (F.sum("words").over(Window.partitionBy("rank").orderBy("block")) - F.col("words")).alias("block_before"))
    inner = Window.partitionBy("rank", "block").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.join(before, ["rank", "block"]).withColumn("before", F.col("block_before") + F.sum("size").over(inner) - F.col("size"))

    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    extra = goal - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), extra - F.col("before")))
    placed = placed.withColumn("taken", (passes * F.col("size") + part).cast("long"))
    # A document's k-th taking begins where k passes and the words before it have been taken.
    takes = F.when(F.col("taken") > 0, F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    shares = F.transform(takes, lambda k: (k * F.col("source_size") + F.col("before")) / F.round("target"))
    times = F.array().cast("array<double>")
    for k, schedule in enumerate(schedules):
        times = F.when(F.pmod("rank", F.lit(len(schedules))) == k, F.transform(shares, schedule.time)).otherwise(times)
    placed = placed.withColumn("positions", times).withColumn("position", F.get("positions", F.lit(0)))
    out = placed.select(F.col("id").alias(id_col), "size", F.col("source").alias(source), "source_size", "target", "taken", "position", "positions", "text_hash")
    return out.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, schedules: tuple[Schedule, ...] = SCHEDULES, rounds: int = 20) -> str:
    """DuckDB SQL of the query op5; ``rounds`` of resharing, at least as many as there are sources."""
    cases = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    times = " ".join(f"WHEN {k} THEN {s.sql('share')}" for k, s in enumerate(schedules))
    levels = ["l0 AS (SELECT (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(weight) FROM s) AS level)"]
    for k in range(1, rounds + 1):
        levels.append(f"""l{k} AS (SELECT coalesce(((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(most) FROM s WHERE most < weight * (SELECT level FROM l{k - 1})), 0))::DOUBLE
            / (SELECT sum(weight) FROM s WHERE most >= weight * (SELECT level FROM l{k - 1})), (SELECT level FROM l{k - 1})) AS level)""")
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS at FROM documents),
s AS MATERIALIZED (SELECT source, rank, source_size, {most} * source_size AS most, CASE rank % {len(weights)} {cases} END AS weight
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source)),
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in levels)},
t AS (SELECT source, rank, source_size, least(CAST(most AS DOUBLE), weight * (SELECT level FROM l{rounds})) AS target FROM s),
p AS (SELECT d.doc_id, d.size, t.rank, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE
    (goal // source_size) * size + greatest(0, least(size, goal - (goal // source_size) * source_size - before)) END AS taken FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE rank % {len(schedules)} {times} END END AS position
FROM (SELECT *, before / goal AS share FROM q)"""


def taken_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``df`` with each row as often as the mix takes it, in training order.

    A taking in part counts if it holds at least half the document. Rows equal
    in id and text are each taken as often as the one of them taken longest.
    """
    mixed = mix(df, id_col, text, source).filter("taken > 0")
    counted = mixed.select(F.col(id_col).alias("_of"), F.col("text_hash").alias("_hash"), F.slice("positions", 1, F.round(F.col("taken") / F.col("size")).cast("int")).alias("at"))
    once = counted.groupBy("_of", "_hash").agg(F.max("at").alias("_at")).filter(F.size("_at") > 0)
    # The row travels whole, so that no column of the caller's can clash.
    keyed = df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"))
    joined = keyed.join(once, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_hash")))
    # Written between the two shuffles of the rows, so that the disk holds one of them at a time.
    each = staged(joined.select("_row", "_id", "_at"), "taken").select("_row", "_id", F.explode("_at").alias("_position"))
    return each.repartitionByRange("_position", "_id").sortWithinPartitions("_position", "_id").select(*(F.col("_row")[c].alias(c) for c in df.columns))
