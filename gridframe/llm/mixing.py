"""Mixing sources to target weights as a Pfair schedule, with DataFrame functions only.

A source's rows are shuffled by a keyed hash and cut into blocks of ``block_rows``.  Weights are whole numbers w of
the sum D of the sources that still have blocks.  Block j (from 0) of a source may run from slot floor(j * D / w), its
release, and must run before slot ceil((j + 1) * D / w), its deadline; of the released blocks, the one with the
earliest deadline takes the slot (of equal ones, the source that comes first by name).  So after each slot each source
is less than one block off its share.

The schedule repeats every D slots: it is computed once for a period and block j of a source then finds its slot by its
period and its place in it.  When a source has no block left, the others go on with their weights as shares of a
smaller D: a new phase, with its own period, in which the same holds.  Slots that an ended source leaves free in its
last period stay empty, so ``slot`` is the schedule's time and not a rank.  No row is dropped or repeated.

Weights are divided by their common divisor; a period may have any number of slots.  It is folded in runs of
``FOLD_SLOTS``; a longer one takes a job for each run, and what goes from one to the next is how many blocks each
source has had.  A plan of up to ``MOST_BROADCAST`` rows is broadcast (its size is known from the weights), a longer
one is joined by shuffle.

Rows are numbered within their source by ranges of the hash, with the ranges' counts summed up, so a source of any
size is spread over many tasks.

Inputs: a null source counts as the source ""; sources without a weight are pooled as one, with ``rest_weight``; rows
that repeat are rows of their own; rows with the same hash stand in the order of their id and of the carried columns'
hash; ids and texts may be null, and texts of any length are only hashed; an empty table gives no rows; columns with
the names of the results are carried inside ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm import common

#: Rows of a hash range that one window sorts.
RANGE_ROWS = 8192

#: Slots that one job folds, and that one array grows to while it does.
FOLD_SLOTS, RUN_SLOTS = 1 << 18, 1 << 9

#: Rows of the plan that are sent to all executors at most: phases times slots of a period.
MOST_BROADCAST = 1_000_000

REST = "(rest)"


def _with_source(docs: DataFrame, weights: dict[str, int], seed: int, carry: list[str]) -> DataFrame:
    """``row`` (the columns to carry), the mix source and the shuffle key of each row, and what orders equal keys."""
    known = F.coalesce(F.col("source").cast("string"), F.lit(""))
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("row"),
        F.when(known.isin(*weights), known).otherwise(F.lit(REST)).alias("mix_source") if weights else F.lit(REST).alias("mix_source"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("shuffle"),
        F.struct(F.col("doc_id").cast("string").alias("id"), F.xxhash64(F.lit(~seed), *[F.col(c) for c in common.hashable(docs, carry)]).alias("rest")).alias("tie"),
    )


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``nth``, from 0, within their source; and the sources with their numbers of rows.

    A source's leading hash bits make ranges of about RANGE_ROWS rows; a range is numbered by one window.
    """
    sizes = rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("source_rows"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("source_rows") / F.lit(float(RANGE_ROWS))))).cast("int")
    # At most one row for each weight and one for the rest.
    ranged = rows.join(F.broadcast(sizes.withColumn("bits", bits)), "mix_source").withColumn("part", F.expr("if(bits = 0, 0L, shiftrightunsigned(shuffle, 64 - greatest(1, bits)))"))
    counts = ranged.groupBy("mix_source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("mix_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("mix_source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("mix_source", "part").orderBy("shuffle", "tie")
    placed = ranged.withColumn("rank", F.row_number().over(order)).join(starts, ["mix_source", "part"])
    return placed.withColumn("nth", F.col("start") + F.col("rank") - 1).select("row", "mix_source", "nth"), sizes


def weight_of(weights: dict[str, int], rest_weight: int) -> Column:
    out = F.lit(rest_weight)
    for name, w in weights.items():
        out = F.when(F.col("mix_source") == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def phases_of(sizes: DataFrame, weights: dict[str, int], rest_weight: int, block_rows: int) -> DataFrame:
    """since, until (periods), base (its first slot), slots (of a period) and live sources (name, w) of each phase."""
    sources = sizes.select("mix_source", weight_of(weights, rest_weight).alias("w"), F.ceil(F.col("source_rows") / block_rows).alias("blocks"))
    sources = sources.withColumn("periods", F.ceil(F.col("blocks") / F.col("w")).cast("long"))
    # At most one struct for each weight.
    one = sources.agg(F.sort_array(F.collect_list(F.struct("mix_source", "w", "periods"))).alias("all"))
    ends = F.sort_array(F.array_distinct(F.col("all.periods")))
    phases = one.select("all", F.posexplode(ends).alias("phase", "until")).withColumn("since", F.coalesce(F.get(ends, F.col("phase") - 1), F.lit(0).cast("long")))
    phases = phases.withColumn("live", F.filter("all", lambda m: m["periods"] >= F.col("until")))
    phases = phases.withColumn("slots", F.aggregate("live", F.lit(0).cast("long"), lambda a, m: a + m["w"]))
    base = Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    return phases.withColumn("base", F.coalesce(F.sum((F.col("until") - F.col("since")) * F.col("slots")).over(base), F.lit(0))).select("since", "until", "base", "slots", "live")


def _next_source(done: Column, t: Column) -> Column:
    """Of the sources whose next block is released, the one with the earliest deadline."""
    windows = F.transform(
        F.col("live"),
        lambda m, i: F.struct(
            F.ceil((F.get(done, i) + 1) * F.col("slots") / m["w"]).alias("deadline"),
            i.alias("who"),
            F.floor(F.get(done, i) * F.col("slots") / m["w"]).alias("release"),
        ),
    )
    return F.array_min(F.filter(windows, lambda x: x["release"] <= t))["who"]


ORDER = "array<struct<who:int,block:long>>"


def folded(phases: DataFrame, begin: int, end: int) -> DataFrame:
    """``phases`` (with ``done``, the blocks that each source has had) after the slots [begin, end) of a period, and
    ``order``, who has which of them with which block.  Runs of RUN_SLOTS are folded on their own, so that no long
    array is copied for each slot.
    """
    stop = F.least(F.col("slots"), F.lit(end))

    def slot(state: Column, t: Column) -> Column:
        return common.let(
            _next_source(state["done"], t),
            lambda c: F.struct(
                F.transform(state["done"], lambda d, i: F.when(i == c, d + 1).otherwise(d)).alias("done"),
                F.concat(state["order"], F.array(F.struct(c.cast("int").alias("who"), F.get(state["done"], c).alias("block")))).alias("order"),
            ),
        )

    def run(state: Column, first: Column) -> Column:
        slots = F.sequence(first, F.least(first + RUN_SLOTS, stop) - 1)
        start = F.struct(state["done"].alias("done"), F.array().cast(ORDER).alias("order"))
        return common.let(F.aggregate(slots, start, slot), lambda r: F.struct(r["done"].alias("done"), F.concat(state["runs"], F.array(r["order"])).alias("runs")))

    firsts = F.when(stop > begin, F.sequence(F.lit(begin).cast("long"), stop - 1, F.lit(RUN_SLOTS).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.col("done").alias("done"), F.array().cast(f"array<{ORDER}>").alias("runs"))
    out = phases.withColumn("folded", F.aggregate(firsts, start, run))
    return out.select("since", "until", "base", "slots", "live", F.col("folded.done").alias("done"), F.flatten("folded.runs").alias("order"))


def schedule(phases: DataFrame, most_slots: int) -> DataFrame:
    """Per phase, slot and its block of a period: the slot in the period, the block's place, and the phase's bounds."""
    now = phases.withColumn("done", F.transform("live", lambda m: F.lit(0).cast("long")))
    parts = None
    for begin in range(0, most_slots, FOLD_SLOTS):
        now = folded(now, begin, begin + FOLD_SLOTS)
        if most_slots > FOLD_SLOTS:
            now = common.written(now, "schedule")
        part = now.select("since", "until", "base", "slots", "live", F.posexplode("order").alias("at", "run")).select(
            "since", "until", "base", "slots", (F.col("at") + F.lit(begin).cast("long")).alias("at"), F.col("run.block").alias("within"),
            F.get("live", F.col("run.who"))["mix_source"].alias("mix_source"), F.get("live", F.col("run.who"))["w"].alias("w"),
        )
        parts = part if parts is None else parts.unionByName(part)
        now = now.drop("order")
    return parts


def placed(docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, block_rows: int = 16, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns to carry, all by default), its mix source, block, slot, release, deadline (in slots) and
    place within the block.
    """
    if any(w < 1 for w in [*weights.values(), rest_weight]) or REST in weights:
        raise ValueError("weights are whole numbers from 1 on")
    common_divisor = math.gcd(rest_weight, *weights.values())
    rest_weight, weights = rest_weight // common_divisor, {name: w // common_divisor for name, w in weights.items()}
    total = sum(weights.values()) + rest_weight
    rows, sizes = numbered(_with_source(docs, weights, seed, docs.columns if carry is None else carry))
    plan = schedule(phases_of(sizes, weights, rest_weight, block_rows), total)
    if (len(weights) + 1) * total <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    rows = rows.withColumn("block", F.floor(F.col("nth") / block_rows)).withColumn("in_block", (F.col("nth") % block_rows).cast("int"))
    w = weight_of(weights, rest_weight)
    rows = rows.withColumn("period", F.floor(F.col("block") / w)).withColumn("within", F.col("block") - F.col("period") * w)
    out = rows.join(plan, ["mix_source", "within"]).where((F.col("period") >= F.col("since")) & (F.col("period") < F.col("until")))
    begin = F.col("base") + (F.col("period") - F.col("since")) * F.col("slots")
    return out.select(
        "row",
        "mix_source",
        "block",
        "in_block",
        (begin + F.col("at")).alias("slot"),
        (begin + F.floor(F.col("within") * F.col("slots") / F.col("w"))).alias("release"),
        (begin + F.ceil((F.col("within") + 1) * F.col("slots") / F.col("w"))).alias("deadline"),
    )


def mixed(docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, block_rows: int = 16, seed: int = 42) -> DataFrame:
    """``docs`` in the order of the schedule, dealt over partitions by ranges of slots."""
    out = placed(docs, weights, rest_weight, block_rows, seed)
    return out.repartitionByRange("slot", "in_block").sortWithinPartitions("slot", "in_block").select("row.*")
