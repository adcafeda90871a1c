"""One-dimensional geometry: chains, anchored and first-fit folds, interval unions, nearest intervals.

Chains (each value against the one before) are window functions.  Folds (each value against what was kept so far)
are ``aggregate`` over a sorted array, so they stay in the JVM and take one group at a time; groups are pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], apart: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row for which ``apart`` holds starts a new one (chain clustering)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def upper_median(values: Column) -> Column:
    """The value at place floor(n / 2) of the sorted array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def anchored_edges(values: Column, gap: float = 3.0) -> Column:
    """Sorted values of which each lies more than ``gap`` beyond the last that was kept."""
    return F.aggregate(
        F.sort_array(values),
        F.array().cast("array<double>"),
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > gap), F.concat(kept, F.array(x))).otherwise(kept),
    )


def first_fit_keys(values: Column, gap: float = 3.0) -> Column:
    """Keys in order of first use: a value joins the first key within ``gap``, or becomes one."""
    return F.aggregate(
        values,
        F.array().cast("array<double>"),
        lambda keys, x: F.when(F.exists(keys, lambda k: F.abs(k - x) <= gap), keys).otherwise(F.concat(keys, F.array(x))),
    )


def interval_cover(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """The length of the union of each group's intervals."""
    before = Window.partitionBy(*keys).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(high).over(before), F.col(low))
    return df.withColumn("_new", F.greatest(F.lit(0.0), F.col(high) - F.greatest(F.col(low), reach))).groupBy(*keys).agg(F.sum("_new").alias("covered"))


def nearest(df: DataFrame, targets: DataFrame, keys: list[str], distance: Column, order: str, carry: list[str]) -> DataFrame:
    """For each row of ``df`` the target of its group at the least distance, the first in ``order`` on a tie.

    The group's keys are an equi-join, so the plan is never a cartesian product; the choice is an aggregate.
    """
    ids = [c for c in df.columns if c not in keys]
    joined = df.join(targets, keys)
    best = joined.groupBy(*keys, *ids).agg(F.min(F.struct(distance.alias("gap"), F.col(order).alias("ord"), *[F.col(c) for c in carry])).alias("best"))
    return best.select(*keys, *ids, "best.gap", *[F.col(f"best.{c}").alias(c) for c in carry])


def gap_to(x: Column, left: Column, right: Column) -> Column:
    """How far a point lies outside an interval."""
    return F.greatest(F.lit(0.0), left - x, x - right)


def nearest_band(words: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Words to the nearest band of their page, within max(14, 0.55 of the first two bands' spacing, or of 30)."""
    spacing = bands.groupBy(*keys).agg((F.max(F.when(F.col("band_ix") == 1, F.col("centre"))) - F.max(F.when(F.col("band_ix") == 0, F.col("centre")))).alias("spacing"))
    found = nearest(words, bands.withColumnRenamed("centre", "band_centre"), keys, gap_to(F.col("centre"), F.col("left"), F.col("right")), "band_ix", ["band_ix"])
    limit = F.greatest(F.lit(14.0), F.coalesce(F.col("spacing"), F.lit(30.0)) * 0.55)
    return found.join(spacing, keys).where(F.col("gap") <= limit).drop("spacing")


def nearest_centre(words: DataFrame, columns: DataFrame, keys: list[str], reach: float = 40.0) -> DataFrame:
    """Words to the column with the nearest centre, at most ``reach`` away."""
    return nearest(words, columns, keys, F.abs(F.col("col_centre") - F.col("centre")), "col_ix", ["col_ix"]).where(F.col("gap") <= reach)


def mark_columns(marks: DataFrame, keys: list[str], page_width: Column) -> DataFrame:
    """Columns of marks by chaining their centres.  ``marks`` has a ``centre``; four or more are needed.

    The pitch is the upper median of the gaps above 1 (or 20); a gap above max(5, min(0.35 pitch, width / 8)) parts.
    """
    by = Window.partitionBy(*keys).orderBy("centre", "w", "y")
    gaps = marks.withColumn("width", page_width).withColumn("step", F.col("centre") - F.lag("centre").over(by))
    pitch = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("step") > 1, F.col("step"))).alias("gaps"))
    pitch = pitch.where("n >= 4").select(*keys, F.coalesce(upper_median(F.col("gaps")), F.lit(20.0)).alias("pitch"))
    split = F.greatest(F.lit(5.0), F.least(F.col("pitch") * 0.35, F.col("width") / 8))
    runs = islands(gaps.join(pitch, keys), keys, ["centre", "w", "y"], F.col("step") > split)
    return runs.groupBy(*keys, F.col("island").alias("band_ix")).agg(
        F.min("centre").alias("left"), F.max("centre").alias("right"), (F.sum("centre") / F.count(F.lit(1))).alias("centre"), F.count(F.lit(1)).alias("hits")
    )


def mark_stacks(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Stacks of marks, chained on the centre by max(6, 1.5 upper median widths); those of three or more marks stay."""
    near = marks.groupBy(*keys).agg(F.greatest(F.lit(6.0), F.coalesce(upper_median(F.collect_list("w")), F.lit(6.0)) * 1.5).alias("near"))
    by = Window.partitionBy(*keys).orderBy("centre", "x", "y")
    runs = islands(marks.join(near, keys), keys, ["centre", "x", "y"], F.col("centre") - F.lag("centre").over(by) > F.col("near"))
    return runs.groupBy(*keys, F.col("island").alias("stack_ix")).agg(F.min("x").alias("left"), F.max("centre").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 3")


def running_runs(words: DataFrame, keys: list[str], reach: float | Column) -> DataFrame:
    """Phrase runs of a line: a word joins while it starts within ``reach`` of the furthest end so far."""
    by = Window.partitionBy(*keys).orderBy("x", "word_ix")
    end = F.max(F.col("x") + F.col("w")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(words, keys, ["x", "word_ix"], F.col("x") - end > reach, "run_ix")
    return runs.groupBy(*keys, "run_ix").agg(
        F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "word_ix", "text"))), lambda s: s["text"]), " ").alias("text")
    )


def stacked_phrases(runs: Column) -> Column:
    """Runs (x0, x1, text) in line order: each joins the first phrase whose extent it overlaps, which grows."""
    kind = "array<struct<x0:double,x1:double,text:string>>"
    one = lambda r: F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"), r["text"].alias("text"))

    def step(phrases: Column, r: Column) -> Column:
        at = F.array_position(F.transform(phrases, lambda p: (r["x0"] <= p["x1"]) & (r["x1"] >= p["x0"])), True)
        grown = F.transform(
            phrases,
            lambda p, i: F.when(
                i + 1 == at, F.struct(F.least(p["x0"], r["x0"]).alias("x0"), F.greatest(p["x1"], r["x1"]).alias("x1"), F.concat_ws(" ", p["text"], r["text"]).alias("text"))
            ).otherwise(p),
        )
        return F.when(at == 0, F.concat(phrases, F.array(one(r)))).otherwise(grown)

    return F.aggregate(runs, F.array().cast(kind), step)


def vertical_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words set letter below letter: single letters in order of (rounded centre, y); a letter goes on the last run
    if its centre is within 3 of the run's first, and it stands between 2 above the run's bottom and 2.5 heights
    below.  Runs of five letters with four different ones stay.
    """
    letters = words.where(F.col("text").rlike("^[A-Za-z]$")).withColumn("centre", F.col("x") + F.col("w") / 2)
    rows = letters.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.floor(F.col("centre") + 0.5).alias("at"), "y", "word_ix", "centre", "h", "text"))).alias("ls"))
    kind = "array<struct<x:double,bottom:double,text:string>>"

    def step(runs: Column, w: Column) -> Column:
        last = F.element_at(runs, -1)
        on = (F.abs(w["centre"] - last["x"]) <= 3) & (w["y"] >= last["bottom"] - 2) & (w["y"] - last["bottom"] <= 2.5 * w["h"])
        new = F.struct(w["centre"].alias("x"), (w["y"] + w["h"]).alias("bottom"), w["text"].alias("text"))
        grown = F.struct(last["x"].alias("x"), (w["y"] + w["h"]).alias("bottom"), F.concat(last["text"], w["text"]).alias("text"))
        return F.when(F.size(runs) == 0, F.array(new)).when(on, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(runs, F.array(new)))

    found = rows.select(*keys, F.posexplode(F.aggregate("ls", F.array().cast(kind), step)).alias("run_ix", "r"))
    distinct = F.size(F.array_distinct(F.split(F.upper(F.col("r.text")), "(?!^)")))
    return found.where((F.length("r.text") >= 5) & (distinct >= 4)).select(*keys, "run_ix", F.col("r.x").alias("x"), F.upper(F.col("r.text")).alias("text"))


def ordered_partition(heads: Column, bands: Column) -> Column:
    """Runs of bands for heads, both in order: the cuts that make the sum of |middle of run - middle of head| least.

    A dynamic programme over the heads: of each number of bands used so far it keeps the least cost and the run ends
    that give it, the earliest start on a tie.  Null if there are fewer bands than heads.
    """
    m, k = F.size(bands), F.size(heads)
    start = F.transform(F.sequence(F.lit(0), m), lambda j: F.struct(F.when(j == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("cost"), F.array().cast("array<int>").alias("ends")))

    def step(best: Column, head: Column) -> Column:
        def upto(j: Column) -> Column:
            options = F.transform(
                F.sequence(F.lit(1), F.greatest(j, F.lit(1))),
                lambda i: F.struct(
                    (F.get(best, i - 1)["cost"] + F.abs((F.get(bands, i - 1) + F.get(bands, j - 1)) / 2 - head)).alias("cost"), i.alias("first"), F.concat(F.get(best, i - 1)["ends"], F.array(j)).alias("ends")
                ),
            )
            return F.get(F.transform(F.array(F.array_min(options)), lambda pick: F.struct(pick["cost"].alias("cost"), pick["ends"].alias("ends"))), F.lit(0))

        none = F.struct(F.lit(float("inf")).alias("cost"), F.array().cast("array<int>").alias("ends"))
        return F.transform(F.sequence(F.lit(0), m), lambda j: F.when(j == 0, none).otherwise(upto(j)))

    return F.when(m >= k, F.element_at(F.aggregate(heads, start, step), -1))


def longest_ascending(values: Column) -> Column:
    """The longest ascending subsequence (strict); the first found of equally long ones."""
    kind = "array<array<int>>"

    def step(runs: Column, x: Column) -> Column:
        fit = F.filter(runs, lambda r: F.element_at(r, -1) < x)
        size = F.array_max(F.transform(fit, lambda r: F.size(r)))
        best = F.get(F.filter(fit, lambda r: F.size(r) == size), F.lit(0))
        return F.concat(runs, F.array(F.concat(F.coalesce(best, F.array().cast("array<int>")), F.array(x))))

    runs = F.aggregate(values, F.array().cast(kind), step)
    return F.get(F.filter(runs, lambda r: F.size(r) == F.array_max(F.transform(runs, lambda q: F.size(q)))), F.lit(0))
