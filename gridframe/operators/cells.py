"""Cells: marks in columns, raised markers, values that span columns, and text that reached nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import geometry as G


def from_marks(marks: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Marks (with row_id, ord) to cells in the nearest band: cleaned values."""
    placed = G.nearest_band(marks.withColumn("centre", F.col("x") + F.col("w") / 2), bands, keys)
    return placed.select(*keys, "row_id", "band_ix", "ord", T.clean(F.col("text")).alias("value"))


def dedupe(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One cell for each row and column: the first."""
    return cells.groupBy(*keys, "row_id", "band_ix").agg(F.min("ord").alias("ord"), F.min_by("value", "ord").alias("value"))


def superscripts(marks: DataFrame, loose: DataFrame, keys: list[str]) -> DataFrame:
    """The first loose word of at most two signs that stands at a mark's right edge (-1 to 3.5), not taller than the
    mark by over 0.5, not below its bottom and at most its height above it.
    """
    small = loose.where(F.col("text").rlike("(?i)^[a-z0-9*†‡§¶#]{1,2}$")).select(*keys, F.col("word_ix").alias("pool_ix"), F.col("text").alias("marker"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("h").alias("sh"))
    right = F.col("x") + F.col("w")
    near = marks.join(small, keys).where(
        F.col("sx").between(right - 1, right + 3.5) & (F.col("sh") <= F.col("h") + 0.5) & (F.col("sy") <= F.col("y") + F.col("h")) & (F.col("sy") >= F.col("y") - F.col("h"))
    )
    return near.groupBy(*keys, "word_ix").agg(F.min_by("marker", "pool_ix").alias("marker"), F.min("pool_ix").alias("used_ix"))


def covered_bands(phrases: DataFrame, bands: DataFrame, keys: list[str], pitch: Column) -> DataFrame:
    """Phrases of at most 60 signs to the bands whose centre lies within half a pitch of their extent; a phrase that
    covers none goes to the nearest within one pitch.
    """
    joined = phrases.where(F.length("text") <= 60).withColumn("pitch", pitch).join(bands, keys)
    inside = F.col("centre").between(F.col("x0") - F.col("pitch") / 2, F.col("x1") + F.col("pitch") / 2)
    gap = F.greatest(F.lit(0.0), F.col("x0") - F.col("centre"), F.col("centre") - F.col("x1"))
    found = joined.groupBy(*keys, "phrase_ix", "text", "pitch").agg(F.sort_array(F.collect_list(F.when(inside, F.col("band_ix")))).alias("bands"), F.min(F.struct(gap.alias("gap"), "band_ix")).alias("near"))
    own = F.when(F.size("bands") > 0, F.col("bands")).when(F.col("near.gap") <= F.col("pitch"), F.array("near.band_ix")).otherwise(F.array().cast("array<int>"))
    return found.select(*keys, "phrase_ix", "text", F.explode(own).alias("band_ix"))


def explode_spans(cells: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """A cell for each band that a phrase covers; where a mark stands, the phrase is added if it has a digit or three
    letters and isn't part of the mark's value.
    """
    on = [*keys, "row_id", "band_ix"]
    both = cells.join(spans.withColumnRenamed("text", "phrase"), on, "full_outer")
    adds = F.col("phrase").rlike(r"\d|[A-Za-z]{3}") & ~F.col("value").contains(F.col("phrase"))
    return both.select(*on, F.when(F.col("value").isNull(), F.col("phrase")).when(F.coalesce(adds, F.lit(False)), F.concat_ws(" ", "value", "phrase")).otherwise(F.col("value")).alias("value"))


def residual(words: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Words of three or more signs that no held text of their page contains: they reached nothing."""
    texts = held.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("held"))
    left = words.where((F.length("text") >= 3) & ~F.col("text").rlike(T.PAGE_FURNITURE)).join(texts, keys, "left")
    return left.where(~F.coalesce(F.col("held").contains(F.col("text")), F.lit(False))).select(*keys, "word_ix", "text")


def split_trailing(value: Column, known: Column) -> tuple[Column, Column]:
    """A value and the known marker at its end, if what stands before has two signs or more."""
    head, tail = F.regexp_extract(value, r"^(.*\S)\s+(\S{1,3})$", 1), F.lower(F.regexp_extract(value, r"^(.*\S)\s+(\S{1,3})$", 2))
    takes = (F.length(head) > 1) & F.array_contains(known, tail)
    return F.when(takes, head).otherwise(value), F.when(takes, tail)


def phrase_cells(words: DataFrame, keys: list[str], pitch: float | Column) -> DataFrame:
    """Phrases of the lines of a row: runs at 0.9 pitch, stacked over lines."""
    runs = G.running_runs(words, [*keys, "line_ix"], pitch * 0.9)
    rows = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_ix", "run_ix", "x0", "x1", "text"))).alias("rs"))
    stacked = G.stacked_phrases(F.transform("rs", lambda r: F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"), r["text"].alias("text"))))
    return rows.select(*keys, F.posexplode(stacked).alias("phrase_ix", "p")).select(*keys, "phrase_ix", "p.x0", "p.x1", "p.text")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
