"""Relations of words and rules that are derived from plain tables, and the schemas of the native ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridframe.functions.text import let

#: Schemas of the native inputs.
PAGES = "doc_id string, page int, width int, height int, rotated boolean"
WORDS = "doc_id string, page int, word_ix int, text string, x double, y double, w double, h double, font string"
RULES = "doc_id string, page int, orient string, rule_ix int, pos double, lo double, hi double, pieces int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(documents: DataFrame) -> DataFrame:
    """Printed lines of texts: one page per document, a line for each line feed, words between spaces."""
    rows = documents.select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_ix", "text"))
    return rows.select("doc_id", F.lit(1).alias("page"), "line_ix", "text", F.filter(F.split("text", " "), lambda t: t != "").alias("tokens"))


def ends(lengths: Column) -> Column:
    """Sums up to each element of an array: each adds the sum that ends 1, 2, 4, ... before it, so no array is copied for
    an element.
    """
    steps = lambda xs: F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda s: s < F.size(xs))
    add = lambda xs, s: F.transform(xs, lambda x, k: F.when(k < s, x).otherwise(x + F.get(xs, k - s)))
    return let(lengths, lambda xs: F.aggregate(steps(xs), xs, add))


def line_words(line: Column, line_ix: Column) -> Column:
    """Words of a printed line on a grid of characters: x = 5 characters along, w = 5 a character; ``word_ix`` counts what
    is between spaces, blank or not.
    """

    def placed(parts: Column) -> Column:
        word = lambda at: F.transform(parts, lambda p, k: F.struct((5.0 * (F.get(at, k) - F.length(p))).alias("x"), (line_ix * 100_000 + k).alias("word_ix"), p.alias("text"), (5.0 * F.length(p)).alias("w")))
        words = let(ends(F.transform(parts, lambda p, k: F.length(p) + F.least(k, F.lit(1)))), word)
        return F.when(F.array_contains(parts, ""), F.filter(words, lambda w: w["text"] != "")).otherwise(words)

    return let(F.split(line, " "), placed)


def doc_words(documents: DataFrame) -> DataFrame:
    """Words of texts, a line for each line feed: y = 12 lines down, h = 10."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ix", "line"))
    words = rows.select("doc_id", "line_ix", F.explode_outer(line_words(F.col("line"), F.col("line_ix"))).alias("p")).where("p is not null")
    return words.select("doc_id", F.lit(1).alias("page"), "line_ix", (F.col("p.word_ix") - F.col("line_ix") * 100_000).alias("part_ix"), "p.text", "p.x", (12.0 * F.col("line_ix")).alias("y"), "p.w", F.lit(10.0).alias("h"))


def doc_runs(documents: DataFrame) -> DataFrame:
    """The same words, a row for each text: a run for each printed line that has any."""
    run = lambda line, i: F.struct((12.0 * i).alias("y"), F.lit(10.0).alias("h"), line_words(line, i).alias("words"))
    runs = F.filter(F.transform(F.split("text", "\n"), run), lambda r: F.size(r["words"]) > 0)
    return documents.where("text is not null").select("doc_id", runs.alias("runs"))


def star_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer nation (page), month (row) and priority (column): what the printed grid shows."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy("c_nationkey", F.month("o_orderdate").alias("r"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    ranks = orders.select("o_orderpriority").distinct().select("o_orderpriority", (F.row_number().over(Window.orderBy("o_orderpriority")) - 1).alias("c"))
    placed = n.join(ranks, "o_orderpriority")
    return placed.select(F.col("c_nationkey").alias("page"), F.col("r").cast("int").alias("r"), "c", "n")


def star_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed schedule from the star schema: marks centred on columns, and a label for each row of a page."""
    cells = star_cells(spark, sf_dir)
    mark = F.when(F.col("n") % 4 == 1, "X").when(F.col("n") % 4 == 2, "3X").when(F.col("n") % 4 == 3, "(X)")
    marks = cells.withColumn("text", mark).where("text is not null")
    marks = marks.select("page", "r", "c", "text", (5.0 * F.length("text")).alias("w")).withColumn("x", 200 + 60 * F.col("c") - F.col("w") / 2)
    labels = cells.select("page", "r").distinct().select("page", "r", F.lit(-1).alias("c"), F.concat(F.lit("Panel"), F.chr((96 + F.col("r")).cast("long")), F.lit("q")).alias("text"))
    labels = labels.select("page", "r", "c", "text", (5.0 * F.length("text")).alias("w"), F.lit(20.0).alias("x"))
    return marks.unionByName(labels).select("page", "r", "c", "text", "x", (100.0 + 14 * F.col("r")).alias("y"), "w", F.lit(10.0).alias("h"))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
