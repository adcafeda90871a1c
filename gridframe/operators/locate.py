"""Finding the pages that hold a schedule: page scores with their reasons, and ranges grown from the best pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T


def is_short(line: Column) -> Column:
    return F.length(F.trim(line)) <= 110


def is_no_reference(line: Column) -> Column:
    """Neither a contents entry nor a cross-reference."""
    s = F.trim(line)
    return ~s.rlike(T.TOC_LEADER) & ~(s.rlike(T.TOC_NUMBER) & (F.length(s) < 80)) & ~s.rlike(T.CROSS_REFERENCE)


def is_heading(line: Column) -> Column:
    """Short enough, no contents entry and no cross-reference."""
    return is_short(line) & is_no_reference(line)


def names_table(line: Column, low: Column | None = None) -> Column:
    """A heading that has one of the table's names; ``low`` is the normalised line where it is at hand.

    The cheapest test comes first: long lines aren't normalised, and no line is more than once.
    """

    def named(low: Column) -> Column:
        out = F.lit(False)
        for name in T.TITLE_WORDS:
            out = out | low.contains(name)
        return out

    return is_short(line) & (T.let(T.norm(line), named) if low is None else named(low)) & is_no_reference(line)


def heads_row(low: Column) -> Column:
    """A normalised line that starts with a header word, or has one between spaces."""
    out = F.lit(False)
    for name in T.HEADER_WORDS:
        out = out | low.startswith(name) | low.contains(f" {name} ")
    return out


def line_facts(lines: DataFrame) -> DataFrame:
    """What each line tells: title, header row, marks, footnote definition.  ``tokens`` are its words' texts."""
    marks = F.size(F.filter("tokens", lambda t: t.rlike(T.CELL_MARK)))
    numbers = F.size(F.filter("tokens", lambda t: t.rlike(T.HEADER_NUMBER)))
    # The normalised line and the counts are columns of their own: they are used many times.
    counted = lines.withColumns({"low": T.norm(F.col("text")), "marks": marks, "numbers": numbers})
    marks, numbers = F.col("marks"), F.col("numbers")
    return counted.select(
        "doc_id", "page", "line_ix", "text", "low", F.size("tokens").alias("n_tokens"), "marks", names_table(F.col("text"), F.col("low")).alias("is_title"),
        ((numbers >= 3) & heads_row(F.col("low"))).alias("is_header"), ((marks >= 3) & (marks > 0.4 * F.size("tokens"))).alias("is_grid"), F.col("text").rlike(T.FOOTNOTE_LINE).alias("is_footnote"),
    )


def page_scores(lines: DataFrame) -> DataFrame:
    """Score of each page with its reasons.  One pass over the lines; periods are looked up in the page's text.

    A title gives 6; up to three header rows 2 each; two or more period names up to 4; eight or more marks an eighth
    each up to 6; three or more grid rows a half each up to 5; three or more footnote lines a third each up to 3.
    """
    periods = [F.max(F.col("low").contains(name).cast("int")) for name in T.PERIOD_WORDS]
    n_periods = periods[0]
    for p in periods[1:]:
        n_periods = n_periods + p
    facts = line_facts(lines)
    sums = facts.groupBy("doc_id", "page").agg(
        F.min(F.when(F.col("is_title"), F.struct("line_ix", "text"))).alias("title"), F.count_if("is_header").alias("headers"), n_periods.alias("periods"), F.sum("marks").alias("marks"),
        F.count_if("is_grid").alias("mark_lines"), F.count_if("is_footnote").alias("footnote_lines"),
    )
    return score(sums)


def score(sums: DataFrame) -> DataFrame:
    title = F.when(F.col("title").isNotNull(), F.lit(6.0)).otherwise(0.0)
    headers = F.least(F.col("headers"), F.lit(3)) * 2.0
    periods = F.when(F.col("periods") >= 2, F.least(F.col("periods"), F.lit(4)) * 1.0).otherwise(0.0)
    marks = F.when(F.col("marks") >= 8, F.least(F.col("marks") / 8, F.lit(6.0))).otherwise(0.0)
    grid = F.when(F.col("mark_lines") >= 3, F.least(F.col("mark_lines") / 2, F.lit(5.0))).otherwise(0.0)
    notes = F.when(F.col("footnote_lines") >= 3, F.least(F.col("footnote_lines") / 3, F.lit(3.0))).otherwise(0.0)
    reasons = F.array_compact(
        F.array(
            F.when(title > 0, F.concat(F.lit("title: "), F.substring("title.text", 1, 60))), F.when(headers > 0, F.concat_ws(" ", F.col("headers"), F.lit("header rows"))),
            F.when(periods > 0, F.concat_ws(" ", F.col("periods"), F.lit("period names"))), F.when(marks > 0, F.concat_ws(" ", F.col("marks"), F.lit("marks"))),
            F.when(grid > 0, F.concat_ws(" ", F.col("mark_lines"), F.lit("grid rows"))), F.when(notes > 0, F.concat_ws(" ", F.col("footnote_lines"), F.lit("footnote lines"))),
        )
    )
    return sums.select("doc_id", "page", T.round2(title + headers + periods + marks + grid + notes).alias("score"), reasons.alias("reasons"), "marks", "mark_lines", "footnote_lines")


def has_grid() -> Column:
    return (F.col("mark_lines") >= 3) & (F.col("marks") >= 8)


def is_footnote_block() -> Column:
    return (F.col("footnote_lines") >= 3) & (F.col("mark_lines") < 3)


def candidates(scores: DataFrame, seed: float = 9.0, most_pages: int = 8, spill: int = 2) -> DataFrame:
    """Ranges of pages around seeds, the best first.

    Seeds are taken by score (earlier pages first on a tie); a range grows over grid pages that aren't taken yet,
    back and then forward, and then over at most ``spill`` footnote pages.  Greedy, so one fold for each run of
    neighbouring pages that are seeds, grids or notes: no range reaches over another page.
    """
    first = F.min(F.struct("score", has_grid().alias("grid"), is_footnote_block().alias("notes")))
    each = scores.groupBy("doc_id", "page").agg(first.alias("p"), F.max("score").alias("best"), F.sum("score").alias("sum"))
    each = each.where((F.col("best") >= seed) | F.col("p.grid") | F.col("p.notes"))
    run = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    pages = each.withColumn("run", run).groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("page", "best", "sum", "p.grid", "p.notes"))).alias("ps")).where(F.exists("ps", lambda p: p["best"] >= seed))
    at = lambda page: F.get("ps", page - F.get("ps", F.lit(0))["page"])
    seeds = F.transform(F.sort_array(F.transform(F.filter("ps", lambda p: p["best"] >= seed), lambda p: F.struct((-p["best"]).alias("neg"), p["page"].alias("page")))), lambda s: s["page"])
    kind = "struct<used:array<int>,out:array<struct<seed:int,pages:array<int>>>>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<seed:int,pages:array<int>>>").alias("out"))

    def grow(used: Column, own: Column, step: int, flag: str, limit: int, room: int | None = None) -> Column:
        """``own`` with the pages next to its end for which ``flag`` holds and that aren't used."""

        def one(acc: Column, i: Column) -> Column:
            edge = F.array_max(acc["own"]) if step > 0 else F.array_min(acc["own"])
            fits = acc["open"] & F.coalesce(at(edge + step)[flag], F.lit(False)) & ~F.array_contains(used, edge + step) & (F.size(acc["own"]) < (most_pages if room is None else 10**6))
            return F.struct(F.when(fits, F.concat(acc["own"], F.array(edge + step))).otherwise(acc["own"]).alias("own"), fits.alias("open"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.struct(own.alias("own"), F.lit(True).alias("open")), one, lambda a: a["own"])

    def take(state: Column, page: Column) -> Column:
        def ranges(own: Column) -> Column:
            back = grow(state["used"], own, -1, "grid", most_pages)
            ahead = grow(state["used"], back, 1, "grid", most_pages)
            return grow(state["used"], ahead, 1, "notes", spill, spill)

        done = F.get(
            F.transform(
                F.transform(F.array(F.array(page)), ranges),
                lambda own: F.struct(F.concat(state["used"], own).alias("used"), F.concat(state["out"], F.array(F.struct(page.alias("seed"), F.array_sort(own).alias("pages")))).alias("out")),
            ),
            F.lit(0),
        )
        return F.when(F.array_contains(state["used"], page), state).otherwise(done)

    total = lambda c: T.round2(F.aggregate(c["pages"], F.lit(0.0), lambda a, page: a + at(page)["sum"]))
    summed = lambda c: F.struct(c["seed"].alias("seed_page"), c["pages"].alias("pages"), at(c["seed"])["best"].alias("score"), total(c).alias("total"))
    found = pages.withColumn("cs", F.aggregate(seeds, start.cast(kind), take, lambda s: s["out"]))
    out = found.select("doc_id", F.explode_outer(F.transform("cs", summed)).alias("c")).select("doc_id", "c.*")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("total"), "seed_page"))
    return out.withColumn("cand_ix", rank - 1)
