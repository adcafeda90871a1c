"""The second reading as a path: tables that can't be trusted are read again, and what comes back is grounded,
reconciled with the geometry, and taken or refused.

An answer is a mapping with ``tables``; each has columns (id, label, period, visitNumber, studyDay, studyWeek, window),
rows (id, kind, label, category, markers, cells of col, value and markers), footnotes (marker, text, page, appliesTo)
and ambiguities.  The first table of an answer may replace the one that was shown; further ones are tables of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import confidence, footnotes, reconcile, review
from gridframe.operators.tables import KEYS, TABLE, Tables, column_texts
from gridframe.sources.stages import cut

FACTS = reconcile.FACTS
SAID = {"visit_number": "$.visitNumber", "study_day": "$.studyDay", "study_week": "$.studyWeek", "visit_window": "$.window", "path": "$.period"}
Reader = review.Reviewer | Callable[[dict], dict | None]


def requests(got: Tables) -> DataFrame:
    """What is shown of each table whose verdict is ``fallback``: its pages as text, in order, and what the geometry
    made of them and why that isn't trusted.
    """
    asked = got.assessments.where("verdict = 'fallback'").select(*TABLE)
    pages = got.pages.join(asked, TABLE, "left_semi")
    size = [F.concat(F.lit(" ("), F.concat_ws("x", *[c for c in ("width", "height") if c in pages.columns]), F.when(F.col("rotated"), ", landscape").otherwise("") if "rotated" in pages.columns else F.lit(""), F.lit(")"))] if "width" in pages.columns else []
    heads = pages.select(*KEYS, F.concat(F.lit("--- page "), "page", *size, F.lit(" ---\n")).alias("head"))
    text = review.serialise(pages.join(got.lines, ["doc_id", "page"]).withColumn("y", F.col("top")), KEYS).join(heads, KEYS)
    text = text.groupBy(*TABLE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", F.concat("head", "text").alias("text")))), lambda p: p["text"]), "\n\n").alias("text"))
    n = lambda df, name: df.groupBy(*TABLE).agg(F.count(F.lit(1)).alias(name))
    why = got.findings.groupBy(*TABLE).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "check", F.lit(": "), "detail"))), "\n").alias("why"))
    context = F.concat(F.lit("The geometry made "), F.coalesce("n_cols", F.lit(0)), F.lit(" columns and "), F.coalesce("n_rows", F.lit(0)), F.lit(" rows of these pages and isn't trusted:\n"), F.coalesce("why", F.lit("")))
    return text.join(n(got.columns, "n_cols"), TABLE, "left").join(n(got.rows, "n_rows"), TABLE, "left").join(why, TABLE, "left").select(*TABLE, "text", context.alias("context"))


def judge(answers: DataFrame, got: Tables) -> DataFrame:
    """Each answered table with what comes of it: the first of an answer is ``used``, or refused because it is no table
    (``found-no-table``) or names fewer than 0.7 of the named rows; later ones are ``extra``, numbered after the
    document's tables, or left out.
    """
    cols, rows = review.listed(F.col("table"), "$.columns"), review.listed(F.col("table"), "$.rows")
    named = F.size(F.filter(rows, lambda r: F.trim(F.coalesce(review.told(r, "$.label"), F.lit(""))) != ""))
    sized = answers.withColumns({"n_cols": F.size(cols).cast("long"), "n_rows": F.size(rows).cast("long"), "n_named": named.cast("long")})
    own = got.rows.groupBy(*TABLE).agg(F.count_if(F.trim("label") != "").alias("n_rows"))
    fine = reconcile.acceptable(sized.where("table_ix = 0").select(*TABLE, "n_cols", "n_rows", "n_named"), own)
    first = sized.where("table_ix = 0").join(fine, TABLE, "left").join(own.withColumnRenamed("n_rows", "g_rows"), TABLE, "left")
    outcome = F.when((F.col("n_rows") == 0) | (F.col("n_cols") < 2), "found-no-table").when(F.col("accepted"), "used").otherwise("rejected-dropped-rows")
    detail = F.when(outcome == "rejected-dropped-rows", F.concat_ws(" ", "n_named", F.lit("named rows against"), "g_rows")).when(outcome == "used", F.concat(F.lit("read by "), "model"))
    first = first.select(*TABLE, F.col("cand").alias("of"), "table_ix", "table", "model", outcome.alias("outcome"), detail.alias("detail"))
    last = got.assessments.groupBy("doc_id").agg(F.max("cand").alias("last"))
    used = first.where("outcome = 'used'").select("doc_id", F.col("of").alias("cand"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("cand", "table_ix"))
    more = sized.where("table_ix > 0 and n_rows > 0 and n_cols >= 2").join(used, TABLE, "left_semi").join(last, "doc_id")
    more = more.select("doc_id", (F.col("last") + place).cast("int").alias("cand"), F.col("cand").alias("of"), "table_ix", "table", "model", F.lit("extra").alias("outcome"), F.lit(None).cast("string").alias("detail"))
    return first.unionByName(more)


def said(node: str, path: str) -> Column:
    return T.nonempty(T.clean(review.told(F.col(node), path)))


def strings(node: str, path: str) -> Column:
    """The non-empty strings of a list."""
    return F.array_distinct(F.filter(F.transform(review.listed(F.col(node), path), lambda m: T.clean(review.told(m, "$"))), lambda m: m.isNotNull() & (m != "")))


def relations(tables: DataFrame, vocabulary: DataFrame) -> dict[str, DataFrame]:
    """Columns, rows, cells, footnotes, links and doubts of answered tables, and what was left out, with its path.

    Columns are named v0, v1, ... and rows r0, r1, ... in their order, whatever the answer calls them; of two with one
    name the first is meant.  A cell is left out if its column isn't there or its value isn't printed on the pages.
    """
    path = lambda *parts: F.concat(F.lit("tables["), "table_ix", F.lit("]"), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    known = ["of", "table_ix"]
    cols = tables.select(*TABLE, *known, F.posexplode(review.listed(F.col("table"), "$.columns")).alias("ord", "c"))
    cols = cols.select(*TABLE, "ord", F.concat(F.lit("v"), "ord").alias("id"), F.coalesce(said("c", "$.id"), F.col("ord").cast("string")).alias("said_id"), F.coalesce(said("c", "$.label"), F.concat(F.lit("Column "), F.col("ord") + 1)).alias("label"), *[said("c", p).alias(name) for name, p in SAID.items()], F.lit(False).alias("divider"))
    cols = cut(cols)
    rows = tables.select(*TABLE, *known, F.posexplode(review.listed(F.col("table"), "$.rows")).alias("ord", "r"))
    rows = cut(rows.select(*TABLE, *known, "ord", F.concat(F.lit("r"), "ord").alias("id"), F.coalesce(said("r", "$.id"), F.col("ord").cast("string")).alias("said_id"), F.coalesce(said("r", "$.label"), F.lit("")).alias("label"), said("r", "$.category").alias("category"), (F.lower(F.coalesce(said("r", "$.kind"), F.lit(""))) == "category").alias("heads"), strings("r", "$.markers").alias("markers"), review.listed(F.col("r"), "$.cells").alias("cells")))
    name = lambda df, out: df.groupBy(*TABLE, F.col("said_id").alias(out)).agg(F.min_by("id", "ord").alias(f"{out}_id"))
    col_names, row_names = name(cols, "col"), name(rows, "row")

    cells = rows.select(*TABLE, *known, "ord", F.col("id").alias("row_id"), F.coalesce(T.nonempty(F.col("label")), "said_id").alias("row"), F.posexplode("cells").alias("cell_ord", "c"))
    cells = cells.select(*TABLE, "of", "row_id", "row", path(".rows[", F.col("ord"), "].cells[", F.col("cell_ord"), "]").alias("cell_ix"), "cell_ord", F.coalesce(said("c", "$.col"), F.lit("")).alias("col"), F.coalesce(said("c", "$.value"), F.lit("")).alias("value"), strings("c", "$.markers").alias("markers"))
    cells = cells.join(col_names, [*TABLE, "col"], "left")
    kept = review.grounded(cells.select("doc_id", "of", "cell_ix", "value"), vocabulary, ["doc_id", "of"])
    judged = cut(cells.join(kept.select("doc_id", "of", "cell_ix", "kept"), ["doc_id", "of", "cell_ix"]).withColumn("reason", F.when(~F.col("kept") | (F.col("value") == ""), "not-printed").when(F.col("col_id").isNull(), "unknown-column")))
    good = judged.where("reason is null").groupBy(*TABLE, "row_id", "col_id").agg(F.min_by("value", "cell_ord").alias("value"), F.array_distinct(F.flatten(F.collect_list("markers"))).alias("markers"))
    shown = F.concat("row", F.lit("/"), "col", F.lit('="'), "value", F.lit('"'))
    rejected = judged.where("reason is not null").select(*TABLE, F.col("cell_ix").alias("path"), shown.alias("shown"), "reason")

    notes = tables.select(*TABLE, *known, F.posexplode(review.listed(F.col("table"), "$.footnotes")).alias("ord", "f"))
    notes = cut(notes.select(*TABLE, *known, "ord", F.lower(F.coalesce(said("f", "$.marker"), F.lit(""))).alias("marker"), F.coalesce(said("f", "$.text"), F.lit("")).alias("text"), review.told(F.col("f"), "$.page", "int").alias("page"), review.listed(F.col("f"), "$.appliesTo").alias("to")))
    to = notes.select(*TABLE, *known, "marker", F.col("ord").alias("note_ord"), F.posexplode("to").alias("to_ord", "t"))
    to = to.select(*TABLE, "marker", path(".footnotes[", F.col("note_ord"), "].appliesTo[", F.col("to_ord"), "]").alias("path"), F.lower(F.coalesce(said("t", "$.target"), F.lit(""))).alias("target"), F.coalesce(said("t", "$.row"), F.lit("")).alias("row"), F.coalesce(said("t", "$.col"), F.lit("")).alias("col"))
    to = cut(to.join(row_names, [*TABLE, "row"], "left").join(col_names, [*TABLE, "col"], "left"))
    lacks = F.when(F.col("target").isin("cell", "row") & F.col("row_id").isNull(), "unknown-row").when(F.col("target").isin("cell", "column") & F.col("col_id").isNull(), "unknown-column").when(~F.col("target").isin("cell", "row", "column", "table"), "unknown-target")
    rejected = rejected.unionByName(to.where(lacks.isNotNull()).select(*TABLE, "path", F.concat("marker", F.lit(" on "), F.concat_ws("/", "row", "col")).alias("shown"), lacks.alias("reason")))
    links = to.where(lacks.isNull() & (F.col("target") != "table")).select(*TABLE, "marker", "target", F.when(F.col("target") != "column", F.col("row_id")).alias("row_id"), F.when(F.col("target") != "row", F.col("col_id")).alias("col_id"))
    doubts = tables.select(*TABLE, F.posexplode(strings("table", "$.ambiguities")).alias("note_ix", "note"))
    return {"columns": cols, "rows": rows.drop("cells", *known), "cells": cut(good), "notes": notes.drop("to", *known), "links": links, "rejected": cut(rejected), "doubts": doubts}


def rejoined(rows: DataFrame, cells: DataFrame, g_rows: DataFrame, ruled: DataFrame) -> DataFrame:
    """Rows with those that one drawn row names put together, their markers too; ``into`` is the row that a row is in."""
    n = cells.groupBy(*TABLE, F.col("row_id").alias("id")).agg(F.count(F.lit(1)).alias("n_cells"))
    by = Window.partitionBy(*TABLE).orderBy("ord")
    counted = rows.join(n, [*TABLE, "id"], "left").join(ruled, TABLE, "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)).cast("bigint"))
    # A heading is neither the tail of another row nor continued by one.
    counted = counted.withColumn("ruled", F.coalesce("ruled", F.lit(False)) & ~F.col("heads") & ~F.coalesce(F.lag("heads").over(by), F.lit(False)))
    whole = reconcile.restore_splits(counted.select(*TABLE, F.col("ord").cast("int").alias("ord"), "label", "n_cells", "ruled"), g_rows)
    joined = rows.drop("label").join(whole.select(*TABLE, "ord", "label"), [*TABLE, "ord"], "left")
    return joined.withColumn("into", F.last(F.when(F.col("label").isNotNull(), F.col("id")), ignorenulls=True).over(by))


def footnotes_of(parts: dict[str, DataFrame], rows: DataFrame, columns: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Footnotes, one for each marker, and what they apply to: what the answer says, the cells and rows that it gives
    the marker, and rows and columns whose text ends in it; the whole table without any.
    """
    pages = F.array_sort(F.collect_set("page"))
    notes = parts["notes"].groupBy(*TABLE, "marker").agg(F.min("ord").alias("ord"), F.aggregate(F.sort_array(F.collect_list(F.struct("ord", "text"))), F.lit(""), lambda a, n: F.when(a.contains(n["text"]), a).otherwise(T.join_wrapped(a, n["text"]))).alias("text"), pages.alias("pages"))
    notes = notes.select(*TABLE, F.col("ord").cast("int").alias("ord"), "marker", "text", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), (F.size("pages") > 1).alias("continued"))
    markers = notes.select(*TABLE, "marker").where("marker != ''")
    into = rows.select(*TABLE, F.col("id").alias("row_id"), "into")
    links = parts["links"].join(into, [*TABLE, "row_id"], "left").withColumn("row_id", F.coalesce("into", "row_id")).drop("into")
    low = lambda df: df.withColumn("marker", F.lower("marker")).join(markers, [*TABLE, "marker"], "left_semi")
    in_cells = links.where("target = 'cell'").select(*TABLE, "row_id", "col_id", "marker").unionByName(low(cells.select(*TABLE, "row_id", "col_id", F.explode("markers").alias("marker"))).select(*TABLE, "row_id", "col_id", "marker"))
    real = rows.where("label is not null")
    in_rows = links.where("target = 'row'").select(*TABLE, "row_id", "marker").unionByName(low(rows.select(*TABLE, F.col("into").alias("row_id"), F.explode("markers").alias("marker"))).select(*TABLE, "row_id", "marker"))
    in_rows = in_rows.unionByName(footnotes.link_trailing(real.select(*TABLE, F.lit("row").alias("target"), "id", F.col("label").alias("text")), markers, TABLE).select(*TABLE, F.col("id").alias("row_id"), "marker"))
    in_cols = links.where("target = 'column'").select(*TABLE, "col_id", "marker").unionByName(footnotes.link_trailing(column_texts(columns).withColumn("target", F.lit("column")), markers, TABLE).select(*TABLE, F.col("id").alias("col_id"), "marker"))
    return notes, footnotes.applies_to(notes, in_rows, in_cells, TABLE, in_cols)


def pages_of(tables: DataFrame, got: Tables) -> DataFrame:
    """The pages of answered tables: those that were shown; of a further table, from the first page after the first
    that prints its title, if there is one.
    """
    shown = tables.select(*TABLE, "of", "table_ix", F.lower(F.substring(F.coalesce(review.told(F.col("table"), "$.title"), F.lit("")), 1, 24)).alias("title")).join(got.pages.withColumnRenamed("cand", "of"), ["doc_id", "of"])
    printed = shown.where("table_ix > 0 and title != ''").join(got.lines.select("doc_id", "page", "text"), ["doc_id", "page"]).where(F.lower("text").contains(F.col("title")))
    begins = printed.groupBy(*TABLE).agg(F.min("page").alias("begins"))
    return shown.join(begins, TABLE, "left").where(F.col("begins").isNull() | (F.col("page") >= F.col("begins"))).drop("of", "table_ix", "title", "begins")


#: What a table says of a reading that came to nothing.
SILENT = {
    "skipped-no-time": "not read a second time: too little was left of the time; this is the geometry's reading",
    "abandoned-on-the-clock": "a second reading wasn't done in time and was given up; this is the geometry's reading",
}


def read(got: Tables, reader: Reader | None = None, rates: dict[str, tuple[float, float]] | None = None) -> Tables:
    """``got`` with the tables that a reader read better, and an outcome for every table.  Without a reader, or without
    an answer, tables stay as they are.  ``rates`` are dollars per million tokens in and out, by model.
    """
    spark = got.columns.sparkSession
    asked = cut(review.read_again(requests(got), reader))
    tables = cut(judge(review.parse_answers(asked.where("answer is not null").select(*TABLE, "model", "answer")), got))
    refused = tables.where("table_ix = 0").select(*TABLE, "outcome", F.col("detail"))
    unread = asked.select(*TABLE, F.col("outcome").alias("asked"), F.col("detail").alias("why"), "model", "attempts", "from_ledger", "tokens_in", "tokens_out")
    told = unread.join(refused, TABLE, "left").withColumns({"outcome": F.coalesce("outcome", F.when(F.col("asked") == "answered", "no-answer").otherwise(F.col("asked"))), "detail": F.coalesce("detail", "why")}).drop("asked", "why")
    others = got.assessments.where("verdict != 'fallback'").select(*TABLE, F.lit("not-needed").alias("outcome"), F.concat(F.lit("the checks scored it "), "verdict").alias("detail"))
    outcomes = told.unionByName(others, allowMissingColumns=True).withColumn("use_ix", F.struct(*TABLE))
    priced = review.price(outcomes, spark.createDataFrame([(m, float(i), float(o)) for m, (i, o) in (rates or {}).items()], "model string, rate_in double, rate_out double")).drop("use_ix")
    outcomes = cut(priced)
    silent = F.create_map(*[F.lit(x) for pair in SILENT.items() for x in pair])
    unsure = outcomes.where(F.col("outcome").isin(*SILENT)).select(*TABLE, F.lit(None).cast("int").alias("page"), F.lit("second-reading").alias("kind"), silent[F.col("outcome")].alias("detail"))

    taken = tables.where(F.col("outcome").isin("used", "extra"))
    if taken.isEmpty():
        return replace(got, outcomes=outcomes, ambiguities=got.ambiguities.unionByName(unsure))
    shown = got.pages.join(got.lines, ["doc_id", "page"]).withColumnRenamed("cand", "of")
    parts = relations(taken, review.vocabulary_arrays(shown, ["doc_id", "of"]))
    keys = taken.select(*TABLE)
    cols, rows, cells = parts["columns"], parts["rows"], parts["cells"]
    g_cols, g_rows, g_cells = (df.join(keys, TABLE, "left_semi") for df in (got.columns, got.rows, got.cells))
    if "path" not in g_cols.columns:
        g_cols = g_cols.withColumn("path", F.lit(None).cast("string"))

    # Header facts and bands, then cells, then rows that were split, then dividers: each stands on the one before.
    facts = reconcile.restore_header(cols, g_cols)
    bands = reconcile.restore_bands(facts.drop("label").join(cols.select(*TABLE, "ord", "label", "path", "divider"), [*TABLE, "ord"]), g_cols)
    headed = cut(facts.drop("label").join(bands, [*TABLE, "ord"]).join(cols.select(*TABLE, "ord", "id", "said_id", "divider"), [*TABLE, "ord"]))
    filled = reconcile.reconcile_cells(rows, headed, cells, g_rows, g_cols.where("not divider"), g_cells)
    cells = cut(filled.join(cells.select(*TABLE, "row_id", "col_id", "markers"), [*TABLE, "row_id", "col_id"], "left").withColumn("markers", F.coalesce("markers", F.array().cast("array<string>"))))
    all_rows = cut(rejoined(rows, cells, g_rows, got.assessments.select(*TABLE, F.col("rows_are_ruled").alias("ruled"))))
    drawn = g_cols.withColumn("after", F.coalesce(F.count_if(~F.col("divider")).over(Window.partitionBy(*TABLE).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("divider").select(*TABLE, "label", "after")
    pages = cut(pages_of(taken, got))
    placed = reconcile.restore_dividers(headed, drawn).join(headed.select(*TABLE, "id", *FACTS, "path"), [*TABLE, "id"], "left").join(pages.groupBy(*TABLE).agg(F.min("page").alias("page")), TABLE, "left")
    placed = cut(placed.withColumns({"ruled": F.lit(False), "band_ix": F.col("ord").cast("long"), "ord": F.col("ord").cast("int")}))
    real = all_rows.where("label is not null")
    kind = real.select(*TABLE, "id", F.when(F.col("heads"), "category").otherwise("assessment").alias("kind"), F.col("ord").cast("int").alias("ord"), "label", "category")
    notes, targets = footnotes_of(parts, all_rows, placed, cells)
    notes, targets = cut(notes), cut(targets)

    def merged(own: DataFrame, new: DataFrame) -> DataFrame:
        return own.join(keys, TABLE, "left_anti").unionByName(new, allowMissingColumns=True)

    columns, table_rows, table_cells = merged(got.columns, placed), merged(got.rows, kind), merged(got.cells, cells)
    table_notes, table_targets = merged(got.footnotes, notes), merged(got.targets, targets)
    found = cut(confidence.findings(columns, table_rows, table_cells, table_targets))
    kept = [c for c in ("locator_score", "locator_evidence") if c in got.assessments.columns]
    titles = got.assessments.select(*TABLE, F.col("title").alias("own_title"), "rows_are_ruled", *kept)
    sizes = [df.groupBy(*TABLE).agg(F.count(F.lit(1)).alias(c)) for df, c in ((got.columns, "columns"), (got.rows, "rows"))]
    before = got.assessments.join(taken.where("outcome = 'used'").select(*TABLE), TABLE, "left_semi").join(sizes[0], TABLE, "left").join(sizes[1], TABLE, "left")
    before = before.select(*TABLE, F.struct("columns", "rows", "confidence", F.filter(F.split("checks", ","), lambda c: c != "").alias("findings")).alias("geometric"))
    new = taken.select(*TABLE, F.lit(True).alias("reviewed"), F.col("model").alias("read_by"), said("table", "$.title").alias("said_title"))
    judged = confidence.assess(columns, found).join(titles, TABLE, "left").join(new, TABLE, "left").join(before, TABLE, "left")
    judged = judged.withColumns({"title": F.coalesce("said_title", "own_title"), "reviewed": F.coalesce("reviewed", F.lit(False)), "rows_are_ruled": F.coalesce("rows_are_ruled", F.lit(False))}).drop("said_title", "own_title")
    return replace(
        got, columns=columns, rows=table_rows, cells=table_cells, footnotes=table_notes, targets=table_targets, findings=found, assessments=judged, ambiguities=merged(got.ambiguities, _doubts(parts, real, headed, cells)).unionByName(unsure),
        pages=merged(got.pages, pages), outcomes=outcomes, rejected=parts["rejected"],
    )


def _doubts(parts: dict[str, DataFrame], rows: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """The answers' own doubts that still stand, how many are settled by now, and what was left out and why."""
    written = cells.where(F.col("value").rlike("(?i)[a-z]{3}")).select(*TABLE, F.col("value").alias("label"))
    names = columns.select(*TABLE, F.explode(F.array_compact(F.concat(F.array("label"), F.split("path", " / ")))).alias("label")).unionByName(columns.where("path is null").select(*TABLE, "label"))
    named = (T.nonempty(F.col("label")).isNotNull() & ~F.col("label").rlike(r"(?i)^column \d+$")) | F.col("path").isNotNull()
    done = cut(reconcile.settled(parts["doubts"], rows.select(*TABLE, "label").unionByName(written).unionByName(names), columns.select(*TABLE, F.col("said_id").alias("id"), named.alias("named"))))
    row = lambda df, kind, detail: df.select(*TABLE, F.lit(None).cast("int").alias("page"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    left = parts["doubts"].join(done.select(*TABLE, "note_ix"), [*TABLE, "note_ix"], "left_anti")
    n_done = done.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"))
    bad = parts["rejected"].where("reason = 'not-printed'").groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"), F.slice(F.transform(F.sort_array(F.collect_list(F.struct("path", "shown"))), lambda b: b["shown"]), 1, 6).alias("first"))
    told = F.concat("n", F.lit(" value(s) of the second reading aren't printed on the pages and were left out: "), F.array_join("first", ", "), F.when(F.col("n") > 6, ", ...").otherwise(""))
    settled = F.concat("n", F.lit(" doubt(s) of the second reading are settled by what is read now"))
    return row(left, "second-reading", F.col("note")).unionByName(row(n_done, "settled", settled)).unionByName(row(bad, "not-printed", told))
