"""Publishing: long relations to the nested table schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators.tables import Tables

KEYS = ["doc_id", "cand"]

#: Markers of notes about the table, words and a legend's marks.
WORD, LEGEND = r"(?i)^[a-z][a-z0-9 /-]+$", r"(?i)^[x✓✔●•◆■]$"


def columns(raw: DataFrame) -> DataFrame:
    """Columns with defaults; blank facts are null."""
    blank = lambda c: T.nonempty(T.clean(F.coalesce(F.col(c), F.lit(""))))
    return raw.select(
        *KEYS, "ord", T.nonempty(F.col("id"), F.concat(F.lit("c"), F.col("ord"))).alias("id"), F.coalesce(blank("label"), F.lit("")).alias("label"), *[blank(c).alias(c) for c in ("visit_number", "study_day", "study_week", "visit_window")],
        F.coalesce("divider", F.lit(False)).alias("divider"),
    )


def rows(raw: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "category", "category").otherwise("assessment")
    return raw.select(*KEYS, "ord", T.nonempty(F.col("id"), F.concat(F.lit("r"), F.col("ord"))).alias("id"), kind.alias("kind"), T.clean(F.coalesce("label", F.lit(""))).alias("label"), T.nonempty(F.col("category")).alias("category"))


def footnotes(raw: DataFrame) -> DataFrame:
    """A footnote is a note if it is linked to nothing and its marker is a word or a legend's mark; it is continued if
    it says so or stands on several pages.
    """
    note = (F.col("n_targets") == 0) & (F.col("marker").rlike(WORD) | F.col("marker").rlike(LEGEND))
    return raw.select(*KEYS, "ord", "marker", T.nonempty(F.col("printed"), F.col("marker")).alias("printed"), F.when(note, "note").otherwise("footnote").alias("kind"), T.clean(F.col("text")).alias("text"), (F.coalesce("continued", F.lit(False)) | (F.col("n_pages") > 1)).alias("continued"))


def merge_footnotes(raw: DataFrame) -> DataFrame:
    """One footnote per marker in small letters: texts that aren't contained yet are added, in order."""
    rows_ = raw.groupBy(*KEYS, F.lower("marker").alias("marker")).agg(F.sort_array(F.collect_list(F.struct("ord", "text", "pages"))).alias("ns"))
    text = F.aggregate("ns", F.lit(""), lambda a, n: F.when(a == "", n["text"]).when(a.contains(n["text"]), a).otherwise(F.concat_ws(" ", a, n["text"])))
    return rows_.select(*KEYS, "marker", F.get("ns", F.lit(0))["ord"].alias("ord"), text.alias("text"), F.array_sort(F.array_distinct(F.flatten(F.transform("ns", lambda n: n["pages"])))).alias("pages"))


def linked_footnotes(got: Tables) -> DataFrame:
    """The footnotes of each table as they are published, one for each marker in small letters: kind, pages, whether it
    is continued, and what it applies to (the whole table, if nothing else).
    """
    low = F.lower("marker")
    to = F.struct("target", T.nonempty(F.col("row_id")).alias("row"), T.nonempty(F.col("col_id")).alias("col"))
    linked = got.targets.where("target != 'table'").groupBy(*KEYS, low.alias("marker")).agg(F.array_sort(F.collect_set(to)).alias("to"))
    pages = F.filter(F.transform(F.split(F.coalesce("pages", F.lit("")), ","), lambda p: p.try_cast("int")), lambda p: p.isNotNull())
    raw = got.footnotes.withColumn("printed", F.col("marker")).withColumn("marker", low).withColumn("page_list", pages).join(linked, [*KEYS, "marker"], "left")
    raw = raw.withColumns({"n_targets": F.coalesce(F.size("to"), F.lit(0)), "n_pages": F.size("page_list")})
    raw = raw.withColumn("n_targets", F.greatest("n_targets", F.lit(0)))
    shaped = footnotes(raw).select(*KEYS, "ord", "marker", "printed", "kind", "continued")
    first = shaped.groupBy(*KEYS, "marker").agg(F.min_by(F.struct("printed", "kind", "continued"), "ord").alias("f"))
    merged = merge_footnotes(raw.select(*KEYS, "ord", "marker", T.clean(F.col("text")).alias("text"), F.col("page_list").alias("pages")))
    whole = F.array(F.struct(F.lit("table").alias("target"), F.lit(None).cast("string").alias("row"), F.lit(None).cast("string").alias("col")))
    out = merged.join(first, [*KEYS, "marker"]).join(linked, [*KEYS, "marker"], "left")
    return out.select(*KEYS, "ord", "marker", "f.printed", "f.kind", "text", "pages", (F.col("f.continued") | (F.size("pages") > 1)).alias("continued"), F.coalesce("to", whole).alias("appliesTo"))


def published_tables(got: Tables) -> DataFrame:
    """One row for each table, its parts nested as they are published."""
    listed = lambda df, name, *cols: df.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*cols).alias("v")))), lambda x: x["v"]).alias(name))
    marks = lambda target, key: got.targets.where(F.col("target") == target).groupBy(*KEYS, F.col(key).alias("id")).agg(F.sort_array(F.collect_set("marker")).alias("markers"))
    none = F.array().cast("array<string>")
    path = F.filter(F.split(F.coalesce("path", F.lit("")), " / "), lambda p: p != "")
    shaped = columns(got.columns).join(got.columns.select(*KEYS, "id", path.alias("path"), "page"), [*KEYS, "id"]).join(marks("column", "col_id"), [*KEYS, "id"], "left")
    pages = F.when(F.col("page").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.col("page").cast("int"))).alias("pages")
    cols = listed(shaped, "columns", "id", "label", "path", F.col("visit_number").alias("visitNumber"), F.col("study_day").alias("studyDay"), F.col("study_week").alias("studyWeek"), F.col("visit_window").alias("window"), F.coalesce("markers", none).alias("markers"), "divider", pages)
    order = got.columns.select(*KEYS, F.col("id").alias("col_id"), F.col("ord").alias("at"))
    cell = F.struct("at", F.struct(F.col("col_id").alias("col"), "value", "markers").alias("v"))
    cells = got.cells.join(order, [*KEYS, "col_id"], "left").groupBy(*KEYS, F.col("row_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["v"]).alias("cells"))
    own = rows(got.rows).join(marks("row", "row_id"), [*KEYS, "id"], "left").join(cells, [*KEYS, "id"], "left")
    rws = listed(own, "rows", "id", "kind", "label", "category", F.coalesce("markers", none).alias("markers"), F.coalesce("cells", F.array().cast(cells.schema["cells"].dataType)).alias("cells"))
    notes = listed(linked_footnotes(got), "footnotes", "marker", "printed", "kind", "text", "pages", "continued", "appliesTo")
    doubts = got.ambiguities.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "kind", "detail"))).alias("ambiguities"))
    found = got.findings.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("check", "severity", "detail"))).alias("findings"))
    read = got.pages.groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.col("page").cast("int"))).alias("pages"))
    base = got.assessments
    for name, kind in (("reviewed", "boolean"), ("read_by", "string"), ("geometric", "struct<columns:bigint,rows:bigint,confidence:double,findings:array<string>>"), ("locator_score", "double"), ("locator_evidence", "array<struct<page:int,score:double,reasons:array<string>>>")):
        base = base if name in base.columns else base.withColumn(name, F.lit(None).cast(kind))
    for part in (cols, rws, notes, doubts, found, read):
        base = base.join(part, KEYS, "left")
    empty = lambda df, name: F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
    provenance = F.struct(
        F.when(F.coalesce("reviewed", F.lit(False)), "review").otherwise("geometry").alias("readBy"), F.col("read_by").alias("model"), "confidence", "verdict", empty(found, "findings"), F.col("rows_are_ruled").alias("rowsAreRuled"), "geometric",
        F.col("locator_score").alias("locatorScore"), F.coalesce("locator_evidence", F.array().cast("array<struct<page:int,score:double,reasons:array<string>>>")).alias("locatorEvidence"),
    ).alias("provenance")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("cand"))
    return base.select(*KEYS, F.concat(F.lit("t"), place).alias("id"), "title", empty(read, "pages"), empty(cols, "columns"), empty(rws, "rows"), empty(notes, "footnotes"), empty(doubts, "ambiguities"), provenance)


def documents(got: Tables, at: str | None = None) -> DataFrame:
    """doc_id and ``value``, one JSON object for each document that was read, with tables or without: its tables, what
    a second reading came to, the lines of all pages that a table came from, and the pages' scores.
    """
    tabs = published_tables(got)
    names = tabs.select(*KEYS, F.col("id").alias("table"))
    nested = tabs.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("cand", F.struct("id", "title", "pages", "columns", "rows", "footnotes", "ambiguities", "provenance").alias("v")))), lambda x: x["v"]).alias("tables"))
    cited = source_lines(got.lines.select("doc_id", "page", "line_ix", "text"), got.pages.join(names, KEYS, "left_semi"))
    score = got.scores.where("score > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "score", "reasons"))).alias("pageScores"))
    out = got.page_counts.join(nested, "doc_id", "left").join(cited, "doc_id", "left").join(score, "doc_id", "left")
    if got.outcomes is not None:
        told = got.outcomes.join(names, KEYS, "left")
        review = told.groupBy("doc_id").agg(F.struct(F.coalesce(F.sum((F.col("attempts") > 0).cast("int")), F.lit(0)).alias("attempted"), F.array_sort(F.collect_list(F.struct("table", "outcome", "detail"))).alias("outcome")).alias("review"))
        out = out.join(review, "doc_id", "left")
    else:
        out = out.withColumn("review", F.lit(None).cast("struct<attempted:bigint,outcome:array<struct<table:string,outcome:string,detail:string>>>"))
    empty = lambda df, name: F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
    whole = F.struct(F.col("doc_id").alias("document"), F.col("n_pages").alias("pageCount"), "review", F.col("source_pages").alias("sourcePages"), empty(nested, "tables"), empty(score, "pageScores"), F.lit(at).alias("extractedAt"))
    return out.select("doc_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def source_lines(lines: DataFrame, cited: DataFrame) -> DataFrame:
    """The lines of cited pages, as a map from page to lines, for each document."""
    own = lines.join(cited.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    per = own.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_ix", "text"))), lambda l: l["text"]).alias("ls"))
    return per.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("page", "ls")))).alias("source_pages"))
