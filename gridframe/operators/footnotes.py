"""Footnotes: definitions, glossaries, segmentation, and what they apply to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions import text as T

#: Signs that are marks of a legend rather than markers.
LEGEND = ["x", "✓", "✔", "●", "•"]


def parse(line: Column) -> dict[str, Column]:
    """Marker (as printed and in small letters without brackets) and text of a definition; empty without one."""
    symbol, letter, body = F.regexp_extract(line, T.FOOTNOTE_DEF, 1), F.regexp_extract(line, T.FOOTNOTE_DEF, 3), F.regexp_extract(line, T.FOOTNOTE_DEF, 4)
    printed = F.when(symbol != "", symbol).otherwise(letter)
    return {"printed": printed, "marker": F.lower(F.regexp_replace(printed, "[()]", "")), "body": body, "on": F.trim(F.regexp_extract(line, T.FOOTNOTE_DEF, 2))}


def glossary(line: Column) -> tuple[Column, Column]:
    """Whether a line is a glossary (parts between semicolons that all read TOKEN = meaning; two or more if it has no
    label), and its label.
    """
    label = F.regexp_extract(line, T.GLOSSARY_LABEL, 0)
    rest = F.substr(line, F.length(label) + 1)
    parts = F.filter(F.transform(F.split(F.regexp_replace(rest, r"[.;]\s*$", ""), ";"), lambda p: F.trim(p)), lambda p: p != "")
    fits = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"^\S{1,20}(\s\S{1,20})?\s*=\s*\S"))
    return fits & ((label != "") | (F.size(parts) >= 2)), F.lower(F.regexp_replace(label, r"[:\s]+$", ""))


def segments(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Footnotes from a page's lines in order (line_ix, y, h, text; ``plausible``: the markers that the table uses).

    A line opens a footnote if its marker is plausible, a legend's, or follows the one before and has more than three
    signs; a glossary opens one without moving the sequence; other lines continue the open one.  A gap above 2.5
    heights, page furniture, or type over 0.5 larger ends the block.
    """
    p = parse(F.col("text"))
    is_glossary, label = glossary(F.col("text"))
    rows = lines.select(
        *keys, "plausible", F.struct("line_ix", "y", "h", "text", p["marker"].alias("marker"), p["printed"].alias("printed"), p["body"].alias("body"), (p["on"] != "").alias("legend"),
                                    is_glossary.alias("glossary"), label.alias("label"), F.col("text").rlike(T.PAGE_FURNITURE).alias("furniture")).alias("l")
    ).groupBy(*keys, "plausible").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    kind = "struct<notes:array<struct<marker:string,printed:string,text:string>>,seq:string,bottom:double,h:double,over:boolean>"
    start = F.struct(
        F.array().cast("array<struct<marker:string,printed:string,text:string>>").alias("notes"), F.lit("").alias("seq"), F.lit(None).cast("double").alias("bottom"), F.lit(None).cast("double").alias("h"), F.lit(False).alias("over")
    ).cast(kind)

    def step(s: Column, l: Column) -> Column:
        opens = (l["marker"] != "") & (
            F.array_contains(F.col("plausible"), l["marker"]) | l["legend"] | (T.follows(l["marker"], s["seq"]) & (F.length(l["body"]) > 3))
        )
        defines = l["glossary"] & (l["marker"] == "") | (l["glossary"] & ~opens)
        ends = F.coalesce((l["y"] - s["bottom"] > 2.5 * F.greatest(l["h"], F.lit(8.0))) | (l["h"] > s["h"] + 0.5), F.lit(False)) | l["furniture"]
        started = F.size(s["notes"]) > 0
        note = F.when(opens, F.struct(l["marker"].alias("marker"), l["printed"].alias("printed"), l["body"].alias("text"))).otherwise(
            F.struct(F.coalesce(T.nonempty(l["label"]), F.lit("glossary")).alias("marker"), F.coalesce(T.nonempty(l["label"]), F.lit("glossary")).alias("printed"), l["text"].alias("text"))
        )
        last = F.element_at(s["notes"], -1)
        longer = F.concat(F.slice(s["notes"], 1, F.greatest(F.size(s["notes"]) - 1, F.lit(0))), F.array(F.struct(last["marker"].alias("marker"), last["printed"].alias("printed"), T.join_wrapped(last["text"], l["text"]).alias("text"))))
        over = s["over"] | (started & ends)
        notes = F.when(over, s["notes"]).when(opens | defines, F.concat(s["notes"], F.array(note))).when(started, longer).otherwise(s["notes"])
        moved = ~over & (opens | defines | started)
        return F.struct(
            notes.alias("notes"), F.when(~over & opens, l["marker"]).otherwise(s["seq"]).alias("seq"), F.when(moved, l["y"] + l["h"]).otherwise(s["bottom"]).alias("bottom"),
            F.when(~over & (opens | defines), l["h"]).otherwise(s["h"]).alias("h"), over.alias("over"),
        )

    found = rows.select(*keys, F.posexplode(F.aggregate("ls", start, step, lambda s: s["notes"])).alias("ord", "n"))
    return found.select(*keys, "ord", "n.marker", "n.printed", T.clean(F.col("n.text")).alias("text"))


def plausible_markers(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Markers that the table's labels (whole = false) and cells (whole = true) end in or consist of."""
    trailing = F.regexp_extract("text", T.TRAILING, 1)
    spaced = F.regexp_extract("text", r"\s([a-z]{1,2}|\d{1,2}|[*†‡§¶#]{1,3})$", 1)
    whole = F.when(F.col("whole"), F.regexp_extract("text", r"^([A-Za-z]{1,2}|[*†‡§¶#]{1,3})$", 1))
    found = texts.select(*keys, F.explode(F.array(trailing, spaced, whole)).alias("m")).where("m is not null and m != ''")
    return found.select(*keys, F.lower("m").alias("marker")).distinct()


def merge_pages(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Footnotes of several pages: a marker is claimed once; again on its page, the text is added; on a later page a
    glossary is replaced by a longer one and others stay.  Pages spilled on make it continued.  One fold per table.
    """
    rows = notes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page", "ord", "marker", "text", "glossary"))).alias("ns"))
    kind = "array<struct<marker:string,page:int,text:string,pages:array<int>>>"

    def step(out: Column, n: Column) -> Column:
        at = F.array_position(F.transform(out, lambda o: o["marker"] == n["marker"]), True)
        new = F.struct(n["marker"].alias("marker"), n["page"].alias("page"), n["text"].alias("text"), F.array(n["page"]).alias("pages"))

        def change(o: Column, i: Column) -> Column:
            text = F.when(o["page"] == n["page"], T.join_wrapped(o["text"], n["text"])).when(n["glossary"] & (F.length(n["text"]) > F.length(o["text"])), n["text"]).otherwise(o["text"])
            return F.when(i + 1 == at, F.struct(o["marker"].alias("marker"), o["page"].alias("page"), text.alias("text"), F.array_union(o["pages"], F.array(n["page"])).alias("pages"))).otherwise(o)

        return F.when(at == 0, F.concat(out, F.array(new))).otherwise(F.transform(out, change))

    got = rows.select(*keys, F.posexplode(F.aggregate("ns", F.array().cast(kind), step)).alias("ord", "n"))
    return got.select(*keys, "ord", "n.marker", "n.text", F.array_join(F.transform("n.pages", lambda p: p.cast("string")), ",").alias("pages"), (F.size("n.pages") > 1).alias("continued"))


def dedupe(notes: DataFrame, keys: list[str]) -> DataFrame:
    """One footnote for each marker and beginning (60 small letters): the longest text, all pages."""
    return notes.groupBy(*keys, "marker", F.lower(F.substring("text", 1, 60)).alias("head")).agg(
        F.max(F.struct(F.length("text").alias("n"), "text")).alias("best"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages")
    ).select(*keys, "marker", F.col("best.text").alias("text"), "pages")


def escaped(marker: Column) -> Column:
    return F.regexp_replace(marker, r"([\\.*+?\[\](){}|^$#])", r"\\$1")


def marker_in(value: Column, marker: Column) -> Column:
    """Whether a cell's value carries the marker: alone, after a mark, in brackets, or right behind a mark or digit."""
    m = escaped(marker)
    return (
        F.regexp_like(value, F.concat(F.lit(r"^[Xx✓●•]\s*"), m, F.lit("$"))) | (value == marker) | value.contains(F.concat(F.lit("("), marker, F.lit(")")))
        | F.regexp_like(value, F.concat(F.lit(r"[Xx0-9]\s*"), m, F.lit(r"([^A-Za-z0-9_]|$)")))
    )


def links(cells: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and the known markers (no legend marks) that their values carry.  Markers of a table are few."""
    known = markers.where(~F.col("marker").isin(*LEGEND))
    return cells.join(known, keys).where(marker_in(F.col("value"), F.col("marker"))).select(*keys, "row_id", "col_id", "marker")


def applies_to(notes: DataFrame, row_links: DataFrame, cell_links: DataFrame, keys: list[str], column_links: DataFrame | None = None) -> DataFrame:
    """Targets of each footnote: rows, cells and columns; the whole table without any."""
    found = row_links.select(*keys, "marker", F.lit("row").alias("target"), "row_id", F.lit("").alias("col_id")).unionByName(cell_links.select(*keys, "marker", F.lit("cell").alias("target"), "row_id", "col_id"))
    if column_links is not None:
        found = found.unionByName(column_links.select(*keys, "marker", F.lit("column").alias("target"), F.lit("").alias("row_id"), "col_id"))
    joined = notes.select(*keys, "marker").distinct().join(found.distinct(), [*keys, "marker"], "left")
    return joined.select(*keys, "marker", F.coalesce("target", F.lit("table")).alias("target"), F.coalesce("row_id", F.lit("")).alias("row_id"), F.coalesce("col_id", F.lit("")).alias("col_id"))


def link_trailing(labels: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """Labels and column facts that end (or begin, before a space) in a known marker: the longest such marker."""
    ends = F.col("text").endswith(F.col("marker")) & (F.length("text") > F.length("marker")) & (~F.col("marker").rlike("^[a-z]") | F.regexp_like(F.col("text"), F.concat(F.lit(r"[^a-z]"), escaped(F.col("marker")), F.lit("$"))))
    begins = F.col("text").startswith(F.concat(F.col("marker"), F.lit(" ")))
    found = labels.join(markers, keys).where(ends | begins)
    return found.groupBy(*keys, "target", "id", "text").agg(F.max_by("marker", F.struct(F.length("marker"), "marker")).alias("marker"))
