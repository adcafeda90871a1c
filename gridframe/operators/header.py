"""Headers: which lines stand over a grid, how their words fall to bands, and what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import geometry as G
from gridframe.operators import columns as K
from gridframe.operators.columns import role_of


def place_words(words: DataFrame, bands: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Words of a row to their nearest bands; the texts of a band are joined from left to right."""
    placed = G.nearest_band(words.withColumn("centre", F.col("x") + F.col("w") / 2), bands, keys)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("x", "word_ix", "text"))), lambda s: s["text"])
    return placed.groupBy(*keys, *by, "band_ix").agg(T.clean(F.array_join(texts, " ")).alias("text"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))


def continue_headings(pieces: DataFrame, headings: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Headings with the phrases of a continuation line: each phrase goes to the heading whose extent is nearest, if
    that is within ``reach``; a hyphen at the break joins without a space.
    """
    gap = F.greatest(F.lit(0.0), F.col("x0") - F.col("hx1"), F.col("hx0") - F.col("x1"))
    heads = headings.select(*keys, "head_ix", F.col("text").alias("head"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"))
    near = pieces.join(heads, keys).groupBy(*keys, "piece_ix", "text").agg(F.min(F.struct(gap.alias("gap"), "head_ix")).alias("near")).where(F.col("near.gap") <= reach)
    more = near.groupBy(*keys, F.col("near.head_ix").alias("head_ix")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_ix", "text"))), lambda s: s["text"]), " ").alias("more"))
    joined = headings.join(more, [*keys, "head_ix"], "left")
    return joined.select(*keys, "head_ix", F.when(F.col("more").isNull(), F.col("text")).otherwise(T.join_wrapped(F.col("text"), F.col("more"))).alias("text"), "x0", "x1")


def header_lines(lines: DataFrame, reach: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of a page's header: those above the first data row and below the grid's top edge, and, going up from
    there, lines that follow within 1.5 line heights and whose words reach half of the bands.

    ``lines``: line_ix, top, bottom, height, n_bands (bands its words reach); ``reach``: first_y, top_edge (or null),
    bands.
    """
    above = lines.join(reach, keys).where(F.col("bottom") <= F.col("first_y") + 1)
    inside = F.col("top_edge").isNull() | (F.col("top") >= F.col("top_edge") - 1)
    up = Window.partitionBy(*keys).orderBy(F.desc("top"))
    gap = F.lag("top").over(up) - F.col("bottom")
    joins = (F.coalesce(gap, F.col("first_y") - F.col("bottom")) <= 1.5 * F.col("height")) & (2 * F.col("n_bands") >= F.col("bands"))
    stopped = F.max((~(inside & F.col("top_edge").isNotNull()) & ~joins).cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0))
    return above.withColumn("stopped", stopped).where("stopped = 0").where(~F.col("text").rlike(T.PAGE_FURNITURE)).drop("stopped")


#: A word of a header line, and the value of a band in a header row.
WORD = "struct<x:double,w:double,h:double,text:string,band:int>"
VALUE = "struct<band:int,text:string,x0:double,x1:double>"
ENTRY = f"struct<label:string,cell:int,top:double,bottom:double,values:array<{VALUE}>>"


def is_raised(text: Column, h: Column, body: Column) -> Column:
    """A footnote marker beside a word: short, and at most three quarters of the line's height."""
    return (F.length(text) <= 2) & (h <= 0.75 * body)


def folded(words: Column, body: Column) -> Column:
    """Words of a line from left to right, with raised markers added to the word before, a space between them, if they
    begin within two heights of its end.
    """

    def step(out: Column, w: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        onto = F.coalesce(is_raised(w["text"], w["h"], body) & (w["x"] - (last["x"] + last["w"]) < 2 * body), F.lit(False))
        grown = F.struct(last["x"].alias("x"), F.greatest(last["w"], w["x"] + w["w"] - last["x"]).alias("w"), last["h"].alias("h"), F.concat_ws(" ", last["text"], w["text"]).alias("text"))
        new = F.struct(w["x"].alias("x"), w["w"].alias("w"), w["h"].alias("h"), w["text"].alias("text"))
        return F.when(onto, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(new)))

    return F.aggregate(words, F.array().cast("array<struct<x:double,w:double,h:double,text:string>>"), step)


def placed(values: Column, words: Column) -> Column:
    """Values with the words of further text, each in its own band."""

    def step(out: Column, w: Column) -> Column:
        here = F.exists(out, lambda v: v["band"] == w["band"])
        grown = F.transform(out, lambda v: F.when(v["band"] == w["band"], F.struct(v["band"].alias("band"), F.concat_ws(" ", v["text"], T.clean(w["text"])).alias("text"), F.least(v["x0"], w["x"]).alias("x0"), F.greatest(v["x1"], w["x"] + w["w"]).alias("x1")).cast(VALUE)).otherwise(v))
        new = F.struct(w["band"].alias("band"), T.clean(w["text"]).alias("text"), w["x"].alias("x0"), (w["x"] + w["w"]).alias("x1")).cast(VALUE)
        return F.when(here, grown).otherwise(F.concat(out, F.array(new)))

    return F.aggregate(words, values, step)


def continued(values: Column, words: Column, reach: Column) -> Column:
    """Values with a line that continues them: its words make phrases (gaps of at most 0.3 of ``reach``), and a phrase
    goes to the value whose extent, before the line, is nearest to where it begins (the middle of a single word), the
    first of equals; one that is further than ``reach`` from all is placed by its words' bands.
    """
    kind = f"array<struct<words:array<{WORD}>,x0:double,x1:double>>"

    def gather(out: Column, w: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        near = F.coalesce(w["x"] - last["x1"] <= 0.3 * reach, F.lit(False))
        grown = F.struct(F.concat(last["words"], F.array(w)).alias("words"), last["x0"].alias("x0"), F.greatest(last["x1"], w["x"] + w["w"]).alias("x1"))
        new = F.struct(F.array(w).alias("words"), w["x"].alias("x0"), (w["x"] + w["w"]).alias("x1"))
        return F.when(near, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(new)))

    def add(out: Column, p: Column) -> Column:
        begins = F.when(F.size(p["words"]) > 1, p["x0"]).otherwise(F.get(p["words"], F.lit(0))["x"] + F.get(p["words"], F.lit(0))["w"] / 2)
        gaps = F.transform(values, lambda v, i: F.struct(F.greatest(F.lit(0.0), v["x0"] - begins, begins - v["x1"]).alias("gap"), i.alias("at")))

        def to(best: Column) -> Column:
            joined = F.transform(
                out,
                lambda v, i: F.when(
                    i == best["at"],
                    F.struct(v["band"].alias("band"), F.aggregate(p["words"], v["text"], lambda t, w: T.join_wrapped(t, T.clean(w["text"]))).alias("text"), F.least(v["x0"], p["x0"]).alias("x0"), F.greatest(v["x1"], p["x1"]).alias("x1")).cast(VALUE),
                ).otherwise(v),
            )
            return F.when(best["gap"] > reach, placed(out, p["words"])).otherwise(joined)

        return F.get(F.transform(F.array(F.array_min(gaps)), to), F.lit(0))

    found = F.aggregate(F.aggregate(words, F.array().cast(kind), gather), values, add)
    return F.when(F.size(values) == 0, values).otherwise(found)


def header_rows(lines: Column, ruled: Column, reach: Column) -> Column:
    """Header rows (``ENTRY``) of a page's header lines in order (label, cell, top, bottom, words).

    Lines in one drawn cell are one row, and on pages without drawn cells a line without a caption continues the row
    above.  Within a drawn cell of a ruled grid words go to their own bands, else to the nearest heading.  A caption may
    come with a later line of its row.  A line that begins a row reaches two bands, or is passed over.
    """

    def step(s: Column, l: Column) -> Column:
        last, n = F.get(s, F.size(s) - 1), F.size(s)
        same = F.coalesce((n > 0) & l["cell"].isNotNull() & (l["cell"] == last["cell"]), F.lit(False))
        joins = same | ((l["label"] == "") & (n > 0) & l["cell"].isNull())
        values = F.when(same & ruled, placed(last["values"], l["words"])).otherwise(continued(last["values"], l["words"], reach))
        longer = F.struct(F.when(last["label"] == "", l["label"]).otherwise(last["label"]).alias("label"), last["cell"].alias("cell"), last["top"].alias("top"), F.greatest(last["bottom"], l["bottom"]).alias("bottom"), values.alias("values")).cast(ENTRY)
        new = F.struct(l["label"].alias("label"), l["cell"].alias("cell"), l["top"].alias("top"), l["bottom"].alias("bottom"), placed(F.array().cast(f"array<{VALUE}>"), l["words"]).alias("values")).cast(ENTRY)
        enough = F.size(F.array_distinct(F.transform(l["words"], lambda w: w["band"]))) >= 2
        return F.when(joins, F.concat(F.slice(s, 1, F.greatest(n - 1, F.lit(0))), F.array(longer))).when(enough, F.concat(s, F.array(new))).otherwise(s)

    return F.aggregate(lines, F.array().cast(f"array<{ENTRY}>"), step)


def cells_of(rules: DataFrame, extent: DataFrame, keys: list[str]) -> DataFrame:
    """The heights of the lines drawn over a page's grid, where there are three or more: the edges of header cells."""
    above = rules.where("orient = 'H'").join(extent, keys).where(F.col("pos") < F.col("first_y") + 2)
    return above.groupBy(*keys).agg(F.array_sort(F.collect_set(F.floor(F.col("pos") + 0.5).cast("double"))).alias("edges")).where("size(edges) >= 3")


def read_header(words: DataFrame, lines: DataFrame, bands: DataFrame, left: DataFrame, rules: DataFrame, extent: DataFrame, keys: list[str]) -> DataFrame:
    """Header values: row_ix, caption, role, band_ix and value, with the extents of the text and of the row.

    ``lines`` are a page's header lines with their words' numbers; words left of the grid are the row's caption, if
    they name a dimension of the columns.  ``extent`` has first_y of each page.
    """
    by_line = [*keys, "line_ix"]
    own = words.drop("top", "bottom").join(lines.select(*by_line, "top", "bottom"), by_line).join(left, keys)
    is_label = F.col("x") + F.col("w") <= F.col("grid_left") + 2
    word = F.struct(F.col("x").cast("double").alias("x"), "word_ix", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"), "text")
    shaped = own.groupBy(*by_line, "top", "bottom").agg(F.max("h").alias("body"), F.sort_array(F.collect_list(F.when(~is_label, word))).alias("ws"), F.sort_array(F.collect_list(F.when(is_label, F.struct("x", "text")))).alias("ls"), F.sort_array(F.collect_list(F.struct("y", "h", "text"))).alias("every"))
    caption = T.clean(F.array_join(F.transform("ls", lambda s: s["text"]), " "))
    ordinary = F.filter("every", lambda w: ~is_raised(w["text"], w["h"], F.col("body")))
    shaped = shaped.withColumn("label", F.when(K.names_dimension(caption), caption).otherwise("")).withColumn("row_top", F.coalesce(F.array_min(F.transform(ordinary, lambda w: w["y"])), F.col("top")).cast("double"))
    each = shaped.select(*by_line, "label", "row_top", "bottom", F.posexplode(folded(F.col("ws"), F.col("body"))).alias("word_ix", "f"))
    each = each.select(*by_line, "label", "row_top", "bottom", "word_ix", "f.*").withColumn("centre", F.col("x") + F.col("w") / 2)
    hit = G.nearest_band(each.select(*by_line, "word_ix", "centre"), bands, keys).select(*by_line, "word_ix", "band_ix")
    met = each.join(hit, [*by_line, "word_ix"])
    placed_words = met.groupBy(*by_line, "label", "row_top", "bottom").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "word_ix", "w", "h", "text", F.col("band_ix").cast("int").alias("band")))), lambda w: F.struct(w["x"].alias("x"), w["w"].alias("w"), w["h"].alias("h"), w["text"].alias("text"), w["band"].alias("band"))).alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("edges") - 2), lambda i: (F.col("row_top") >= F.get("edges", i) - 2) & (F.col("row_top") < F.get("edges", i + 1) - 2))
    celled = placed_words.join(cells_of(rules, extent, keys), keys, "left").withColumn("cell", F.when(F.col("edges").isNotNull(), F.get(at, F.lit(0))))
    line = F.struct("line_ix", "label", "cell", F.col("row_top").alias("top"), F.col("bottom").cast("double").alias("bottom"), "words")
    page = celled.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    shape = bands.groupBy(*keys).agg(F.bool_and("ruled").alias("ruled"), F.when(F.count(F.lit(1)) > 1, (F.max("centre") - F.min("centre")) / (F.count(F.lit(1)) - 1)).otherwise(40.0).alias("reach"))
    # Exploded from the fold's result, so that the programme runs once for a page.
    rows = page.join(shape, keys).select(*keys, F.posexplode(header_rows(F.col("lines"), F.col("ruled"), F.col("reach"))).alias("row_ix", "e"))
    numeric = F.forall("e.values", lambda v: v["text"].rlike(r"(?i)^\d{1,3}[a-z]?$"))
    named = rows.select(*keys, "row_ix", F.col("e.label").alias("caption"), role_of(F.col("e.label"), numeric).alias("role"), F.col("e.top").alias("top"), F.col("e.bottom").alias("bottom"), F.explode("e.values").alias("v"))
    return named.select(*keys, "row_ix", "caption", "role", F.col("v.band").alias("band_ix"), F.col("v.text").alias("value"), F.col("v.x0").alias("x0"), F.col("v.x1").alias("x1"), "top", "bottom")


def spread(values: DataFrame, bands: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Header values on all bands that their headings stand over: drawn cells first, where a row's vertical rules make
    as many as it has headings; else runs of bands that the headings are centred over; else the bands that a sparse
    row's texts cover.  Values of other rows stay where they are.
    """
    by_row = [*keys, "row_ix"]
    heads = values.select(*by_row, F.col("band_ix").alias("head_ix"), F.col("value").alias("text"), "x0", "x1", "top", "bottom")
    rows = heads.groupBy(*by_row).agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("n_heads"))
    over = bands.join(rows.select(*by_row), keys).select(*by_row, "band_ix", "centre")
    crossing = rules.where("orient = 'V'").select(*keys, "pos", "lo", "hi").join(rows, keys).where((F.col("lo") <= F.col("top") + 2) & (F.col("hi") >= F.col("bottom") - 2))
    edges = crossing.groupBy(*by_row, "n_heads").agg(G.anchored_edges(F.collect_list("pos")).alias("edges")).where("size(edges) >= 3 and size(edges) - 1 >= n_heads")
    cells = edges.select(*by_row, F.explode(F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct(F.get("edges", i - 1).alias("l"), F.get("edges", i).alias("r")))).alias("c")).select(*by_row, F.col("c.l").alias("cell_left"), F.col("c.r").alias("cell_right"))
    ruled = K.ruled_spans(heads, cells, over, by_row).withColumn("how", F.lit(0))
    centred = K.centred_spans(heads, over, by_row).withColumn("how", F.lit(1))
    sparse = K.sparse_spans(heads, over, by_row).drop("inferred").withColumn("how", F.lit(2))
    own = heads.select(*by_row, "head_ix", "text", F.col("head_ix").alias("band_ix"), F.lit(3).alias("how"))
    every = ruled.unionByName(centred).unionByName(sparse).unionByName(own)
    best = F.min("how").over(Window.partitionBy(*by_row))
    picked = every.withColumn("best", best).where("how = best").groupBy(*by_row, "band_ix").agg(F.min_by("text", "head_ix").alias("value"))
    told = values.groupBy(*by_row).agg(F.first("caption").alias("caption"), F.first("role").alias("role"))
    return picked.join(told, by_row).select(*by_row, "caption", "role", "band_ix", "value")
