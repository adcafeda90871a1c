"""Columns: drawn bands, roles of header rows, spans of headings, continuation over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import geometry as G

#: Role and the caption it goes by, in the order in which they are tried.
ROLES = [
    ("visitNumber", r"(?i)^(visit\s*(number|no\.?|#)|visit$)"),
    ("studyDay", r"(?i)^(study\s+)?days?($|[^a-z])"),
    ("studyWeek", r"(?i)^(study\s+|activity\s+)?weeks?($|[^a-z])"),
    ("studyMonth", r"(?i)^(study\s+)?months?($|[^a-z])"),
    ("window", r"(?i)^(visit\s+)?window"),
    ("visitName", r"(?i)^(visit\s+name|visits|timepoint|time\s+point)"),
    ("period", r"(?i)^(study\s+)?(period|phase|stage)"),
    ("cycle", r"(?i)^cycles?($|[^a-z])"),
]

DIMENSION = r"(?i)(^|[^A-Za-z0-9_])(visits?|days?|weeks?|months?|windows?|periods?|phases?|cycles?|timepoints?|hours?)([^A-Za-z0-9_]|$)"


def first_words(label: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(T.clean(label), " "), 1, n), " ")


def role_of(label: Column, numeric: Column) -> Column:
    """The role of a header row by its caption; "Visits" over numbers alone counts visits."""
    out = F.lit(None).cast("string")
    for role, pattern in reversed(ROLES):
        out = F.when(first_words(label).rlike(pattern), F.lit(role)).otherwise(out)
    return F.when((out == "visitName") & T.norm(label).startswith("visits") & numeric, "visitNumber").otherwise(out)


def names_dimension(label: Column) -> Column:
    return first_words(label).rlike(DIMENSION)


def drawn_columns(rules: DataFrame, extent: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """Bands between vertical rules that cover ``share`` of the data rows' height (pieces within 3 are one rule).

    ``extent`` has top, bottom and grid_left of each page; bands that end within 2 of the grid's left are labels'.
    """
    pieces = rules.where("orient = 'V'").join(extent, keys)
    sorted_at = pieces.groupBy(*keys).agg(G.first_fit_keys(F.transform(F.sort_array(F.collect_list(F.struct("rule_ix", "pos"))), lambda p: p["pos"])).alias("lines"))
    near = pieces.join(sorted_at, keys).withColumn("line", F.get(F.filter("lines", lambda k: F.abs(k - F.col("pos")) <= 3), F.lit(0)))
    clipped = near.withColumn("lo", F.greatest("lo", "top")).withColumn("hi", F.least("hi", "bottom")).where("hi > lo")
    spanning = G.interval_cover(clipped, [*keys, "line", "top", "bottom", "grid_left"], "lo", "hi").where(F.col("covered") >= share * (F.col("bottom") - F.col("top")))
    edges = spanning.groupBy(*keys, "grid_left").agg(G.anchored_edges(F.collect_list("line")).alias("edges")).where("size(edges) >= 3")
    bands = edges.select(*keys, "grid_left", F.explode(F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct(F.get("edges", i - 1).alias("left"), F.get("edges", i).alias("right")))).alias("b"))
    bands = bands.where(F.col("b.right") > F.col("grid_left") + 2).select(*keys, "b.left", "b.right", ((F.col("b.left") + F.col("b.right")) / 2).alias("centre"))
    ix = F.row_number().over(Window.partitionBy(*keys).orderBy("left")) - 1
    return bands.withColumn("band_ix", ix).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("n >= 2").drop("n")


def choose_bands(drawn: DataFrame, inferred: DataFrame, keys: list[str]) -> DataFrame:
    """A page's drawn bands where it has them, else those of its marks."""
    cols = [*keys, "band_ix", "left", "right", "centre"]
    return drawn.select(*cols, F.lit(True).alias("ruled")).unionByName(inferred.join(drawn.select(*keys).distinct(), keys, "left_anti").select(*cols, F.lit(False).alias("ruled")))


def header_pivot(values: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of each column from header values (row_ix, role, band_ix, value): the first of each role; what has no
    role goes to the path, a period before it; the label is the first of name, number, period, heading, or a number.
    """
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("value")), F.when(F.col("role") == role, F.col("row_ix")))
    free = F.transform(F.sort_array(F.collect_list(F.when(F.col("role").isNull(), F.struct("row_ix", "value")))), lambda s: s["value"])
    facts = values.groupBy(*keys, "band_ix").agg(
        first("visitNumber").alias("visit_number"), first("studyDay").alias("study_day"), first("studyWeek").alias("study_week"), first("window").alias("visit_window"), first("visitName").alias("visit_name"),
        first("period").alias("period"), free.alias("free"),
    )
    path = F.concat(F.when(F.col("period").isNotNull(), F.array("period")).otherwise(F.array().cast("array<string>")), F.col("free"))
    label = T.nonempty(F.col("visit_name"), F.col("visit_number"), F.col("period"), F.get("free", F.lit(0)), F.concat(F.lit("Column "), F.col("band_ix") + 1))
    return facts.select(*keys, "band_ix", "visit_number", "study_day", "study_week", "visit_window", label.alias("label"), F.array_join(path, " / ").alias("path"))


def spacers(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Places where two bands lie over 1.6 times the first pitch apart: a column may be missing there."""
    by = Window.partitionBy(*keys).orderBy("band_ix")
    steps = bands.withColumn("step", F.col("centre") - F.lag("centre").over(by))
    pitch = F.first("step", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return steps.withColumn("pitch", pitch).where(F.col("step") > 1.6 * F.col("pitch")).select(*keys, "band_ix", "step", "pitch")


def ruled_spans(heads: DataFrame, cells: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Headings in drawn header cells cover all bands whose centre lies in the cell that holds the heading's middle."""
    mid = (F.col("x0") + F.col("x1")) / 2
    held = heads.join(cells, keys).where((mid >= F.col("cell_left")) & (mid < F.col("cell_right")))
    return held.join(bands, keys).where((F.col("centre") >= F.col("cell_left")) & (F.col("centre") < F.col("cell_right"))).select(*keys, "head_ix", "text", "band_ix")


def sparse_spans(heads: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Headings that cover several centres, or a word, among few: covered bands, else the nearest (inferred)."""
    joined = heads.join(bands, keys)
    inside = (F.col("centre") >= F.col("x0")) & (F.col("centre") <= F.col("x1"))
    covered = joined.where(inside).select(*keys, "head_ix", "text", "band_ix", F.lit(False).alias("inferred"))
    n = joined.groupBy(*keys, "head_ix", "text").agg(F.count_if(inside).alias("n"), F.min(F.struct(F.abs(F.col("centre") - (F.col("x0") + F.col("x1")) / 2).alias("gap"), "band_ix")).alias("near"))
    useful = n.groupBy(*keys).agg(F.bool_or((F.col("n") >= 2) | (F.length("text") >= 4)).alias("useful")).where("useful").select(*keys)
    nearest = n.where("n = 0").select(*keys, "head_ix", "text", F.col("near.band_ix").alias("band_ix"), F.lit(True).alias("inferred"))
    return covered.unionByName(nearest).join(useful, keys, "left_semi")


def centred_spans(heads: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Headings centred over runs of bands: the cheapest ordered partition, if each run's middle is within half a
    pitch of its heading's.
    """
    h = heads.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("head_ix", ((F.col("x0") + F.col("x1")) / 2).alias("mid"), "text"))).alias("hs"))
    b = bands.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("band_ix", "centre"))), lambda s: s["centre"]).alias("cs"))
    # Exploded from an array of one, so that the programme runs once and isn't copied to where its result is named.
    got = h.join(b, keys).where("size(cs) >= size(hs)").select(*keys, "hs", "cs", F.explode(F.array(G.ordered_partition(F.transform("hs", lambda s: s["mid"]), F.col("cs"))["ends"])).alias("ends"))
    got = got.withColumn("pitch", F.coalesce(F.get("cs", F.lit(1)) - F.get("cs", F.lit(0)), F.lit(0.0)))
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1))
    middle = lambda i: (F.get("cs", begin(i)) + F.get("cs", F.get("ends", i) - 1)) / 2
    fits = F.forall(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.abs(middle(i) - F.get("hs", i)["mid"]) <= 0.5 * F.col("pitch"))
    runs = got.where(fits).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.struct(F.get("hs", i)["head_ix"].alias("head_ix"), F.get("hs", i)["text"].alias("text"), begin(i).alias("a"), F.get("ends", i).alias("b")))).alias("r"))
    return runs.select(*keys, "r.head_ix", "r.text", F.explode(F.sequence(F.col("r.a"), F.col("r.b") - 1)).alias("band_ix"))


def column_key(number: Column, day: Column, week: Column, label: Column) -> Column:
    """What makes columns of two pages the same: number, day and week, else a label of at most 14 signs."""
    facts = T.label_key(F.concat_ws("|", number, day, week))
    short = F.when((F.length(label) <= 14) & ~T.label_key(label).rlike("^column[0-9]+$"), T.nonempty(T.label_key(label)))
    return F.coalesce(T.nonempty(facts), short)


def continue_columns(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of later pages take the id of the column they continue.

    ``columns``: ord, id, page, key, width, centre, pitch, in order.  By key among other pages' columns, the first;
    without a key by the nearest centre within half a pitch on pages of the same width; else a new column.
    """
    cs = columns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "id", "page", "key", "width", "centre", "pitch"))).alias("cs"))
    kind = "array<struct<id:string,page:int,key:string,width:double,centre:double>>"
    start = F.struct(F.array().cast(kind).alias("known"), F.array().cast("array<string>").alias("of"))

    def step(state: Column, c: Column) -> Column:
        same = F.filter(state["known"], lambda k: (k["page"] != c["page"]) & (k["key"] == c["key"]))
        near = F.filter(state["known"], lambda k: (k["page"] != c["page"]) & c["key"].isNull() & (k["width"] == c["width"]) & (F.abs(k["centre"] - c["centre"]) <= 0.5 * c["pitch"]))
        best = F.array_min(F.transform(near, lambda k: F.struct(F.abs(k["centre"] - c["centre"]).alias("gap"), k["id"].alias("id"))))["id"]
        found = F.coalesce(F.get(same, F.lit(0))["id"], best)
        new = F.struct(c["id"].alias("id"), c["page"].alias("page"), c["key"].alias("key"), c["width"].alias("width"), c["centre"].alias("centre"))
        return F.struct(F.when(found.isNull(), F.concat(state["known"], F.array(new))).otherwise(state["known"]).alias("known"), F.concat(state["of"], F.array(F.coalesce(found, c["id"]))).alias("of"))

    got = cs.withColumn("of", F.aggregate("cs", start, step, lambda s: s["of"]))
    return got.select(*keys, F.explode(F.arrays_zip("cs", "of")).alias("z")).select(*keys, F.col("z.cs.id").alias("own_id"), F.col("z.of").alias("id"), F.col("z.cs.page").alias("page"))


def prune_empty(columns: DataFrame, cells: DataFrame, keys: list[str], drop_unnamed: bool = False) -> DataFrame:
    """Columns without those that are ruled, have no name and no cell; with ``drop_unnamed``, ruled or not."""
    nameless = F.col("label").rlike(r"^Column \d+$") & F.col("visit_number").isNull() & F.col("study_day").isNull() & F.col("study_week").isNull() & F.col("visit_window").isNull()
    used = cells.select(*keys, F.col("col_id").alias("id")).distinct().withColumn("used", F.lit(True))
    return columns.join(used, [*keys, "id"], "left").where(~(F.col("used").isNull() & nameless & (F.col("ruled") | F.lit(drop_unnamed)))).drop("used")


def divide(cells: DataFrame, dividers: DataFrame, keys: list[str]) -> DataFrame:
    """Cells without those under a vertical word: all of a column without a timepoint, else its single letters."""
    joined = cells.join(dividers, [*keys, "col_id"], "left")
    return joined.where(F.col("timed").isNull() | (F.col("timed") & ~F.col("value").rlike(r"^[A-WYZa-wyz](\s+[A-WYZa-wyz])*$"))).select(*cells.columns)
