"""Rows: marks, the split into label and grid, drawn rows, and what a row is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import geometry as G


def is_mark(word: Column) -> Column:
    """A cell's mark: short, of the token pattern, and without three letters in a row but for dosing words."""
    return (F.length(word) <= 14) & word.rlike(T.CELL_TOKEN) & (~word.rlike("[A-Za-z]{3,}") | word.rlike(T.WORDY_MARK))


def grid_left(words: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Where the grid of each page begins: the least left edge of the first stack of marks, from lines with two or
    more marks (a symbol at a line's start aside), of which there must be three; else the mark at 15 % of the sorted
    left edges.
    """
    first = F.row_number().over(Window.partitionBy(*keys, line).orderBy("x")) == 1
    marked = words.withColumn("mark", is_mark(F.col("text")) & ~(first & F.col("text").rlike("^[*†‡§¶#●•]$")))
    n = F.sum(F.col("mark").cast("int")).over(Window.partitionBy(*keys, line))
    marks = marked.withColumn("n", n).where("mark and n >= 2")
    enough = marks.groupBy(*keys).agg(F.count_distinct(line).alias("lines"), F.sort_array(F.collect_list("x")).alias("xs")).where("lines >= 3")
    stacks = G.mark_stacks(marks.withColumn("centre", F.col("x") + F.col("w") / 2), keys)
    lead = stacks.groupBy(*keys).agg(F.min_by("left", "stack_ix").alias("lead"))
    low = F.get("xs", F.floor(F.size("xs") * 0.15).cast("int"))
    return enough.join(lead, keys, "left").select(*keys, F.coalesce("lead", low).alias("grid_left"))


def split_words(words: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """Each word's part: label (it ends within 2 of the grid's left), mark or other."""
    part = F.when(F.col("grid_left").isNull() | (F.col("x") + F.col("w") <= F.col("grid_left") + 2), "label").when(is_mark(F.col("text")), "mark").otherwise("other")
    return words.join(left, keys, "left").withColumn("part", part)


def drawn_rows(rules: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """Row bands between horizontal rules that span half of the grid: edges more than 3 apart, four or more; an end
    band is cut when it is over 1.2 times the tallest other (14 at least) and lies over 10 outside the box.
    """
    wide = rules.join(left, keys).where((F.col("orient") == "H") & (F.col("hi") - F.col("lo") >= 0.5 * (F.col("width") - F.col("grid_left"))))
    box = rules.where("orient = 'V'").groupBy(*keys).agg(F.min("lo").alias("box_top"), F.max("hi").alias("box_bottom"))
    edges = wide.groupBy(*keys).agg(G.anchored_edges(F.collect_list("pos")).alias("edges")).where("size(edges) >= 4").join(box, keys, "left")
    gaps = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.get("edges", i) - F.get("edges", i - 1))
    edges = edges.withColumn("gaps", gaps)
    others_last = F.greatest(F.lit(14.0), F.array_max(F.slice("gaps", 1, F.size("gaps") - 1)))
    others_first = F.greatest(F.lit(14.0), F.array_max(F.slice("gaps", 2, F.size("gaps") - 1)))
    tail = (F.element_at("gaps", -1) > 1.2 * others_last) & (F.element_at("edges", -1) > F.col("box_bottom") + 10)
    head = (F.get("gaps", F.lit(0)) > 1.2 * others_first) & (F.get("edges", F.lit(0)) < F.col("box_top") - 10)
    cut = edges.withColumn("edges", F.when(F.coalesce(tail, F.lit(False)), F.slice("edges", 1, F.size("edges") - 1)).otherwise(F.col("edges")))
    cut = cut.withColumn("edges", F.when(F.coalesce(head, F.lit(False)), F.slice("edges", 2, F.size("edges"))).otherwise(F.col("edges")))
    bands = cut.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct(F.get("edges", i - 1).alias("top"), F.get("edges", i).alias("bottom")))).alias("row_ix", "b"))
    return bands.select(*keys, "row_ix", "b.top", "b.bottom")


def lines_to_bands(lines: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Lines to the first band that holds their middle, with 1 of slack."""
    mid = F.col("y") + F.col("h") / 2
    held = lines.join(bands, keys).where((mid >= F.col("top") - 1) & (mid <= F.col("bottom") + 1))
    return held.groupBy(*keys, "line_ix").agg(F.min("row_ix").alias("row_ix"))


def adopt_drawn(marks: DataFrame, drawn: DataFrame, inferred: DataFrame, keys: list[str]) -> DataFrame:
    """Whether drawn rows hold at least as many marks as inferred ones, page by page: only then are they used."""
    box = drawn.groupBy(*keys).agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    kept = marks.join(box, keys).groupBy(*keys).agg(F.count_if((F.col("y") >= F.col("top") - 2) & (F.col("y") <= F.col("bottom") + 2)).alias("drawn_marks"))
    return kept.join(inferred, keys).select(*keys, "drawn_marks", "inferred_marks", (F.col("drawn_marks") >= F.col("inferred_marks")).alias("use_drawn"))


def prefix_match(a: Column, b: Column) -> Column:
    """Keys that are equal, or of which the shorter (12 signs or more, and 0.7 of the longer) begins the longer."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((short >= 12) & (short >= 0.7 * long) & (a.startswith(b) | b.startswith(a)))


def row_identity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each label's row: the exact key's if there is one so far, else the first that matches by prefix, else a new
    one.  Order matters, so it is a fold per table.  ``rows`` has ``ord`` and ``label``.
    """
    ls = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "label", T.label_key(F.col("label")).alias("key")))).alias("ls"))
    start = F.struct(F.array().cast("array<string>").alias("known"), F.array().cast("array<int>").alias("of"))

    def step(state: Column, l: Column) -> Column:
        exact = F.array_position(state["known"], l["key"])
        near = F.array_position(F.transform(state["known"], lambda k: prefix_match(k, l["key"])), True)
        at = F.when(exact > 0, exact).otherwise(near)
        return F.struct(
            F.when(at == 0, F.concat(state["known"], F.array(l["key"]))).otherwise(state["known"]).alias("known"),
            F.concat(state["of"], F.array(F.when(at == 0, F.size(state["known"]) + 1).otherwise(at).cast("int"))).alias("of"),
        )

    found = ls.withColumn("of", F.aggregate("ls", start, step, lambda s: s["of"]))
    return found.select(*keys, F.explode(F.arrays_zip("ls", "of")).alias("z")).select(*keys, F.col("z.ls.ord").alias("ord"), F.col("z.ls.label").alias("label"), F.concat(F.lit("r"), F.col("z.of")).alias("row_id"))


def fill_categories(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a value are categories, which stand over the rows that follow on their page."""
    by = Window.partitionBy(*keys).orderBy("entry_ix").rowsBetween(Window.unboundedPreceding, -1)
    is_category = F.col("n_values") == 0
    return entries.select(
        *keys, "entry_ix", "label", F.when(is_category, "category").otherwise("assessment").alias("kind"),
        F.when(~is_category, F.last(F.when(is_category, F.col("label")), ignorenulls=True).over(by)).alias("category"),
    )


def raised_markers(words: DataFrame, keys: list[str]) -> DataFrame:
    """Single letters or symbols of a label that are set over 0.4 smaller than the upper median of its words."""
    body = words.groupBy(*keys).agg(G.upper_median(F.collect_list(F.when(F.length("text") > 1, F.col("h")))).alias("body"))
    return words.join(body, keys).where(F.col("text").rlike("^[A-Za-z*†‡§¶#]$") & (F.col("h") < F.col("body") - 0.4)).select(*keys, "word_ix", F.lower("text").alias("marker"))


#: A label that reads like a new name rather than the rest of one.
NEW_NAME = "^[A-Z][a-z]+ [A-Z]"

#: An entry: a row of a page.
ENTRY = "struct<kind:string,label:string,y:double,bottom:double,n_marks:int,n_lines:int>"


def assembled(lines: Column) -> Column:
    """Inferred rows (``ENTRY``) of lines in order; a line has y, bottom, label, n_marks and other.

    An unlabelled line of text close below a row belongs to it, and ends it.  A marked line starts an assessment and
    takes the lines close below that have either a label or text, no marks, and don't look like a new name; a label
    alone takes the labels close below it.  Whether the last row still takes lines is part of the state, so nothing
    has to be looked at twice.
    """
    def step(s: Column, l: Column) -> Column:
        last, n = F.element_at(s["out"], -1), F.size(s["out"])
        close = (l["y"] - last["bottom"] <= 6) & (l["n_marks"] == 0)
        labelled, told = l["label"] != "", l["other"] != ""
        new_name = (F.length(l["label"]) < 40) & l["label"].rlike(NEW_NAME)
        takes = F.coalesce(s["open"] & close & F.when(s["marked"], (labelled != told) & ~new_name).otherwise(labelled & ~told), F.lit(False))
        tail = F.coalesce(~labelled & (l["n_marks"] == 0) & told & (l["y"] - last["bottom"] <= 8), F.lit(False))
        grown = F.struct(
            last["kind"].alias("kind"), F.when(takes, F.concat_ws(" ", T.nonempty(last["label"]), T.nonempty(l["label"]))).otherwise(last["label"]).alias("label"), last["y"].alias("y"), l["bottom"].alias("bottom"), last["n_marks"].alias("n_marks"), (last["n_lines"] + 1).alias("n_lines"),
        ).cast(ENTRY)
        new = F.struct(F.when(l["n_marks"] > 0, "assessment").otherwise("label-only").alias("kind"), l["label"].alias("label"), l["y"].alias("y"), l["bottom"].alias("bottom"), l["n_marks"].alias("n_marks"), F.lit(1).alias("n_lines")).cast(ENTRY)
        begins = ~takes & (labelled | (l["n_marks"] > 0))
        out = F.when(takes | tail, F.concat(F.slice(s["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(grown))).when(begins, F.concat(s["out"], F.array(new))).otherwise(s["out"])
        return F.struct(out.alias("out"), (takes | begins).alias("open"), F.when(begins, l["n_marks"] > 0).otherwise(s["marked"]).alias("marked"))

    # ``element_at`` of an empty array is an error, so the first line meets an entry that nothing can join.
    nothing = F.struct(F.lit("").alias("kind"), F.lit("").alias("label"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("bottom"), F.lit(0).alias("n_marks"), F.lit(0).alias("n_lines")).cast(ENTRY)
    begin = F.struct(F.array(nothing).alias("out"), F.lit(False).alias("open"), F.lit(False).alias("marked"))
    return F.aggregate(lines, begin, step, lambda s: F.slice(s["out"], 2, F.size(s["out"])))


def listed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of each group in order, as an array ``ls``."""
    line = F.struct("line_ix", F.col("y").cast("double").alias("y"), F.col("bottom").cast("double").alias("bottom"), F.coalesce("label", F.lit("")).alias("label"), F.col("n_marks").cast("int").alias("n_marks"), F.coalesce("other", F.lit("")).alias("other"))
    return lines.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("ls"))


def assemble_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Inferred rows of all pages; a page's lines are at most some hundred, so a page is one fold."""
    return listed(lines, keys).select(*keys, F.posexplode(assembled(F.col("ls"))).alias("entry_ix", "e")).select(*keys, "entry_ix", "e.*")


def rows_in_bands(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of drawn bands (``row_ix`` of each line): a band is one row, its names in order, unless two or more of
    its lines have a name of their own (more than two signs, not a small letter first) beside marks or text; such a
    band, ruled around a section, is read as an unruled page is, if that gives several rows.
    """
    own = F.filter("ls", lambda l: (F.length(l["label"]) > 2) & l["label"].rlike("^[A-Z0-9]") & ((l["n_marks"] > 0) | (l["other"] != "")))
    total = lambda name: F.aggregate("ls", F.lit(0), lambda a, l: a + l[name])
    label = F.array_join(F.filter(F.transform("ls", lambda l: l["label"]), lambda x: x != ""), " ")
    one = F.struct(F.when(total("n_marks") > 0, "assessment").otherwise("label-only").alias("kind"), T.clean(label).alias("label"), F.get("ls", F.lit(0))["y"].alias("y"), F.array_max(F.transform("ls", lambda l: l["bottom"])).alias("bottom"), total("n_marks").alias("n_marks"), F.size("ls").alias("n_lines")).cast(ENTRY)
    bands = listed(lines, [*keys, "row_ix"]).withColumn("within", F.when(F.size(own) >= 2, assembled(F.col("ls"))).otherwise(F.array().cast(f"array<{ENTRY}>")))
    found = bands.select(*keys, "row_ix", F.posexplode(F.when(F.size("within") > 1, F.col("within")).otherwise(F.array(one))).alias("at", "e")).select(*keys, "row_ix", "at", "e.*")
    # A band with nothing but white space between its rules is no row.
    kept = found.where((F.col("label") != "") | (F.col("n_marks") > 0) | (F.col("n_lines") > 0))
    ix = F.row_number().over(Window.partitionBy(*keys).orderBy("row_ix", "at")) - 1
    return kept.withColumn("entry_ix", ix.cast("int")).drop("row_ix", "at")
