"""Table orchestration: from words, rules and pages to published tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import cells as C
from gridframe.operators import columns as K
from gridframe.operators import confidence, footnotes, header, locate, rows
from gridframe.operators import geometry as G
from gridframe.operators import lines as L
from gridframe.sources.stages import cut

KEYS = ["doc_id", "cand", "page"]
TABLE = ["doc_id", "cand"]


@dataclass
class Tables:
    """The long relations of all tables."""

    candidates: DataFrame
    columns: DataFrame
    rows: DataFrame
    cells: DataFrame
    footnotes: DataFrame
    targets: DataFrame
    findings: DataFrame
    assessments: DataFrame
    ambiguities: DataFrame
    pages: DataFrame
    lines: DataFrame
    #: What came of a second reading, for each table, and what was left out of it; none before one.
    outcomes: DataFrame | None = None
    rejected: DataFrame | None = None
    #: The score of every page with its reasons, and how many pages each document has.
    scores: DataFrame | None = None
    page_counts: DataFrame | None = None


def title_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The first of a page's first twelve lines that names the table, shorter than 120 signs."""
    named = lines.where((F.col("line_ix") < 12) & (F.length("text") < 120) & locate.names_table(F.col("text")))
    return named.groupBy(*keys).agg(F.min_by("text", "line_ix").alias("title"))


def next_table(lines: DataFrame, titles: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """The first caption among a page's first 14 lines that starts another table: not "continued", and another name
    (24 letters and digits) than the title's.
    """
    key = lambda c: F.substring(T.label_key(c), 1, 24)
    caption = F.col("text").rlike(T.NEW_TABLE) & ~F.lower("text").contains("continued")
    found = lines.where((F.col("line_ix") < 14) & caption).join(titles, on or keys, "left").where(F.col("title").isNull() | (key(F.col("text")) != key(F.col("title"))))
    return found.groupBy(*keys).agg(F.min(F.struct("line_ix", "y", "text")).alias("s")).select(*keys, F.col("s.text").alias("another_title"), F.col("s.y").alias("another_y"))


def queue(candidates: DataFrame, most: int = 3, floor: float = 12.0) -> DataFrame:
    """The candidates that are tried: the best always, up to ``most`` of them while they reach ``floor``."""
    return candidates.where((F.col("cand_ix") == 0) | ((F.col("cand_ix") < most) & (F.col("score") >= floor)))


def ranges(found: DataFrame, lines: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The page ranges that are read, each a table of its own, and the pages that a range refuses.

    A page after the first of its range that carries the caption of another table is refused there, and the first such
    page opens a range of its own, next in order: from the caption's height to before the first page without a grid,
    under the caption as its title.  Such a range may open another, ``most`` deep at most.
    """
    range_keys = ["doc_id", "order"]
    top = lines.where("line_ix < 14").select("doc_id", "page", "line_ix", "top", "text")
    new = found.select("doc_id", F.array(F.col("cand_ix")).alias("order"), "pages", F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("from_y"))
    every, refused = new, None
    for _ in range(most):
        on = new.select(*range_keys, "title", F.posexplode("pages").alias("at", "page"))
        read = top.join(on, ["doc_id", "page"])
        named = title_of(read.where("at < 2"), [*range_keys, "at"]).groupBy(*range_keys).agg(F.min_by("title", "at").alias("found_title"))
        titles = new.select(*range_keys, "title").join(named, range_keys, "left").select(*range_keys, F.coalesce("title", "found_title").alias("title"))
        captions = cut(next_table(read.where("at > 0").select(*range_keys, "page", "line_ix", F.col("top").alias("y"), "text"), titles, [*range_keys, "page"], range_keys))
        refused = captions.select(*range_keys, "page") if refused is None else refused.unionByName(captions.select(*range_keys, "page"))
        if captions.isEmpty():
            break
        first = captions.groupBy(*range_keys).agg(F.min(F.struct("page", "another_title", "another_y")).alias("s")).select(*range_keys, "s.*")
        words = lines.join(on.select("doc_id", "page").distinct(), ["doc_id", "page"]).select("doc_id", "page", "line_ix", F.explode("words").alias("w")).select("doc_id", "page", "line_ix", "w.*")
        grids = rows.grid_left(words, ["doc_id", "page"], "line_ix").groupBy("doc_id").agg(F.collect_set("page").alias("grids"))
        rest = new.drop("title", "from_y").join(first, range_keys).join(grids, "doc_id", "left").withColumn("grids", F.coalesce("grids", F.array().cast("array<int>")))
        end = F.array_min(F.filter("pages", lambda p: (p > F.col("page")) & ~F.array_contains("grids", p)))
        rest = rest.select("doc_id", F.concat("order", F.array(F.lit(0))).alias("order"), F.filter("pages", lambda p: (p >= F.col("page")) & (end.isNull() | (p < end))).alias("pages"), F.col("another_title").alias("title"), F.col("another_y").alias("from_y"))
        known = every.select("doc_id", F.get("pages", F.lit(0)).alias("begins")).distinct()
        new = cut(rest.join(known, (rest["doc_id"] == known["doc_id"]) & (F.get("pages", F.lit(0)) == known["begins"]), "left_anti"))
        every = every.unionByName(new)
    cand = (F.row_number().over(Window.partitionBy("doc_id").orderBy("order")) - 1).alias("cand")
    numbered = cut(every.select("*", cand))
    return numbered, cut(refused.join(numbered.select(*range_keys, "cand"), range_keys).select("doc_id", "cand", F.col("page").cast("int").alias("page")).distinct())


def accept(columns: DataFrame, n_rows: DataFrame, titles: DataFrame, most: int | None = None) -> DataFrame:
    """Tables with rows and two columns; later ones of a document need a title and facts in half of their columns; at
    most ``most`` of them.
    """
    fact = T.nonempty(F.col("visit_number"), F.col("study_day"), F.col("study_week"), F.col("visit_window")).isNotNull()
    c = columns.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n_cols"), F.count_if(fact).alias("n_facts"))
    joined = c.join(n_rows, TABLE).join(titles, TABLE, "left").where("n_cols >= 2 and n_rows > 0")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("cand"))
    kept = joined.withColumn("first", place == 1).where(F.col("first") | (F.col("title").isNotNull() & (2 * F.col("n_facts") >= F.col("n_cols"))))
    return kept.withColumn("place", place).where(F.lit(True) if most is None else F.col("place") <= most).select(*TABLE)


def extract(words: DataFrame, rules: DataFrame, pages: DataFrame, seed: float = 9.0, most: int = 3, floor: float = 12.0) -> Tables:
    """All tables of all documents.

    Everything carries (doc_id, cand, page), so stages after the locator shuffle on the same keys, and only words of
    candidate pages go on.
    """
    page_keys = ["doc_id", "page"]
    lines = cut(L.lines(words, page_keys).withColumn("tokens", F.transform("words", lambda w: w["text"])))
    scores = cut(locate.page_scores(lines))
    found = cut(queue(locate.candidates(scores, seed), most, floor))
    read, refused = ranges(found, lines, most)
    on = read.select(*TABLE, "title", "from_y", F.posexplode("pages").alias("at", "page")).withColumn("from_y", F.when(F.col("at") == 0, F.col("from_y")))
    every_line = lines.join(on, page_keys)
    titles = title_of(every_line.drop("title").where("at < 2"), KEYS).groupBy(*TABLE).agg(F.min_by("title", "page").alias("found_title"))
    titles = cut(read.select(*TABLE, "title").join(titles, TABLE, "left").select(*TABLE, F.coalesce("title", "found_title").alias("title")))
    grid_lines = every_line.join(refused, KEYS, "left_anti")
    word_lines = L.words_below(grid_lines.select(*KEYS, "line_ix", "top", "bottom", "from_y", F.explode("words").alias("w")).select(*KEYS, "line_ix", "top", "bottom", "from_y", "w.*"), F.col("from_y")).drop("from_y")
    split = cut(rows.split_words(word_lines, rows.grid_left(word_lines, KEYS, "line_ix"), KEYS))
    by_line = cut(_by_line(split))
    extent = by_line.where("first_y is not null").select(*KEYS, "first_y", "last_y", "grid_left").distinct()
    left = extent.where("grid_left is not null").select(*KEYS, "grid_left")
    # Sizes and rules of candidate pages alone, written: five stages read them.
    width = cut(pages.select(*page_keys, "width").join(on.select(*page_keys).distinct(), page_keys, "left_semi"))
    own_rules = cut(L.rules_below(rules.join(on.select(*KEYS, "from_y"), page_keys).join(refused, KEYS, "left_anti"), F.col("from_y")).drop("from_y").join(width, page_keys))

    data = by_line.where("is_data").select(*KEYS, "line_ix")
    marks = split.where("part = 'mark'").join(data, [*KEYS, "line_ix"], "left_semi").withColumn("centre", F.col("x") + F.col("w") / 2)
    drawn_bands = K.drawn_columns(own_rules.select(*KEYS, "orient", "rule_ix", "pos", "lo", "hi"), extent.where("grid_left is not null").select(*KEYS, F.col("first_y").alias("top"), F.col("last_y").alias("bottom"), "grid_left"), KEYS)
    bands = cut(K.choose_bands(drawn_bands, G.mark_columns(marks.join(width, page_keys), KEYS, F.col("width")), KEYS))
    # Written, because spreading names it many times.
    header_rows = header.spread(cut(_header(split, by_line, extent, bands, left, own_rules)), bands, own_rules, KEYS)
    cols = bands.join(K.header_pivot(header_rows, KEYS), [*KEYS, "band_ix"], "left").join(width, page_keys)
    cols = cut(_unified(cut(cols)))

    entries, adopted = _entries(by_line, own_rules, left, marks)
    entries, adopted = cut(entries), cut(adopted)
    marks_in, spans = _phrases(split, marks, entries, bands)
    marks_in, spans = cut(marks_in), cut(spans)
    n_spans = spans.groupBy(*KEYS, "entry_ix").agg(F.count(F.lit(1)).alias("n_spans"))
    row_ids = cut(_rows(entries.join(n_spans, [*KEYS, "entry_ix"], "left")))
    cells_ = cut(_cells(marks_in, spans, row_ids, cols, bands))

    first = F.struct("page", "entry_ix")
    table_rows = row_ids.groupBy(*TABLE, F.col("row_id").alias("id")).agg(F.min(first).alias("at"), *[F.min_by(c, first).alias(c) for c in ("label", "kind", "category")])
    table_rows = cut(table_rows.withColumn("ord", F.row_number().over(Window.partitionBy(*TABLE).orderBy("at")) - 1).drop("at"))
    table_cols = cols.groupBy(*TABLE, "id").agg(*[F.min_by(c, F.struct("page", "band_ix")).alias(c) for c in ("label", "path", "visit_number", "study_day", "study_week", "visit_window", "page", "ruled", "band_ix")])
    dividers = _dividers(split, cols)
    cells_ = K.divide(cells_, dividers.select(*TABLE, "col_id", "timed"), TABLE)
    renamed = dividers.where("not timed").select(*TABLE, F.col("col_id").alias("id"), F.col("text").alias("divides"))
    table_cols = table_cols.join(renamed, [*TABLE, "id"], "left").withColumn("divider", F.col("divides").isNotNull()).withColumn("label", F.coalesce("divides", "label")).drop("divides")
    kept_cols = K.prune_empty(table_cols.where("not divider"), cells_, TABLE).unionByName(table_cols.where("divider"))
    kept_cols = cut(kept_cols.withColumn("ord", F.row_number().over(Window.partitionBy(*TABLE).orderBy("page", "band_ix")) - 1))

    notes = cut(_notes(every_line, extent, table_rows, cells_, kept_cols))
    cells_ = cut(_marked_cells(cells_, notes))
    targets = cut(_targets(notes, table_rows, cells_, kept_cols, _raised(split, entries, row_ids)))
    ok = cut(accept(kept_cols, table_rows.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n_rows")), titles, most))
    keep = lambda df: df.join(ok, TABLE, "left_semi")
    doubts = _doubts(refused, extent, bands, adopted, split, entries, spans, dividers, table_cols, kept_cols)
    table_cols, table_rows, cells_, notes, targets, doubts = map(keep, (kept_cols, table_rows, cells_, notes, targets, doubts))
    findings = cut(confidence.findings(table_cols, table_rows, cells_, targets))
    ruled = adopted.groupBy(*TABLE).agg(F.bool_and("use_drawn").alias("rows_are_ruled"))
    judged = confidence.assess(table_cols, findings).join(titles, TABLE, "left").join(ruled, TABLE, "left").withColumn("rows_are_ruled", F.coalesce("rows_are_ruled", F.lit(False)))
    own_pages = read.select(*TABLE, F.explode("pages").alias("page")).join(pages.select(*page_keys, *[c for c in ("width", "height", "rotated") if c in pages.columns]), page_keys, "left")
    # What the locator says of each table: the score of its range, and of its pages with their reasons.
    range_score = read.select(*TABLE, F.get("order", F.lit(0)).alias("cand_ix")).join(found.select("doc_id", "cand_ix", F.col("score").alias("locator_score")), ["doc_id", "cand_ix"], "left").drop("cand_ix")
    evidence = read.select(*TABLE, F.explode("pages").alias("page")).join(scores.select("doc_id", "page", "score", "reasons"), page_keys).groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("page", "score", "reasons"))).alias("locator_evidence"))
    judged = judged.join(range_score, TABLE, "left").join(evidence, TABLE, "left")
    return Tables(found, table_cols, table_rows, cells_, notes, targets, findings, judged, cut(doubts), own_pages, lines, scores=scores, page_counts=pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")))


def _text(part: str) -> Column:
    return T.clean(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("x", "word_ix", "text")))), lambda s: s["text"]), " "))


def _by_line(split: DataFrame) -> DataFrame:
    """A page's lines: label, other text, marks; whether they are data, and the height of the page's data."""
    out = split.groupBy(*KEYS, "line_ix").agg(
        F.min("y").alias("y"), F.max(F.col("y") + F.col("h")).alias("bottom"), _text("label").alias("label"), F.count_if(F.col("part") == "mark").alias("n_marks"), _text("other").alias("other"), F.max("h").alias("h"), F.first("grid_left").alias("grid_left")
    )
    out = out.withColumn("is_data", (F.col("n_marks") > 0) & ~K.names_dimension(F.col("label")))
    page = Window.partitionBy(*KEYS)
    return out.withColumns({"first_y": F.min(F.when(F.col("is_data"), F.col("y"))).over(page), "last_y": F.max(F.when(F.col("is_data"), F.col("bottom"))).over(page)})


def _header(words: DataFrame, by_line: DataFrame, extent: DataFrame, bands: DataFrame, left: DataFrame, own_rules: DataFrame) -> DataFrame:
    """Header values above each page's first data row."""
    words = words.select(*KEYS, "line_ix", "word_ix", "text", "x", "y", "w", "h")
    reached = header.place_words(words, bands, KEYS, ["line_ix"]).groupBy(*KEYS, "line_ix").agg(F.count_distinct("band_ix").alias("n_bands"))
    shaped = by_line.select(*KEYS, "line_ix", F.col("y").alias("top"), "bottom", F.col("h").alias("height"), F.concat_ws(" ", "label", "other").alias("text")).join(reached, [*KEYS, "line_ix"])
    top_edge = own_rules.where("orient = 'H'").groupBy(*KEYS).agg(F.min("pos").alias("top_edge"))
    n = bands.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("bands"))
    reach = extent.select(*KEYS, "first_y").join(n, KEYS).join(top_edge, KEYS, "left")
    return header.read_header(words, header.header_lines(shaped, reach, KEYS), bands, left, own_rules, extent.select(*KEYS, "first_y"), KEYS)


def _unified(cols: DataFrame) -> DataFrame:
    """Columns with the id that they have or continue."""
    key = K.column_key(F.col("visit_number"), F.col("study_day"), F.col("study_week"), F.coalesce("label", F.lit("")))
    pitch = F.coalesce(F.lead("centre").over(Window.partitionBy(*KEYS).orderBy("band_ix")) - F.col("centre"), F.col("centre") - F.lag("centre").over(Window.partitionBy(*KEYS).orderBy("band_ix")), F.lit(20.0))
    full = cols.withColumn("own_id", F.concat(F.lit("p"), F.col("page"), F.lit("c"), F.col("band_ix"))).withColumn("key", key).withColumn("pitch", pitch)
    full = full.withColumn("ord", F.row_number().over(Window.partitionBy(*TABLE).orderBy("page", "band_ix"))).withColumn("label", F.coalesce("label", F.concat(F.lit("Column "), F.col("band_ix") + 1)))
    same = K.continue_columns(full.select(*TABLE, "ord", F.col("own_id").alias("id"), F.col("page").cast("int").alias("page"), "key", F.col("width").cast("double").alias("width"), "centre", "pitch"), TABLE).select(*TABLE, "own_id", "id")
    return full.join(same, [*TABLE, "own_id"])


def _entries(by_line: DataFrame, own_rules: DataFrame, left: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of each page: drawn ones, three or more, where they hold at least as many marks as the inferred ones, else
    those; and whether the drawn ones were taken, of pages that have them.
    """
    inside = by_line.where((F.col("y") >= F.col("first_y") - 2) & (F.col("bottom") <= F.col("last_y") + 2) & ~(K.names_dimension(F.col("label")) & (F.col("n_marks") > 0)))
    inferred = rows.assemble_rows(inside, KEYS)
    ruled = rows.drawn_rows(own_rules, left, KEYS)
    held = rows.lines_to_bands(inside.select(*KEYS, "line_ix", "y", "h"), ruled, KEYS).join(inside, [*KEYS, "line_ix"])
    drawn = rows.rows_in_bands(held, KEYS)
    enough = drawn.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    in_lines = marks.join(inside.select(*KEYS, "line_ix"), [*KEYS, "line_ix"], "left_semi").select(*KEYS, "y")
    judged = rows.adopt_drawn(in_lines, ruled.join(enough, KEYS, "left_semi"), inside.groupBy(*KEYS).agg(F.sum("n_marks").alias("inferred_marks")), KEYS)
    better = judged.where("use_drawn").select(*KEYS)
    return drawn.join(better, KEYS, "left_semi").unionByName(inferred.join(better, KEYS, "left_anti")), judged


def _phrases(split: DataFrame, marks: DataFrame, entries: DataFrame, bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks with their entry and raised marker; and the bands of an entry that a phrase beside its marks covers."""
    by_entry = [*KEYS, "entry_ix"]
    marks_in = _in_entries(marks, entries).withColumnsRenamed({"my": "y", "mh": "h"})
    loose = _in_entries(split.where("part = 'other'"), entries).withColumnsRenamed({"my": "y", "mh": "h"})
    raised = C.superscripts(marks_in.select(*KEYS, "word_ix", "x", "y", "w", "h"), loose.select(*KEYS, "word_ix", "text", "x", "y", "h"), KEYS)
    marks_in = marks_in.join(raised.select(*KEYS, "word_ix", "marker"), [*KEYS, "word_ix"], "left").select(*by_entry, "word_ix", "x", "w", "text", "marker")
    pitch = bands.groupBy(*KEYS).agg(F.coalesce(F.max(F.when(F.col("band_ix") == 1, F.col("centre"))) - F.max(F.when(F.col("band_ix") == 0, F.col("centre"))), F.lit(30.0)).alias("pitch"))
    free = loose.join(raised.select(*KEYS, F.col("used_ix").alias("word_ix")).distinct(), [*KEYS, "word_ix"], "left_anti")
    found = C.phrase_cells(free.join(pitch, KEYS).select(*by_entry, "line_ix", "word_ix", "text", "x", "w", "pitch"), by_entry, F.col("pitch"))
    ends = _in_entries(split.where("part = 'label'"), entries).groupBy(*by_entry).agg(F.max(F.col("x") + F.col("w")).alias("label_right"))
    letters = F.filter(F.split("text", " "), lambda t: t != "")
    found = found.join(pitch, KEYS).join(ends, by_entry, "left").where(
        (F.col("label_right").isNull() | (F.col("x0") - F.col("label_right") >= 0.4 * F.col("pitch"))) & ~((F.size(letters) > 1) & F.forall(letters, lambda t: t.rlike("^[A-Za-z]$")))
    )
    behind = marks_in.select(*by_entry, (F.col("x") + F.col("w")).alias("end"))
    found = found.join(behind, by_entry, "left").groupBy(*by_entry, "phrase_ix", "text", "x0", "x1", "pitch").agg(F.coalesce(F.bool_or((F.length("text") <= 2) & (F.col("x0") - F.col("end") > -1) & (F.col("x0") - F.col("end") < 10)), F.lit(False)).alias("tail"))
    named = found.where("not tail").withColumn("phrase_ix", F.concat_ws(":", "entry_ix", "phrase_ix"))
    covered = C.covered_bands(named.select(*KEYS, "phrase_ix", "text", "x0", "x1", "pitch"), bands.select(*KEYS, "band_ix", "centre"), KEYS, F.col("pitch"))
    at = lambda i: F.get(F.split("phrase_ix", ":"), F.lit(i)).cast("int")
    return marks_in, covered.select(*KEYS, at(0).alias("entry_ix"), at(1).alias("phrase_ix"), "text", "band_ix")


def _rows(entries: DataFrame) -> DataFrame:
    """Entries with their row's id over all pages of the table, kind and category."""
    values = F.col("n_marks") + F.coalesce("n_spans", F.lit(0))
    filled = rows.fill_categories(entries.select(*KEYS, "entry_ix", "label", values.alias("n_values")), KEYS)
    ordered = filled.withColumn("ord", F.row_number().over(Window.partitionBy(*TABLE).orderBy("page", "entry_ix")))
    ids = rows.row_identity(ordered.select(*TABLE, "ord", "label"), TABLE).select(*TABLE, "ord", "row_id")
    return ordered.join(ids, [*TABLE, "ord"]).drop("ord")


def _in_entries(words: DataFrame, entries: DataFrame) -> DataFrame:
    """Words to the entry whose height holds their middle, the first if several do."""
    mid = F.col("my") + F.col("mh") / 2
    m = words.drop("top", "bottom").withColumnsRenamed({"y": "my", "h": "mh"})
    hit = m.join(entries.select(*KEYS, "entry_ix", F.col("y").alias("ey"), F.col("bottom").alias("eb")), KEYS).where((mid >= F.col("ey") - 1) & (mid <= F.col("eb") + 1))
    return C.first_by(hit, [*KEYS, "line_ix", "word_ix"], "entry_ix").drop("ey", "eb")


def _cells(marks_in: DataFrame, spans: DataFrame, row_ids: DataFrame, cols: DataFrame, bands: DataFrame) -> DataFrame:
    """row_id, col_id, value and raised markers: marks in their band, phrases in all bands that they cover; of several
    pages' cells the first.
    """
    of_entry = row_ids.select(*KEYS, "entry_ix", "row_id")
    own = marks_in.join(of_entry, [*KEYS, "entry_ix"]).select(*KEYS, "row_id", "word_ix", F.col("x").alias("ord"), "text", "marker", (F.col("x") + F.col("w") / 2).alias("centre"))
    placed = G.nearest_band(own, bands, KEYS).groupBy(*KEYS, "row_id", "band_ix").agg(F.min_by(T.clean(F.col("text")), F.struct("ord", "word_ix")).alias("value"), F.sort_array(F.collect_set("marker")).alias("markers"))
    spanned = spans.join(of_entry, [*KEYS, "entry_ix"]).groupBy(*KEYS, "row_id", "band_ix").agg(F.min_by("text", F.struct("entry_ix", "phrase_ix")).alias("text"))
    both = C.explode_spans(placed.drop("markers"), spanned, KEYS).join(placed.drop("value"), [*KEYS, "row_id", "band_ix"], "left")
    named = both.join(cols.select(*KEYS, "band_ix", "id"), [*KEYS, "band_ix"])
    order = F.struct("page", "band_ix")
    return named.groupBy(*TABLE, "row_id", F.col("id").alias("col_id")).agg(F.min_by("value", order).alias("value"), F.coalesce(F.min_by("markers", order), F.array().cast("array<string>")).alias("markers"))


def _dividers(split: DataFrame, cols: DataFrame) -> DataFrame:
    """Columns beside which a word is set letter below letter: the word, its page and whether the column is a visit."""
    upright = G.vertical_words(split, KEYS).select(*KEYS, "run_ix", "text", F.col("x").alias("centre"))
    near = G.nearest_centre(upright, cols.select(*KEYS, F.col("band_ix").alias("col_ix"), F.col("centre").alias("col_centre")), KEYS)
    timed = T.nonempty(F.col("visit_number"), F.col("study_day"), F.col("study_week")).isNotNull()
    met = near.join(cols.select(*KEYS, F.col("band_ix").alias("col_ix"), "id", timed.alias("timed")), [*KEYS, "col_ix"])
    return met.groupBy(*TABLE, F.col("id").alias("col_id")).agg(F.bool_or("timed").alias("timed"), F.min_by("text", F.struct("page", "run_ix")).alias("text"), F.min("page").alias("page"))


def column_texts(cols: DataFrame) -> DataFrame:
    """The label and the facts of each column, one row each."""
    return cols.select(*TABLE, "id", F.explode(F.array_compact(F.array("label", "visit_number", "study_day", "study_week", "visit_window"))).alias("text")).where("text != ''")


def _notes(lines: DataFrame, extent: DataFrame, table_rows: DataFrame, cells_: DataFrame, cols: DataFrame) -> DataFrame:
    """Footnotes below the grids of a table's pages and on its pages without one."""
    texts = table_rows.select(*TABLE, F.col("label").alias("text"), F.lit(False).alias("whole")).unionByName(cells_.select(*TABLE, F.col("value").alias("text"), F.lit(True).alias("whole")))
    texts = texts.unionByName(column_texts(cols).select(*TABLE, "text", F.lit(False).alias("whole"))).unionByName(cells_.select(*TABLE, F.explode("markers").alias("text"), F.lit(True).alias("whole")))
    known = footnotes.plausible_markers(texts, TABLE).groupBy(*TABLE).agg(F.array_sort(F.collect_set("marker")).alias("plausible"))
    below = lines.join(extent.select(*KEYS, "last_y"), KEYS, "left").where(F.col("last_y").isNull() | (F.col("top") > F.col("last_y"))).join(known, TABLE, "left").withColumn("plausible", F.coalesce("plausible", F.array().cast("array<string>")))
    found = footnotes.segments(below.select(*KEYS, "plausible", "line_ix", F.col("top").alias("y"), F.col("height").alias("h"), "text"), KEYS)
    return footnotes.merge_pages(found.withColumn("glossary", F.length("marker") > 2), TABLE)


def _marked_cells(cells_: DataFrame, notes: DataFrame) -> DataFrame:
    """Cells whose value ends in a known marker, without it; the marker is kept beside the value."""
    known = notes.groupBy(*TABLE).agg(F.collect_set("marker").alias("known"))
    value, tail = C.split_trailing(F.col("value"), F.col("known"))
    met = cells_.join(known, TABLE, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return met.select(*TABLE, "row_id", "col_id", value.alias("value"), F.when(tail.isNull(), F.col("markers")).otherwise(F.array_union("markers", F.array(tail))).alias("markers"))


def _raised(split: DataFrame, entries: DataFrame, row_ids: DataFrame) -> DataFrame:
    """Markers set smaller within a row's label."""
    own = _in_entries(split.where("part = 'label'"), entries).select(*KEYS, "entry_ix", "word_ix", "text", F.col("mh").alias("h"))
    return rows.raised_markers(own, [*KEYS, "entry_ix"]).join(row_ids.select(*KEYS, "entry_ix", "row_id"), [*KEYS, "entry_ix"]).select(*TABLE, "row_id", "marker").distinct()


def _targets(notes: DataFrame, table_rows: DataFrame, cells_: DataFrame, cols: DataFrame, raised: DataFrame) -> DataFrame:
    """What each footnote applies to: rows by their label's end or raised sign, cells by value or raised sign, columns
    by their label or facts."""
    markers = notes.select(*TABLE, "marker").distinct()
    in_cells = footnotes.links(cells_, markers, TABLE).unionByName(cells_.select(*TABLE, "row_id", "col_id", F.explode("markers").alias("marker")).join(markers, [*TABLE, "marker"], "left_semi").select(*TABLE, "row_id", "col_id", "marker"))
    in_rows = footnotes.link_trailing(table_rows.select(*TABLE, F.lit("row").alias("target"), "id", F.col("label").alias("text")), markers, TABLE).select(*TABLE, F.col("id").alias("row_id"), "marker")
    in_rows = in_rows.unionByName(raised.join(markers, [*TABLE, "marker"], "left_semi").select(*TABLE, "row_id", "marker"))
    in_cols = footnotes.link_trailing(column_texts(cols).withColumn("target", F.lit("column")), markers, TABLE).select(*TABLE, F.col("id").alias("col_id"), "marker")
    return footnotes.applies_to(notes, in_rows, in_cells, TABLE, in_cols)


def _doubts(refused: DataFrame, extent: DataFrame, bands: DataFrame, adopted: DataFrame, split: DataFrame, entries: DataFrame, spans: DataFrame, dividers: DataFrame, cols: DataFrame, kept: DataFrame) -> DataFrame:
    """Ambiguities: what was read in one of several ways, or reached nothing.  One row each, with its page."""

    def told(df: DataFrame, kind: str, detail: Column) -> DataFrame:
        return df.select(*TABLE, F.col("page").cast("int").alias("page"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))

    n_bands = bands.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    held = entries.select(*KEYS, F.col("label").alias("value")).unionByName(spans.select(*KEYS, F.col("text").alias("value"))).unionByName(split.where("part = 'mark'").select(*KEYS, F.col("text").alias("value")))
    inside = split.join(extent.select(*KEYS, "first_y", "last_y"), KEYS).where((F.col("y") >= F.col("first_y") - 2) & (F.col("y") + F.col("h") <= F.col("last_y") + 2))
    gone = cols.where("not divider").join(kept.select(*TABLE, "id"), [*TABLE, "id"], "left_anti")
    return (
        told(refused, "another-table", F.lit("carries the caption of another table"))
        .unionByName(told(extent.join(n_bands, KEYS, "left").where(F.coalesce("n", F.lit(0)) < 2), "no-columns", F.lit("fewer than two columns")))
        .unionByName(told(K.spacers(bands, KEYS), "spacer", F.concat(F.lit("a column may be missing before column "), F.col("band_ix") + 1)))
        .unionByName(told(adopted.where("not use_drawn"), "drawn-rows", F.concat_ws(" ", F.lit("drawn rows hold"), "drawn_marks", F.lit("of"), "inferred_marks", F.lit("marks"))))
        .unionByName(told(C.residual(inside.select(*KEYS, "word_ix", "text"), held, KEYS), "residual", F.col("text")))
        .unionByName(told(dividers, "vertical-word", F.col("text")))
        .unionByName(told(gone, "empty-column", F.col("label")))
    )
