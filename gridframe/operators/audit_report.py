"""The audit as a whole: each table against the grid that its pages draw, and an account of what was compared.

Each check is written once; how much it compared is observed while it is written, so the account costs no pass.  What
couldn't be compared is told with its reason: a page without a drawn grid, a grid of another table, a printed column
without a counterpart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import audit
from gridframe.operators.tables import KEYS, TABLE, Tables
from gridframe.sources.stages import cut


@dataclass
class Report:
    """faults: doc_id, cand, page, check, subject, detail; skipped: doc_id, cand, page, what, reason; and how many
    items each check compared."""

    faults: DataFrame
    skipped: DataFrame
    compared: dict[str, int]


def observed(checked: DataFrame, name: str, counts: dict[str, Observation]) -> DataFrame:
    """``checked`` as a written table, its rows counted on the way."""
    counts[name] = Observation(f"audit-{name}")
    return cut(checked.observe(counts[name], F.count(F.lit(1)).alias("n")))


def _texts(matrix: DataFrame, where: Column, by: list[str], order: str) -> DataFrame:
    return matrix.where(where).groupBy(*by).agg(T.clean(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda t: t["text"]), " ")).alias("said"))


def report(got: Tables, words: DataFrame, rules: DataFrame) -> Report:
    """Compares rows, cells, headings and footnotes of all tables with their pages."""
    counts: dict[str, Observation] = {}
    page = ["doc_id", "page"]
    pages = cut(got.pages.select(*KEYS).distinct())
    edges = cut(audit.grid_edges(rules.join(pages.select(*page).distinct(), page, "left_semi"), page))
    no_grid = pages.join(edges.select(*page), page, "left_anti").select(*KEYS, F.lit("page").alias("what"), F.lit("no ruled grid").alias("reason"))
    begins = pages.groupBy(*TABLE).agg(F.min("page").alias("page"))
    others = pages.alias("p").join(begins.alias("b"), (F.col("p.doc_id") == F.col("b.doc_id")) & (F.col("p.page") == F.col("b.page")) & (F.col("p.cand") != F.col("b.cand"))).select("p.doc_id", "p.cand", "p.page").distinct()
    grid = audit.grid_words(words.join(edges.select(*page), page, "left_semi"), edges, page).join(pages, page).join(others, KEYS, "left_anti")
    known = got.rows.select(*TABLE, "label").join(pages, TABLE)
    matrix = cut(grid)
    shaped = cut(matrix.join(audit.label_columns(matrix, KEYS), KEYS).join(audit.header_rows(matrix, known, KEYS), KEYS))

    # Printed columns and ours meet through the rows that both have a value in; order keeps those that don't cross.
    labels = _texts(shaped, (F.col("c") < F.col("label_columns")) & (F.col("r") >= F.col("header_rows")), [*KEYS, "r"], "c").withColumnRenamed("said", "label")
    body = shaped.where((F.col("c") >= F.col("label_columns")) & (F.col("r") >= F.col("header_rows"))).join(labels, [*KEYS, "r"]).withColumn("row", T.label_key(F.col("label")))
    own = got.cells.join(got.rows.select(*TABLE, F.col("id").alias("row_id"), T.label_key(F.col("label")).alias("row")), [*TABLE, "row_id"])
    own = own.join(got.columns.where("not divider").select(*TABLE, F.col("id").alias("col_id"), F.col("ord").alias("at")), [*TABLE, "col_id"]).join(pages, TABLE)
    own = cut(own.select(*KEYS, "row", "at", "col_id", T.clean(F.concat_ws(" ", F.col("value"), F.array_join("markers", " "))).alias("ours")))
    heads = _texts(shaped, (F.col("c") >= F.col("label_columns")) & (F.col("r") < F.col("header_rows")), [*KEYS, "c"], "r")
    scores = audit.column_scores(own.select(*KEYS, F.lpad(F.col("at").cast("string"), 6, "0").alias("col"), "row"), body.select(*KEYS, F.lpad(F.col("c").cast("string"), 6, "0").alias("col"), "row"), KEYS)
    # Columns under one heading are half a point more alike.
    our_heads = got.columns.select(*TABLE, F.lpad(F.col("ord").cast("string"), 6, "0").alias("a"), T.label_key(F.concat_ws(" ", "visit_number", "study_day", "study_week", "visit_window")).alias("our_head"))
    their_heads = heads.select(*KEYS, F.lpad(F.col("c").cast("string"), 6, "0").alias("b"), T.label_key(F.col("said")).alias("their_head"))
    scores = scores.join(our_heads, [*TABLE, "a"], "left").join(their_heads, [*KEYS, "b"], "left")
    alike = F.coalesce((F.col("our_head") != "") & (F.col("their_head").contains(F.col("our_head"))), F.lit(False))
    scores = scores.select(*KEYS, "a", "b", (F.col("score") + F.when(alike, 0.5).otherwise(0.0)).alias("score"))
    pairs = audit.greedy_pairs(scores, KEYS).select(*KEYS, F.col("a").cast("int").alias("pos"), F.col("b").cast("int").alias("at"))
    pairs = cut(audit.uncrossed(pairs, KEYS).select(*KEYS, F.col("pos").alias("our"), F.col("at").alias("c")))
    drawn = body.select(*KEYS, "c").distinct()
    sizes = drawn.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_drawn")).join(pairs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_paired")), KEYS, "left")
    judged = audit.foreign(sizes.withColumns({"n_paired": F.coalesce("n_paired", F.lit(0)), "starts_another": F.lit(False)}), KEYS)
    alien = cut(judged.where("foreign").select(*KEYS))
    here = lambda df: df.join(alien, KEYS, "left_anti")

    rows = observed(here(labels).where("label != ''"), "rows", counts)
    missing = audit.missing_rows(rows.select(*KEYS, F.col("r").alias("row"), "label"), known, KEYS).select(*KEYS, F.lit("missing-row").alias("check"), F.col("label").alias("subject"), F.lit("printed, and in no row of the table").alias("detail"))

    # A row's cells, where the table has the row: what the page prints and what is held, on either side of a pair.
    shared = here(body.join(pairs, [*KEYS, "c"])).join(own.select(*KEYS, "row").distinct(), [*KEYS, "row"], "left_semi").select(*KEYS, "row", "our", "label", F.col("text").alias("printed"))
    held = here(own.withColumn("our", F.col("at"))).join(pairs.select(*KEYS, "our"), [*KEYS, "our"], "left_semi").join(labels.select(*KEYS, T.label_key(F.col("label")).alias("row")).distinct(), [*KEYS, "row"], "left_semi").select(*KEYS, "row", "our", "ours")
    both = shared.join(held, [*KEYS, "row", "our"], "full_outer").withColumns({"printed": F.coalesce("printed", F.lit("")), "ours": F.coalesce("ours", F.lit("")), "spanned": F.lit(False)})
    # A token alone in one of them is in neither bag: an empty side is a fault unless both are.
    cells = observed(audit.check_cells(both).withColumn("fine", F.col("fine") & ((F.col("printed") == "") == (F.col("ours") == "")) & (audit.tokens(F.col("printed")) == audit.tokens(F.col("ours")))), "cells", counts)
    wrong = cells.where("not fine").select(*KEYS, F.lit("cell").alias("check"), F.concat_ws("/", F.coalesce("label", "row"), "our").alias("subject"), F.concat(F.lit("printed '"), "printed", F.lit("', held '"), "ours", F.lit("'")).alias("detail"))

    facts = F.concat_ws(" ", *[F.col(c) for c in ("label", "path", "visit_number", "study_day", "study_week", "visit_window") if c in got.columns.columns])
    columns = got.columns.select(*TABLE, F.col("ord").alias("our"), T.label_key(facts).alias("whole"), F.filter(F.transform(F.array("label", "visit_number", "study_day", "study_week", "visit_window"), lambda v: T.label_key(F.coalesce(v, F.lit("")))), lambda v: F.length(v) > 1).alias("said_by_us"))
    met = here(heads.join(pairs, [*KEYS, "c"])).join(columns, [*TABLE, "our"]).withColumn("head", T.label_key(F.col("said"))).where("head != ''")
    covered = F.exists("said_by_us", lambda v: F.col("head").contains(v) | v.contains(F.col("head"))) | ((F.length("whole") > 1) & (F.col("head").contains(F.col("whole")) | F.col("whole").contains(F.col("head"))))
    heading = observed(met.withColumn("covered", covered), "headings", counts)
    unread = heading.where("not covered").select(*KEYS, F.lit("heading").alias("check"), F.col("said").alias("subject"), F.lit("printed over a column that doesn't say it").alias("detail"))

    told = got.footnotes.where(F.length("text") >= 8)
    texts = got.lines.select(*page, "text").join(pages, page).select(*TABLE, "text")
    notes = observed(audit.footnote_text(told, texts, TABLE), "footnotes", counts)
    lost = notes.where("not found").select(*TABLE, F.lit(None).cast("int").alias("page"), F.lit("footnote").alias("check"), F.col("marker").alias("subject"), F.lit("its text isn't on the table's pages").alias("detail"))

    unpaired = here(drawn).join(pairs.select(*KEYS, "c"), [*KEYS, "c"], "left_anti").join(heads, [*KEYS, "c"], "left").select(*KEYS, F.concat(F.lit("column "), F.coalesce(T.nonempty(F.col("said")), F.col("c").cast("string"))).alias("what"), F.lit("no counterpart").alias("reason"))
    skipped = no_grid.unionByName(others.select(*KEYS, F.lit("page").alias("what"), F.lit("another table starts here").alias("reason"))).unionByName(alien.select(*KEYS, F.lit("page").alias("what"), F.lit("a grid of another table").alias("reason"))).unionByName(unpaired)
    faults = cut(missing.unionByName(wrong).unionByName(unread).unionByName(lost))
    return Report(faults, cut(skipped), {name: o.get["n"] for name, o in counts.items()})
