"""Queries over pages that are derived from the plain tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import audit, cells, columns, footnotes, geometry, locate, review, rows, tables
from gridframe.operators import lines as L
from gridframe.sources import layout

DOC_LINES = """doc_lines as (
  select doc_id, 1 as page, cast(ix - 1 as integer) as line_ix, text, list_filter(string_split(text, ' '), lambda t: t <> '') as tokens
  from (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as ix from documents))"""

LINE_FACTS = f"""facts as (
  select doc_id, page, line_ix, text, len(tokens) as n_tokens, len(list_filter(tokens, lambda t: regexp_matches(t, '{T.CELL_MARK}'))) as marks,
    regexp_matches(text, '{T.FOOTNOTE_LINE}') as is_footnote from doc_lines)"""


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.doc_lines(layout.table(spark, sf_dir, "documents"))


def _in_any(words: list[str], test: str) -> str:
    return "(" + " or ".join(test.format(w) for w in words) + ")"


TITLE_SQL = _in_any(T.TITLE_WORDS, "contains({{t}}, '{}')")

def _is_title(text: str = "text") -> str:
    low = f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"
    named = TITLE_SQL.replace("{t}", low)
    return f"({named} and {_is_heading(text)})"


def _is_heading(text: str = "text") -> str:
    t = f"trim({text})"
    return f"(length({t}) <= 110 and not regexp_matches({t}, '{T.TOC_LEADER}') and not (regexp_matches({t}, '{T.TOC_NUMBER}') and length({t}) < 80) and not regexp_matches({t}, '{T.CROSS_REFERENCE}'))"


def _heads_row(text: str = "text") -> str:
    low = f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"
    return _in_any(T.HEADER_WORDS, f"(starts_with({low}, '{{0}}') or contains({low}, ' {{0}} '))")


SCORES = f"""{DOC_LINES}, facts as (
  select *, len(tokens) as n_tokens, len(list_filter(tokens, lambda t: regexp_matches(t, '{T.CELL_MARK}'))) as marks,
    len(list_filter(tokens, lambda t: regexp_matches(t, '{T.HEADER_NUMBER}'))) as numbers, regexp_matches(text, '{T.FOOTNOTE_LINE}') as is_footnote, {_is_title()} as is_title, {_heads_row()} as heads from doc_lines),
sums as (
  select doc_id, page, max(case when is_title then 6.0 else 0 end) as title, count(*) filter (heads and numbers >= 3) as headers, sum(marks) as marks,
    count(*) filter (marks >= 3 and marks > 0.4 * n_tokens) as mark_lines, count(*) filter (is_footnote) as footnote_lines,
    {" + ".join(f"max(contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '{w}')::int)" for w in T.PERIOD_WORDS)} as periods
  from facts group by doc_id, page),
scores as (
  select doc_id, page, marks, mark_lines, footnote_lines, floor((title + least(headers, 3) * 2.0 + case when periods >= 2 then least(periods, 4) * 1.0 else 0 end
    + case when marks >= 8 then least(marks / 8, 6.0) else 0 end + case when mark_lines >= 3 then least(mark_lines / 2, 5.0) else 0 end + case when footnote_lines >= 3 then least(footnote_lines / 3, 3.0) else 0 end) * 100 + 0.5) / 100 as score
  from sums)"""


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = locate.page_scores(lines_of(spark, sf_dir))
    return out.select("doc_id", "page", "score", *[F.col(c).cast("long").alias(c) for c in ("marks", "mark_lines", "footnote_lines")])


def page_mark_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = locate.line_facts(lines_of(spark, sf_dir))
    return facts.groupBy("doc_id").agg(F.sum("marks").cast("long").alias("marks"), F.sum("n_tokens").cast("long").alias("tokens"), F.count_if("is_grid").alias("grid_lines"))


def page_footnote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = locate.line_facts(lines_of(spark, sf_dir))
    return facts.groupBy("doc_id").agg(F.count_if("is_footnote").alias("footnote_lines"), F.min(F.when(F.col("is_footnote"), F.col("line_ix"))).cast("long").alias("first_line"))


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = locate.page_scores(lines_of(spark, sf_dir))
    return scores.groupBy(locate.has_grid().alias("has_grid"), locate.is_footnote_block().alias("footnote_block")).agg(F.count(F.lit(1)).alias("n"))


def document_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as the pages of one file, and the ranges found in it."""
    docs = layout.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("page"), F.col("source").alias("file"))
    scores = locate.page_scores(lines_of(spark, sf_dir)).select(F.col("doc_id").cast("int").alias("page"), "score", "marks", "mark_lines", "footnote_lines")
    out = locate.candidates(scores.join(docs, "page").withColumnRenamed("file", "doc_id"), seed=2.0)
    return out.select("doc_id", "cand_ix", "seed_page", "score", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = layout.doc_words(layout.table(spark, sf_dir, "documents"))
    return words.select("doc_id", F.col("line_ix").cast("long").alias("line_ix"), "text", "x", "y", "w")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.lines_of(layout.doc_runs(layout.table(spark, sf_dir, "documents")), ["doc_id"], words=False)
    return out.select("doc_id", F.col("line_ix").cast("long").alias("line_ix"), "top", "bottom", "centre", "height", F.col("n_words").cast("long").alias("n_words"), "text")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_text(lines_of(spark, sf_dir), ["doc_id"])


def footnote_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = footnotes.parse(F.col("text"))
    return lines_of(spark, sf_dir).select("doc_id", F.col("line_ix").cast("long").alias("line_ix"), p["marker"].alias("marker"), p["body"].alias("body")).where("body != ''")


def vocabulary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.vocabulary(lines_of(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"))


def grounding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document's successor as answers: what isn't printed in the document itself is rejected."""
    ls = lines_of(spark, sf_dir)
    asked = ls.where("text != ''").select((F.col("doc_id") - 1).alias("doc_id"), F.col("line_ix").alias("cell_ix"), F.array_join("tokens", " ").alias("value"))
    out = review.grounded(asked, review.vocabulary_arrays(ls))
    return out.select("doc_id", F.col("cell_ix").cast("long").alias("cell_ix"), "kept")


def star_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.star_words(spark, sf_dir).select("page", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "text", "x", "y", "w")


STAR = """cells as (
  select c_nationkey as page, month(o_orderdate) as r, dense_rank() over (order by o_orderpriority) - 1 as c, count(*) as n
  from orders join customer on o_custkey = c_custkey group by c_nationkey, month(o_orderdate), o_orderpriority),
star as (
  select page, r, c, text, 200 + 60 * c - 5.0 * length(text) / 2 as x, 100.0 + 14 * r as y, 5.0 * length(text) as w, 10.0 as h
  from (select *, case n % 4 when 1 then 'X' when 2 then '3X' when 3 then '(X)' end as text from cells) where text is not null
  union all select distinct page, r, -1, 'Panel' || chr(96 + r::int) || 'q', 20.0, 100.0 + 14 * r, 35.0, 10.0 from cells)"""


def _star_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.star_words(spark, sf_dir).where(rows.is_mark(F.col("text"))).withColumn("centre", F.col("x") + F.col("w") / 2)


def mark_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.mark_columns(_star_marks(spark, sf_dir), ["page"], F.lit(600.0))
    return out.select("page", F.col("band_ix").cast("long").alias("band_ix"), F.col("left").cast("double").alias("band_left"), F.col("right").cast("double").alias("band_right"), F.col("centre").cast("double").alias("band_centre"), "hits")


def mark_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.mark_stacks(_star_marks(spark, sf_dir), ["page"])
    return out.select("page", F.col("stack_ix").cast("long").alias("stack_ix"), F.col("left").cast("double").alias("stack_left"), "n")


def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = layout.star_words(spark, sf_dir)
    out = rows.split_words(words, rows.grid_left(words, ["page"], "y"), ["page"])
    return out.groupBy("page").agg(F.count_if(F.col("part") == "label").alias("labels"), F.count_if(F.col("part") == "mark").alias("marks"), F.count_if(F.col("part") == "other").alias("others"), F.max("grid_left").cast("double").alias("grid_left"))


def cells_from_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _star_marks(spark, sf_dir).withColumn("row_id", F.concat(F.lit("r"), F.col("r"))).withColumn("ord", F.col("c"))
    bands = geometry.mark_columns(marks, ["page"], F.lit(600.0))
    out = cells.dedupe(cells.from_marks(marks, bands, ["page"]), ["page"])
    return out.select("page", "row_id", F.col("band_ix").cast("long").alias("band_ix"), "value")


def star_document(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The star words as one ruled page per document: words, rules and pages."""
    flat = layout.star_words(spark, sf_dir).select(F.col("page").cast("string").alias("doc_id"), F.lit(1).alias("page"), (F.col("r") * 10 + F.col("c") + 1).cast("int").alias("word_ix"), "text", "x", "y", "w", "h")
    docs = flat.select("doc_id").distinct()
    vertical = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("doc_id", F.lit(1).alias("page"), F.lit("V").alias("orient"), F.col("i").alias("rule_ix"), (170.0 + 60 * F.col("i")).alias("pos"), F.lit(111.0).alias("lo"), F.lit(279.0).alias("hi"))
    across = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("i")).select("doc_id", F.lit(1).alias("page"), F.lit("H").alias("orient"), F.col("i").alias("rule_ix"), (97.0 + 14 * F.col("i")).alias("pos"), F.lit(20.0).alias("lo"), F.lit(470.0).alias("hi"))
    return flat, vertical.unionByName(across), docs.select("doc_id", F.lit(1).alias("page"), F.lit(600).alias("width"))


def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extraction over the star pages: the cells with their rows' names and columns' places."""
    got = tables.extract(*star_document(spark, sf_dir))
    named = got.rows.select("doc_id", "cand", F.col("id").alias("row_id"), "label")
    return got.cells.join(named, ["doc_id", "cand", "row_id"]).select(F.col("doc_id").cast("int").alias("page"), "label", F.regexp_extract("col_id", r"c(\d+)$", 1).cast("long").alias("c"), "value")


def extract_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tables.extract(*star_document(spark, sf_dir)).assessments
    return got.select("doc_id", "cand", "verdict", "checks")


def audit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed grid rebuilt from its rules alone: what the audit compares the extraction with."""
    words, rules, _ = star_document(spark, sf_dir)
    matrix = audit.grid_words(words, audit.grid_edges(rules, ["doc_id", "page"]), ["doc_id", "page"])
    return matrix.select(F.col("doc_id").cast("int").alias("page"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "text")


def drawn_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from_page = ["doc_id", "page"]
    words, rules, _ = star_document(spark, sf_dir)
    extent = rows.grid_left(words, from_page, "y").select(*from_page, F.lit(114.0).alias("top"), F.lit(278.0).alias("bottom"), "grid_left")
    out = columns.drawn_columns(rules, extent, from_page)
    return out.select(F.col("doc_id").cast("int").alias("page"), F.col("band_ix").cast("long").alias("band_ix"), F.col("left").alias("band_left"), F.col("right").alias("band_right"))


def drawn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, rules, pages = star_document(spark, sf_dir)
    out = rows.drawn_rows(rules.join(pages, ["doc_id", "page"]), rows.grid_left(words, ["doc_id", "page"], "y"), ["doc_id", "page"])
    return out.select(F.col("doc_id").cast("int").alias("page"), F.col("row_ix").cast("long").alias("row_ix"), "top", "bottom")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.event_grid(spark, sf_dir)


def audit_column_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types' sets of users, of the first and the second half of the event ids, paired as columns."""
    events = layout.table(spark, sf_dir, "events")
    half = lambda k: events.where(F.col("event_id") % 2 == k).select(F.lit(1).alias("page"), F.col("event_type").alias("col"), F.col("user_id").alias("row"))
    out = audit.column_scores(half(0), half(1), ["page"])
    return out.select("a", "b", (F.floor(F.col("score") * 1_000_000 + 0.5) / 1_000_000).alias("score"))


def audit_greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = layout.table(spark, sf_dir, "events")
    half = lambda k: events.where(F.col("event_id") % 2 == k).select(F.lit(1).alias("page"), F.col("event_type").alias("col"), F.col("user_id").alias("row"))
    return audit.greedy_pairs(audit.column_scores(half(0), half(1), ["page"]), ["page"]).select("a", "b")


def audit_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user in even ids as printed, in odd ids as extracted."""
    events = layout.table(spark, sf_dir, "events")
    half = lambda k: events.where(F.col("event_id") % 2 == k).select("user_id", F.col("event_type").alias("token"))
    return audit.multiset_diff(half(0), half(1), ["user_id"])


def event_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the same counts of all event types: the duplicate-column signature."""
    grid = _grid(spark, sf_dir).select(F.lit("events").alias("doc_id"), F.lit(0).alias("cand"), F.col("event_type").alias("row_id"), F.col("user_id").cast("string").alias("col_id"), F.col("n").cast("string").alias("value"))
    sums = grid.groupBy("doc_id", "cand", F.col("col_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "row_id", "value"))), "|").alias("signature"))
    return sums.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").cast("long")).alias("first_user"))


STAR_MARKS = f"{STAR}, marks as (select *, x + w / 2 as centre from star where regexp_matches(text, '{T.CELL_TOKEN}') and length(text) <= 14)"
STAR_BANDS = f"""{STAR_MARKS}, steps as (select *, centre - lag(centre) over (partition by page order by centre, w, y) as step from marks),
pitch as (select page, coalesce(list_sort(list(step) filter (step > 1))[cast(floor(count(*) filter (step > 1) / 2) as int) + 1], 20.0) as pitch from steps group by page having count(*) >= 4),
runs as (select s.*, sum(case when step > greatest(5.0, least(pitch * 0.35, 75.0)) then 1 else 0 end) over (partition by page order by centre, w, y rows unbounded preceding) as band_ix from steps s join pitch using (page))"""

#: What stands before a word of the documents to make tokens that begin like marks.
MARK_HEADS = ["", "x", "yes", "no", "prn", "bid", "tid", "id", "qd", "qw", "na", "n/a", "y/n", "3x", "q2w", "(X)", "✓", "12.5", "Daily"]


def mark_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens are marks: the words of all documents, and their first letters behind what marks begin with."""
    words = lines_of(spark, sf_dir).select(F.explode("tokens").alias("w")).distinct()
    ends = words.select(F.explode(F.array(F.substring("w", 1, 1), F.substring("w", 1, 2), F.lit(""))).alias("end")).distinct()
    tokens = ends.select(F.explode(F.transform(F.array(*[F.lit(h) for h in MARK_HEADS]), lambda h: F.concat(h, "end"))).alias("token")).unionByName(words.withColumnRenamed("w", "token")).distinct()
    return tokens.select("token", rows.is_mark(F.col("token")).alias("mark"))


#: The marks that are words, written out: what is none of these and has three letters in a row isn't a mark.
MARK_PREDICATE_SQL = f"""with {DOC_LINES}, w as (select distinct unnest(tokens) as w from doc_lines), e as (select distinct unnest([w[1:1], w[1:2], '']) as e from w),
t as (select distinct h || e as token from e, (select unnest([{", ".join(f"'{h}'" for h in MARK_HEADS)}]) as h) union select w from w)
select token, length(token) <= 14 and regexp_matches(token, '{T.CELL_TOKEN}') and (not regexp_matches(token, '[A-Za-z]{{3}}') or lower(token) in ('bid', 'id', 'tid', 'qd', 'qw', 'prn', 'y/n', 'yes', 'no', 'n/a', 'na')) as mark from t"""

QUERIES = {
    "mark_predicate": mark_predicate,
    "page_scores": page_scores, "page_mark_density": page_mark_density, "page_footnote_lines": page_footnote_lines, "page_kinds": page_kinds, "document_candidates": document_candidates, "doc_words": doc_words, "doc_lines": doc_lines, "page_text": page_text,
    "footnote_parse": footnote_parse, "vocabulary": vocabulary_size, "grounding_validate": grounding_validate, "star_words": star_words, "mark_columns": mark_columns, "mark_stacks": mark_stacks, "label_split": label_split, "cells_from_marks": cells_from_marks,
    "audit_column_pairs": audit_column_pairs, "audit_greedy_pairs": audit_greedy_pairs, "audit_multiset": audit_multiset, "event_signatures": event_signatures,
    "extract_tables": extract_tables, "extract_assessments": extract_assessments, "audit_grid": audit_grid, "drawn_columns": drawn_columns, "drawn_rows": drawn_rows,
}

ORACLES = {
    "mark_predicate": MARK_PREDICATE_SQL,
    "page_scores": f"with {SCORES} select doc_id, page, score::double as score, marks::bigint as marks, mark_lines::bigint as mark_lines, footnote_lines::bigint as footnote_lines from scores",
    "page_mark_density": f"with {DOC_LINES}, {LINE_FACTS} select doc_id, sum(marks)::bigint as marks, sum(n_tokens)::bigint as tokens, count(*) filter (marks >= 3 and marks > 0.4 * n_tokens) as grid_lines from facts group by doc_id",
    "page_footnote_lines": f"with {DOC_LINES}, {LINE_FACTS} select doc_id, count(*) filter (is_footnote) as footnote_lines, min(case when is_footnote then line_ix end)::bigint as first_line from facts group by doc_id",
    "page_kinds": f"with {SCORES} select (mark_lines >= 3 and marks >= 8) as has_grid, (footnote_lines >= 3 and mark_lines < 3) as footnote_block, count(*) as n from scores group by 1, 2",
    "doc_words": f"""with {DOC_LINES}, parts as (select doc_id, line_ix, string_split(text, ' ') as p from doc_lines),
      each as (select doc_id, line_ix, unnest(p) as text, generate_subscripts(p, 1) as ix, p from parts)
      select doc_id, line_ix::bigint as line_ix, text, 5.0::double * (case when ix = 1 then 0 else length(array_to_string(p[1:ix-1], ' ')) + 1 end) as x, 12.0::double * line_ix as y, 5.0::double * length(text) as w from each where text <> ''""",
    "doc_lines": f"""with {DOC_LINES}, full_lines as (select * from doc_lines where len(tokens) > 0)
      select doc_id, (row_number() over (partition by doc_id order by line_ix) - 1)::bigint as line_ix, 12.0::double * line_ix as top, 12.0::double * line_ix + 10 as bottom, 12.0::double * line_ix + 5 as centre, 10.0::double as height, len(tokens)::bigint as n_words,
        trim(regexp_replace(array_to_string(tokens, ' '), '\\s+', ' ', 'g')) as text from full_lines""",
    "page_text": "select doc_id, text from documents",
    "footnote_parse": f"""with {DOC_LINES}, p as (select doc_id, line_ix, regexp_extract(text, '{T.FOOTNOTE_DEF}', 1) as s, regexp_extract(text, '{T.FOOTNOTE_DEF}', 3) as m, regexp_extract(text, '{T.FOOTNOTE_DEF}', 4) as body from doc_lines)
      select doc_id, line_ix::bigint as line_ix, lower(regexp_replace(case when s <> '' then s else m end, '[()]', '', 'g')) as marker, body from p where body <> ''""",
    "vocabulary": f"""with {DOC_LINES} select doc_id, count(distinct term) as terms from (select doc_id, unnest(tokens) as term from doc_lines union all select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) from doc_lines) where term <> '' group by doc_id""",
    "grounding_validate": f"""with {DOC_LINES}, vocab as (select distinct doc_id, term from (select doc_id, unnest(tokens) as term from doc_lines union all select doc_id, trim(text) from doc_lines) where term <> ''),
      asked as (select doc_id - 1 as doc_id, line_ix, array_to_string(tokens, ' ') as value, tokens as pieces from doc_lines where text <> ''),
      each as (select a.doc_id, a.line_ix, value, unnest(pieces) as piece from asked a),
      ok as (select e.doc_id, e.line_ix, bool_and(v.term is not null) as every_piece from each e left join vocab v on v.doc_id = e.doc_id and v.term = e.piece group by 1, 2)
      select a.doc_id, a.line_ix::bigint as cell_ix, coalesce(o.every_piece, true) or exists (select 1 from vocab v where v.doc_id = a.doc_id and v.term = a.value) as kept from asked a left join ok o on o.doc_id = a.doc_id and o.line_ix = a.line_ix""",
    "star_words": f"with {STAR} select page, r::bigint as r, c::bigint as c, text, x::double as x, y::double as y, w::double as w from star",
    "mark_columns": f"with {STAR_BANDS} select page, band_ix::bigint as band_ix, min(centre)::double as band_left, max(centre)::double as band_right, (sum(centre) / count(*))::double as band_centre, count(*) as hits from runs group by page, band_ix",
    "mark_stacks": f"""with {STAR_MARKS}, near as (select page, greatest(6.0, list_sort(list(w))[cast(floor(count(*) / 2) as int) + 1] * 1.5) as near from marks group by page),
      s as (select m.*, near, centre - lag(centre) over (partition by page order by centre, x, y) as step from marks m join near using (page)),
      runs as (select *, sum(case when step > near then 1 else 0 end) over (partition by page order by centre, x, y rows unbounded preceding) as stack_ix from s)
      select page, stack_ix::bigint as stack_ix, min(x)::double as stack_left, count(*) as n from runs group by page, stack_ix having count(*) >= 3""",
    "cells_from_marks": f"with {STAR_MARKS} select page, 'r' || r as row_id, c::bigint as band_ix, text as value from marks",
    "audit_column_pairs": """with e as (select distinct event_id % 2 as half, event_type, user_id from events), n as (select half, event_type, count(*) as n from e group by 1, 2),
      b as (select x.event_type as a, y.event_type as b, count(*) as shared from e x join e y on x.user_id = y.user_id and x.half = 0 and y.half = 1 group by 1, 2)
      select a, b, floor((shared / (p.n + q.n - shared) + case when a = b then 0.5 else 0 end) * 1000000 + 0.5) / 1000000 as score from b join n p on p.half = 0 and p.event_type = a join n q on q.half = 1 and q.event_type = b""",
    "audit_multiset": """with a as (select user_id, event_type as token, count(*) as printed from events where event_id % 2 = 0 group by 1, 2), b as (select user_id, event_type as token, count(*) as ours from events where event_id % 2 = 1 group by 1, 2)
      select * from (select user_id, token, coalesce(printed, 0) as printed, coalesce(ours, 0) as ours, case when coalesce(printed, 0) > coalesce(ours, 0) then 'lost' when coalesce(printed, 0) = 0 then 'extra' end as kind from a full join b using (user_id, token)) where kind is not null""",
    "event_signatures": """with g as (select user_id, event_type, count(*) as n from events group by 1, 2), s as (select user_id, string_agg(event_type || '=' || n, '|' order by event_type || '=' || n) as signature from g group by 1)
      select signature, count(*) as n, min(user_id) as first_user from s group by 1""",
}
STACKS = ORACLES["mark_stacks"].removeprefix(f"with {STAR_MARKS},")
ORACLES["label_split"] = f"""with {STAR_MARKS.replace("marks as", "every_mark as")}, marks as (select * from (select *, count(*) over (partition by page, y) as n from every_mark) where n >= 2),
  stacks as (with {STACKS}), lead as (select page, arg_min(stack_left, stack_ix) as grid_left from stacks group by page)
  select page, count(*) filter (x + w <= grid_left + 2) as labels, count(*) filter (not x + w <= grid_left + 2) as marks, 0::bigint as others, max(grid_left)::double as grid_left from star join lead using (page) group by page"""
ORACLES["extract_tables"] = f"with {STAR} select page, 'Panel' || chr(96 + r::int) || 'q' as label, c::bigint as c, text as value from star where c >= 0"
ORACLES["audit_grid"] = f"with {STAR} select page, (r - 1)::bigint as r, c::bigint as c, text from star where c >= 0"
ORACLES["drawn_columns"] = f"with {STAR} select page, i::bigint as band_ix, (170 + 60 * i)::double as band_left, (230 + 60 * i)::double as band_right from (select distinct page from star), range(5) t(i)"
ORACLES["drawn_rows"] = f"with {STAR} select page, i::bigint as row_ix, (111 + 14 * i)::double as top, (125 + 14 * i)::double as bottom from (select distinct page from star), range(12) t(i)"
