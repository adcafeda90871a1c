"""Queries over layouts derived from the tables (and a few rare rows): one per operator, with its DuckDB statement where SQL states it plainly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import audit, cells, columns, confidence, footnotes, geometry, header, lines, locate, publish, reconcile, review, rows, rules, tables
from gridframe.plans import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the tables as a query."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(X.Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def joined(array, sep: str = ","):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


LOW = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


def any_of(words: list[str], test: str) -> str:
    return "(" + " or ".join(test.format(w) for w in words) + ")"


HEADING = f"(length(trim(text)) <= 110 and not regexp_matches(trim(text), '{T.TOC_LEADER}') and not (regexp_matches(trim(text), '{T.TOC_NUMBER}') and length(trim(text)) < 80) and not regexp_matches(trim(text), '{T.CROSS_REFERENCE}'))"


@query("heading_predicate", f"select line_ix, {HEADING} as heading from {X.HEADINGS.sql}")
def heading_predicate(data):
    return X.HEADINGS.frame(data).select("line_ix", locate.is_heading(F.col("text")).alias("heading"))


@query("title_lines", f"select line_ix, substring(text, 1, 60) as reason from {X.HEADINGS.sql} where {any_of(T.TITLE_WORDS, 'contains(' + LOW + ', {0!r})')} and {HEADING}")
def title_lines(data):
    return X.HEADINGS.frame(data).where(locate.names_table(F.col("text"))).select("line_ix", F.substring("text", 1, 60).alias("reason"))


@query("period_words", f"select doc_id, page, ({' + '.join(f'max(contains({LOW}, {w!r})::int)' for w in T.PERIOD_WORDS)})::bigint as periods from {X.PERIODS.sql} group by doc_id, page")
def period_words(data):
    found = [F.max(T.norm(F.col("text")).contains(w).cast("int")) for w in T.PERIOD_WORDS]
    total = found[0]
    for f in found[1:]:
        total = total + f
    return X.PERIODS.frame(data).groupBy("doc_id", "page").agg(total.cast("long").alias("periods"))


@query("candidate_ranges")
def candidate_ranges(data):
    out = locate.candidates(X.SCORES.frame(data))
    return out.select("doc_id", F.col("cand_ix").cast("long").alias("cand_ix"), F.col("seed_page").cast("long").alias("seed_page"), "score", "total", joined("pages").alias("pages"))


@query("path_classify", f"""select doc_id, page, path_ix, case when max_y - min_y <= 2.5 and max_x - min_x >= 12 then 'H' else 'V' end as orient, case when max_y - min_y <= 2.5 and max_x - min_x >= 12 then (min_y + max_y) / 2 else (min_x + max_x) / 2 end as pos
  from {X.PATHS.sql} where (max_y - min_y <= 2.5 and max_x - min_x >= 12) or (max_x - min_x <= 2.5 and max_y - min_y >= 12)""")
def path_classify(data):
    return rules.classify_paths(X.PATHS.frame(data)).select("doc_id", "page", "path_ix", "orient", "pos")


@query("box_transform", f"""select box, least(a*min_x+c*min_y, a*min_x+c*max_y, a*max_x+c*min_y, a*max_x+c*max_y) + e as min_x, greatest(a*min_x+c*min_y, a*min_x+c*max_y, a*max_x+c*min_y, a*max_x+c*max_y) + e as max_x,
  least(b*min_x+d*min_y, b*min_x+d*max_y, b*max_x+d*min_y, b*max_x+d*max_y) + f as min_y, greatest(b*min_x+d*min_y, b*min_x+d*max_y, b*max_x+d*min_y, b*max_x+d*max_y) + f as max_y from {X.BOXES.sql} where e is not null""")
def box_transform(data):
    return rules.transform_boxes(X.BOXES.frame(data))


@query("word_rotate", f"""select word_ix, text, floor(m4 * 100 + 0.5) / 100 as x, floor((m5 - sqrt(m2*m2 + m3*m3)) * 100 + 0.5) / 100 as y,
  floor(width * case when sqrt(m0*m0 + m1*m1) / case when sqrt(t0*t0 + t1*t1) = 0 then 1 else sqrt(t0*t0 + t1*t1) end > 0 then sqrt(m0*m0 + m1*m1) / case when sqrt(t0*t0 + t1*t1) = 0 then 1 else sqrt(t0*t0 + t1*t1) end else 1 end * 100 + 0.5) / 100 as w,
  floor(sqrt(m2*m2 + m3*m3) * 100 + 0.5) / 100 as h from {X.ITEMS.sql} where trim(text) <> '' and (width > 0 or height > 0)""")
def word_rotate(data):
    return lines.project_words(X.ITEMS.frame(data)).select("word_ix", "text", "x", "y", "w", "h")


#: The fold as a recursive statement: one piece after the other in order.
@query("rule_merge", f"""with recursive p as (select *, row_number() over (partition by doc_id, page, orient order by pos, lo, hi) as n from (
    select doc_id, page, case when max_y - min_y <= 2.5 and max_x - min_x >= 12 then 'H' else 'V' end as orient, case when max_y - min_y <= 2.5 and max_x - min_x >= 12 then (min_y + max_y) / 2 else (min_x + max_x) / 2 end as pos,
      case when max_y - min_y <= 2.5 and max_x - min_x >= 12 then min_x else min_y end as lo, case when max_y - min_y <= 2.5 and max_x - min_x >= 12 then max_x else max_y end as hi
    from {X.PATHS.sql} where (max_y - min_y <= 2.5 and max_x - min_x >= 12) or (max_x - min_x <= 2.5 and max_y - min_y >= 12))),
  f as (select doc_id, page, orient, n, 0 as rule_ix, pos, lo, hi, 1 as pieces from p where n = 1
    union all select p.doc_id, p.page, p.orient, p.n, case when abs(f.pos - p.pos) <= 2.5 and p.lo <= f.hi + 80 then f.rule_ix else f.rule_ix + 1 end, case when abs(f.pos - p.pos) <= 2.5 and p.lo <= f.hi + 80 then f.pos else p.pos end,
      case when abs(f.pos - p.pos) <= 2.5 and p.lo <= f.hi + 80 then least(f.lo, p.lo) else p.lo end, case when abs(f.pos - p.pos) <= 2.5 and p.lo <= f.hi + 80 then greatest(f.hi, p.hi) else p.hi end,
      case when abs(f.pos - p.pos) <= 2.5 and p.lo <= f.hi + 80 then f.pieces + 1 else 1 end from f join p on p.doc_id = f.doc_id and p.page = f.page and p.orient = f.orient and p.n = f.n + 1)
  select doc_id, page, orient, rule_ix::bigint as rule_ix, arg_max(pos, n) as pos, arg_max(lo, n) as lo, arg_max(hi, n) as hi, max(pieces)::bigint as pieces from f group by doc_id, page, orient, rule_ix""")
def rule_merge(data):
    out = rules.merge_rules(rules.classify_paths(X.PATHS.frame(data)), ["doc_id", "page", "orient"])
    return out.select("doc_id", "page", "orient", F.col("rule_ix").cast("long").alias("rule_ix"), "pos", "lo", "hi", F.col("pieces").cast("long").alias("pieces"))


@query("edge_dedupe", f"""with recursive p as (select grp, pos, row_number() over (partition by grp order by pos) as n from {X.EDGES.sql}), f as (select grp, n, pos as kept, true as own from p where n = 1
  union all select p.grp, p.n, case when p.pos - f.kept > 3 then p.pos else f.kept end, p.pos - f.kept > 3 from f join p on p.grp = f.grp and p.n = f.n + 1) select grp, kept as pos from f where own""")
def edge_dedupe(data):
    return X.EDGES.frame(data).groupBy("grp").agg(geometry.anchored_edges(F.collect_list("pos")).alias("e")).select("grp", F.explode("e").alias("pos"))


@query("interval_coverage", f"""with i as (select *, max(high) over (partition by grp order by low, high rows between unbounded preceding and 1 preceding) as reach from {X.INTERVALS.sql})
  select grp, sum(greatest(0.0, high - greatest(low, coalesce(reach, low)))) as covered from i group by grp""")
def interval_coverage(data):
    return geometry.interval_cover(X.INTERVALS.frame(data), ["grp"], "low", "high")


@query("nearest_band", f"""with b as (select *, lead(centre) over (partition by doc_id, page order by band_ix) as c2 from {X.BANDS.sql}), s as (select doc_id, page, c2 - centre as spacing from b where band_ix = 0),
  g as (select p.doc_id, p.page, p.word_ix, b.band_ix, greatest(0.0, b."left" - p.centre, p.centre - b."right") as gap, row_number() over (partition by p.doc_id, p.page, p.word_ix order by greatest(0.0, b."left" - p.centre, p.centre - b."right"), b.band_ix) as n
    from {X.POINTS.sql} p join b on b.doc_id = p.doc_id and b.page = p.page)
  select g.doc_id, g.page, g.word_ix, g.band_ix, g.gap from g join s on s.doc_id = g.doc_id and s.page = g.page where n = 1 and gap <= greatest(14.0, coalesce(spacing, 30) * 0.55)""")
def nearest_band(data):
    return geometry.nearest_band(X.POINTS.frame(data), X.BANDS.frame(data), ["doc_id", "page"]).select("doc_id", "page", "word_ix", "band_ix", "gap")


@query("nearest_centre", f"""with g as (select p.doc_id, p.page, p.word_ix, b.band_ix as col_ix, abs(b.centre - p.centre) as gap, row_number() over (partition by p.doc_id, p.page, p.word_ix order by abs(b.centre - p.centre), b.band_ix) as n
    from {X.POINTS.sql} p join {X.BANDS.sql} b on b.doc_id = p.doc_id and b.page = p.page) select doc_id, page, word_ix, col_ix, gap from g where n = 1 and gap <= 40""")
def nearest_centre(data):
    cols = X.BANDS.frame(data).select("doc_id", "page", F.col("band_ix").alias("col_ix"), F.col("centre").alias("col_centre"))
    return geometry.nearest_centre(X.POINTS.frame(data), cols, ["doc_id", "page"]).select("doc_id", "page", "word_ix", "col_ix", "gap")


@query("vertical_words")
def vertical_words(data):
    return geometry.vertical_words(X.VERTICAL.frame(data), ["doc_id", "page"]).select("doc_id", "page", "x", "text")


@query("phrase_runs", f"""with m as (select *, max(x + w) over (partition by doc_id, row, line_ix order by x, word_ix rows between unbounded preceding and 1 preceding) as reach from {X.LINE_WORDS.sql}),
  r as (select *, sum(case when x - reach > 54 then 1 else 0 end) over (partition by doc_id, row, line_ix order by x, word_ix rows unbounded preceding) as run_ix from m)
  select doc_id, row, line_ix, run_ix::bigint as run_ix, min(x) as x0, max(x + w) as x1, string_agg(text, ' ' order by x, word_ix) as text from r group by doc_id, row, line_ix, run_ix""")
def phrase_runs(data):
    return geometry.running_runs(X.LINE_WORDS.frame(data), ["doc_id", "row", "line_ix"], 54.0)


@query("phrase_stacks")
def phrase_stacks(data):
    return cells.phrase_cells(X.LINE_WORDS.frame(data), ["doc_id", "row"], 60.0)


@query("label_key_identity")
def row_identity(data):
    return rows.row_identity(X.LABELS.frame(data), ["doc_id", "cand"]).select("ord", "row_id")


@query("row_prefix_match", f"""with k as (select doc_id, ord, {KEY.format('label')} as k from {X.LABELS.sql}) select a.ord as a, b.ord as b from k a join k b on a.doc_id = b.doc_id and a.ord < b.ord
  where a.k = b.k or (least(length(a.k), length(b.k)) >= 12 and least(length(a.k), length(b.k)) >= 0.7 * greatest(length(a.k), length(b.k)) and (starts_with(a.k, b.k) or starts_with(b.k, a.k)))""")
def row_prefix_match(data):
    ls = X.LABELS.frame(data).select("doc_id", "ord", T.label_key(F.col("label")).alias("k"))
    a, b = ls.alias("a"), ls.alias("b")
    return a.join(b, "doc_id").where((F.col("a.ord") < F.col("b.ord")) & rows.prefix_match(F.col("a.k"), F.col("b.k"))).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))


@query("category_fill", f"""select doc_id, page, entry_ix, label, case when n_values = 0 then 'category' else 'assessment' end as kind,
  case when n_values > 0 then last_value(case when n_values = 0 then label end ignore nulls) over (partition by doc_id, page order by entry_ix rows between unbounded preceding and 1 preceding) end as category from {X.ENTRIES.sql}""")
def category_fill(data):
    return rows.fill_categories(X.ENTRIES.frame(data), ["doc_id", "page"])


@query("assemble_rows")
def assemble_rows(data):
    return rows.assemble_rows(X.ASSEMBLE.frame(data), ["doc_id", "page"])


@query("row_adoption", f"""with d as (select doc_id, page, min(y) + 5 as top, max(y) - 30 as bottom from {X.ASSEMBLE.sql} group by 1, 2), i as (select doc_id, page, count(*) as inferred_marks from {X.ASSEMBLE.sql} where n_marks > 0 group by 1, 2)
  select a.doc_id, a.page, count(*) filter (n_marks > 0 and y >= d.top - 2 and y <= d.bottom + 2) as drawn_marks, any_value(inferred_marks) as inferred_marks, count(*) filter (n_marks > 0 and y >= d.top - 2 and y <= d.bottom + 2) >= any_value(inferred_marks) as use_drawn
  from {X.ASSEMBLE.sql} a join d using (doc_id, page) join i using (doc_id, page) group by a.doc_id, a.page""")
def row_adoption(data):
    ls = X.ASSEMBLE.frame(data)
    drawn = ls.groupBy("doc_id", "page").agg((F.min("y") + 5).alias("top"), (F.max("y") - 30).alias("bottom"))
    marked = ls.where("n_marks > 0")
    return rows.adopt_drawn(marked.select("doc_id", "page", "y"), drawn, marked.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("inferred_marks")), ["doc_id", "page"])


@query("cell_dedupe", f"select doc_id, cand, row_id, band_ix, min(ord) as ord, arg_min(value, ord) as value from {X.CELLS.sql} group by doc_id, cand, row_id, band_ix")
def cell_dedupe(data):
    return cells.dedupe(X.CELLS.frame(data), ["doc_id", "cand"])


@query("superscript_attach", f"""with j as (select m.doc_id, m.page, m.word_ix, l.text as marker, row_number() over (partition by m.doc_id, m.page, m.word_ix order by l.word_ix) as n from {X.MARKS.sql} m join {X.LOOSE.sql} l on l.doc_id = m.doc_id and l.page = m.page
  where length(l.text) <= 2 and l.x between m.x + m.w - 1 and m.x + m.w + 3.5 and l.h <= m.h + 0.5 and l.y <= m.y + m.h and l.y >= m.y - m.h) select doc_id, page, word_ix, marker from j where n = 1""")
def superscript_attach(data):
    return cells.superscripts(X.MARKS.frame(data), X.LOOSE.frame(data), ["doc_id", "page"]).drop("used_ix")


@query("span_cover", f"""with h as (select doc_id, page, row * 10 + head_ix as phrase_ix, text, x0, x1 from {X.HEADS.sql}), j as (select h.*, b.band_ix, b.centre between x0 - 30 and x1 + 30 as inside, greatest(0.0, x0 - centre, centre - x1) as gap from h join {X.HEAD_BANDS.sql} b on b.doc_id = h.doc_id and b.page = h.page),
  n as (select *, count(*) filter (inside) over (partition by doc_id, page, phrase_ix) as covered, row_number() over (partition by doc_id, page, phrase_ix order by gap, band_ix) as near from j)
  select doc_id, page, phrase_ix, text, band_ix from n where inside or (covered = 0 and near = 1 and gap <= 60)""")
def span_cover(data):
    phrases = X.HEADS.frame(data).select("doc_id", "page", (F.col("row") * 10 + F.col("head_ix")).alias("phrase_ix"), "text", "x0", "x1")
    return cells.covered_bands(phrases, X.HEAD_BANDS.frame(data), ["doc_id", "page"], F.lit(60.0))


DEDUPED = f"(select doc_id, cand, row_id, band_ix, arg_min(value, ord) as value from {X.CELLS.sql} group by doc_id, cand, row_id, band_ix)"


@query("span_explode", f"""select doc_id, cand, row_id, band_ix, case when c.value is null then s.text when regexp_matches(s.text, '[0-9]|[A-Za-z]{{3}}') and not contains(c.value, s.text) then c.value || ' ' || s.text else c.value end as value
  from {DEDUPED} c full join {X.SPANS.sql} s using (doc_id, cand, row_id, band_ix)""")
def span_explode(data):
    return cells.explode_spans(cells.dedupe(X.CELLS.frame(data), ["doc_id", "cand"]).drop("ord"), X.SPANS.frame(data), ["doc_id", "cand"])


@query("residual_text", f"""with held as (select doc_id, string_agg(value, chr(10) order by value) as held from {X.VALUES.sql} group by doc_id) select doc_id, word_ix, text from {X.LINE_WORDS.sql} left join held using (doc_id)
  where length(text) >= 3 and not regexp_matches(text, '{T.PAGE_FURNITURE}') and not coalesce(contains(held, text), false)""")
def residual_text(data):
    return cells.residual(X.LINE_WORDS.frame(data), X.VALUES.frame(data), ["doc_id"])


@query("trailing_split", f"""select row_id, col_id, case when f then h else value end as value, case when f then m end as marker from (select *, length(h) > 1 and m in ('a', 'b') as f from (
  select *, regexp_extract(value, '^(.*\\S)\\s+(\\S{{1,3}})$', 1) as h, lower(regexp_extract(value, '^(.*\\S)\\s+(\\S{{1,3}})$', 2)) as m from {X.VALUES.sql}))""")
def trailing_split(data):
    value, marker = cells.split_trailing(F.col("value"), F.array(F.lit("a"), F.lit("b")))
    return X.VALUES.frame(data).select("row_id", "col_id", value.alias("value"), marker.alias("marker"))


ROLE = " ".join(f"when regexp_matches(two, '{p}') then '{r}'" for r, p in columns.ROLES)


@query("header_roles", f"""select ix, case when role = 'visitName' and starts_with(lower(label), 'visits') and numeric then 'visitNumber' else role end as role from (select *, case {ROLE} end as role from (
  select *, array_to_string(string_split(label, ' ')[1:2], ' ') as two from {X.CAPTIONS.sql}))""")
def header_roles(data):
    return X.CAPTIONS.frame(data).select("ix", columns.role_of(F.col("label"), F.col("numeric")).alias("role"))


@query("dimension_captions", f"select ix, regexp_matches(array_to_string(string_split(label, ' ')[1:2], ' '), '{columns.DIMENSION}') as dimension from {X.CAPTIONS.sql}")
def dimension_captions(data):
    return X.CAPTIONS.frame(data).select("ix", columns.names_dimension(F.col("label")).alias("dimension"))


FIRST = "arg_min(value, row_ix) filter (role = '{}')"


@query("header_pivot", f"""with f as (select doc_id, cand, band_ix, {FIRST.format('visitNumber')} as visit_number, {FIRST.format('studyDay')} as study_day, {FIRST.format('studyWeek')} as study_week, {FIRST.format('window')} as visit_window, {FIRST.format('period')} as period,
    string_agg(value, ' / ' order by row_ix) filter (role is null) as free, arg_min(value, row_ix) filter (role is null) as head from {X.HEADER_VALUES.sql} group by doc_id, cand, band_ix)
  select doc_id, cand, band_ix, visit_number, study_day, study_week, visit_window, coalesce(visit_number, period, head, 'Column ' || (band_ix + 1)) as label, coalesce(concat_ws(' / ', period, free), '') as path from f""")
def header_pivot(data):
    return columns.header_pivot(X.HEADER_VALUES.frame(data), ["doc_id", "cand"])


@query("ruled_spans", f"""select h.doc_id, h.page, h.head_ix, h.text, b.band_ix from {X.HEADS.sql} h join {X.HEAD_CELLS.sql} c on c.doc_id = h.doc_id and (x0 + x1) / 2 >= cell_left and (x0 + x1) / 2 < cell_right
  join {X.HEAD_BANDS.sql} b on b.doc_id = h.doc_id and b.centre >= cell_left and b.centre < cell_right where h.row = 0""")
def ruled_spans(data):
    return columns.ruled_spans(X.HEADS.frame(data).where("row = 0"), X.HEAD_CELLS.frame(data), X.HEAD_BANDS.frame(data), ["doc_id", "page"])


#: All cuts are enumerated: three headings over seven bands, two over three.
@query("centred_spans", f"""with h as (select *, (x0 + x1) / 2 as mid from {X.HEADS.sql} where row = 0), b as (select * from {X.HEAD_BANDS.sql}),
  a3 as (select p.band_ix as p, q.band_ix as q from b p join b q on p.doc_id = 'a' and q.doc_id = 'a' and p.band_ix >= 1 and q.band_ix > p.band_ix),
  c3 as (select p, q, abs((select (100 + b.centre) / 2 from b where doc_id = 'a' and band_ix = p - 1) - (select mid from h where doc_id = 'a' and head_ix = 0)) as d0,
    abs((select b.centre from b where doc_id = 'a' and band_ix = p) / 2 + (select b.centre from b where doc_id = 'a' and band_ix = q - 1) / 2 - (select mid from h where doc_id = 'a' and head_ix = 1)) as d1,
    abs((select b.centre from b where doc_id = 'a' and band_ix = q) / 2 + 235 - (select mid from h where doc_id = 'a' and head_ix = 2)) as d2 from a3),
  best as (select * from c3 order by d0 + d1 + d2, p, q limit 1)
  select 'a' as doc_id, 1 as page, case when band_ix < p then 0 when band_ix < q then 1 else 2 end as head_ix, band_ix from b, best where doc_id = 'a' and d0 <= 30 and d1 <= 30 and d2 <= 30""")
def centred_spans(data):
    out = columns.centred_spans(X.HEADS.frame(data).where("row = 0"), X.HEAD_BANDS.frame(data), ["doc_id", "page"])
    return out.where("doc_id = 'a'").select("doc_id", "page", "head_ix", F.col("band_ix").cast("int").alias("band_ix"))


@query("sparse_spans", f"""with j as (select h.doc_id, h.page, h.head_ix, h.text, b.band_ix, b.centre between x0 and x1 as inside, abs(b.centre - (x0 + x1) / 2) as gap from {X.HEADS.sql} h join {X.HEAD_BANDS.sql} b on b.doc_id = h.doc_id and b.page = h.page where h.row = 0),
  n as (select *, count(*) filter (inside) over (partition by doc_id, page, head_ix) as covered, row_number() over (partition by doc_id, page, head_ix order by gap, band_ix) as near from j),
  u as (select doc_id, page from n group by doc_id, page having bool_or(covered >= 2 or length(text) >= 4))
  select n.doc_id, n.page, head_ix, text, band_ix, covered = 0 as inferred from n join u on u.doc_id = n.doc_id and u.page = n.page where inside or (covered = 0 and near = 1)""")
def sparse_spans(data):
    return columns.sparse_spans(X.HEADS.frame(data).where("row = 0"), X.HEAD_BANDS.frame(data), ["doc_id", "page"])


@query("spacer_gaps", f"""with s as (select *, centre - lag(centre) over (partition by doc_id, page order by band_ix) as step from {X.HEAD_BANDS.sql}), p as (select doc_id, page, arg_min(step, band_ix) filter (step is not null) as pitch from s group by doc_id, page)
  select s.doc_id, s.page, band_ix, step, pitch from s join p on p.doc_id = s.doc_id and p.page = s.page where step > 1.6 * pitch""")
def spacer_gaps(data):
    return columns.spacers(X.HEAD_BANDS.frame(data), ["doc_id", "page"])


@query("column_continuation")
def column_continuation(data):
    return columns.continue_columns(X.CONTINUED.frame(data), ["doc_id", "cand"]).select("own_id", "id", "page")


@query("empty_column_prune", f"""select doc_id, cand, id from {X.T_COLUMNS.sql} c where not (ruled and regexp_matches(label, '^Column [0-9]+$') and visit_number is null and study_day is null and study_week is null and visit_window is null
  and not exists (select 1 from {X.T_CELLS.sql} x where x.doc_id = c.doc_id and x.cand = c.cand and x.col_id = c.id))""")
def empty_column_prune(data):
    return columns.prune_empty(X.T_COLUMNS.frame(data), X.T_CELLS.frame(data), ["doc_id", "cand"]).select("doc_id", "cand", "id")


@query("divider_columns", f"select row_id, col_id, value from {X.VALUES.sql} where not (col_id = 'c1' and regexp_matches(value, '^[A-WYZa-wyz]$'))")
def divider_columns(data):
    dividers = data.spark.sql("select 'a' as doc_id, 0 as cand, 'c1' as col_id, true as timed")
    return columns.divide(X.VALUES.frame(data), dividers, ["doc_id", "cand"]).select("row_id", "col_id", "value")


@query("glossary_parse", f"""with l as (select *, regexp_extract(text, '{T.GLOSSARY_LABEL}') as head from {X.DEFS.sql}),
  p as (select *, list_filter(list_transform(string_split(regexp_replace(substring(text, length(head) + 1), '[.;]\\s*$', ''), ';'), lambda x: trim(x)), lambda x: x <> '') as parts from l)
  select doc_id, line_ix, len(parts) > 0 and len(list_filter(parts, lambda x: not regexp_matches(x, '^\\S{{1,20}}(\\s\\S{{1,20}})?\\s*=\\s*\\S'))) = 0 and (head <> '' or len(parts) >= 2) as glossary, lower(regexp_replace(head, '[:\\s]+$', '')) as label from p""")
def glossary_parse(data):
    fits, label = footnotes.glossary(F.col("text"))
    return X.DEFS.frame(data).select("doc_id", "line_ix", fits.alias("glossary"), label.alias("label"))


@query("footnote_sequence", f"""with p as (select line_ix, doc_id, lower(regexp_extract(text, '{T.FOOTNOTE_DEF}', 3)) as marker from {X.DEFS.sql}), q as (select *, lag(marker) over (partition by doc_id order by line_ix) as before from p where marker <> '')
  select doc_id, line_ix, coalesce(length(marker) = 1 and length(before) = 1 and ascii(marker) = ascii(before) + 1, false) as follows from q""")
def footnote_sequence(data):
    p = X.DEFS.frame(data).select("doc_id", "line_ix", F.lower(F.regexp_extract("text", T.FOOTNOTE_DEF, 3)).alias("marker")).where("marker != ''")
    before = F.lag("marker").over(Window.partitionBy("doc_id").orderBy("line_ix"))
    return p.withColumn("before", before).select("doc_id", "line_ix", F.coalesce(T.follows(F.col("marker"), F.col("before")), F.lit(False)).alias("follows"))


@query("footnote_segments")
def footnote_segments(data):
    ls = X.DEFS.frame(data).withColumn("plausible", F.array(*[F.lit(m) for m in X.PLAUSIBLE]))
    return footnotes.segments(ls, ["doc_id", "page"])


@query("plausible_markers", f"""with e as (select doc_id, cand, regexp_extract(text, '{T.TRAILING}', 1) as m from {X.TEXTS.sql} union all select doc_id, cand, regexp_extract(text, '\\s([a-z]{{1,2}}|\\d{{1,2}}|[*†‡§¶#]{{1,3}})$', 1) from {X.TEXTS.sql}
  union all select doc_id, cand, regexp_extract(text, '^([A-Za-z]{{1,2}}|[*†‡§¶#]{{1,3}})$', 1) from {X.TEXTS.sql} where whole) select distinct doc_id, cand, lower(m) as marker from e where m <> ''""")
def plausible_markers(data):
    return footnotes.plausible_markers(X.TEXTS.frame(data), ["doc_id", "cand"])


@query("footnote_pages")
def footnote_pages(data):
    return footnotes.merge_pages(X.NOTES.frame(data), ["doc_id", "cand"])


@query("footnote_dedupe", f"""select doc_id, cand, marker, arg_max(text, length(text)) as text, string_agg(distinct page::varchar, ',' order by page::varchar) as pages from {X.NOTES.sql} group by doc_id, cand, marker, lower(substring(text, 1, 60))""")
def footnote_dedupe(data):
    return footnotes.dedupe(X.NOTES.frame(data), ["doc_id", "cand"])


MARKED = "(regexp_matches(value, '^[Xx✓●•]\\s*' || marker || '$') or value = marker or contains(value, '(' || marker || ')') or regexp_matches(value, '[Xx0-9]\\s*' || marker || '([^A-Za-z0-9_]|$)'))"


@query("marker_links", f"select row_id, col_id, marker from {X.VALUES.sql} join {X.MARKERS.sql} using (doc_id, cand) where marker <> 'x' and {MARKED}")
def marker_links(data):
    return footnotes.links(X.VALUES.frame(data), X.MARKERS.frame(data), ["doc_id", "cand"]).select("row_id", "col_id", "marker")


@query("applies_to", f"""with t as (select doc_id, cand, marker, 'row' as target, row_id, '' as col_id from {X.ROW_LINKS.sql} union all select doc_id, cand, marker, 'cell', row_id, col_id from {X.VALUES.sql} join {X.MARKERS.sql} using (doc_id, cand) where marker <> 'x' and {MARKED})
  select m.marker, coalesce(target, 'table') as target, coalesce(row_id, '') as row_id, coalesce(col_id, '') as col_id from {X.MARKERS.sql} m left join t using (doc_id, cand, marker)""")
def applies_to(data):
    keys = ["doc_id", "cand"]
    found = footnotes.links(X.VALUES.frame(data), X.MARKERS.frame(data), keys)
    return footnotes.applies_to(X.MARKERS.frame(data), X.ROW_LINKS.frame(data), found, keys).select("marker", "target", "row_id", "col_id")


@query("trailing_links", f"""with j as (select t.doc_id, t.cand, t.text, m.marker from {X.TEXTS.sql} t join {X.MARKERS.sql} m on m.doc_id = t.doc_id and m.cand = t.cand
  where (ends_with(text, marker) and length(text) > length(marker) and (not regexp_matches(marker, '^[a-z]') or regexp_matches(text, '[^a-z]' || marker || '$'))) or starts_with(text, marker || ' ')) select text, max(marker) as marker from j group by text""")
def trailing_links(data):
    labels = X.TEXTS.frame(data).select("doc_id", "cand", F.lit("row").alias("target"), F.col("text").alias("id"), "text")
    return footnotes.link_trailing(labels, X.MARKERS.frame(data), ["doc_id", "cand"]).select("text", "marker")


def _tables(data) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return X.T_COLUMNS.frame(data), X.T_ROWS.frame(data), X.T_CELLS.frame(data), X.T_TARGETS.frame(data)


def _short(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "cand", "severity", T.round2(F.col("cost") * 100).alias("cost"), joined("pages").alias("pages"))


NAMED_COLUMN = "(coalesce(nullif(visit_number, ''), nullif(study_day, ''), nullif(study_week, ''), nullif(visit_window, '')) is not null or (coalesce(label, '') <> '' and length(label) <= 14 and not regexp_matches(label, '(?i)^column\\s*[0-9]+$')))"

#: The findings of each check: doc_id, cand, severity, cost and pages.
CHECK_SQL = {
    "unidentified-columns": f"""with n as (select *, {NAMED_COLUMN} as named from {X.T_COLUMNS.sql}),
  s as (select doc_id, cand, count(*) as n, count(*) filter (not named) as bad, string_agg(distinct page::varchar, ',' order by page::varchar) filter (not named) as pages from n group by 1, 2)
  select doc_id, cand, case when bad / n > 0.4 then 'high' else 'low' end as severity, least(0.55, 0.8 * (bad / n)) as cost, pages from s where bad > 0""",
    "column-count-disagrees": f"""with p as (select doc_id, cand, page, count(*) as n from {X.T_COLUMNS.sql} where page is not null group by 1, 2, 3), s as (select doc_id, cand, max(n) as most, min(n) as fewest, string_agg(page::varchar, ',' order by page) as pages from p group by 1, 2 having count(*) >= 2 and max(n) - min(n) > 1)
  select doc_id, cand, case when most >= 2 * fewest then 'high' else 'low' end as severity, least(0.4, (most - fewest) / most * 0.6) as cost, pages from s""",
    "duplicate-columns": f"""with g as (select doc_id, cand, col_id as id, string_agg(row_id || '=' || value, '|' order by row_id || '=' || value) as s from {X.T_CELLS.sql} group by 1, 2, 3 having count(*) >= 6),
  c as (select doc_id, cand, s, page, not {NAMED_COLUMN} as unnamed, count(*) over (partition by doc_id, cand, s) as n, row_number() over (partition by doc_id, cand, s order by id) as nth from g join {X.T_COLUMNS.sql} using (doc_id, cand, id))
  select doc_id, cand, case when bool_or(unnamed) then 'high' else 'low' end as severity, least(0.4, 0.15 * count(*) filter (nth > 1)) as cost, string_agg(distinct page::varchar, ',' order by page::varchar) as pages from c where n > 1 group by 1, 2""",
    "unlabelled-rows": f"""with r as (select doc_id, cand, trim(coalesce(label, '')) = '' and exists (select 1 from {X.T_CELLS.sql} x where x.doc_id = r.doc_id and x.cand = r.cand and x.row_id = r.id) as bad from {X.T_ROWS.sql} r),
  s as (select doc_id, cand, count(*) as n, count(*) filter (bad) as bad from r group by 1, 2), p as (select doc_id, cand, string_agg(distinct page::varchar, ',' order by page::varchar) as pages from {X.T_COLUMNS.sql} group by 1, 2)
  select doc_id, cand, case when bad / n > 0.15 then 'high' else 'low' end as severity, least(0.3, 1.5 * (bad / n)) as cost, coalesce(pages, '') as pages from s left join p using (doc_id, cand) where bad > 0""",
    "unlinked-footnotes": f"""with m as (select doc_id, cand, marker, bool_and(target = 'table') as loose from {X.T_TARGETS.sql} group by 1, 2, 3), s as (select doc_id, cand, count(*) as n, count(*) filter (loose) as bad from m group by 1, 2)
  select doc_id, cand, case when bad / n >= 0.55 then 'high' else 'low' end as severity, least(0.35, 0.45 * (bad / n)) as cost, '' as pages from s where bad >= 2 and bad / n >= 0.5""",
    "sparse-grid": f"""with c as (select doc_id, cand, count(*) as cols from {X.T_COLUMNS.sql} group by 1, 2), r as (select doc_id, cand, count(*) as rows from {X.T_ROWS.sql} where kind = 'assessment' group by 1, 2), x as (select doc_id, cand, count(*) as n from {X.T_CELLS.sql} group by 1, 2)
  select doc_id, cand, 'low' as severity, 0.2::double as cost, '' as pages from c join r using (doc_id, cand) left join x using (doc_id, cand) where coalesce(n, 0) / (cols * rows) < 0.08""",
}


def short_sql(check: str) -> str:
    return f"select doc_id, cand, severity, floor(cost * 100 * 100 + 0.5) / 100 as cost, pages from ({CHECK_SQL[check]})"


@query("check_unidentified", short_sql("unidentified-columns"))
def check_unidentified(data):
    return _short(confidence.unidentified(_tables(data)[0]))


@query("check_column_counts", short_sql("column-count-disagrees"))
def check_column_counts(data):
    return _short(confidence.column_counts(_tables(data)[0]))


@query("check_duplicates", short_sql("duplicate-columns"))
def check_duplicates(data):
    c, _, x, _ = _tables(data)
    return _short(confidence.duplicates(c, x))


@query("check_unlabelled", short_sql("unlabelled-rows"))
def check_unlabelled(data):
    c, r, x, _ = _tables(data)
    return _short(confidence.unlabelled(r, x, c))


@query("check_unlinked", short_sql("unlinked-footnotes"))
def check_unlinked(data):
    return _short(confidence.unlinked(_tables(data)[3]))


@query("check_sparse", short_sql("sparse-grid"))
def check_sparse(data):
    c, r, x, _ = _tables(data)
    return _short(confidence.sparse(c, r, x))


ASSESS_SQL = f"""with f as ({" union all ".join(f"select {o} as o, '{name}' as name, doc_id, cand, severity, cost, pages from ({sql})" for o, (name, sql) in enumerate(CHECK_SQL.items()))}),
  g as (select doc_id, cand, list_reduce(list_prepend(1.0::double, list(1 - cost order by o)), lambda a, x: a * x) as product, bool_or(severity = 'high') as high, string_agg(name, ',' order by o) as checks,
    list_sort(list_filter(list_distinct(flatten(list(string_split(pages, ',')) filter (severity = 'high'))), lambda p: p <> '')) as fallback from f group by 1, 2)
  select doc_id, cand, floor(coalesce(product, 1.0) * 100 + 0.5) / 100 as confidence, case when high then 'fallback' when high is not null then 'check' else 'trust' end as verdict,
    coalesce(array_to_string(fallback, ','), '') as fallback_pages, coalesce(checks, '') as checks from (select distinct doc_id, cand from {X.T_COLUMNS.sql}) left join g using (doc_id, cand)"""


@query("assess", ASSESS_SQL)
def assess(data):
    return confidence.assess_packed(X.packed_tables(data))


@query("assess_summary", f"""select doc_id, cand, 'confidence ' || regexp_replace(printf('%.2f', confidence), '\\.?0+$', '') || ' — ' || case verdict when 'trust' then 'self-checks passed' else verdict || ': ' || string_split(checks, ',')[1] end as summary from ({ASSESS_SQL})""")
def assess_summary(data):
    return confidence.summarise(confidence.assess_packed(X.packed_tables(data)))


FACT_KEYS = " union all ".join(f"select doc_id, cand, ord, '{t}:' || {KEY.format(c)} as key from {{0}} where not divider and {KEY.format(c)} <> ''" for t, c in (("n", "visit_number"), ("d", "study_day"), ("w", "study_week"), ("l", "label")))


@query("restore_header", f"""with r as ({FACT_KEYS.format(X.REVIEWED.sql)}), g as ({FACT_KEYS.format(X.GEOMETRIC.sql)}), h as (select r.doc_id, r.cand, r.ord, min(g.ord) as g from r join g using (doc_id, cand, key) group by 1, 2, 3)
  select a.doc_id, a.cand, a.ord, a.label, {", ".join(f"coalesce(nullif(a.{c}, ''), nullif(b.{c}, '')) as {c}" for c in reconcile.FACTS)} from {X.REVIEWED.sql} a left join h using (doc_id, cand, ord) left join {X.GEOMETRIC.sql} b on b.doc_id = a.doc_id and b.cand = a.cand and b.ord = h.g""")
def restore_header(data):
    return reconcile.restore_header(X.REVIEWED.frame(data), X.GEOMETRIC.frame(data))


@query("restore_splits")
def restore_splits(data):
    return reconcile.restore_splits(X.SPLIT_ROWS.frame(data), X.DRAWN_LABELS.frame(data))


@query("restore_dividers", f"""with a as (select doc_id, cand, id, label, row_number() over (partition by doc_id, cand order by ord) as place, 0 as side, false as divider from {X.REVIEWED.sql} union all select doc_id, cand, 'divider-' || {KEY.format('label')}, label, after, 1, true from {X.DIVIDERS.sql})
  select doc_id, cand, row_number() over (partition by doc_id, cand order by place, side, id) - 1 as ord, id, label, divider from a""")
def restore_dividers(data):
    return reconcile.restore_dividers(X.REVIEWED.frame(data), X.DIVIDERS.frame(data)).withColumn("ord", F.col("ord").cast("long"))


@query("review_accepted", """select 'a' as doc_id, 0 as cand, true as accepted union all select 'b', 0, false""")
def review_accepted(data):
    reviewed = data.spark.sql("select * from values ('a', 0, 5, 11, 9), ('b', 0, 5, 11, 3) as t(doc_id, cand, n_cols, n_rows, n_named)")
    return reconcile.acceptable(reviewed, data.spark.sql("select * from values ('a', 0, 12), ('b', 0, 12) as t(doc_id, cand, n_rows)"))


@query("review_price", f"select use_ix, model, tokens_in, tokens_out, floor((tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out) * 10000 + 0.5) / 10000 as dollars from {X.USAGE.sql} left join {X.RATES.sql} using (model)")
def review_price(data):
    return review.price(X.USAGE.frame(data), X.RATES.frame(data))


@query("page_serialise", f"select doc_id, row, string_agg(line, chr(10) order by line_ix) as text from (select doc_id, row, line_ix, 'y=' || (line_ix * 12) || ' ' || string_agg(x::int || ':' || text, ' ' order by x) as line from {X.LINE_WORDS.sql} group by 1, 2, 3) group by 1, 2")
def page_serialise(data):
    ls = X.LINE_WORDS.frame(data).groupBy("doc_id", "row", "line_ix").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("words")).withColumn("y", F.col("line_ix") * 12.0)
    return review.serialise(ls, ["doc_id", "row"])


@query("unescape")
def unescape(data):
    return data.spark.sql(r"select * from values (1, r'café ✓'), (2, 'plain'), (3, r'A') as t(ix, s)").select("ix", review.unescape(F.col("s")).alias("s"))


@query("audit_ascending")
def audit_ascending(data):
    return audit.uncrossed(X.PAIRS.frame(data), ["grp"])


TOKEN_BAG = "regexp_extract_all(lower({}), '[a-z0-9]+')"
HOLDS = "list_bool_and(list_transform(list_filter({a}, lambda t: not regexp_matches(t, '^[a-z]$')), lambda t: len(list_filter({a}, lambda x: x = t)) <= len(list_filter({b}, lambda x: x = t))))"


@query("audit_bag_contains", f"""with b as (select *, {TOKEN_BAG.format('printed')} as p, {TOKEN_BAG.format('ours')} as o from {X.BAGS.sql})
  select ix, coalesce({HOLDS.format(a='p', b='o')}, true) or coalesce({HOLDS.format(a='o', b='p')}, true) or spanned as fine from b""")
def audit_bag_contains(data):
    return audit.check_cells(X.BAGS.frame(data)).select("ix", "fine")


WORDS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) >= {}))"


@query("audit_row_overlap", f"""with p as (select *, {WORDS_SQL.format('label', 2)} as ws from {X.P_ROWS.sql} where not regexp_matches(label, '(?i)^\\s*(x|✓|●|•)\\s*[=:-]')), o as (select *, {WORDS_SQL.format('label', 2)} as ws from {X.O_ROWS.sql})
  select doc_id, page, row, label from p where not exists (select 1 from o where o.doc_id = p.doc_id and o.page = p.page and len(list_intersect(p.ws, o.ws)) >= 0.7 * least(len(p.ws), len(o.ws)) and len(list_intersect(p.ws, o.ws)) > 0)""")
def audit_row_overlap(data):
    return audit.missing_rows(X.P_ROWS.frame(data), X.O_ROWS.frame(data), ["doc_id", "page"])


@query("audit_headings", f"""select doc_id, page, heading, exists (select 1 from {X.OWN_HEADS.sql} o where o.doc_id = h.doc_id and o.page = h.page and {KEY.format('o.label')} <> '' and (contains({KEY.format('o.label')}, {KEY.format('h.heading')}) or contains({KEY.format('h.heading')}, {KEY.format('o.label')}))) as covered from {X.HEADLINES.sql} h""")
def audit_headings(data):
    return audit.heading_coverage(X.HEADLINES.frame(data), X.OWN_HEADS.frame(data), ["doc_id", "page"])


@query("audit_footnote_text", f"""with p as (select doc_id, page, string_agg(text, ' ' order by text) as t from {X.PAGE_TEXTS.sql} group by 1, 2) select doc_id, page, marker, contains({KEY.format('t')}, {KEY.format('text')})
  or len(list_intersect({WORDS_SQL.format('text', 3)}, {WORDS_SQL.format('t', 3)})) / greatest(len({WORDS_SQL.format('text', 3)}), 1) >= 0.9 as found from {X.NOTE_TEXTS.sql} left join p using (doc_id, page)""")
def audit_footnote_text(data):
    return audit.footnote_text(X.NOTE_TEXTS.frame(data), X.PAGE_TEXTS.frame(data), ["doc_id", "page"])


@query("audit_coverage", f"select kind, coalesce(skipped, 'compared') as state, count(*) as n from {X.CHECKS.sql} group by 1, 2")
def audit_coverage(data):
    return audit.coverage(X.CHECKS.frame(data))


CLEANED = "nullif(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')), '')"


@query("publish_columns", f"select doc_id, cand, ord, coalesce(nullif(id, ''), 'c' || ord) as id, coalesce({CLEANED.format('label')}, '') as label, {', '.join(CLEANED.format(c) + ' as ' + c for c in reconcile.FACTS)}, coalesce(divider, false) as divider from {X.RAW_COLUMNS.sql}")
def publish_columns(data):
    return publish.columns(X.RAW_COLUMNS.frame(data))


@query("publish_rows", f"select doc_id, cand, ord, coalesce(nullif(id, ''), 'r' || ord) as id, case when kind = 'category' then 'category' else 'assessment' end as kind, coalesce({CLEANED.format('label')}, '') as label, nullif(category, '') as category from {X.RAW_ROWS.sql}")
def publish_rows(data):
    return publish.rows(X.RAW_ROWS.frame(data))


@query("publish_footnotes", f"""select doc_id, cand, ord, marker, coalesce(nullif(printed, ''), marker) as printed, case when n_targets = 0 and (regexp_full_match(marker, '[A-Za-z][A-Za-z0-9 /-]+') or marker in ('x', 'X', '✓', '✔', '●', '•', '◆', '■')) then 'note' else 'footnote' end as kind,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, coalesce(continued, false) or n_pages > 1 as continued from {X.RAW_NOTES.sql}""")
def publish_footnotes(data):
    return publish.footnotes(X.RAW_NOTES.frame(data))


@query("merge_footnotes")
def merge_footnotes(data):
    return publish.merge_footnotes(X.NOTES.frame(data).select("doc_id", "cand", "ord", "marker", "text", F.array("page").alias("pages"))).select("doc_id", "cand", "marker", "text", joined("pages").alias("pages"))


NAMED = f"line_ix < 12 and length(text) < 120 and {any_of(T.TITLE_WORDS, 'contains(' + LOW + ', {0!r})')} and {HEADING}"


@query("title_pick", f"select doc_id, page, arg_min(text, line_ix) as title from {X.PAGE_LINES.sql} where {NAMED} group by doc_id, page")
def title_pick(data):
    return tables.title_of(X.PAGE_LINES.frame(data), ["doc_id", "page"])


@query("second_table", f"""with s as (select l.*, t.title from {X.PAGE_LINES.sql} l left join {X.TITLES.sql} t using (doc_id, page) where line_ix < 14 and regexp_matches(text, '{T.NEW_TABLE}') and not contains(lower(text), 'continued'))
  select doc_id, page, arg_min(text, line_ix) as another_title, arg_min(y, line_ix) as another_y from s where title is null or substring({KEY.format('text')}, 1, 24) <> substring({KEY.format('title')}, 1, 24) group by doc_id, page""")
def second_table(data):
    return tables.next_table(X.PAGE_LINES.frame(data), X.TITLES.frame(data), ["doc_id", "page"])


@query("page_crop", f"""select doc_id, page, orient, rule_ix, pos, case when coalesce(cut, 0) = 0 or orient = 'H' then lo else greatest(lo, cut - 1) end as lo, hi from {X.CUTS.sql}
  where coalesce(cut, 0) = 0 or case when orient = 'H' then pos >= cut - 1 else hi >= cut - 1 end""")
def page_crop(data):
    return lines.rules_below(X.CUTS.frame(data), F.col("cut")).select("doc_id", "page", "orient", "rule_ix", "pos", "lo", "hi")


@query("work_queue", f"select doc_id, cand_ix from {X.RANKED.sql} where cand_ix = 0 or (cand_ix < 3 and score >= 12)")
def work_queue(data):
    return tables.queue(X.RANKED.frame(data)).select("doc_id", "cand_ix")


@query("accepted_tables", f"""with c as (select doc_id, cand, count(*) as cols, count(*) filter (coalesce(nullif(visit_number, ''), nullif(study_day, ''), nullif(study_week, ''), nullif(visit_window, '')) is not null) as facts from {X.T_COLUMNS.sql} group by 1, 2)
  select doc_id, cand from c where cols >= 2 and exists (select 1 from {X.T_ROWS.sql} r where r.doc_id = c.doc_id and r.cand = c.cand)""")
def accepted_tables(data):
    n = X.T_ROWS.frame(data).groupBy("doc_id", "cand").agg(F.count(F.lit(1)).alias("n_rows"))
    return tables.accept(X.T_COLUMNS.frame(data), n, data.spark.sql("select 'x' as doc_id, 0 as cand, 'x' as title"))


@query("raised_markers", f"""with b as (select doc_id, row, list_sort(list(h) filter (length(text) > 1)) as hs from {X.LABEL_WORDS.sql} group by 1, 2), m as (select doc_id, row, hs[cast(floor(len(hs) / 2) as int) + 1] as body from b)
  select doc_id, row, word_ix, lower(text) as marker from {X.LABEL_WORDS.sql} join m using (doc_id, row) where regexp_matches(text, '^[A-Za-z*†‡§¶#]$') and h < body - 0.4""")
def raised_markers(data):
    return rows.raised_markers(X.LABEL_WORDS.frame(data), ["doc_id", "row"])


@query("heading_continuation", """select * from (values ('a', 1, 0, 'End of Treat-ment'), ('a', 1, 1, 'Follow up period'), ('a', 1, 2, 'Visit')) t(doc_id, page, head_ix, text)""")
def heading_continuation(data):
    return header.continue_headings(X.PIECES_X.frame(data), X.HEADINGS_X.frame(data), ["doc_id", "page"], 20.0).select("doc_id", "page", "head_ix", "text")


@query("header_cells", f"""with h as (select h.*, (x0 + x1) / 2 as mid from {X.HEADS.sql} h), g as (select h.doc_id, h.page, h.row, h.head_ix, h.text, b.band_ix, abs(b.centre - mid) as gap, row_number() over (partition by h.doc_id, h.page, h.row, h.head_ix order by abs(b.centre - mid), b.band_ix) as n
    from h join {X.HEAD_BANDS.sql} b on b.doc_id = h.doc_id and b.page = h.page), s as (select doc_id, page, max(centre) filter (band_ix = 1) - max(centre) filter (band_ix = 0) as spacing from {X.HEAD_BANDS.sql} group by 1, 2)
  select g.doc_id, g.page, g.row, band_ix, string_agg(text, ' ' order by head_ix) as text from g join s on s.doc_id = g.doc_id and s.page = g.page where n = 1 and gap <= greatest(14.0, coalesce(spacing, 30) * 0.55) group by 1, 2, 3, 4""")
def header_cells(data):
    bands = X.HEAD_BANDS.frame(data).withColumn("left", F.col("centre")).withColumn("right", F.col("centre"))
    words = X.HEADS.frame(data).select("doc_id", "page", "row", F.col("head_ix").alias("word_ix"), "text", F.col("x0").alias("x"), (F.col("x1") - F.col("x0")).alias("w"))
    return header.place_words(words, bands, ["doc_id", "page"], ["row"]).select("doc_id", "page", "row", "band_ix", "text")


@query("audit_label_columns", f"""with s as (select doc_id, page, c, avg(regexp_matches(text, '[A-Za-z]{{3}}')::int) as share from {X.MATRIX.sql} group by 1, 2, 3)
  select doc_id, page, coalesce(min(c) filter (share < 0.5), max(c) + 1) as label_columns from s group by 1, 2""")
def audit_label_columns(data):
    return audit.label_columns(X.MATRIX.frame(data), ["doc_id", "page"])


@query("audit_header_rows", f"""with t as (select doc_id, page, r, count(*) filter (regexp_matches(text, '(?i)^(x|✓|●|•)$')) as ticks, arg_min(text, c) as label from {X.MATRIX.sql} group by 1, 2, 3)
  select doc_id, page, coalesce(min(r) filter (ticks >= 3 or exists (select 1 from {X.KNOWN_ROWS.sql} k where k.doc_id = t.doc_id and k.page = t.page and {KEY.format('k.label')} = {KEY.format('t.label')})), max(r) + 1) as header_rows from t group by 1, 2""")
def audit_header_rows(data):
    return audit.header_rows(X.MATRIX.frame(data), X.KNOWN_ROWS.frame(data), ["doc_id", "page"])


@query("audit_phrases", f"""select doc_id, page, row, phrase from {X.PHRASES.sql} p where not exists (select 1 from {X.PRINTED.sql} x where x.doc_id = p.doc_id and x.page = p.page and x.row = p.row and contains({KEY.format('x.text')}, {KEY.format('p.phrase')}))""")
def audit_phrases(data):
    return audit.phrase_placement(X.PHRASES.frame(data), X.PRINTED.frame(data), ["doc_id", "page"])


@query("audit_foreign_grids", f"select doc_id, page, (n_drawn >= 4 and n_paired < 0.5 * n_drawn) or starts_another as foreign_grid from {X.GRIDS.sql}")
def audit_foreign_grids(data):
    return audit.foreign(X.GRIDS.frame(data), ["doc_id", "page"]).withColumnRenamed("foreign", "foreign_grid")


@query("source_lines", f"select doc_id, string_agg(page || ':' || n, ',' order by page) as pages from (select doc_id, page, count(*) as n from {X.PAGE_LINES.sql} where page <= 2 group by 1, 2) group by 1")
def source_lines(data):
    got = publish.source_lines(X.PAGE_LINES.frame(data), X.PAGE_LINES.frame(data).where("page <= 2"))
    entries = F.array_sort(F.transform(F.map_entries("source_pages"), lambda e: F.concat_ws(":", e["key"], F.size(e["value"]))))
    return got.select("doc_id", F.array_join(entries, ",").alias("pages"))
