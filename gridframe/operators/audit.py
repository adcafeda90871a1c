"""An independent audit: the printed grid is rebuilt from its rules and compared with what was extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import geometry as G
from gridframe.operators import lines as L


def grid_edges(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of each page's grid: rules of at least 50 % (or 25 %) of the longest of their direction, more than 3
    apart; of both shares the one that gives more cells.  Three edges each way are needed.
    """
    longest = F.max(F.col("hi") - F.col("lo")).over(Window.partitionBy(*keys, "orient"))
    long = rules.withColumn("share", (F.col("hi") - F.col("lo")) / longest)
    per = [
        long.where(F.col("share") >= s).groupBy(*keys).agg(
            F.lit(s).alias("floor"), G.anchored_edges(F.collect_list(F.when(F.col("orient") == "H", F.col("pos")))).alias("rows"), G.anchored_edges(F.collect_list(F.when(F.col("orient") == "V", F.col("pos")))).alias("cols")
        )
        for s in (0.5, 0.25)
    ]
    both = per[0].unionByName(per[1]).where("size(rows) >= 3 and size(cols) >= 3")
    return both.groupBy(*keys).agg(F.max_by(F.struct("rows", "cols"), F.struct(((F.size("rows") - 1) * (F.size("cols") - 1)).alias("n"), "floor")).alias("g")).select(*keys, "g.rows", "g.cols")


def line_bands(found: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Printed lines with the row ``r`` of their page's grid: the first that holds their middle (1 of slack), or of it
    and its neighbours the one that holds more of the line, which may straddle an edge.  -1 outside the grid.
    """
    joined = found.join(edges, keys)
    n = F.size("rows") - 1
    mid = (F.col("top") + F.col("bottom")) / 2
    first = F.get(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (mid > F.get("rows", i) - 1) & (mid < F.get("rows", i + 1) + 1)), F.lit(0))
    over = lambda i: F.least("bottom", F.get("rows", i + 1)) - F.greatest("top", F.get("rows", i))
    down = joined.withColumn("_at", F.coalesce(first, F.lit(-1)))
    down = down.withColumn("_at", F.when((F.col("_at") >= 0) & (F.col("_at") + 1 < n) & (over(F.col("_at") + 1) > over(F.col("_at"))), F.col("_at") + 1).otherwise(F.col("_at")))
    up = F.when((F.col("_at") > 0) & (over(F.col("_at") - 1) > over(F.col("_at"))), F.col("_at") - 1).otherwise(F.col("_at"))
    return down.withColumn("r", up).drop("_at")


def grid_words(words: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of the printed cells: words by their line's row, so that raised signs and second lines stay with it, and by
    their middle strictly inside a column; line by line, from left to right.
    """
    in_rows = line_bands(L.lines(words, keys), edges, keys).where("r >= 0")
    mid_x = F.col("w.x") + F.col("w.w") / 2
    each = in_rows.select(*keys, "r", "line_ix", "cols", F.explode("words").alias("w")).withColumn("c", F.size(F.filter("cols", lambda e: e < mid_x)) - 1)
    inside = each.where((F.col("c") >= 0) & (F.col("c") < F.size("cols") - 1) & (mid_x < F.get("cols", F.col("c") + 1)))
    word = F.struct("line_ix", F.col("w.x").alias("x"), F.col("w.word_ix").alias("word_ix"), F.col("w.text").alias("text"))
    return inside.groupBy(*keys, "r", "c").agg(T.clean(F.array_join(F.transform(F.sort_array(F.collect_list(word)), lambda x: x["text"]), " ")).alias("text"))


def label_columns(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """How many leading columns are prose: at least half of their texts have three letters in a row."""
    wordy = F.avg(F.col("text").rlike("[A-Za-z]{3}").cast("double"))
    per = matrix.groupBy(*keys, "c").agg(wordy.alias("share"))
    fails = per.groupBy(*keys).agg(F.min(F.when(F.col("share") < 0.5, F.col("c"))).alias("first"), (F.max("c") + 1).alias("n"))
    return fails.select(*keys, F.coalesce("first", "n").alias("label_columns"))


def header_rows(matrix: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows stand before the first whose first text is a known row's name, or that has three ticks."""
    ticks = matrix.groupBy(*keys, "r").agg(F.count_if(F.col("text").rlike(r"(?i)^(x|✓|●|•)$")).alias("ticks"), F.min_by("text", "c").alias("label"))
    named = ticks.withColumn("key", T.label_key(F.col("label"))).join(known.select(*keys, T.label_key(F.col("label")).alias("key")).distinct().withColumn("known", F.lit(True)), [*keys, "key"], "left")
    return named.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.coalesce("known", F.lit(False)) | (F.col("ticks") >= 3), F.col("r"))), F.max("r") + 1).alias("header_rows"))


def column_scores(ours: DataFrame, printed: DataFrame, keys: list[str]) -> DataFrame:
    """Likeness of columns: Jaccard of the rows that have a value, and 0.5 for the same heading.

    Pairs are formed through the rows they share, so columns without a common row are no pair.
    """
    a = ours.select(*keys, F.col("col").alias("a"), "row").distinct()
    b = printed.select(*keys, F.col("col").alias("b"), "row").distinct()
    na, nb = a.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("na")), b.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("nb"))
    shared = a.join(b, [*keys, "row"]).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("both"))
    joined = shared.join(na, [*keys, "a"]).join(nb, [*keys, "b"])
    bonus = F.when((T.label_key(F.col("a")) == T.label_key(F.col("b"))) & (T.label_key(F.col("a")) != ""), 0.5).otherwise(0.0)
    return joined.select(*keys, "a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) + bonus).alias("score"))


def greedy_pairs(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one pairs by falling score (then names): a pair is taken if both sides are free."""
    ranked = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "a", "b"))).alias("ps"))
    kind = "array<struct<a:string,b:string,score:double>>"

    def step(out: Column, p: Column) -> Column:
        taken = F.exists(out, lambda o: (o["a"] == p["a"]) | (o["b"] == p["b"]))
        return F.when(taken, out).otherwise(F.concat(out, F.array(F.struct(p["a"].cast("string").alias("a"), p["b"].cast("string").alias("b"), (-p["neg"]).alias("score")))))

    return ranked.select(*keys, F.explode(F.aggregate("ps", F.array().cast(kind), step)).alias("p")).select(*keys, "p.a", "p.b", "p.score")


def uncrossed(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (pos, at) without those that cross the longest ascending run."""
    rows = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "at"))).alias("ps"))
    kept = rows.withColumn("run", G.longest_ascending(F.transform("ps", lambda p: p["at"])))
    return kept.select(*keys, F.explode("run").alias("at")).join(pairs, [*keys, "at"]).select(*keys, "pos", "at")


def foreign(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Grids of which under half of four or more columns found a pair, or where another table starts: not compared."""
    return drawn.select(*keys, (((F.col("n_drawn") >= 4) & (F.col("n_paired") < 0.5 * F.col("n_drawn"))) | F.col("starts_another")).alias("foreign"))


def tokens(text: Column, least: int = 1) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= least)


def missing_rows(printed: DataFrame, ours: DataFrame, keys: list[str]) -> DataFrame:
    """Printed labels that no extracted label shares 0.7 of the smaller word set with; legends aside.

    Pairs are formed through shared words.
    """
    p = printed.where(~F.col("label").rlike(r"(?i)^\s*(x|✓|●|•)\s*[=:-]")).select(*keys, "row", "label", F.array_distinct(tokens(F.col("label"), 2)).alias("ws")).where("size(ws) > 0")
    o = ours.select(*keys, F.col("label").alias("own"), F.array_distinct(tokens(F.col("label"), 2)).alias("own_ws")).where("size(own_ws) > 0").distinct()
    a = p.select(*keys, "row", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    b = o.select(*keys, "own", F.size("own_ws").alias("own_n"), F.explode("own_ws").alias("w"))
    hits = a.join(b, [*keys, "w"]).groupBy(*keys, "row", "n", "own", "own_n").agg(F.count(F.lit(1)).alias("both")).where("both >= 0.7 * least(n, own_n)")
    return p.join(hits.select(*keys, "row").distinct(), [*keys, "row"], "left_anti").select(*keys, "row", "label")


def multiset_diff(printed: DataFrame, ours: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of each row that are printed more often than extracted (lost), or extracted and not printed (extra)."""
    a = printed.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("printed"))
    b = ours.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("ours"))
    both = a.join(b, [*keys, "token"], "full_outer").select(*keys, "token", F.coalesce("printed", F.lit(0)).alias("printed"), F.coalesce("ours", F.lit(0)).alias("ours"))
    return both.withColumn("kind", F.when(F.col("printed") > F.col("ours"), "lost").when(F.col("printed") == 0, "extra")).where("kind is not null")


def bag_contains(a: Column, b: Column) -> Column:
    """Whether each token of a (lone letters aside) is in b at least as often."""
    ts, us = F.filter(tokens(a), lambda t: ~t.rlike("^[a-z]$")), tokens(b)
    return F.forall(ts, lambda t: F.size(F.filter(ts, lambda x: x == t)) <= F.size(F.filter(us, lambda x: x == t)))


def check_cells(pairs: DataFrame) -> DataFrame:
    """Printed and extracted texts of the same cell: fine if either holds the other's tokens, or a phrase spans it."""
    fine = bag_contains(F.col("printed"), F.col("ours")) | bag_contains(F.col("ours"), F.col("printed")) | F.col("spanned")
    return pairs.withColumn("fine", fine)


def phrase_placement(phrases: DataFrame, printed: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases that no printed text of their row holds."""
    texts = printed.groupBy(*keys, "row").agg(T.label_key(F.array_join(F.sort_array(F.collect_list("text")), " ")).alias("printed"), F.transform(F.collect_list("text"), lambda t: T.label_key(t)).alias("each"))
    joined = phrases.join(texts, [*keys, "row"], "left")
    own = T.label_key(F.col("phrase"))
    return joined.where(~F.coalesce(F.col("printed").contains(own) | F.exists("each", lambda t: t.contains(own)), F.lit(False))).select(*keys, "row", "phrase")


def heading_coverage(printed: DataFrame, ours: DataFrame, keys: list[str]) -> DataFrame:
    """Printed headings that are neither part of an extracted one nor hold one."""
    known = ours.groupBy(*keys).agg(F.collect_set(T.label_key(F.col("label"))).alias("known"))
    own = T.label_key(F.col("heading"))
    joined = printed.join(known, keys, "left")
    covered = F.exists("known", lambda k: (k != "") & (k.contains(own) | own.contains(k)))
    return joined.select(*keys, "heading", F.coalesce(covered, F.lit(False)).alias("covered"))


def footnote_text(notes: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a footnote's text stands on its pages: its letters and digits in a row, or 90 % of its words."""
    page = pages.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("page_text"))
    ws = F.array_distinct(tokens(F.col("text"), 3))
    joined = notes.join(page, keys, "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))
    share = F.size(F.array_intersect(ws, tokens(F.col("page_text"), 3))) / F.greatest(F.size(ws), F.lit(1))
    return joined.select(*keys, "marker", (T.label_key(F.col("page_text")).contains(T.label_key(F.col("text"))) | (share >= 0.9)).alias("found"))


def coverage(checks: DataFrame) -> DataFrame:
    """What was compared and what wasn't, by kind and reason."""
    return checks.groupBy("kind", F.coalesce("skipped", F.lit("compared")).alias("state")).agg(F.count(F.lit(1)).alias("n"))
