"""Words to lines, pages to texts, and the cut of a page at a height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions.text import clean, let, round2


def project_words(items: DataFrame) -> DataFrame:
    """Placed text items (matrix m0..m5 in page space, t0, t1 of the item, width) to words, rounded to 2 places.

    Blank items and items without any extent are left out.
    """
    along = F.hypot("m0", "m1") / F.coalesce(F.nullif(F.hypot("t0", "t1"), F.lit(0.0)), F.lit(1.0))
    h = F.hypot("m2", "m3")
    w = F.col("width") * F.when((along > 0) & (along < float("inf")), along).otherwise(F.lit(1.0))
    kept = items.where((F.trim("text") != "") & ((F.col("width") > 0) | (F.col("height") > 0)))
    return kept.select("doc_id", "page", "word_ix", "text", round2(F.col("m4")).alias("x"), round2(F.col("m5") - h).alias("y"), round2(w).alias("w"), round2(h).alias("h"))


def page_runs(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of each page in order of (y, x, word_ix), as runs of neighbours of one y and one height."""
    ws = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x", "word_ix", "w", "h", "text"))).alias("ws"))
    differs = lambda i, c: ~F.get("ws", i)[c].eqNullSafe(F.get("ws", i - 1)[c])
    starts = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: (i == 0) | differs(i, "y") | differs(i, "h"))
    own = lambda starts, s, k: F.slice("ws", s + 1, F.coalesce(F.get(starts, k + 1), F.size("ws")) - s)
    word = lambda w: F.struct(*[w[c].alias(c) for c in ("x", "word_ix", "text", "w")])
    run = lambda starts: F.transform(starts, lambda s, k: F.struct(F.get("ws", s)["y"].alias("y"), F.get("ws", s)["h"].alias("h"), F.transform(own(starts, s, k), word).alias("words")))
    return ws.select(*keys, let(starts, run).alias("runs"))


def run_lines(pages: DataFrame, keys: list[str], words: bool = True) -> DataFrame:
    """A row for each page: its lines, in order of their tops, with their text and, if asked for, their words by x.

    ``runs`` are the page's, in order: y, h and words (x, word_ix, text, w), by x.  A run joins the first line whose
    centre (that of its first word) is within 0.6 of the greater of both heights; the line's height grows.  The words of
    a run all do what its first does.  Lines that are too far above for the page's greatest height are closed, so few are
    looked at.
    """
    line = "struct<top:double,no:int,centre:double,height:double,bottom:double,of:array<int>>"
    none = F.array().cast(f"array<{line}>")

    def step(s: Column, i: Column) -> Column:
        r = F.get("runs", i)
        mid, end, reach = r["y"] + r["h"] / 2, r["y"] + r["h"], F.col("tall") * 0.6
        new = F.struct(r["y"].alias("top"), s["n"].alias("no"), mid.alias("centre"), r["h"].alias("height"), end.alias("bottom"), F.array(i).alias("of"))
        grown = lambda l: F.struct(l["top"].alias("top"), l["no"].alias("no"), l["centre"].alias("centre"), F.greatest(l["height"], r["h"]).alias("height"), F.greatest(l["bottom"], end).alias("bottom"), F.concat(l["of"], F.array(i)).alias("of"))

        def place(near: Column) -> Column:
            at = F.array_position(F.transform(near, lambda l: F.abs(l["centre"] - mid) <= F.greatest(r["h"], l["height"]) * 0.6), True)
            put = lambda at: F.when(at == 0, F.concat(near, F.array(new))).otherwise(F.transform(near, lambda l, k: F.when(k + 1 == at, grown(l)).otherwise(l)))
            return let(at, put)

        opened = let(F.filter(s["open"], lambda l: r["y"] - l["centre"] <= reach), place)
        done = F.concat(s["done"], F.filter(s["open"], lambda l: r["y"] - l["centre"] > reach))
        return let(opened, lambda o: F.struct(F.greatest(s["n"], F.get(o, F.size(o) - 1)["no"] + 1).alias("n"), o.alias("open"), done.alias("done")))

    start = F.struct(F.lit(0).alias("n"), none.alias("open"), none.alias("done"))
    each = F.filter(F.sequence(F.lit(0), F.size("runs")), lambda i: i < F.size("runs"))
    tall = pages.withColumn("tall", F.array_max(F.transform("runs", lambda r: r["h"])))
    found = tall.withColumn("ls", F.aggregate(each, start, step, lambda s: F.sort_array(F.concat(s["done"], s["open"]))))
    own = lambda r: F.transform(r["words"], lambda w: F.struct(*[w[c].alias(c) for c in ("x", "word_ix", "text")], r["y"].alias("y"), w["w"].alias("w"), r["h"].alias("h"))) if words else r["words"]
    flat = lambda l: F.flatten(F.transform(l["of"], lambda i: own(F.get("runs", i))))
    sorted_words = lambda l: F.when(F.size(l["of"]) == 1, flat(l)).otherwise(F.sort_array(flat(l)))
    text = lambda ws: clean(F.array_join(F.transform(ws, lambda w: w["text"]), " "))
    whole = lambda l, ws: F.struct(*[l[c].alias(c) for c in ("no", "top", "bottom", "centre", "height")], F.size(ws).alias("n_words"), text(ws).alias("text"), *([ws.alias("words")] if words else []))
    return found.select(*keys, F.transform("ls", lambda l: let(sorted_words(l), lambda ws: whole(l, ws))).alias("ls"))


def assign_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words with the number of their line, from 1 in the order in which the lines begin."""
    found = run_lines(page_runs(words, keys), keys).select(*keys, F.explode_outer("ls").alias("l")).where("l is not null")
    return found.select(*keys, (F.col("l.no") + 1).alias("line"), F.explode_outer("l.words").alias("w")).where("w is not null").select(*keys, "line", *[f"w.{c}" for c in ("y", "x", "word_ix", "w", "h", "text")])


def lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Lines in order of their tops: top, bottom, centre, height, text, number of words and the words by x."""
    return lines_of(page_runs(words, keys), keys)


def lines_of(pages: DataFrame, keys: list[str], words: bool = True) -> DataFrame:
    """``lines`` of pages whose words are in runs."""
    # An inner explode would compute the array once more, for a filter on its size.
    got = run_lines(pages, keys, words).select(*keys, F.posexplode_outer("ls").alias("line_ix", "l")).where("l is not null")
    return got.select(*keys, "line_ix", *[f"l.{c}" for c in ("top", "bottom", "centre", "height", "n_words", "text", *(["words"] if words else []))])


def page_text(found: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of each page joined by line feeds."""
    return found.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_ix", "text"))), lambda l: l["text"]), "\n").alias("text"))


def words_below(words: DataFrame, cut: Column) -> DataFrame:
    """Words from a height on (with 1 of slack); a cut that is null or 0 keeps all."""
    return words.where(F.coalesce(cut == 0, F.lit(True)) | (F.col("y") >= cut - 1))


def rules_below(rules: DataFrame, cut: Column) -> DataFrame:
    """Horizontal rules from a height on; vertical ones that reach it, shortened to it."""
    none = F.coalesce(cut == 0, F.lit(True))
    kept = rules.where(none | F.when(F.col("orient") == "H", F.col("pos") >= cut - 1).otherwise(F.col("hi") >= cut - 1))
    return kept.withColumn("lo", F.when(none | (F.col("orient") == "H"), F.col("lo")).otherwise(F.greatest(F.col("lo"), cut - 1)))
