"""Self-assessment: six checks of a table, each over its parts as arrays, and the verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions import text as T

KEYS = ["doc_id", "cand"]

#: What the checks read of a table: a row for each table has its columns, rows, cells and targets as arrays of these.
PARTS = {
    "cols": {"id": "string", "label": "string", "visit_number": "string", "study_day": "string", "study_week": "string", "visit_window": "string", "page": "int"},
    "rows": {"id": "string", "kind": "string", "label": "string"},
    "cells": {"row_id": "string", "col_id": "string", "value": "string"},
    "targets": {"marker": "string", "target": "string"},
}


def kind(part: str) -> str:
    return f"array<struct<{','.join(f'{c}:{t}' for c, t in PARTS[part].items())}>>"


def pack(**relations: DataFrame) -> DataFrame:
    """A row for each table that is in any of the relations, with those as arrays."""
    out = None
    for part, df in relations.items():
        own = df.groupBy(*KEYS).agg(F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in PARTS[part].items()])).alias(part))
        out = own if out is None else out.join(own, KEYS, "full")
    return out.select(*KEYS, *[F.coalesce(part, F.array().cast(kind(part))).alias(part) for part in relations])


def finding(name: str, there: Column, high: Column, cost: Column, pages: Column, detail: Column) -> Column:
    """The finding of a check, or null."""
    return F.when(there, F.struct(F.lit(name).alias("check"), F.when(high, "high").otherwise("low").alias("severity"), cost.alias("cost"), pages.alias("pages"), detail.alias("detail")))


def no_pages() -> Column:
    return F.array().cast("array<int>")


def is_named(c: Column) -> Column:
    """Whether a column has a fact, or a label of at most 14 characters that isn't a mere number of a column."""
    fact = T.nonempty(c["visit_number"], c["study_day"], c["study_week"], c["visit_window"]).isNotNull()
    label = F.coalesce(c["label"], F.lit(""))
    return fact | ((label != "") & (F.length(label) <= 14) & ~label.rlike(r"(?i)^column\s*\d+$"))


def pages_of(columns: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(columns, lambda c: c["page"]))))


def count(array: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(array, test))


def _unidentified() -> Column:
    """Columns without a fact or a short label."""

    def found(bad: Column) -> Column:
        share = F.size(bad) / F.size("cols")
        return finding("unidentified-columns", F.size(bad) > 0, share > 0.4, F.least(F.lit(0.55), 0.8 * share), pages_of(bad), F.concat_ws(" ", F.size(bad), F.lit("of"), F.size("cols"), F.lit("columns")))

    return T.let(F.filter("cols", lambda c: ~is_named(c)), found)


def _column_counts() -> Column:
    """Pages whose numbers of columns differ by two or more; columns without a page don't count."""

    def found(s: Column) -> Column:
        most, fewest = F.array_max(s["n"]), F.array_min(s["n"])
        return finding("column-count-disagrees", (F.size(s["n"]) >= 2) & (most - fewest > 1), most >= 2 * fewest, F.least(F.lit(0.4), (most - fewest) / most * 0.6), s["all"], F.concat_ws(" ", F.lit("from"), fewest, F.lit("to"), most))

    return T.let(T.let(pages_of(F.col("cols")), lambda all_: F.struct(all_.alias("all"), F.transform(all_, lambda p: count("cols", lambda c: c["page"] == p)).alias("n"))), found)


def _duplicates() -> Column:
    """Columns with the same cells as an earlier one; high if either of a pair has no name.  No column is paired with
    more than the first of its group.  Only columns of six or more cells are compared, all their rows and values as one
    text.
    """

    def signed(c: Column) -> Column:
        text = lambda own: F.when(F.size(own) >= 6, F.array_join(F.sort_array(F.transform(own, lambda x: F.concat_ws("=", x["row_id"], x["value"]))), "|"))
        return F.struct(T.let(F.filter("cells", lambda x: x["col_id"] == c["id"]), text).alias("signature"), is_named(c).alias("named"), c["page"].alias("page"))

    def found(same: Column) -> Column:
        pairs = F.size(same) - F.size(F.array_distinct(F.transform(same, lambda c: c["signature"])))
        return finding("duplicate-columns", pairs > 0, F.exists(same, lambda c: ~c["named"]), F.least(F.lit(0.4), 0.15 * pairs), pages_of(same), F.concat_ws(" ", pairs, F.lit("pairs")))

    # Two columns of six cells are twelve.
    whole = F.filter(F.transform(F.when(F.size("cells") >= 12, F.col("cols")).otherwise(F.array().cast(kind("cols"))), signed), lambda c: c["signature"].isNotNull())
    return T.let(T.let(whole, lambda cs: F.filter(cs, lambda c: count(cs, lambda o: o["signature"] == c["signature"]) > 1)), found)


def _unlabelled() -> Column:
    """Rows with cells and no label, among all rows; the pages are the table's."""

    def found(bad: Column) -> Column:
        share = bad / F.size("rows")
        return finding("unlabelled-rows", bad > 0, share > 0.15, F.least(F.lit(0.3), 1.5 * share), pages_of(F.col("cols")), F.concat_ws(" ", bad, F.lit("of"), F.size("rows"), F.lit("rows")))

    return T.let(count("rows", lambda r: (F.trim(F.coalesce(r["label"], F.lit(""))) == "") & F.exists("cells", lambda x: x["row_id"] == r["id"])), found)


def _unlinked() -> Column:
    """Footnotes that apply to the table alone, if they are two and half of all."""
    applies = lambda m, test: F.coalesce(F.exists("targets", lambda t: t["marker"].eqNullSafe(m) & test(t["target"])), F.lit(False))
    loose = lambda m: applies(m, lambda t: t == "table") & ~applies(m, lambda t: t != "table")

    def found(s: Column) -> Column:
        share = s["bad"] / s["n"]
        return finding("unlinked-footnotes", (s["bad"] >= 2) & (share >= 0.5), share >= 0.55, F.least(F.lit(0.35), 0.45 * share), no_pages(), F.concat_ws(" ", s["bad"], F.lit("of"), s["n"], F.lit("footnotes")))

    return T.let(T.let(F.array_distinct(F.transform("targets", lambda t: t["marker"])), lambda ms: F.struct(F.size(ms).alias("n"), count(ms, loose).alias("bad"))), found)


def _sparse() -> Column:
    """Few cells for the columns and assessments that there are."""
    return T.let(
        F.size("cols") * count("rows", lambda r: r["kind"] == "assessment"),
        lambda room: finding("sparse-grid", (room > 0) & (F.size("cells") / F.greatest(room, F.lit(1)) < 0.08), F.lit(False), F.lit(0.2), no_pages(), F.concat_ws(" ", F.size("cells"), F.lit("cells"))),
    )


def _found(tables: DataFrame, *checks: Column) -> DataFrame:
    """A row for each finding."""
    out = tables.select(*KEYS, F.explode_outer(F.array_compact(F.array(*checks))).alias("f"))
    return out.where("f is not null").select(*KEYS, "f.*")


def unidentified(columns: DataFrame) -> DataFrame:
    return _found(pack(cols=columns), _unidentified())


def column_counts(columns: DataFrame) -> DataFrame:
    return _found(pack(cols=columns), _column_counts())


def duplicates(columns: DataFrame, cells: DataFrame) -> DataFrame:
    return _found(pack(cols=columns, cells=cells), _duplicates())


def unlabelled(rows: DataFrame, cells: DataFrame, columns: DataFrame) -> DataFrame:
    return _found(pack(rows=rows, cells=cells, cols=columns), _unlabelled())


def unlinked(targets: DataFrame) -> DataFrame:
    return _found(pack(targets=targets), _unlinked())


def sparse(columns: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    return _found(pack(cols=columns, rows=rows, cells=cells), _sparse())


#: The order in which costs are multiplied.
CHECKS = ["unidentified-columns", "column-count-disagrees", "duplicate-columns", "unlabelled-rows", "unlinked-footnotes", "sparse-grid"]


def every_check() -> list[Column]:
    return [_unidentified(), _column_counts(), _duplicates(), _unlabelled(), _unlinked(), _sparse()]


def findings(columns: DataFrame, rows: DataFrame, cells: DataFrame, targets: DataFrame) -> DataFrame:
    return _found(pack(cols=columns, rows=rows, cells=cells, targets=targets), *every_check())


def verdict(found: Column) -> Column:
    """Confidence (the product of 1 - cost, 2 places), verdict and pages to fall back on, of findings in their order."""
    high = F.filter(found, lambda f: f["severity"] == "high")
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(high, lambda f: f["pages"]))))
    return F.struct(
        T.round2(F.aggregate(found, F.lit(1.0), lambda a, f: a * (1 - f["cost"]))).alias("confidence"), F.when(F.size(high) > 0, "fallback").when(F.size(found) > 0, "check").otherwise("trust").alias("verdict"),
        F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("fallback_pages"), F.array_join(F.transform(found, lambda f: f["check"]), ",").alias("checks"),
    )


def assess(tables: DataFrame, found: DataFrame) -> DataFrame:
    """The verdict on each table, from the findings of all."""
    order = F.array_position(F.array(*[F.lit(c) for c in CHECKS]), F.col("check"))
    got = found.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "check", "severity", "cost", "pages"))).alias("found"))
    none = F.array().cast("array<struct<o:bigint,check:string,severity:string,cost:double,pages:array<int>>>")
    joined = tables.select(*KEYS).distinct().join(got, KEYS, "left").withColumn("found", F.coalesce("found", none))
    return joined.select(*KEYS, verdict(F.col("found")).alias("v")).select(*KEYS, "v.*")


def assess_packed(tables: DataFrame) -> DataFrame:
    """The same of packed tables that have columns: no table's parts meet again, so nothing is shuffled."""
    judged = T.let(F.array_compact(F.array(*every_check())), verdict)
    return tables.where(F.size("cols") > 0).select(*KEYS, judged.alias("v")).select(*KEYS, "v.*")


def summarise(assessments: DataFrame) -> DataFrame:
    """One line a table: the confidence in its shortest form, and the verdict with the first finding, if there is one."""
    shown = F.regexp_replace(F.format_string("%.2f", "confidence"), r"\.?0+$", "")
    rest = F.when(F.col("verdict") == "trust", "self-checks passed").otherwise(F.concat_ws(": ", "verdict", F.substring_index("checks", ",", 1)))
    return assessments.select(*KEYS, F.concat(F.lit("confidence "), shown, F.lit(" — "), rest).alias("summary"))
