"""The audit of a whole document: what is planted is told, what is right isn't, what wasn't compared is accounted for."""

from dataclasses import replace

from pyspark.sql import functions as F
from test_extract_full import BANDS, printed

from gridframe.operators import audit_report, tables


def drawn(spark):
    """The printed schedule with rules around its rows and columns on the first page, none on the second."""
    words, _ = printed()
    ys = [60.0, 74.0, 88.0, 110.0, *[126.0 + 14 * i for i in range(7)]]
    rules = [("doc", 1, "H", i, y, 15.0, 410.0) for i, y in enumerate(ys)] + [("doc", 1, "V", i, x, 60.0, 210.0) for i, x in enumerate([15.0, 170.0, 230.0, 290.0, 350.0, 410.0])]
    frame = spark.createDataFrame(words, "doc_id string, page int, word_ix int, text string, x double, y double, w double, h double")
    lines = spark.createDataFrame(rules, "doc_id string, page int, orient string, rule_ix int, pos double, lo double, hi double")
    return frame, lines, spark.createDataFrame([("doc", 1, 600), ("doc", 2, 600)], "doc_id string, page int, width int")


def test_planted_faults_are_told(spark):
    words, rules, pages = drawn(spark)
    got = tables.extract(words, rules, pages)
    assert got.assessments.count() >= 1 and len(BANDS) == 4
    fine = audit_report.report(got, words, rules)
    assert [tuple(r) for r in fine.faults.where("check != 'cell' or detail not like '%Recorded%'").collect()] == []
    assert fine.compared["rows"] >= 7 and fine.compared["cells"] >= 19 and fine.compared["headings"] >= 4 and fine.compared["footnotes"] >= 1
    assert ("page", "no ruled grid") in {(r["what"], r["reason"]) for r in fine.skipped.collect()}

    ids = {r["label"]: r["id"] for r in got.rows.where("cand = 0").collect()}
    weight, height = ids["Weight"], ids["Height"]
    first = got.columns.where("cand = 0 and ord = 0").first()["id"]
    cells = got.cells.where(~((F.col("row_id") == height) & (F.col("col_id") == first))).withColumn("value", F.when((F.col("row_id") == weight) & (F.col("col_id") == first), "3X").otherwise(F.col("value")))
    broken = replace(
        got, cells=cells, rows=got.rows.where("label != 'Urine sample'"), footnotes=got.footnotes.withColumn("text", F.lit("Something that no page prints anywhere")),
        columns=got.columns.withColumns({c: F.when(F.col("ord") == 3, "99").otherwise(F.col(c)) for c in ("label", "path", "visit_number", "study_day")}),
    )
    told = {(r["check"], r["subject"]) for r in audit_report.report(broken, words, rules).faults.where("detail not like '%Recorded%'").collect()}
    assert ("missing-row", "Urine sample") in told and ("footnote", "b") in told and ("cell", "Weight/0") in told and any(c == "cell" and s.startswith(("Height", "height")) for c, s in told)
    assert any(c == "heading" for c, _ in told) and len([1 for c, _ in told if c == "cell"]) == 2
