"""Self-assessment: what it shuffles, and tables that lack a part."""

from pathlib import Path

import pytest

from gridframe.operators import confidence
from gridframe.plans import catalog

DATA = Path("/root/testdata/sf0.001")
COLUMNS = "doc_id string, cand int, id string, label string, visit_number string, study_day string, study_week string, visit_window string, page int"


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["assess", "assess_summary"])
def test_items_are_read_and_shuffled_once(spark, name):
    plan = catalog.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    before = plan.split("FileScan parquet")[0].split("\n")
    depth, above = len(before[-1]), []
    for line in reversed(before[:-1]):
        at = len(line) - len(line.lstrip(" :+-|"))
        if at < depth:
            depth = at
            above.append(line)
    assert sum("Exchange" in line for line in above) == 1, plan


def test_tables_that_lack_a_part(spark):
    columns = spark.createDataFrame([("a", 0, "c0", "Column 1", None, None, None, None, None), ("a", 0, "c1", "", None, None, None, None, 2), ("b", 0, "c0", "V1", None, None, None, None, 1)], COLUMNS)
    rows = spark.createDataFrame([("a", 0, "r0", "assessment", None), ("rows", 0, "r0", "assessment", " ")], "doc_id string, cand int, id string, kind string, label string")
    cells = spark.createDataFrame([("a", 0, "r0", "c0", "X"), ("rows", 0, "r0", "c0", "X")], "doc_id string, cand int, row_id string, col_id string, value string")
    targets = spark.createDataFrame([("a", 0, None, "table"), ("a", 0, "b", "table"), ("a", 0, "c", None), ("b", 0, "a", "table"), ("b", 0, "a", "row"), ("b", 0, "b", "table")], "doc_id string, cand int, marker string, target string")
    found = confidence.findings(columns, rows, cells, targets)
    got = sorted((r["doc_id"], r["check"], r["severity"], round(r["cost"], 6), r["pages"], r["detail"]) for r in found.collect())
    assert got == [
        ("a", "unidentified-columns", "high", 0.55, [2], "2 of 2 columns"), ("a", "unlabelled-rows", "high", 0.3, [2], "1 of 1 rows"), ("a", "unlinked-footnotes", "high", 0.3, [], "2 of 3 footnotes"), ("rows", "unlabelled-rows", "high", 0.3, [], "1 of 1 rows"),
    ]
    want = {("a", 0.22, "fallback", "2", "unidentified-columns,unlabelled-rows,unlinked-footnotes"), ("b", 1.0, "trust", "", "")}
    packed = confidence.pack(cols=columns, rows=rows, cells=cells, targets=targets)
    for judged in (confidence.assess(columns, found), confidence.assess_packed(packed)):
        assert {(r["doc_id"], r["confidence"], r["verdict"], r["fallback_pages"], r["checks"]) for r in judged.collect()} == want
