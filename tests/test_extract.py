"""The whole extraction on a small printed schedule, ruled and unruled."""

import json

from gridframe.operators import publish, tables
from gridframe.streaming.arrivals import score_arrivals


def schedule(doc: str, ruled: bool):
    words, rules = [], []

    def put(text, x, y):
        for part in text.split():
            words.append((doc, 1, len(words), part, float(x), float(y), 5.0 * len(part), 10.0))
            x += 5 * len(part) + 4

    put("Schedule of Activities", 200, 40)
    put("Visit Number", 20, 80)
    put("Study Day", 20, 94)
    for c in range(4):
        put(str(c + 1), 200 + 60 * c - 2.5, 80)
        put(str(c * 7 + 1), 200 + 60 * c - 2.5, 94)
    for r, name in enumerate(["Physical exam a", "Vital signs", "Blood sample", "Urine sample"]):
        put(name, 20, 114 + 14 * r)
        for c in range(4):
            if (r + c) % 4 != 3:
                put("X", 200 + 60 * c - 2.5, 114 + 14 * r)
    put("a. Only at the first visit of all", 20, 200)
    put("when it is needed", 20, 212)
    if ruled:
        rules += [(doc, 1, "V", i, 170.0 + 60 * i, 75.0, 168.0) for i in range(5)] + [(doc, 1, "H", i, 111.0 + 14 * i, 15.0, 410.0) for i in range(5)]
    return words, rules


def test_schedule_is_recovered(spark, tmp_path):
    words, rules = [], []
    for doc, ruled in (("ruled", True), ("plain", False)):
        w, r = schedule(doc, ruled)
        words, rules = words + w, rules + r
    pages = spark.createDataFrame([("ruled", 1, 600), ("plain", 1, 600)], "doc_id string, page int, width int")
    got = tables.extract(
        spark.createDataFrame(words, "doc_id string, page int, word_ix int, text string, x double, y double, w double, h double"),
        spark.createDataFrame(rules, "doc_id string, page int, orient string, rule_ix int, pos double, lo double, hi double"),
        pages,
        seed=6.0,
    )
    columns = got.columns.orderBy("ord").collect()
    cells = got.cells.collect()
    labels = {(r["doc_id"], r["id"]): r["label"] for r in got.rows.collect()}
    for doc in ("ruled", "plain"):
        mine = [c for c in columns if c["doc_id"] == doc]
        assert [(c["visit_number"], c["study_day"]) for c in mine] == [("1", "1"), ("2", "8"), ("3", "15"), ("4", "22")]
        assert {labels[doc, c["row_id"]] for c in cells if c["doc_id"] == doc} == {"Physical exam a", "Vital signs", "Blood sample", "Urine sample"}
        assert sum(c["doc_id"] == doc for c in cells) == 12 and {c["value"] for c in cells} == {"X"}
    notes = {(r["doc_id"], r["marker"]): r["text"] for r in got.footnotes.collect()}
    assert notes["ruled", "a"] == "Only at the first visit of all when it is needed"
    assert {(r["target"], r["row_id"]) for r in got.targets.collect() if r["doc_id"] == "ruled"} == {("row", "r1")}
    verdicts = {r["doc_id"]: r["verdict"] for r in got.assessments.collect()}
    assert verdicts == {"ruled": "trust", "plain": "trust"}
    one = {r["doc_id"]: json.loads(r["value"]) for r in publish.documents(got).collect()}["ruled"]["tables"][0]
    assert one["title"] == "Schedule of Activities" and len(one["columns"]) == 4 and len(one["rows"]) == 4 and one["rows"][0]["cells"][0]["value"] == "X"


def test_arrivals_are_scored_once(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "X X X\n3X X X\nX X (X)\nX X"), (2, "prose")], schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        score_arrivals(spark, f"{tmp_path}/in", schema, f"{tmp_path}/scores", f"{tmp_path}/state").awaitTermination()
    got = {r["doc_id"]: r["score"] for r in spark.read.parquet(f"{tmp_path}/scores").collect()}
    assert got == {1: 3.88, 2: 0.0}
