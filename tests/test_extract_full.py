"""A printed schedule with everything that the extraction wires together: headings and values over several columns,
raised markers, a word set upright, text that reaches nothing, and a second table on the next page."""

from gridframe.operators import tables

BANDS = [200.0, 260.0, 320.0, 380.0]


def printed():
    words, rules = [], []

    def put(page, text, x, y, h=10.0):
        for part in text.split():
            words.append(("doc", page, len(words), part, float(x), float(y), 5.0 * len(part), h))
            x += 5 * len(part) + 4

    def centred(page, text, x, y, h=10.0):
        put(page, text, x - (5 * len(text.replace(" ", "")) + 4 * text.count(" ")) / 2, y, h)

    for page, title in ((1, "Schedule of Activities"), (2, "APPENDIX II: Blood Collections")):
        put(page, title, 150, 30)
        put(page, "Visit Number", 20, 80)
        put(page, "Study Day", 20, 94)
        for c, x in enumerate(BANDS):
            centred(page, str(c + 1), x, 80)
            centred(page, str(c * 7 + 1), x, 94)
    put(1, "Period", 20, 66)
    centred(1, "Screening", 230, 66)
    centred(1, "Treatment", 350, 66)
    names = ["Physical exam", "Vital signs", "Blood sample", "Urine sample", "Weight"]
    for r, name in enumerate(names):
        put(1, name, 20, 114 + 14 * r)
        for c, x in enumerate(BANDS):
            if (r + c) % 4 != 3:
                centred(1, "X", x, 114 + 14 * r)
    # A raised marker beside the first mark of the first row.
    put(1, "b", 203, 112, 6.0)
    put(1, "Adverse events", 20, 184)
    put(1, "Recorded throughout", 245, 184)
    put(1, "Height", 20, 198)
    for x in BANDS:
        centred(1, "X", x, 198)
    put(1, "b. Before the first dose alone", 20, 240)
    for r, name in enumerate(["Serum", "Plasma", "Whole blood", "Lipids"]):
        put(2, name, 20, 114 + 14 * r)
        for c, x in enumerate(BANDS):
            if (r + c) % 3 != 2:
                centred(2, "X", x, 114 + 14 * r)
    return words, rules


def test_everything_is_wired(spark):
    words, rules = printed()
    got = tables.extract(
        spark.createDataFrame(words, "doc_id string, page int, word_ix int, text string, x double, y double, w double, h double"),
        spark.createDataFrame(rules, "doc_id string, page int, orient string, rule_ix int, pos double, lo double, hi double"),
        spark.createDataFrame([("doc", 1, 600), ("doc", 2, 600)], "doc_id string, page int, width int"),
    )
    titles = {r["cand"]: r["title"] for r in got.assessments.collect()}
    assert titles == {0: "Schedule of Activities", 1: "APPENDIX II: Blood Collections"}
    columns = sorted((r["cand"], r["ord"], r["visit_number"], r["study_day"], r["page"]) for r in got.columns.collect())
    assert columns == [(t, c, str(c + 1), str(c * 7 + 1), t + 1) for t in (0, 1) for c in range(4)]
    rows = {(r["cand"], r["label"]): r for r in got.rows.collect()}
    assert [label for t, label in sorted(rows) if t] == sorted(["Serum", "Plasma", "Whole blood", "Lipids"])
    assert rows[0, "Adverse events"]["kind"] == "assessment" and rows[0, "Height"]["category"] is None
    cells = {(r["cand"], r["row_id"], r["col_id"]): (r["value"], r["markers"]) for r in got.cells.collect()}
    events = {k[2]: v[0] for k, v in cells.items() if k[:2] == (0, rows[0, "Adverse events"]["id"])}
    assert events == {"p1c1": "Recorded throughout", "p1c2": "Recorded throughout"}
    assert cells[0, rows[0, "Physical exam"]["id"], "p1c0"] == ("X", ["b"])
    assert sum(k[0] == 0 and v[0] == "X" for k, v in cells.items()) == 5 * 3 + 1 + 4 - 1 and sum(k[0] for k in cells) == 11
    targets = {(r["marker"], r["target"], r["row_id"], r["col_id"]) for r in got.targets.collect() if r["cand"] == 0}
    assert targets == {("b", "cell", rows[0, "Physical exam"]["id"], "p1c0")}
    assert ("another-table", 2) in {(r["kind"], r["page"]) for r in got.ambiguities.where("cand = 0").collect()}
