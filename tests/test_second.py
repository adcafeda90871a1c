"""The second reading: asked for tables that can't be trusted, grounded, reconciled, taken or refused."""

from gridframe.operators import reconcile, review, second
from gridframe.operators.tables import Tables

T = "doc_id string, cand int, "


def geometric(spark, verdict="fallback"):
    lines = [("d", 1, i, 10.0 * i, text.split(), text) for i, text in enumerate(["Visit 1 2 3", "Vital signs X X Weekly", "Blood sample for pharmacokinetics X", "tests", "Weight X X X"])]
    frame = spark.createDataFrame([(d, p, i, y, ts, t, [(float(j), w) for j, w in enumerate(ts)]) for d, p, i, y, ts, t in lines], "doc_id string, page int, line_ix int, top double, tokens array<string>, text string, words array<struct<x:double,text:string>>")
    cols = spark.createDataFrame([("d", 0, i, f"c{i}", f"{i + 1}", f"{i + 1}", None, None, None, False, 1, True, i) for i in range(3)] + [("d", 0, 3, "c3", "RANDOMIZATION", None, None, None, None, True, 1, True, 3)], T + "ord int, id string, label string, visit_number string, study_day string, study_week string, visit_window string, divider boolean, page int, ruled boolean, band_ix long")
    rows = spark.createDataFrame([("d", 0, 0, "g0", "Vital signs", "assessment", None), ("d", 0, 1, "g1", "Blood sample for pharmacokinetics tests", "assessment", None)], T + "ord int, id string, label string, kind string, category string")
    cells = spark.createDataFrame([("d", 0, "g0", "c0", "X", []), ("d", 0, "g0", "c2", "Weekly", []), ("d", 0, "g1", "c0", "X", [])], T + "row_id string, col_id string, value string, markers array<string>")
    judged = spark.createDataFrame([("d", 0, 0.2, verdict, "", "", "Schedule", True)], T + "confidence double, verdict string, fallback_pages string, checks string, title string, rows_are_ruled boolean")
    empty = lambda ddl: spark.createDataFrame([], T + ddl)
    return Tables(
        empty("x int"), cols, rows, cells, empty("ord int, marker string, text string, pages string, continued boolean"), empty("marker string, target string, row_id string, col_id string"), empty("check string, severity string, cost double, pages array<int>, detail string"), judged,
        empty("page int, kind string, detail string"), spark.createDataFrame([("d", 0, 1)], T + "page int"), frame,
    )


def readers():
    """Made inside a function, so that they travel to the workers by value."""

    def answer(asked):
        assert "Weekly" in asked["text"] and "--- page 1 ---" in asked["text"] and "4 columns and 2 rows" in asked["context"]
        col = lambda n: {"label": n, "period": "Treat\\u2019d" if n == "2" else None, "visitNumber": n if n != "3" else None, "studyDay": None, "studyWeek": None, "window": None}
        row = lambda label, cells: {"label": label, "category": None, "cells": [{"col": c, "value": v, "markers": []} for c, v in cells]}
        marks = [(0, "X"), (1, "X"), (2, "X")]
        return {"title": "x", "columns": [col("1"), col("2"), col("3")], "rows": [row("Vital signs", [*marks[:2], (2, "made up"), (7, "X")]), row("Blood sample for pharmacokinetics", marks[:1]), row("tests", []), row("Weight", marks)], "footnotes": []}

    def fails(asked):
        raise OSError("no line")

    def poor(asked):
        return {**answer(asked), "rows": answer(asked)["rows"][:1]}

    return answer, fails, poor


def outcomes(got):
    return [(r["outcome"], r["detail"]) for r in got.outcomes.collect()]


def test_a_reading_is_grounded_reconciled_and_taken(spark):
    got = second.read(geometric(spark), readers()[0])
    cells = {(r["row_id"], r["col_id"]): r["value"] for r in got.cells.collect()}
    assert cells == {("r0", "v0"): "X", ("r0", "v1"): "X", ("r0", "v2"): "Weekly", ("r1", "v0"): "X", ("r3", "v0"): "X", ("r3", "v1"): "X", ("r3", "v2"): "X"}
    rows = {r["id"]: r["label"] for r in got.rows.collect()}
    assert rows == {"r0": "Vital signs", "r1": "Blood sample for pharmacokinetics tests", "r3": "Weight"}
    cols = sorted((r["ord"], r["label"], r["visit_number"], r["path"], r["divider"]) for r in got.columns.collect())
    assert cols == [(0, "1", "1", "1", False), (1, "2", "2", "Treat\u2019d", False), (2, "3", "3", "3", False), (3, "RANDOMIZATION", None, None, True)]
    assert [r["reviewed"] for r in got.assessments.collect()] == [True]
    assert sorted((r["path"], r["reason"]) for r in got.rejected.collect()) == [("tables[0].rows[0].cells[2]", "not-printed"), ("tables[0].rows[0].cells[3]", "unknown-column")]
    assert [r["detail"] for r in got.ambiguities.where("kind = 'not-printed'").collect()] == ['1 value(s) of the second reading aren\'t printed on the pages and were left out: Vital signs/2="made up"']
    assert [o for o, _ in outcomes(got)] == ["used"]


def test_refused_failed_or_not_asked_leaves_the_geometry(spark):
    before = sorted(map(repr, geometric(spark).cells.collect()))
    answer, fails, poor = readers()
    cases = ((geometric(spark), None, "not-asked"), (geometric(spark), fails, "no-answer"), (geometric(spark, "trust"), answer, "not-needed"), (geometric(spark), poor, "rejected-dropped-rows"), (geometric(spark), lambda asked: {"tables": [{"columns": [], "rows": 3}, 5]}, "found-no-table"), (geometric(spark), lambda asked: {"tables": []}, "no-answer"))
    for table, reader, outcome in cases:
        got = second.read(table, as_fast(reader))
        assert sorted(map(repr, got.cells.collect())) == before and [o for o, _ in outcomes(got)] == [outcome], outcome
    assert outcomes(second.read(geometric(spark), as_fast(fails)))[0][1] == "OSError: no line"


def as_fast(reader):
    return reader and review.Reviewer(review.Provider("r", (), "big", "small", reader), pause=0.01)


def rich():
    """An answer with everything: ids of its own, periods, markers, footnotes with targets, doubts, a second table."""

    def answer(asked):
        cols = [{"id": "c1", "label": "1", "period": "Screening", "visitNumber": "1"}, {"id": "c2", "label": "2", "visitNumber": 2}]
        rows = [
            {"id": "a", "kind": "category", "label": "Vital signs", "cells": []},
            {"id": "b", "kind": "assessment", "label": "Weight", "markers": ["B"], "cells": [{"col": "c1", "value": "X", "markers": ["a"]}, {"col": "c2", "value": "X"}]},
            {"id": "c", "kind": "assessment", "label": "Blood sample*", "cells": []},
        ]
        notes = [
            {"marker": "a", "text": "Before \\u2018dosing", "page": 1, "appliesTo": [{"target": "column", "col": "c2"}, {"target": "cell", "row": "b", "col": "c9"}, {"target": "row", "row": "b"}]},
            {"marker": "a", "text": "and after", "page": 2}, {"marker": "b", "text": "By hand", "page": 1}, {"marker": "*", "text": "Fasting", "page": 1}, {"marker": "z", "text": "Nothing", "page": 1, "appliesTo": [{"target": "table"}]},
        ]
        other = {"title": "Blood sample for pharm", "columns": cols, "rows": rows[1:2], "footnotes": [], "ambiguities": []}
        doubts = ["No label could be found for c1 and c2, cannot tell", "The unit of Height is not captured", "Rows cannot be told apart"]
        return {"tables": [{"columns": cols, "rows": rows, "footnotes": notes, "ambiguities": doubts}, other, {"columns": [], "rows": [], "footnotes": [], "ambiguities": []}], "usage": {"input": 1_000_000, "output": 200_000}}

    return answer


def test_periods_markers_footnotes_and_further_tables_arrive(spark):
    got = second.read(geometric(spark), as_fast(rich()), {"big": (2.0, 10.0)})
    notes = {(r["cand"], r["marker"]): (r["text"], r["pages"], r["continued"]) for r in got.footnotes.collect()}
    assert notes == {(0, "a"): ("Before \u2018dosing and after", "1,2", True), (0, "b"): ("By hand", "1", False), (0, "*"): ("Fasting", "1", False), (0, "z"): ("Nothing", "1", False)}
    targets = {(r["marker"], r["target"], r["row_id"], r["col_id"]) for r in got.targets.where("cand = 0").collect()}
    assert targets == {("a", "column", "", "v1"), ("a", "row", "r1", ""), ("a", "cell", "r1", "v0"), ("b", "row", "r1", ""), ("*", "row", "r2", ""), ("z", "table", "", "")}
    assert {(r["row_id"], r["col_id"]): r["markers"] for r in got.cells.where("cand = 0").collect()} == {("r1", "v0"): ["a"], ("r1", "v1"): []}
    assert {r["id"]: r["kind"] for r in got.rows.where("cand = 0").collect()} == {"r0": "category", "r1": "assessment", "r2": "assessment"}
    assert [r["path"] for r in got.columns.where("cand = 0 and not divider").orderBy("ord").collect()] == ["Screening", "2"]
    assert sorted(r["cand"] for r in got.assessments.collect()) == [0, 1] and got.rows.where("cand = 1").count() == 1
    assert [tuple(r) for r in got.pages.where("cand = 1").select("page").collect()] == [(1,)]
    kinds = sorted((r["kind"], r["detail"]) for r in got.ambiguities.where("cand = 0").collect())
    assert kinds == [("second-reading", "Rows cannot be told apart"), ("second-reading", "The unit of Height is not captured"), ("settled", "1 doubt(s) of the second reading are settled by what is read now")]
    assert [(r["path"], r["reason"]) for r in got.rejected.collect()] == [("tables[0].footnotes[0].appliesTo[1]", "unknown-column")]
    assert [(r["outcome"], r["model"], r["dollars"], r["attempts"]) for r in got.outcomes.collect()] == [("used", "big", 4.0, 1)]


def requests(spark, n):
    return spark.createDataFrame([(f"d{i}", 0, f"page {i}", "") for i in range(n)], "doc_id string, cand int, text string, context string").repartition(2)


def counting(folder, body):
    """A reader that leaves a file for each time that it is asked."""

    def reader(asked):
        import time
        import uuid

        open(f"{folder}/{asked['doc_id']}-{asked['model']}-{uuid.uuid4().hex}", "w").close()
        return body(asked, time)

    return reader


def test_a_task_that_runs_again_asks_nobody_twice(spark, tmp_path):
    calls, ledger = tmp_path / "calls", tmp_path / "ledger"
    calls.mkdir()
    reader = counting(str(calls), lambda asked, time: {"tables": [], "said": asked["text"]})
    who = review.Reviewer(review.Provider("r", (), "big", "small", reader), ledger=str(ledger), pause=0.01)
    first = sorted(map(tuple, review.read_again(requests(spark, 6), who).select("doc_id", "answer", "outcome").collect()))
    again = review.read_again(requests(spark, 6), who)
    assert sorted(map(tuple, again.select("doc_id", "answer", "outcome").collect())) == first and len(list(calls.iterdir())) == 6
    assert again.select("from_ledger").distinct().collect() == [(True,)] and {x[2] for x in first} == {"answered"}
    own = review.Ledger(str(ledger))
    assert own.put("ab12", {"answer": 1}) == {"answer": 1} and own.put("ab12", {"answer": 2}) == {"answer": 1}
    # A job that fails on one table keeps what the others said.
    fresh = tmp_path / "fresh"
    broken = review.Reviewer(review.Provider("r", (), "other", "small", counting(str(calls), lambda asked, time: {"tables": []} if asked["doc_id"] != "d5" else object())), ledger=str(fresh), pause=0.01, concurrency=1)
    for _ in range(2):
        try:
            review.read_again(requests(spark, 6).coalesce(1), broken).collect()
        except Exception as error:
            assert "not JSON serializable" in str(error)
    assert sorted(p.name.split("-")[0] for p in calls.iterdir() if "-other-" in p.name).count("d0") == 1


def test_the_clock_and_the_pause(spark, tmp_path):
    import time

    folder = tmp_path / "calls"
    folder.mkdir()
    slow = counting(str(folder), lambda asked, time: time.sleep(30))
    at = lambda left, reader, **more: review.Reviewer(review.Provider("r", (), "big", "small", reader), deadline=time.time() + left, **more)
    one = lambda who: [(r["outcome"], r["model"], r["attempts"]) for r in review.read_again(requests(spark, 1), who).collect()]
    assert one(at(10, slow)) == [("skipped-no-time", "small", 0)] and not list(folder.iterdir())
    began = time.time()
    # Enough time to begin, too little to end: six seconds before the deadline the reading is given up.
    reviewer = at(26, slow)
    row = {"doc_id": "d", "cand": 0, "text": "t", "context": ""}
    assert review.review_one(row, at(25.5, counting(str(folder), lambda asked, time: time.sleep(40))), None)["outcome"] == "abandoned-on-the-clock" and time.time() - began < 24
    assert reviewer.provider.fast_model == "small" and review.shape(80_000) == {"rushed": True, "max_tokens": 8000, "thinking": False} and review.shape(None)["max_tokens"] == 16000
    # Each failure is tried once more, and four tables of a task wait at the same time.
    flaky = counting(str(folder), lambda asked, time: time.sleep(1) or (None if asked["model"] == "big" else {"tables": []}))
    began = time.time()
    got = review.read_again(requests(spark, 4).coalesce(1), review.Reviewer(review.Provider("r", (), "big", "small", flaky), pause=0.5)).collect()
    assert [(r["outcome"], r["attempts"]) for r in got] == [("no-answer", 2)] * 4 and time.time() - began < 8
    assert one(at(1000, flaky, pause=0.01)) == [("no-answer", "big", 2)] and one(at(60, flaky)) == [("answered", "small", 1)]


def test_who_is_asked():
    a, b = review.Provider("first", ("K1", "K2"), "m", "f", print), review.Provider("second", ("K3",), "n", "g", print)
    name = lambda env: (p := review.provider([a, b], env)) and (p.name, p.model, p.fast_model)
    assert name({}) is None and name({"K3": "x"}) == ("second", "n", "g") and name({"K2": "x", "K3": "y"}) == ("first", "m", "f")
    assert name({"K2": "x", "K3": "y", "GRIDFRAME_REVIEWER": "SECOND", "GRIDFRAME_REVIEW_MODEL": "big"}) == ("second", "big", "g")
    assert name({"K2": "x", "GRIDFRAME_REVIEWER": "second", "GRIDFRAME_FAST_MODEL": "q"}) == ("first", "m", "q")


def test_notes_are_settled_as_by_a_plain_search(spark):
    import random
    import re

    rnd = random.Random(6)
    words = ["alpha", "beta", "of", "visit", "week12", "x", "dosing", "follow", "up"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    admits = ["could not", "CANNOT", "were discarded", "was omitted", "not captured", "Best-effort", "may actually", "no explicit", "not confidently", "guess", "was excluded", "were excluded", "not included", "unclear", "missing"]
    notes = [(f"d{i % 3}", 0, i, f"{rnd.choice(admits)} {text(rnd.randrange(9))} {rnd.choice(['', 'c1', 'c2-c3', 'abc1', 'c9'])}") for i in range(150)]
    labels = [(f"d{i % 3}", 0, rnd.choice([text(rnd.randrange(1, 9)), "Beta, visit: dosing/follow", "of x", "abc"])) for i in range(12)] + [("d0", 0, None), ("d0", 0, "")]
    ids = [("d0", 0, "C1", True), ("d0", 0, "c2", True), ("d0", 0, "c3", False), ("d1", 0, "c2", True), ("d1", 0, "c3", True)]
    got = {(r["doc_id"], r["note_ix"]) for r in reconcile.settled(spark.createDataFrame(notes, T + "note_ix int, note string"), spark.createDataFrame(labels, T + "label string"), spark.createDataFrame(ids, T + "id string, named boolean")).collect()}
    defeat = re.compile("|".join(a for a in admits if a not in ("unclear", "missing")), re.I)
    want = set()
    for doc, _, i, note in notes:
        said = note.lower()
        spoken = set(re.findall("[a-z0-9]+", said))
        named = {k.lower(): n for d, _, k, n in ids if d == doc}
        found = re.findall(r"\bc\d+\b", said)
        hit = bool(found) and all(named.get(k) for k in found)
        for d, _, v in labels:
            if d == doc and v:
                parts = [w for w in re.findall("[a-z0-9]+", v.lower()) if len(w) > 2]
                hit |= (len(v) > 3 and v.lower() in said) or (len(parts) >= 4 and sum(w in spoken for w in parts) >= 0.8 * len(parts))
        if hit and defeat.search(note):
            want.add((doc, i))
    assert got == want and 5 < len(want) < 145


def test_phrases_are_spent_once_and_copies_trimmed(spark):
    k = T + "ord int, id string, label string, visit_number string, study_day string, study_week string, visit_window string, divider boolean"
    cols = spark.createDataFrame([("d", 0, i, f"v{i}", "4", None, "4", None, None, False) for i in range(2)] + [("d", 0, 2, "v2", "9", None, None, None, None, False)], k)
    g_cols = spark.createDataFrame([("d", 0, 0, "c0", "4", None, "4", None, None, False), ("d", 0, 1, "c1", "9", None, None, None, None, False)], k)
    rows = spark.createDataFrame([("d", 0, "r0", "Diary review")], T + "id string, label string")
    g_rows = spark.createDataFrame([("d", 0, 0, "g0", "Diary review")], T + "ord int, id string, label string")
    cells = spark.createDataFrame([("d", 0, "r0", "v1", "Daily"), ("d", 0, "r0", "v2", "Dai")], T + "row_id string, col_id string, value string")
    g_cells = spark.createDataFrame([("d", 0, "g0", "c0", "Weekly"), ("d", 0, "g0", "c1", "Daily x 2")], T + "row_id string, col_id string, value string")
    got = {(r["col_id"], r["value"]) for r in reconcile.reconcile_cells(rows, cols, cells, g_rows, g_cols, g_cells).collect()}
    assert got == {("v0", "Weekly"), ("v1", "Daily"), ("v2", "Daily x 2")}
