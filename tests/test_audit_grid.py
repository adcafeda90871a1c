"""The printed grid: lines that straddle an edge belong to the row that holds more of them."""

import random

from gridframe.operators import audit, lines


def band_of(top, bottom, rows):
    mid = (top + bottom) / 2
    at = next((i for i in range(len(rows) - 1) if rows[i] - 1 < mid < rows[i + 1] + 1), -1)
    over = lambda i: min(bottom, rows[i + 1]) - max(top, rows[i])
    if at >= 0:
        if at + 1 < len(rows) - 1 and over(at + 1) > over(at):
            at += 1
        if at > 0 and over(at - 1) > over(at):
            at -= 1
    return at


def test_words_go_with_their_line(spark):
    rnd = random.Random(2)
    words, grids = [], []
    for page in range(60):
        rows = [100.0]
        while len(rows) < 7:
            rows.append(rows[-1] + rnd.choice([8.0, 14.0, 30.0]))
        grids.append(("d", page, rows, [50.0, 110.0, 170.0, 230.0]))
        for i in range(60):
            words.append(("d", page, i, f"w{i}", rnd.uniform(30, 230), rnd.uniform(90, rows[-1] + 10), rnd.choice([5.0, 20.0]), rnd.choice([6.0, 10.0, 24.0])))
    frame = spark.createDataFrame(words, "doc_id string, page int, word_ix int, text string, x double, y double, w double, h double")
    edges = spark.createDataFrame(grids, "doc_id string, page int, rows array<double>, cols array<double>")
    keys = ["doc_id", "page"]
    found = lines.lines(frame, keys).collect()
    want: dict = {}
    for line in found:
        rows, cols = next((g[2], g[3]) for g in grids if g[1] == line["page"])
        r = band_of(line["top"], line["bottom"], rows)
        for w in line["words"]:
            mid = w["x"] + w["w"] / 2
            c = next((i for i in range(len(cols) - 1) if cols[i] < mid < cols[i + 1]), -1)
            if r >= 0 and c >= 0:
                want.setdefault((line["page"], r, c), []).append((line["line_ix"], w["x"], w["word_ix"], w["text"]))
    got = {(x["page"], x["r"], x["c"]): x["text"] for x in audit.grid_words(frame, edges, keys).collect()}
    assert got == {k: " ".join(t for *_, t in sorted(v)) for k, v in want.items()}
    straddling = sum(1 for line in found for g in grids if g[1] == line["page"] and any(line["top"] < e < line["bottom"] for e in g[2]))
    assert straddling > 300


def test_a_raised_sign_and_a_second_line_stay_in_their_row(spark):
    at = lambda i, text, x, y, w, h: ("d", 1, i, text, float(x), float(y), float(w), float(h))
    words = [at(0, "Weight", 10, 102, 30, 10), at(1, "X", 80, 102, 5, 10), at(2, "b", 86, 98, 3, 6), at(3, "Height", 10, 117, 30, 10), at(4, "standing", 10, 125, 40, 8)]
    frame = spark.createDataFrame(words, "doc_id string, page int, word_ix int, text string, x double, y double, w double, h double")
    edges = spark.createDataFrame([("d", 1, [100.0, 114.0, 132.0], [0.0, 60.0, 120.0])], "doc_id string, page int, rows array<double>, cols array<double>")
    got = {(x["r"], x["c"]): x["text"] for x in audit.grid_words(frame, edges, ["doc_id", "page"]).collect()}
    assert got == {(0, 0): "Weight", (0, 1): "X b", (1, 0): "Height standing"}
