"""Header rows against a plain reading of the lines, and headings that the page prints over two lines."""

import random

from pyspark.sql import functions as F

from gridframe.operators import header

BANDS = [200.0, 260.0, 320.0, 380.0]


def joined(a, b):
    return b if not a else a if not b else a.rstrip() + b if a.rstrip().endswith("-") else f"{a} {b}"


def place(values, words):
    for x, w, _, text, band in words:
        if band in values:
            v = values[band]
            values[band] = (f"{v[0]} {text}", min(v[1], x), max(v[2], x + w))
        else:
            values[band] = (text, x, x + w)


def carry_on(values, words, reach):
    if not values:
        return
    before, phrases = list(values.items()), []
    for word in words:
        if phrases and word[0] - phrases[-1][2] <= 0.3 * reach:
            phrases[-1][0].append(word)
            phrases[-1][2] = max(phrases[-1][2], word[0] + word[1])
        else:
            phrases.append([[word], word[0], word[0] + word[1]])
    for own, x0, _ in phrases:
        begins = x0 if len(own) > 1 else own[0][0] + own[0][1] / 2
        gap, at = min((max(0.0, v[1] - begins, begins - v[2]), i) for i, (_, v) in enumerate(before))
        if gap > reach:
            place(values, own)
            continue
        band = before[at][0]
        for x, w, _, text, _ in own:
            v = values[band]
            values[band] = (joined(v[0], text), min(v[1], x), max(v[2], x + w))


def plain(lines, ruled, reach):
    out = []
    for label, cell, top, bottom, words in lines:
        same = bool(out) and cell is not None and cell == out[-1]["cell"]
        if same or (not label and out and cell is None):
            (place if same and ruled else lambda v, w: carry_on(v, w, reach))(out[-1]["values"], words)
            out[-1]["bottom"] = max(out[-1]["bottom"], bottom)
            out[-1]["label"] = out[-1]["label"] or label
        elif len({w[4] for w in words}) >= 2:
            out.append({"label": label, "cell": cell, "top": top, "bottom": bottom, "values": {}})
            place(out[-1]["values"], words)
    return [(e["label"], e["cell"], e["top"], e["bottom"], [(k, *v) for k, v in e["values"].items()]) for e in out]


def test_header_rows_are_those_of_a_plain_reading(spark):
    rnd = random.Random(11)
    pages = []
    for p in range(120):
        lines, y, cell = [], 10.0, 0
        for i in range(rnd.randrange(1, 7)):
            cell += rnd.randrange(2)
            words, x = [], rnd.uniform(150, 260)
            for _ in range(rnd.randrange(1, 7)):
                w = rnd.choice([5.0, 20.0, 45.0])
                words.append((x, w, 10.0, rnd.choice(["Visit", "1", "Follow-", "up", "End of", "b"]), min(range(4), key=lambda b: abs(BANDS[b] - x - w / 2))))
                x += w + rnd.choice([2.0, 10.0, 30.0, 70.0])
            lines.append((rnd.choice(["", "", "Day", "Visit"]), cell if p % 3 else None, y, y + 10, words))
            y += 12
        pages.append((p, bool(p % 2), 60.0, lines))
    schema = f"page int, ruled boolean, reach double, lines array<struct<label:string,cell:int,top:double,bottom:double,words:array<{header.WORD}>>>"
    got = spark.createDataFrame(pages, schema).select("page", header.header_rows(F.col("lines"), F.col("ruled"), F.col("reach")).alias("rows")).collect()
    for r in got:
        _, ruled, reach, lines = pages[r["page"]]
        assert [(e["label"], e["cell"], e["top"], e["bottom"], [tuple(v) for v in e["values"]]) for e in r["rows"]] == plain(lines, ruled, reach), r["page"]
    assert sum(len(plain(*[x[3], x[1], x[2]])) for x in pages) > 150


def page_of(spark, texts, rules, ruled=True):
    words = [("d", 1, line, i, text, float(x), float(y), float(w), float(h)) for line, row in enumerate(texts) for i, (text, x, y, w, h) in enumerate(row)]
    keys = ["doc_id", "page"]
    frame = spark.createDataFrame(words, "doc_id string, page int, line_ix int, word_ix int, text string, x double, y double, w double, h double")
    lines = frame.groupBy(*keys, "line_ix").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    bands = spark.createDataFrame([("d", 1, i, c - 30, c + 30, c, ruled) for i, c in enumerate(BANDS)], "doc_id string, page int, band_ix int, left double, right double, centre double, ruled boolean")
    left = spark.createDataFrame([("d", 1, 170.0)], "doc_id string, page int, grid_left double")
    extent = spark.createDataFrame([("d", 1, 200.0)], "doc_id string, page int, first_y double")
    drawn = spark.createDataFrame([("d", 1, "H", float(y)) for y in rules], "doc_id string, page int, orient string, pos double")
    got = header.read_header(frame, lines, bands, left, drawn, extent, keys)
    return {(r["row_ix"], r["band_ix"]): (r["role"], r["value"]) for r in got.collect()}


def centred(text, centre, y, h=10.0):
    return (text, centre - 2.5 * len(text), y, 5.0 * len(text), h)


def test_lines_in_one_drawn_cell_are_one_row(spark):
    """The caption stands on the second line, and the first would else be a row of its own."""
    texts = [
        [centred(f"Visit{i}", c, 120) for i, c in enumerate(BANDS)],
        [("Visits", 20, 132, 30, 10.0), *[centred(n, c, 132) for n, c in zip(["Start", "Middle", "Late", "End"], BANDS, strict=True)]],
        [("Day", 20, 160, 15, 10.0), *[centred(str(7 * i + 1), c, 160) for i, c in enumerate(BANDS)]],
    ]
    got = page_of(spark, texts, [110, 150, 180])
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, i): ("visitName", f"Visit{i} {n}") for i, n in enumerate(["Start", "Middle", "Late", "End"])}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, i): ("studyDay", str(7 * i + 1)) for i in range(4)}


def test_raised_markers_stay_with_their_word_and_captions_name_dimensions(spark):
    texts = [[("Table", 20, 120, 25, 10.0), *[centred(f"Week{i}", c, 120) for i, c in enumerate(BANDS)], ("b", BANDS[1] + 14, 118, 4, 6.0)], [centred("Follow-", BANDS[0], 134), centred("up", BANDS[3], 134)]]
    got = page_of(spark, texts, [], ruled=False)
    # The title's words are no caption; the second line has none and continues the nearest headings.
    assert got == {(0, 0): (None, "Week0 Follow-"), (0, 1): (None, "Week1 b"), (0, 2): (None, "Week2"), (0, 3): (None, "Week3 up")}
