"""Rows against a plain reading of lines, on pages of any shape and within drawn bands."""

import random
import re

from gridframe.operators import rows

NEW_NAME = re.compile("[A-Z][a-z]+ [A-Z]")
SCHEMA = "doc_id string, page int, row_ix int, line_ix int, y double, bottom double, label string, n_marks int, other string"


def assemble(lines):
    """Inferred rows of one page, from its lines in order, by looking ahead."""
    out, i = [], 0
    while i < len(lines):
        a = lines[i]
        i += 1
        if not a["label"] and not a["n_marks"]:
            if a["other"] and out and a["y"] - out[-1]["bottom"] <= 8:
                out[-1]["bottom"] = a["bottom"]
                out[-1]["n_lines"] += 1
            continue
        entry = {"kind": "assessment" if a["n_marks"] else "label-only", "label": a["label"], "y": a["y"], "bottom": a["bottom"], "n_marks": a["n_marks"], "n_lines": 1}
        while i < len(lines):
            b = lines[i]
            close = b["y"] - entry["bottom"] <= 6 and not b["n_marks"]
            if a["n_marks"]:
                takes = close and bool(b["label"]) != bool(b["other"]) and not (len(b["label"]) < 40 and NEW_NAME.match(b["label"]))
            else:
                takes = close and bool(b["label"]) and not b["other"]
            if not takes:
                break
            entry["label"] = " ".join(x for x in (entry["label"], b["label"]) if x)
            entry["bottom"] = b["bottom"]
            entry["n_lines"] += 1
            i += 1
        out.append(entry)
    return out


def pages(n):
    rnd = random.Random(7)
    out = []
    for page in range(n):
        y = 0.0
        for i in range(rnd.randrange(1, 25)):
            y += rnd.choice([2.0, 5.0, 6.0, 7.0, 8.0, 9.0, 20.0])
            label = rnd.choice(["", "", "Vital signs", "Vital Signs", "sampling", "ab", "ECG", "Blood draw " + "x" * 30, "2 hour test"])
            out.append(("d", page, rnd.randrange(i // 3, i // 3 + 2), i, y, y + rnd.choice([0.0, 4.0]), label, rnd.choice([0, 0, 1, 3]), rnd.choice(["", "", "Weekly"])))
            y = out[-1][5]
    return out


def as_dicts(lines):
    return [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], x, strict=True)) for x in lines]


def test_rows_of_pages_are_those_of_looking_ahead(spark):
    lines = pages(150)
    got = {}
    for r in rows.assemble_rows(spark.createDataFrame(lines, SCHEMA), ["doc_id", "page"]).orderBy("page", "entry_ix").collect():
        got.setdefault(r["page"], []).append({k: r[k] for k in ("kind", "label", "y", "bottom", "n_marks", "n_lines")})
    for page in range(150):
        assert got.get(page, []) == assemble([x for x in as_dicts(lines) if x["page"] == page]), page


def test_a_band_of_several_named_rows_is_split(spark):
    lines = pages(150)
    got = {}
    for r in rows.rows_in_bands(spark.createDataFrame(lines, SCHEMA), ["doc_id", "page"]).orderBy("page", "entry_ix").collect():
        got.setdefault(r["page"], []).append((r["kind"], r["label"], r["y"], r["n_marks"], r["n_lines"]))
    split = 0
    for page in range(150):
        own, want = [x for x in as_dicts(lines) if x["page"] == page], []
        for band in sorted({x["row_ix"] for x in own}):
            inside = [x for x in own if x["row_ix"] == band]
            named = [x for x in inside if len(x["label"]) > 2 and re.match("[A-Z0-9]", x["label"]) and (x["n_marks"] or x["other"])]
            within = assemble(inside) if len(named) >= 2 else []
            if len(within) > 1:
                split += 1
                want += [(e["kind"], e["label"], e["y"], e["n_marks"], e["n_lines"]) for e in within]
            else:
                marks = sum(x["n_marks"] for x in inside)
                want.append(("assessment" if marks else "label-only", " ".join(x["label"] for x in inside if x["label"]), inside[0]["y"], marks, len(inside)))
        assert got[page] == want, page
    assert split > 40


def test_three_named_rows_in_one_band(spark):
    names = ["Baseline evaluation", "Sputum smear", "Chest film"]
    lines = [("d", 1, 0, i, 14.0 * i, 14.0 * i + 10, n, 2, "") for i, n in enumerate(names)] + [("d", 1, 1, 3, 60.0, 70.0, "Weight", 1, ""), ("d", 1, 1, 4, 71.0, 80.0, "in kilograms", 0, "")]
    got = [(r["entry_ix"], r["label"]) for r in rows.rows_in_bands(spark.createDataFrame(lines, SCHEMA), ["doc_id", "page"]).orderBy("entry_ix").collect()]
    assert got == [*enumerate(names), (3, "Weight in kilograms")]
