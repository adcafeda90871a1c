"""Folds against plain models."""

import itertools
import random

from pyspark.sql import functions as F

from gridframe.operators import geometry as g
from gridframe.operators import lines, rows


def arrays(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in xs]) for i, xs in enumerate(data)], "i int, xs array<double>")


def test_anchored_edges_and_first_fit(spark):
    rnd = random.Random(1)
    data = [[rnd.randrange(40) / 2 for _ in range(rnd.randrange(12))] for _ in range(60)] + [[1, 2, 3.5, 5, 9]]
    got = {r["i"]: (r["e"], r["k"]) for r in arrays(spark, data).select("i", g.anchored_edges(F.col("xs")).alias("e"), g.first_fit_keys(F.col("xs")).alias("k")).collect()}
    for i, xs in enumerate(data):
        edges, keys = [], []
        for x in sorted(xs):
            if not edges or x - edges[-1] > 3:
                edges.append(x)
        for x in xs:
            if not any(abs(k - x) <= 3 for k in keys):
                keys.append(x)
        assert got[i] == (edges, keys)
    assert got[60][0] == [1, 5, 9]


def test_ordered_partition_is_the_cheapest(spark):
    rnd = random.Random(2)
    cases = [(sorted(rnd.randrange(300) for _ in range(k)), sorted(rnd.sample(range(300), m))) for m, k in itertools.product(range(1, 7), range(1, 4))]
    frame = spark.createDataFrame([(i, [float(x) for x in h], [float(x) for x in b]) for i, (h, b) in enumerate(cases)], "i int, h array<double>, b array<double>")
    for r in frame.select("i", "h", "b", g.ordered_partition(F.col("h"), F.col("b")).alias("best")).collect():
        h, b = r["h"], r["b"]
        if len(b) < len(h):
            assert r["best"] is None
            continue
        cost = lambda cuts: sum(abs((b[s] + b[e - 1]) / 2 - x) for x, s, e in zip(h, [0, *cuts], [*cuts, len(b)], strict=True))
        least = min(cost(c) for c in itertools.combinations(range(1, len(b)), len(h) - 1))
        assert abs(r["best"]["cost"] - least) < 1e-9 and abs(cost(r["best"]["ends"][:-1]) - least) < 1e-9 and r["best"]["ends"][-1] == len(b)


def test_longest_ascending(spark):
    rnd = random.Random(3)
    data = [[rnd.randrange(9) for _ in range(rnd.randrange(1, 8))] for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(data)), "i int, xs array<int>")
    for r in frame.select("xs", g.longest_ascending(F.col("xs")).alias("run")).collect():
        xs, run = r["xs"], r["run"]
        best = max(len(c) for n in range(1, len(xs) + 1) for c in itertools.combinations(xs, n) if list(c) == sorted(set(c)))
        assert len(run) == best and run == sorted(set(run))


def test_lines_join_the_first_open_line(spark):
    rnd = random.Random(4)
    words = [("d", p, i, f"w{i}", float(rnd.randrange(300)), rnd.randrange(120) / 2, 9.0, float(rnd.choice([6, 10, 12]))) for p in range(8) for i in range(40)]
    got = {}
    for r in lines.assign_lines(spark.createDataFrame(words, "doc string, page int, word_ix int, text string, x double, y double, w double, h double"), ["doc", "page"]).collect():
        got.setdefault(r["page"], {})[r["word_ix"]] = r["line"]
    for p in range(8):
        opened, want = [], {}
        for _, _, i, _, _, y, _, h in sorted((w for w in words if w[1] == p), key=lambda w: (w[5], w[4], w[2])):
            for n, line in enumerate(opened):
                if abs(line[0] - (y + h / 2)) <= max(h, line[1]) * 0.6:
                    line[1] = max(line[1], h)
                    want[i] = n + 1
                    break
            else:
                opened.append([y + h / 2, h])
                want[i] = len(opened)
        assert got[p] == want


def test_wrapped_labels_and_new_names(spark):
    line = lambda y, label="", marks=0, other="": (y, y + 10, label, marks, other)
    lines = [line(0, "Physical", 3), line(12, "examination"), line(24, "Vital Signs"), line(26, "pulse", 2), line(38, other="weekly"), line(90, "SAFETY"), line(103, "TESTS")]
    frame = spark.createDataFrame([("d", i, float(y), float(b), *rest) for i, (y, b, *rest) in enumerate(lines)], "doc_id string, line_ix int, y double, bottom double, label string, n_marks int, other string")
    got = rows.assemble_rows(frame, ["doc_id"]).orderBy("entry_ix").collect()
    assert [(e["kind"], e["label"]) for e in got] == [("assessment", "Physical examination"), ("label-only", "Vital Signs"), ("assessment", "pulse"), ("label-only", "SAFETY TESTS")]
