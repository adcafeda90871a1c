"""Lines of words against a plain model, and of a page with many words."""

import random
import time

from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import lines as L
from gridframe.plans import page_queries
from gridframe.sources import layout

WORDS = "doc string, word_ix int, text string, x double, y double, w double, h double"


def plain(words):
    found = []
    for w in sorted(words, key=lambda w: (w[4], w[3], w[1])):
        mid = w[4] + w[6] / 2
        at = next((l for l in found if abs(l["centre"] - mid) <= max(w[6], l["height"]) * 0.6), None)
        if at is None:
            found.append(at := {"centre": mid, "height": w[6], "words": []})
        at["height"] = max(at["height"], w[6])
        at["words"].append(w)
    found.sort(key=lambda l: min(w[4] for w in l["words"]))
    return [(min(w[4] for w in l["words"]), max(w[4] + w[6] for w in l["words"]), l["centre"], l["height"], [w[1] for w in sorted(l["words"], key=lambda w: (w[3], w[1]))]) for l in found]


def test_lines_of_mixed_heights(spark):
    rnd = random.Random(4)
    words = [(f"d{d}", i, f"w{i}", float(rnd.randrange(40)), float(rnd.randrange(60)) / 2, 5.0, float(rnd.choice((4, 6, 9, 9, 9, 30) if d % 2 else (0, 5)))) for d in range(40) for i in range(rnd.randrange(1, 40))]
    got = {}
    for r in L.lines(spark.createDataFrame(words, WORDS), ["doc"]).orderBy("doc", "line_ix").collect():
        assert r["n_words"] == len(r["words"]) and r["text"] == " ".join(w["text"] for w in r["words"])
        got.setdefault(r["doc"], []).append((r["top"], r["bottom"], r["centre"], r["height"], [w["word_ix"] for w in r["words"]]))
    assert got == {d: plain([w for w in words if w[0] == d]) for d in {w[0] for w in words}}


def test_white_space_is_collapsed(spark):
    texts = ["a b", " a  b ", "a b", "a   b", "\t a　 b\n", "a", "", " ", "﻿a b ", "a\x0bb c  d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.clean(F.col("t")).alias("got"), F.trim(F.regexp_replace("t", T.SPACE, " ")).alias("want")).collect():
        assert r["got"] == r["want"], r


def test_a_long_text_takes_time_in_proportion(spark, tmp_path):
    lines = [" ".join(f"w{i}" for i in range(9)) for _ in range(1500)] + ["", "  two   words ", " ".join(f"v{i}" for i in range(6000))]
    spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = page_queries.doc_lines(spark, str(tmp_path)).orderBy("line_ix").collect()
    assert time.time() - began < 60
    assert [r["text"] for r in got] == [" ".join(t.split()) for t in lines if t.split()]
    assert [r["top"] for r in got] == [12.0 * i for i, t in enumerate(lines) if t.split()]
    last = layout.doc_words(layout.table(spark, str(tmp_path), "documents")).where("line_ix >= 1501").orderBy("line_ix", "part_ix").collect()
    assert [(r["part_ix"], r["x"], r["text"]) for r in last[:2]] == [(2, 10.0, "two"), (5, 40.0, "words")]
    assert [(r["x"], r["w"]) for r in last[2:]] == [(5.0 * len(lines[1502].split(f"v{i}")[0]) if i == 0 else 5.0 * (len(" ".join(f"v{j}" for j in range(i))) + 1), 5.0 * len(f"v{i}")) for i in range(6000)]
