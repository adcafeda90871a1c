"""Candidate ranges against a plain greedy model, and in a file of many pages."""

import random
import time

from pyspark.sql import functions as F

from gridframe.functions import text as T
from gridframe.operators import locate

SCORES = "doc_id string, page int, score double, marks int, mark_lines int, footnote_lines int"


def plain(scores, seed=9.0, most=8, spill=2):
    by = {p: (s, m >= 8 and ml >= 3, n >= 3 and ml < 3) for _, p, s, m, ml, n in scores}
    used, out = set(), []
    for page in sorted((p for p in by if by[p][0] >= seed), key=lambda p: (-by[p][0], p)):
        if page in used:
            continue
        own = [page]
        for step, kind, room in ((-1, 1, most), (1, 1, most), (1, 2, None)):
            for _ in range(spill if room is None else most):
                following = (max(own) if step > 0 else min(own)) + step
                if following not in by or not by[following][kind] or following in used or (room and len(own) >= room):
                    break
                own.append(following)
        used |= set(own)
        out.append((page, sorted(own), by[page][0], int(sum(by[p][0] for p in sorted(own)) * 100 + 0.5) / 100))
    return sorted(out, key=lambda c: (-c[2], -c[3], c[0]))


def drawn(rnd, doc, pages):
    return [(doc, p, rnd.randrange(48) / 4, rnd.randrange(4, 20), rnd.randrange(6), rnd.randrange(8)) for p in pages]


def found(spark, rows):
    got = {}
    for r in locate.candidates(spark.createDataFrame(rows, SCORES)).orderBy("doc_id", "cand_ix").collect():
        got.setdefault(r["doc_id"], []).append((r["seed_page"], r["pages"], r["score"], r["total"]))
    return got


def test_ranges_are_the_greedy_models(spark):
    rnd = random.Random(2)
    docs = {f"d{i}": drawn(rnd, f"d{i}", sorted(rnd.sample(range(-5, 70), rnd.randrange(1, 60)))) for i in range(40)}
    # All pages grids, so that ranges meet, and one page alone.
    docs["all"] = [("all", p, 9.0 + p % 3, 20, 5, 0) for p in range(1, 40)]
    docs["one"] = [("one", 7, 9.0, 0, 0, 0)]
    want = {d: plain(rows) for d, rows in docs.items()}
    assert found(spark, [r for rows in docs.values() for r in rows]) == {d: w for d, w in want.items() if w}


def test_a_file_of_many_pages(spark):
    rows = drawn(random.Random(3), "long", (p for p in range(40_000) if p % 10 not in (3, 7)))
    began = time.time()
    got = found(spark, rows)
    assert time.time() - began < 60
    assert got == {"long": plain(rows)}


def test_long_lines_arent_searched_for_names(spark):
    lines = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 1000 == 7, F.concat(F.lit("TABLE 2   Study  Schedule "), "id")).otherwise(F.concat(F.repeat(F.lit("visit schedule and more "), 300), "id")).alias("text"))
    began = time.time()
    got = lines.where(locate.names_table(F.col("text"))).collect()
    assert time.time() - began < 30
    assert sorted(r["text"] for r in got) == sorted(f"TABLE 2   Study  Schedule {i}" for i in range(7, 20_000, 1000))


def test_names_of_tables(spark):
    texts = ["Schedule of  Events", "the study flow chart", "Schedule of Events ..... 14", "Schedule of Events    14", "see Schedule of Events", "Foresee the visit schedule", "Schedule", "x" * 100 + " flowchart", "x" * 101 + " flowchart", "  " + "x" * 100 + " flowchart  ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["text"] for r in df.where(locate.names_table(F.col("text"))).collect()] == [texts[i] for i in (0, 1, 5, 7, 9)]
    assert [r["text"] for r in df.withColumn("low", T.norm(F.col("text"))).where(locate.names_table(F.col("text"), F.col("low"))).collect()] == [texts[i] for i in (0, 1, 5, 7, 9)]
