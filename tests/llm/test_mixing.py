import random
from fractions import Fraction

import pytest

from gridframe.llm import mixing


def edf(sizes, weights, block_rows):
    """(source, block) to (slot, release, deadline): the schedule slot by slot, with a new phase for each source that ends."""
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    periods = {s: -(-b // weights[s]) for s, b in blocks.items()}
    out, base, since = {}, 0, 0
    for until in sorted(set(periods.values())):
        live = sorted(s for s in blocks if periods[s] >= until)
        total = sum(weights[s] for s in live)
        for period in range(since, until):
            done = dict.fromkeys(live, 0)
            for t in range(total):
                window = {s: (done[s] * total // weights[s], -(-(done[s] + 1) * total // weights[s])) for s in live}
                s = min((s for s in live if window[s][0] <= t), key=lambda s: (window[s][1], s))
                at = base + (period - since) * total
                if period * weights[s] + done[s] < blocks[s]:
                    out[s, period * weights[s] + done[s]] = (at + t, at + window[s][0], at + window[s][1])
                done[s] += 1
        base, since = base + (until - since) * total, until
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [(i, rnd.choices(["a", "b", "c", "d", None, "other", "more"], [40, 20, 10, 10, 5, 8, 7])[0], f"t{i % 9}", "x") for i in range(900)] + [(1, "a", "t1", "x")] * 3 + [(None, "b", None, "x")]


@pytest.mark.parametrize("ranges, fold, run, spread", [(8192, 1 << 18, 512, 1_000_000), (64, 5, 3, 0)])
def test_the_schedule_is_the_earliest_deadline_one(spark, rows, monkeypatch, ranges, fold, run, spread):
    for name, value in {"RANGE_ROWS": ranges, "FOLD_SLOTS": fold, "RUN_SLOTS": run, "MOST_BROADCAST": spread}.items():
        monkeypatch.setattr(mixing, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot string")
    weights = {"a": 10, "b": 6, "c": 6, "d": 2}
    got = mixing.placed(docs, weights, rest_weight=4, block_rows=4).collect()
    assert len(got) == len(rows)
    halved = {"a": 5, "b": 3, "c": 3, "d": 1, mixing.REST: 2}
    sizes = {}
    for r in got:
        sizes[r["mix_source"]] = sizes.get(r["mix_source"], 0) + 1
    want = edf(sizes, halved, 4)
    assert {((r["mix_source"], r["block"]), (r["slot"], r["release"], r["deadline"])) for r in got} == set(want.items())
    assert len({x[0] for x in want.values()}) == len(want) and all(x[1] <= x[0] < x[2] for x in want.values())
    assert {(r["mix_source"], r["block"], r["in_block"]) for r in got} == {(s, i // 4, i % 4) for s, n in sizes.items() for i in range(n)}
    mixed = mixing.mixed(docs, weights, 4, 4)
    assert mixed.columns == docs.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, docs.collect()))


def test_every_source_is_less_than_a_block_off_in_every_phase(spark, rows):
    """In each phase, at each slot, of all sources that have blocks until the phase ends."""
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot string")
    weights = {"a": 5, "b": 3, "c": 3, "d": 1, mixing.REST: 2}
    got = mixing.placed(docs, {k: v for k, v in weights.items() if k != mixing.REST}, rest_weight=2, block_rows=4).collect()
    at = {r["slot"]: r["mix_source"] for r in got}
    blocks = {s: max(r["block"] for r in got if r["mix_source"] == s) + 1 for s in weights}
    base = since = phases = 0
    for until in sorted({-(-b // weights[s]) for s, b in blocks.items()}):
        live = [s for s in blocks if -(-blocks[s] // weights[s]) >= until]
        total, run = sum(weights[s] for s in live), dict.fromkeys(live, 0)
        for t in range((until - since) * total):
            if base + t in at:
                run[at[base + t]] += 1
            for s in live:
                if blocks[s] >= until * weights[s]:
                    assert abs(run[s] - Fraction(weights[s] * (t + 1), total)) < 1
        base, since, phases = base + (until - since) * total, until, phases + 1
    assert phases > 2 and base > max(at)


def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot string")
    assert mixing.placed(docs.limit(0), {"a": 2}).collect() == []
    assert mixing.placed(docs, {}).count() == len(rows)
    long = spark.createDataFrame([(1, "a", "w " * 400_000), (1, "a", "w " * 400_000), (2, None, "")], "doc_id long, source string, text string")
    assert mixing.mixed(long, {"a": 3}).count() == 3
    with pytest.raises(ValueError):
        mixing.placed(docs, {"a": 0})


def test_rows_that_tie_stand_in_one_order(spark):
    """Same id and text, other columns that differ: the order doesn't hang on how the rows were dealt."""
    rows = [(1, "a", "t", f"x{i}") for i in range(40)]
    runs = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows[:: 1 if parts == 1 else -1], "doc_id long, source string, text string, more string").repartition(parts)
        runs.append([r["row"]["more"] for r in sorted(mixing.placed(docs, {"a": 1}).collect(), key=lambda r: (r["slot"], r["in_block"]))])
    assert runs[0] == runs[1]


def test_large_weights_are_scheduled(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot string")
    got = mixing.placed(docs, {"a": 30_011, "b": 20_011}, rest_weight=7, block_rows=1).collect()
    assert len(got) == len(rows) and len({r["slot"] for r in got}) == len(rows) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
