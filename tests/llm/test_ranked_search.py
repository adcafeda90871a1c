"""Ranked lexical search against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridframe.llm import ranked_search as s

WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, rank string, score string"


def terms(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, best):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if score > 0:
                found.append((-score, doc is None, doc if doc is not None else 0))
        out += [(item, k, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block_terms", "entries"), [(500_000, 2_000_000), (5, 7)])
def test_ranks_as_a_plain_scorer(spark, block_terms, entries):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(["the", "The", "of", "aé", "b2", "x_y", "rare%d" % rnd.randrange(30)]) for _ in range(n))
    docs = [(i, text(rnd.randrange(30))) for i in range(80)]
    docs += [(7, docs[7][1]), (200, docs[3][1]), (None, docs[3][1]), (201, None), (202, ""), (203, "?! --"), (204, text(5000))]
    items = [(i, text(rnd.randrange(1, 9))) for i in range(9)] + [(3, "rare1 rare1 the"), (None, "rare2 of"), (50, None), (51, " "), (52, "nowhere")]
    frame = spark.createDataFrame([(*d, "a", "b") for d in docs], SCHEMA).repartition(5)
    got = s.search(frame, spark.createDataFrame(items, "item_id long, text string"), 4, block_terms, entries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 4)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item, no_item = spark.createDataFrame([("q", "a")], "item_id string, text string"), spark.createDataFrame([], "item_id string, text string")
    assert s.search(none, item).collect() == [] and s.search(some, no_item).collect() == []
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in s.search(some, item).collect()] == [("q", 1, 1)]


def test_radix_order_sorts():
    rnd = np.random.default_rng(1)
    for top in (1, 1 << 15, 1 << 17, 1 << 40, 1 << 63):
        keys = rnd.integers(0, top, 500, dtype=np.uint64)
        order = s.radix_order(keys)
        assert (keys[order] == np.sort(keys)).all() and (order == np.argsort(keys, kind="stable")).all()
    assert len(s.radix_order(np.zeros(0, np.uint64))) == 0
