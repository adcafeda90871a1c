import hashlib
import random
import re

import pytest

from gridframe.llm import decontaminate as d

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    wins = {}
    for name, text in items:
        w = plain(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if w else []:
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(name) if name is not None else None)
    out = []
    for doc_id, text in docs:
        w, hit, named = plain(text), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if (t := tuple(w[i : i + size])) in wins:
                    hit.update(range(i, i + size))
                    named |= wins[t]
        ids = sorted(named - {None})
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [7, 10_000])
def test_report_matches_brute_force(spark, block_words):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "B", "cé", "d9", "The", "e_e"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 5, 9, 14])))) for i in range(12)] + [(None, "a a a a"), (3, "zz b"), (99, None)]
    items = [x for x in items if len(plain(x[1])) != 1 or x[0] % 2]
    docs = [(i, "  ".join(word() for _ in range(rnd.randrange(40)))) for i in range(60)] + [(7, None), (7, ""), (None, "x zz B y"), (8, items[5][1])]
    frame = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, d.report(frame, bench, 4, block_words).collect()), key=repr)
    assert got == brute(docs, items, 4)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.report(empty, bench).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r)[1:4] for r in d.report(one, bench).collect()] == [(3, 0, 0)]


def test_clean_cuts_spans_and_leaves_the_rest(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    rows = [(1, "Keep this.  One, two three FOUR\nand keep that too, all of it.", "x"), (2, "one two three four five", "x"), (3, "Untouched  text ", "x"), (4, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["text"] for r in d.clean(frame, bench, 4).collect()}
    assert got == {1: "Keep this.  and keep that too, all of it.", 3: "Untouched  text ", 4: None}


def test_one_automaton_or_many_find_the_same():
    rnd = random.Random(2)
    items = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(9))] for _ in range(40)]
    texts = [[rnd.choice([b"a", b"b", b"c", b"x"]) for _ in range(rnd.randrange(60))] for _ in range(60)]
    found = []
    for part_words in (1, 20, 10_000):
        block = d.Block(4)
        for i, item in enumerate(items):
            block.add(str(i), item)
        block.finished(part_words)
        found.append([(sorted(set(spans)), names) for spans, names in map(block.matches, texts)])
    assert found[0] == found[1] == found[2] and any(names for _, names in found[0])
    for words, (spans, names) in zip(texts, found[0], strict=True):
        want = {(i, i + len(w), str(k)) for k, item in enumerate(items) for w in [item[j : j + 4] for j in range(max(1, len(item) - 3))] if w for i in range(len(words) - len(w) + 1) if words[i : i + len(w)] == w}
        assert {(a, b) for a, b, _ in want} == set(spans) and {k for *_, k in want} == names
