import random
import re

import pytest

from gridframe.llm import license_scan as ls
from gridframe.llm.queries import OP3_SQL

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """Base columns, labels and the best score, by looking at every diagonal of every template."""
    words = words_of(text)
    places = [(i, label) for label, phrase in ls.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts, labels, best = [i for i, _ in places], {x for _, x in places}, 1.0 if places else 0.0
    for label, phrase in [*ls.TEMPLATES, *ls.TEXTS]:
        t = phrase.split()
        k = 2 if len(t) <= 4 else 3
        at = {}
        for q in range(len(t) - k + 1):
            at.setdefault(tuple(t[q : q + k]), []).append(q)
        hits = {}
        for p in range(len(words) - k + 1):
            for q in at.get(tuple(words[p : p + k]), []):
                hits.setdefault(p - q, set()).add(q)
        for d in hits:
            met = [(e, q) for e in range(d, d + ls.NEAR + 1) for q in hits.get(e, ())]
            share = len({q for _, q in met}) / (len(t) - k + 1)
            best = max(best, share)
            if share >= ls.COVERAGE and max(e + q for e, q in met) + k - min(e + q for e, q in met) <= ls.STRETCH * len(t):
                labels.add(label)
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), best)


def columns(rows):
    return sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in rows], key=repr)


def test_matches_brute_force(spark):
    rnd = random.Random(6)
    bits = ["GNU General", "Public License", "apache license", "CC BY", "cc-by", "MIT", "license.", "the", "x", "gnu general public license", "É", "mit\tlicense", "3", "licensed under", "cc by nc 4.0", "cc by nc", "version 2.0", "Released under the"]
    bits += [" ".join(t.split()[: rnd.randrange(9, 200)]) for _, t in ls.TEXTS]
    docs = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))) for i in range(160)] + [(1, None), (1, ""), (None, "mit license"), (3, "cc by " * 3000), (3, "cc by " * 3000)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, labels string")
    got = ls.scan(frame).collect()
    assert columns(got) == sorted([(d, *brute(t)) for d, t in docs], key=repr)
    assert ls.scan(frame.limit(0)).collect() == []
    con = pytest.importorskip("duckdb").connect()
    con.register("documents", frame.toArrow())
    result = con.execute(OP3_SQL)
    names = [x[0] for x in result.description]
    assert sorted(map(tuple, result.fetchall()), key=repr) == sorted((tuple(r[n] for n in names) for r in got), key=repr)


def test_notices_with_gaps_are_found(spark):
    notice = dict(ls.TEMPLATES[::-1])["bsd"].split()
    noisy = [*notice[:9], "surely", *notice[9:]]
    mit, long = dict(ls.TEXTS)["mit"], "the software is provided as is "
    docs = [
        (1, "a b " + " ".join(noisy) + " c"), (2, " ".join(notice[:6])), (3, "Licensed under CC BY-NC 4.0."), (4, "plain words only"), (5, "under cc by nc cc by nc 4"),
        (6, long * 200 + mit + long * 200), (7, dict(ls.TEXTS)["bsd-3-clause"]), (8, dict(ls.TEXTS)["bsd-2-clause"]), (9, "licensed under a creative commons attribution shareKalike sharealike 4 0 international license"),
    ]
    got = {r["doc_id"]: r for r in ls.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "bsd" in got[1]["labels"] and got[1]["n_base"] == 0 and got[1]["n_spans"] == 1
    assert got[2]["labels"] == "" and 0 < got[2]["score"] < 1
    assert "cc-by-nc" in got[3]["labels"] and got[3]["base_labels"] == "cc-by"
    assert got[4]["score"] == 0
    assert got[5]["labels"] == "cc-by" and got[5]["score"] == 1.0  # the base phrase; of the notice only three of five k-grams
    assert got[6]["labels"] == "mit"
    assert got[7]["labels"] == "bsd,bsd-3-clause" and got[8]["labels"] == "bsd,bsd-2-clause"
