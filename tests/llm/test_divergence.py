"""The source divergence audit against plain sums, with tiles and blocks of any size."""

import random
import re
from collections import Counter, defaultdict

import pytest

from gridframe.llm import divergence as d

WORDS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        ws = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(ws)
        df[lang].update(set(ws))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        in_lang = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        v, n = len(kept), sum(in_lang.values())
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (total[s] + 5 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (in_lang[t] + 5) // (n + 5 * v) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def corpus(rnd):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "Ab", "ab", "one2two"]
    rows = []
    for i in range(160):
        source = rnd.choice(["s0", "s0", "s0", *(f"s{k}" for k in range(9)), None, ""])
        own = words[(hash_of(source) * 7) % 40 :][:20]
        rows.append((rnd.choice(["en", "fr", None]), source, " ".join(rnd.choice(own if rnd.random() < 0.7 else words) for _ in range(rnd.randrange(25)))))
    return [*rows, ("xx", "a", "too few words"), ("xx", "b", None), ("yy", "alone", ""), ("en", "void", None)]


def hash_of(source):
    return sum(map(ord, source or ""))


@pytest.mark.parametrize("sizes", [{}, {"tile": 3, "rare_tile": 4, "sources": 3}, {"tile": 1, "rare_tile": 1, "sources": 1}])
def test_audit_is_the_plain_sum(spark, sizes):
    rows = corpus(random.Random(4))
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, item string, value int")
    got = d.audit(frame, 4, 5, **sizes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 5)


def test_heavy_alone_and_rare_alone_agree(spark, monkeypatch):
    rows = corpus(random.Random(9))
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    found = []
    for many in (0, 1, 1000):
        monkeypatch.setattr(d, "MANY", many)
        found.append(sorted(map(tuple, d.audit(frame, 2).collect())))
    assert found[0] == found[1] == found[2] == brute(rows, 2, 50)


def test_empty_table(spark):
    assert d.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
