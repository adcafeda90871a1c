import math
import random

import pytest

from gridframe.llm import quality_rules as q
from gridframe.llm.queries import OP9_SQL


def brute(text):
    spaces = " \t\n\v\f\r"
    words, word = [], ""
    for c in (text or "") + " ":
        if c in spaces:
            words += [word] if word else []
            word = ""
        else:
            word += c
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(spaces)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_features_match_brute_force(spark):
    rnd = random.Random(5)
    docs = [(i, "".join(rnd.choice(["a ", "bé ", "\n", "# ", " x ", "a b c d e ", "<p>\t"]) for _ in range(rnd.randrange(60))), "en") for i in range(80)]
    docs += [(1, None, None), (None, "", "en"), (2, "\n\n", "fr"), (3, "z", "fr")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = q.apply_rules(frame, labels).collect()
    want = sorted(((d, *brute(t)) for d, t, _ in docs), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=repr) == want
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # no stratum has labels enough
    assert q.apply_rules(frame.limit(0), labels).collect() == []


def test_bound_is_exact_and_limits_false_rejection():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (7, 9, 0.5)):
        assert math.isclose(q.lower_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
    above = [0 if c >= 300 else 500 for c in q.GRID]
    assert q.chosen(10_000, above, 0.005, 0.05 / 8) == 300 and q.chosen(20, [0] * len(q.GRID), 0.005, 0.05 / 8) is None
    assert q.chosen(10_000, [500] * len(q.GRID), 0.005, 0.05 / 8) is None and q.chosen(10_000, [0] * len(q.GRID), 0.005, 0.05 / 8) == 0


def thousands(spark):
    """Good documents with few symbols, bad ones with many; a stratum that has labels enough and one that hasn't."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, labels = [], []
    for i in range(2600):
        lang, good = ("en" if i % 20 else "fr"), i % 5 > 0
        words = [word() + ("#" * rnd.randrange(2) if good else rnd.choice(["##%%", "&&&&"])) for _ in range(12)]
        docs.append((i, " ".join(words).upper() if not good and i % 3 == 0 else " ".join(words), lang if i % 40 else None))
        labels.append((i, int(good)))
    docs += [(None, docs[1][1], "en"), (5, docs[5][1], "en"), (5000, "#" * 40, "de")]
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, kept string"), spark.createDataFrame([*labels, (1, 0), (None, 1)], "doc_id long, quality int")


def test_certified_rules_fire(spark):
    """Cutoffs, rules that fired and verdicts against plain Python over the same features."""
    docs, labels = thousands(spark)
    got = q.apply_rules(docs, labels).collect()
    marks = {}
    for r in labels.collect():
        if r["doc_id"] is not None:
            marks[r["doc_id"]] = max(r["quality"], marks.get(r["doc_id"], 0))
    texts = {}
    for r in docs.collect():
        texts.setdefault((r["doc_id"], r["lang"] or ""), r["text"])
    metrics = {}
    for (doc, stratum), text in texts.items():
        n, chars, symbols, dups, repeats = brute(text)
        lines = [x for x in text.split("\n") if x.strip()]
        metrics[doc, stratum] = (n < 10 or 100 * repeats > 20 * n, {"symbols": 1000 * symbols / max(chars, 1), "dup_lines": 1000 * dups / max(len(lines), 1), "repeats": 1000 * repeats / max(n, 1), "capitals": 1000 * sum("A" <= c <= "Z" for c in text) / max(chars, 1)})
    held = [(r["doc_id"], r["lang"] or "") for r in docs.collect() if marks.get(r["doc_id"]) == 1 and not metrics[r["doc_id"], r["lang"] or ""][0]]
    strata, cut = sorted({s for _, s in held}), {}
    for s in strata:
        mine = [metrics[k][1] for k in held if k[1] == s]
        for rule in q.RULES:
            for c in q.GRID:
                k = sum(m[rule] > c for m in mine)
                tail = sum(math.comb(len(mine), i) * 0.005**i * 0.995 ** (len(mine) - i) for i in range(k + 1)) if k < len(mine) else 1
                if k > len(mine) * 0.005 or tail > 0.05 / (4 * len(strata)):
                    break
                cut[s, rule] = c
    assert {s for s, _ in cut} == {"en"} and {rule for _, rule in cut} == set(q.RULES)
    want = []
    for r in docs.collect():
        failed, m = metrics[r["doc_id"], r["lang"] or ""]
        fired = ",".join(sorted(rule for rule in q.RULES if (r["lang"] or "", rule) in cut and m[rule] > cut[r["lang"] or "", rule]))
        want.append((r["doc_id"], failed, fired, not failed and not fired))
    assert sorted(((r["doc_id"], r["base_failed"], r["rejected_by"], r["kept"]) for r in got), key=repr) == sorted(want, key=repr)
    assert sum("symbols" in w[2] for w in want) > 300 and sum(w[3] for w in want) > 1500


def test_the_statement_gives_the_same_rows(spark):
    """The DuckDB statement on the fixture where rules fire."""
    duckdb = pytest.importorskip("duckdb")
    docs, labels = thousands(spark)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toArrow())
    con.register("labels", labels.toArrow())
    result = con.execute(OP9_SQL)
    names = [x[0] for x in result.description]
    want = sorted(map(tuple, result.fetchall()), key=repr)
    got = q.apply_rules(docs, labels).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == want and sum(bool(w[-1]) for w in want) > 300
