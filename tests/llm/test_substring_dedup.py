import hashlib
import random
import re
from collections import Counter

from gridframe.llm import substring_dedup as s


def brute(docs, size):
    words = [[w for w in re.split("[ \t-\r]+", t or "") if w] for _, t in docs]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        hit = {j for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        out.append((doc, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    passages = [" ".join(rnd.choice(["a", "b", "cé", "D"]) + str(rnd.randrange(30)) for _ in range(rnd.randrange(5, 40))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else f"u{rnd.randrange(9)} v{rnd.randrange(9)} w{i}" for _ in range(rnd.randrange(8))]
        docs.append((i, "  ".join(parts)))
    docs += [(200, None), (201, ""), (202, "ha " * 40), (203, "one two three four five six"), (203, "one two three four five six"), (None, passages[0]), (5, "x " * 3), (204, "l m n " * 15)]
    frame = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, n_words string")
    for size, k in ((6, 3), (7, 8), (5, 1)):
        got = sorted(map(tuple, s.digests(frame, size, k).collect()), key=repr)
        assert got == brute(docs, size)
    assert s.digests(frame.limit(0)).collect() == []
    kept = sorted((hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in s.remove_repeats(frame, 6, 3).collect()))
    assert kept == sorted(x[3] for x in brute(docs, 6))
