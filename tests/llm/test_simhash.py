import random

import xxhash

from gridframe.llm import simhash
from gridframe.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t-\r]+", low) if w]
    n = len(words)
    grams = [" ".join(words[i : i + 3]) for i in range(n - 2)] if n >= 3 else [" ".join(words)] if n else []
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, distance):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, p in rows:
        for e, q in rows:
            if (p ^ q).bit_count() <= distance:
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: find(d) for d, _ in rows}


def test_prints_and_components_match_brute_force(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(60)) for _ in range(6)]
    docs = []
    for i in range(150):
        words = rnd.choice(base).split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(60)] = rnd.choice("xyz")
        docs.append((i * 3 % 151, " ".join(words)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "One Two"), (504, "one  two"), (505, "É è ß"), (506, "one two three " * 2000), (7, docs[0][1]), (None, docs[1][1])]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(frame, crowd=4).collect()
    prints = [(d, brute_print(t)) for d, t in docs]
    want = brute_components([x for x in prints if x[0] is not None], 2)
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in got), key=repr) == sorted(((d, f"{p:016x}") for d, p in prints), key=repr)
    assert {r["doc_id"]: r["component_id"] for r in got} == {**want, None: None}
    kept = {r["doc_id"] for r in simhash.keep_one(frame).collect()}
    assert kept == {None, *want.values()}
    assert simhash.near_duplicates(frame.limit(0)).collect() == []


def test_planted_distances_around_crowds(spark):
    rnd = random.Random(4)
    prints = set()
    for _ in range(8):
        p = rnd.getrandbits(64)
        for _ in range(40):
            q = p
            for b in rnd.sample(range(64), rnd.randrange(4)):
                q ^= 1 << b
            prints.add(q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for crowd in (1, 8, 1000):
        for distance in (1, 2):
            edges = simhash.links(frame, distance, crowd)
            found = {r["node"]: r["component"] for r in components(edges).collect()}
            want = brute_components([(signed(p), p) for p in prints], distance)
            assert all(found.get(d, d) == c for d, c in want.items())


def test_thresholds_fill_the_pigeonhole():
    assert simhash.allocate([[0, 5, 50], [0, 1, 9], [0, 2, 99]], -1) in ([-1, 0, 0],)
    assert sum(simhash.allocate([[0, 5, 50, 90], [0, 1, 9, 99]], 1)) == 1


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id as u", "id + 1 as v")
    assert {r["component"] for r in components(edges).collect()} == {0}
