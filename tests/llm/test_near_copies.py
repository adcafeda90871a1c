import random

import corpus_pipeline

from gridframe.llm import near_copies


def jaccard(a, b, size=5):
    def of(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    x, y = of(a), of(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def documents(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    line = [word() for _ in range(12)]
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([4, 30, 60, 150]))] + rnd.choice([[], line])
        docs.append(base)
        for _ in range(rnd.randrange(5)):
            near = list(rnd.choice(docs[-3:]))
            for _ in range(rnd.randrange(1, 4)):
                near[rnd.randrange(len(near))] = word()
            docs.append(near)
    docs += [docs[3], [w.upper() for w in docs[4]], [], []]
    rnd.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def components(docs):
    at = {i: i for i, _ in docs}
    for i, a in docs:
        for j, b in docs:
            if i < j and at[i] != at[j] and jaccard(a, b) >= 0.8:
                lo, hi = sorted((at[i], at[j]))
                at = {k: lo if v == hi else v for k, v in at.items()}
    return at


def test_groups_are_those_of_all_pairs(spark):
    docs = [(1000 * s + i, t) for s in range(3) for i, t in documents(s)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = components(docs)
    assert got == want
    assert sum(want[i] != i for i in want) > 30 and len(set(want.values())) > 20


def test_stage_drops_near_copies_and_keeps_less_similar_texts(spark, tmp_path):
    words = [f"word{i}" for i in range(100)]
    near, far = list(words), list(words)
    near[30], far[10], far[30], far[50] = "x", "x", "y", "z"
    assert jaccard(" ".join(words), " ".join(near)) >= 0.8 > jaccard(" ".join(words), " ".join(far))
    docs = [(1, " ".join(words), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, " ".join(far), "en", "a", 1), (None, " ".join(near), "en", "a", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path))
    assert out.columns == frame.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]  # the row without an id is a copy too


def test_repeated_rows_and_rows_without_an_id_are_documents(spark):
    words = [f"word{i}" for i in range(60)]
    one, two, other = " ".join(words), " ".join([*words[:30], "x", *words[31:]]), " ".join(words[::-1])
    docs = [(1, one, "b"), (1, one, "a"), (1, one, "a"), (2, one, "c"), (2, one, "c"), (None, two, "d"), (None, other, "e"), (None, other, "e"), (3, None, "f"), (3, "", "g"), (None, None, "h"), (4, "alone", "i"), (4, "other words", "j")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, _near_id string").coalesce(1)
    runs = [sorted(map(tuple, near_copies.keep_one(f).collect()), key=repr) for f in (frame, frame.orderBy("_near_id", ascending=False))]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]].count(1) == 1 and len(runs[0]) == 5
    assert {(i, t or "") for i, t, _ in runs[0]} == {(1, one), (None, other), (3, ""), (4, "alone"), (4, "other words")}
    groups = {r["doc_id"]: r["component_id"] for r in near_copies.groups(frame).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    empty = spark.createDataFrame([], "doc_id long, text string, _near_id string")
    assert near_copies.keep_one(empty).collect() == [] and near_copies.groups(empty).collect() == []
    long = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w " * 300_000, "b")], "doc_id long, text string, _near_id string")
    assert [r["doc_id"] for r in near_copies.keep_one(long).collect()] == [1]
