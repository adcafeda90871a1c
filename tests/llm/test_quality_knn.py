import random
import zlib

import numpy as np

from gridframe.llm import quality_knn as q


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    docs, labels = [], []
    for i in range(500):
        good = rnd.random() < 0.7
        words = [word() for _ in range(rnd.randrange(15, 60))]
        docs.append((i, " ".join(words if good else [w + rnd.choice(["###", "$$$", "!!"]) for w in words])))
        labels.append((i, int(good)))
    docs += [(900, None), (901, ""), (901, ""), (None, "a b c"), (902, "x " * 20000)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), labels[0]], "doc_id long, quality int")
    got = q.classify(frame, marks).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    flipped = spark.createDataFrame([(i, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, x in truth.items()], "doc_id long, quality int")
    key = lambda rows: sorted((repr(r["doc_id"]), round(r["score"], 9)) for r in rows)
    assert key(q.classify(frame, flipped).collect()) == key(got)  # held-out labels are never learnt from
    assert {r["score"] for r in q.classify(frame, marks.limit(0)).collect()} == {0.5}
    assert q.classify(frame.limit(0), marks).collect() == []


def test_words_matter_beside_shapes(spark):
    """Texts of one shape that differ in their words alone; and ties, which never hang on how rows were dealt."""
    rnd = random.Random(8)
    good, bad = (["".join(rnd.choice(x) for _ in range(5)) for _ in range(60)] for x in ("abcdefgh", "ijklmnop"))
    docs = [(i, " ".join(rnd.choice(good if i % 2 else bad) for _ in range(30))) for i in range(300)]
    docs += [(1000 + i, docs[i % 4][1]) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1000 + i, i % 3 % 2) for i in range(80)], "doc_id long, quality int")
    runs = []
    for parts in (1, 5):
        got = q.classify(spark.createDataFrame(docs[:: 1 if parts == 1 else -1], "doc_id long, text string").repartition(parts), labels).collect()
        runs.append({r["doc_id"]: r["score"] for r in got})
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((runs[0][i] >= 0.5) == (i % 2) for i in held if i > 3) / len(held) > 0.95
    assert all(abs(runs[0][i] - runs[1][i]) < 1e-3 for i in runs[0])


def test_exact_cosines_decide(spark):
    """Scores from the broadcast space equal those of plain sums over all sampled vectors."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("stone river house cloud Winter ### 12 $$$".split()) for _ in range(rnd.randrange(1, 30))).encode() for _ in range(120)]
    labels, terms = [rnd.randrange(2) for _ in texts], q.Terms()
    space = q.Space([terms.counts(t) for t in texts], labels)
    got = space.scores(terms, texts, 7)
    x = space.latent(terms, texts)
    x /= np.linalg.norm(x, axis=1)[:, None]
    # Cosines are rounded to five places, and of equal ones the sample's order decides.
    cosines = np.round(x @ space.vectors.T, 5).astype(np.float64)
    for i in range(len(texts)):
        near = sorted(range(len(texts)), key=lambda j: (-cosines[i, j], j))[:7]
        weight = [max(cosines[i, j], 0) ** q.POWER for j in near]
        assert abs(got[i] - sum(w * labels[j] for w, j in zip(weight, near, strict=True)) / sum(weight)) < 1e-6
