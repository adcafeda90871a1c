import random

from gridframe.llm import language_id


def test_the_commonest_64_languages_are_not_all(spark):
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02d}": ["".join(rnd.choice(letters) for _ in range(6)) for _ in range(12)] for i in range(70)}
    docs = [(lang, " ".join(rnd.choice(known) for _ in range(25))) for lang, known in words.items() for _ in range(6 if lang < "l64" else 4)]
    frame = spark.createDataFrame([(i, t, lang, "web") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language_id.documents(frame).collect()}
    assert [i for i, (lang, _) in enumerate(docs) if got[i]["lang"] != lang or not got[i]["kept"]] == []
