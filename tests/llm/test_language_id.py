import random

import numpy as np
from pyspark.sql import functions as F

from gridframe.llm import language_id as li

WORDS = {"en": "the and thing with house water over because nothing", "de": "der und nicht schön Haus Wasser über weil nichts", "fr": "le et pas maison eau parce rien sur très été"}


def rows():
    rnd = random.Random(3)
    out = []
    for i in range(240):
        lang = rnd.choice(list(WORDS))
        told = lang if rnd.random() < 0.9 else rnd.choice(list(WORDS))
        out.append((i, " ".join(rnd.choice(WORDS[lang].split()) for _ in range(rnd.randrange(8, 30))), told, f"h-{lang}", lang))
    return out


def test_evidence_is_fused(spark):
    data = rows()
    edge = [(500, None, "en", "h-en", ""), (501, "", None, None, ""), (502, "12 34 ###", "fr", "h-fr", ""), (503, "xq", "de", "h-de", "de"), (None, "the house", "en", "h-en", "en"), (504, "schön " * 20000, None, None, "de"), (503, "the house and water", "en", "h-en", "en")]
    frame = spark.createDataFrame([(i, t, d, h, "x") for i, t, d, h, _ in data + edge], "doc_id long, text string, lang string, source string, kept string")
    got = li.documents(frame).collect()
    assert len(got) == len(data) + len(edge)
    truth = {i: lang for i, _, _, _, lang in data}
    assert sum(r["lang"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth) / len(truth) > 0.98
    by = {(r["doc_id"], r["n_lexical"]): r for r in got}
    assert not by[500, 0]["kept"] and not by[501, 0]["kept"] and not by[502, 0]["kept"] and by[502, 0]["lang"] is None
    assert by[504, 20000]["lang"] == "de"
    kept = li.kept_documents(frame)
    assert kept.columns == frame.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    assert ids == sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got if r["kept"])
    assert li.documents(frame.limit(0)).collect() == [] and li.kept_documents(frame.limit(0)).collect() == []
    assert {r["kept"] for r in li.documents(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {False}


def test_priors_decide_where_the_text_does_not(spark):
    seen = spark.createDataFrame([(i, t, d, h) for i, t, d, h, _ in rows()] + [(900, "qqq", None, "h-fr"), (901, "qqq", None, "h-de")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["lang"] for r in li.documents(seen).collect()}
    assert got[900] == "fr" and got[901] == "de"


def test_pages_give_markup_host_and_suffix(spark):
    pages = spark.createDataFrame([(1, "https://Blog.Haus.de:8080/x?a", '<html lang="de-AT"><head><style>p{}</style></head><body><p>der und <b>nicht</b> sch&ouml;n</p></body></html>'), (2, None, None)], "page_id long, url string, html string")
    got = {r["row_id"]: r for r in li.of_pages(pages).collect()}
    assert (got[1]["declared"], got[1]["suffix"], got[1]["host"]) == ("de", "de", "blog.haus.de") and "p{}" not in got[1]["text"] and "nicht" in got[1]["text"]
    assert "&ouml;" in got[1]["text"]
    docs = spark.createDataFrame([(i, t, d, h) for i, t, d, h, _ in rows()], "doc_id long, text string, lang string, source string")
    out = {r["page_id"]: r for r in li.pages(pages, docs).collect()}
    assert out[1]["lang"] == "de" and not out[2]["kept"]


def test_only_letters_are_evidence(spark):
    signs = ["😀 🎉 👍", "。、「」！？", "１２３ ４５", "\u0301 \u0308", "— … « »", "12 34 ###"]
    docs = [(i, t, d, h) for i, t, d, h, _ in rows()] + [(800 + i, t, "en", "h-en") for i, t in enumerate(signs)] + [(900, "house😀water — over", "en", "h-en"), (901, "café", "fr", "h-fr")]
    got = {r["doc_id"]: r for r in li.documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[800 + i]["n_lexical"] == 0 and not got[800 + i]["kept"] and got[800 + i]["lang"] is None for i in range(len(signs)))
    assert got[900]["n_lexical"] == 2 and got[901]["n_lexical"] == 1


def test_a_row_has_no_vote_in_its_own_prior(spark):
    """A host with one row: only the corpus is left as its prior, and a declaration that only it makes says nothing."""
    docs = [(i, t, d, h) for i, t, d, h, _ in rows()] + [(900, "haus wasser und", None, "lonely"), (901, "haus wasser und", None, "")]
    got = {r["doc_id"]: r for r in li.documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert abs(got[900]["posterior"] - got[901]["posterior"]) < 1e-9


def test_junk_tags_cost_nothing_and_reject_nothing(spark):
    """Tags that only a row or two have: their rows are judged by the candidates, or keep the language they declare."""
    docs = [(i, t, d, h) for i, t, d, h, _ in rows()]
    junk = [(10_000 + i, t, f"junk{i % 100_000:05d}", h) for i, (t, h) in enumerate((r[1], r[3]) for _ in range(420) for r in docs)][:100_000]
    odd = [(900_000, "zq", "tlh", "lonely"), (900_001, "zq", None, "lonely"), (900_002, "12", "tlh", "lonely")]
    frame = spark.createDataFrame(docs + junk + odd, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in li.documents(frame).collect()}
    truth = {i: lang for i, _, _, _, lang in rows()}
    assert len(got) == len(docs) + len(junk) + 3 and li.train(li.of_documents(frame))[0] == ["de", "en", "fr"]
    assert sum(got[10_000 + i]["lang"] == truth[i % 240] for i in range(2400)) > 2350 and all(got[i]["kept"] for i, *_ in junk)
    assert got[900_000]["kept"] and got[900_000]["lang"] in ("tlh", "de", "en", "fr") and not got[900_002]["kept"]
    few = frame.where("doc_id >= 900000")
    assert {r["doc_id"]: (r["lang"], r["kept"]) for r in li.documents(few).collect()} == {900_000: ("tlh", True), 900_001: (None, False), 900_002: (None, False)}


def test_clashing_columns_stay(spark):
    data = [(i, t, d, h, i, "x") for i, t, d, h, _ in rows()]
    frame = spark.createDataFrame([*data, (999, "12 34", "en", "h-en", 1, "y")], "doc_id long, text string, lang string, source string, gone_id long, gone_text string")
    kept = li.kept_documents(frame)
    assert kept.columns == frame.columns and kept.where("doc_id = 999").count() == 0 and kept.count() > 200


def test_trigrams_are_those_of_each_word_alone():
    """Runs of letters within a word, a space around each; many words at once or one by one; words that are dropped."""
    words = ["house😀water", "Été", "e\u0301t", "\u0301", "😀", "x", "ΑΒΓ", "日本語"]
    data, signs = [w.encode() for w in words], li.Signs()
    each = [li.trigrams([w], 997, signs)[0].tolist() for w in data]
    found, n = li.trigrams(data, 997, signs)
    assert n.tolist() == [len(x) for x in each] == [10, 3, 3, 0, 0, 1, 3, 3] and found.tolist() == sum(each, [])
    assert li.trigrams([b"house", b"water"], 997, signs)[0].tolist() == each[0] and li.trigrams(["été".encode()], 997, signs)[0].tolist() == each[1]
    rnd = random.Random(1)
    table = np.random.default_rng(0).random((997, 3)).astype(np.float32)
    text = " ".join(rnd.choice(words + ["long" * 30, "a", "b1c"]) for _ in range(400)).encode()
    wide, narrow = li.Likelihoods(table), li.Likelihoods(table, limit=3)
    for _ in range(2):
        (n, x), (m, y) = wide.of(text), narrow.of(text)
        assert n == m and np.allclose(x, y, rtol=1e-4)
