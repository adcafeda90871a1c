"""Token counts against the library on whole texts."""

import random

import pytest

from gridframe.llm import token_counts as t

public_tokenizers = pytest.importorskip("public_tokenizers")

SIGNS = ["a", "Word", "it's", "'ll", "don", "12", "7x9", "é", "Straße", "東京", "…", "--", "<|endoftext|>", "<|end", "́", "🙂", "\x1f"]
SPACES = [" ", "  ", "\n", "\n\n", "\t", " \n", " ", "　 ", "  ", "\x85", "", ""]


def texts(n):
    rnd = random.Random(8)
    return ["".join(rnd.choice(SIGNS) + rnd.choice(SPACES) for _ in range(rnd.randrange(30))) for _ in range(n)]


def library(name):
    path = str(public_tokenizers.path(name))
    if name.endswith(".model"):
        import sentencepiece

        return lambda x: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(x))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda x: len(own.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(name):
    count, own = t.Counter(str(public_tokenizers.path(name)), limit=40), library(name)
    assert count.safe == (name == "byte_bpe_50k.json")
    given = ["", " ", "\n", *texts(3000 if count.safe else 60)]
    for i in range(0, len(given), 50):
        assert count.counts(given[i : i + 50]) == [own(x) for x in given[i : i + 50]]
    assert len(count.young) < 40 + 1500


def test_long_texts_are_cut_and_count_the_same():
    count, own = t.Counter(str(public_tokenizers.path("byte_bpe_50k.json"))), library("byte_bpe_50k.json")
    rnd = random.Random(1)
    joined = "".join(rnd.choice("abcXYZ0189'-") for _ in range(4 * t.LONG))
    pieces = t.cut(joined)
    assert "".join(pieces) == joined and len(pieces) > 1
    prose = " ".join(texts(4000))
    assert count.counts([joined, prose, "x" * 300]) == [own(joined), own(prose), own("x" * 300)]
    assert [sum(map(len, b)) <= 100 or len(b) == 1 for b in t.batches_of(t.cut(prose), 100)].count(False) == 0


def test_rows_of_a_table(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "two words"), (1, "two words"), (None, "é"), (2, None), (3, ""), (4, "a b c d")]
    frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, t.count(frame, path, limit=3).collect()), key=repr)
    own = library("byte_bpe_50k.json")
    assert got == sorted([(i, len((x or "").encode()), own(x or ""), own(x or "") > 3) for i, x in rows], key=repr)
    assert t.count(frame.where("false"), path).collect() == []
