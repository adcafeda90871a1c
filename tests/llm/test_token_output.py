import functools
import random
import zlib

import numpy as np
import pytest

from gridframe.llm import common, token_output

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@functools.lru_cache
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library(text):
    return whole().encode(text or "", add_special_tokens=False).ids


def texts():
    rnd = random.Random(9)
    bits = ["the", "The", "don't", "it'S", "'", "é", "é", "́", "ß", "İ", "ſ", "K", "«", "(«", "»x", "12", "3.5", "٣", "a1b", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "中文", "한", "👍🏽", "--", "x_y", " ", " ", "\x1c", "\x85", "Σ", "ΑΣ"]
    seps = [" ", "", "\n", "\t ", "  ", "\x0b"]
    return ["".join(rnd.choice(bits) + rnd.choice(seps) for _ in range(rnd.randrange(30))) for _ in range(400)] + [None, "", "x" * 5000, "word " * 3000]


def test_chunks_give_the_ids_of_whole_texts():
    ids = token_output.ChunkIds(PATH, limit=7)
    for text in texts():
        assert np.frombuffer(ids.of((text or "").encode()), "<u4").tolist() == library(text), text


def test_round_trip(spark):
    rows = [(i * 7 % 301, t, "x") for i, t in enumerate(texts()[:300])] + [(None, "null id", "x"), (5, "again", "x"), (5, "again", "x"), (6, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    path = common.scratch(spark, "t")
    token_output.write_tokens(docs, path, PATH, 2)
    got = token_output.digests(spark, path).collect()
    by_id = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    starts, at = [], 0
    stored = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: (r["part"], r["start_in_part"]))
    assert [r["doc_id"] for r in stored] == [r[0] for r in by_id]
    for r in stored:
        starts.append((at, len(r["tokens"]), zlib.crc32(np.array(r["tokens"], "<u4").tobytes())))
        at += len(r["tokens"])
    assert sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(starts)
    want = sorted((r[0] if r[0] is not None else -1, [*library(r[1]), 2]) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, list(r["tokens"])) for r in stored) == want


def test_empty_table_and_selective_reads(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = common.scratch(spark, "t")
    token_output.write_tokens(docs, path, PATH, 2)
    assert token_output.digests(spark, path).collect() == []
    plan = token_output.part_starts(spark, path)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<part:int,n_tokens:bigint>" in plan


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    ids, library = token_output.ChunkIds(path), Tokenizer.from_file(path)
    assert not ids.plain and token_output.ChunkIds(PATH).plain
    for text in ["The  house\nand it's", "", "Été 12", "a" * 300]:
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_have_the_encodings_and_the_page_index(spark):
    import glob

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(6000)], "doc_id long, text string").repartition(1)
    path = common.scratch(spark, "t")
    token_output.write_tokens(docs, path, PATH, 2)
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 40 << 20
            for c in range(group.num_columns):
                column = group.column(c)
                listed = column.path_in_schema.startswith("tokens")
                assert ("DELTA_BINARY_PACKED" in column.encodings) != listed and ("RLE_DICTIONARY" in column.encodings) == listed
                assert column.has_column_index and column.has_offset_index or column.path_in_schema.startswith("tokens")
    some = token_output.read_documents(spark, path, [7, 4321])
    assert sorted(r["doc_id"] for r in some.collect()) == [7, 4321]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [4321,7])]" in plan.replace("[7,4321]", "[4321,7]")
