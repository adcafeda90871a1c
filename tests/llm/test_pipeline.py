import random

import corpus_pipeline

from gridframe.llm import decontaminate, language_id, mixing, simhash, token_output
from gridframe.llm.queries import tokenizer_file


def test_stages_keep_columns_and_decisions_take_effect(spark, tmp_path):
    rnd = random.Random(11)
    words = "the and thing with house water over because nothing stone river".split()
    text = lambda n: " ".join(rnd.choice(words) + rnd.choice("abcdefgh") for _ in range(n))
    passage = text(14)
    docs = [(i, text(40), "en", f"src{i % 3}", 1) for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "src0", 1) for i in range(5)] + [(200, f"{text(30)} {passage} {text(30)}", "en", "src1", 1), (201, passage, "en", "src1", 1), (202, "### 12", "en", "src2", 1), (203, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{i}")
        frame = spark.read.parquet(f"{tmp_path}/out-{i}")
        seen.append({r["doc_id"]: r for r in frame.collect()})
        if i < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert [len(x) for x in seen] == [67, 62, 61, 61, 61]
    assert 202 not in seen[0] and 203 not in seen[0] and 100 not in seen[1] and 201 not in seen[2]
    assert passage not in seen[2][200]["text"]
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, seen[4].values()))
    assert sum(r["n_tokens"] for r in run) == max(r["start"] + r["n_tokens"] for r in run)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert tokenizer_file() and all((language_id, simhash, decontaminate, mixing, token_output))


def test_an_empty_table_runs_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, slot string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    none = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    assert decontaminate.clean(none, bench).collect() == [] and mixing.mixed(none, {"a": 1}).collect() == []
    assert decontaminate.clean(none, bench).columns == none.columns
