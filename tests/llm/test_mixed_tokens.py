import corpus_pipeline

from gridframe.llm import mixing
from gridframe.llm.queries import MIX


def test_tokens_are_written_in_the_order_of_the_mix(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}", f"src{i % 3 * 8}") for i in range(400)], "doc_id long, text string, source string")
    placed = mixing.placed(docs, MIX, carry=["doc_id"]).select("row.doc_id", "slot", "in_block").collect()
    want = [r["doc_id"] for r in sorted(placed, key=lambda r: (r["slot"], r["in_block"]))]
    mix, write = (corpus_pipeline.STAGES[i][1] for i in (3, 4))
    mix(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    for frame in (spark.read.parquet(f"{tmp_path}/mixed"), mix(spark, docs, str(tmp_path))):
        rows = sorted(write(spark, frame, str(tmp_path)).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in rows] == want != sorted(want)
        assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
