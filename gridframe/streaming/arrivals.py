"""Documents that arrive as files of lines: scores of each micro-batch's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridframe.operators import locate
from gridframe.sources import layout


def score_arrivals(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Scores the pages of new documents and appends them to ``sink``; all that is there is read, then it stops.

    A document arrives whole, so a micro-batch has all pages that its scores need, and no state is kept.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        scores = locate.page_scores(layout.doc_lines(batch)).select("doc_id", "page", "score", "marks", "mark_lines", "footnote_lines")
        scores.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
