"""python -m gridframe.cli 'files/*.pdf' --out folder: the tables of all files as JSON lines, one object a document.

``--reader module:function`` names a reader for tables that the checks don't trust (see ``review.Provider``); without
one, or with ``--no-assist``, nobody is asked.  Settings in a file .env are taken where the environment has none.
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridframe.operators import publish, review, second, tables
from gridframe.sources import env, json_sink, pdf
from gridframe.sources.stages import cut


def reader_of(name: str, seconds: float | None, ledger: str | None) -> review.Reviewer:
    """The reviewer that module:attribute names: one, a provider, or a function."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    if isinstance(found, review.Reviewer):
        return found
    provider = found if isinstance(found, review.Provider) else review.Provider(name, (), "", "", found)
    return review.Reviewer(provider, deadline=None if seconds is None else time.time() + seconds, ledger=ledger)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("path", help="a path or glob of PDF files that Spark reads")
    parser.add_argument("--out", required=True, help="a folder that isn't there yet, or is empty")
    parser.add_argument("--reader", help="module:function that reads a table again")
    parser.add_argument("--no-assist", action="store_true", help="ask no reader")
    parser.add_argument("--seconds", type=float, help="time for the second reading")
    parser.add_argument("--ledger", help="a folder in which answers are kept")
    asked = parser.parse_args(argv)
    env.load()
    spark = SparkSession.builder.appName("gridframe").getOrCreate()
    json_sink.register(spark)
    found = cut(pdf.parts(spark, asked.path))
    got = tables.extract(*pdf.relations(found))
    if asked.reader and not asked.no_assist:
        got = second.read(got, reader_of(asked.reader, asked.seconds, asked.ledger))
    out = publish.documents(got, datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"))
    out.select("value").write.format(json_sink.FORMAT).mode("append").save(asked.out)
    told = got.page_counts.join(got.assessments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("verdict")), ", ").alias("verdicts")), "doc_id", "left")
    for row in told.orderBy("doc_id").toLocalIterator():
        print(f"{row['doc_id']}: {row['n'] or 0} table(s)" + (f", {row['verdicts']}" if row["n"] else ""))
    for row in pdf.errors(found).orderBy("doc_id", "page").toLocalIterator():
        print(f"{row['doc_id']}: page {row['page']} not read: {row['error']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
