"""Published documents: the shape, what a table says of itself, and a sink that writes each document once."""

import json
import os

import pytest
from test_extract_full import printed

from gridframe import cli
from gridframe.operators import publish, second, tables
from gridframe.sources import env, json_sink


@pytest.fixture(scope="module")
def extracted(spark):
    words, rules = printed()
    return tables.extract(
        spark.createDataFrame(words, "doc_id string, page int, word_ix int, text string, x double, y double, w double, h double"),
        spark.createDataFrame(rules, "doc_id string, page int, orient string, rule_ix int, pos double, lo double, hi double"),
        spark.createDataFrame([("doc", 1, 600), ("doc", 2, 600), ("blank", 1, 600)], "doc_id string, page int, width int"),
    )


def objects(df):
    return {r["doc_id"]: json.loads(r["value"]) for r in df.collect()}


def test_documents_have_the_published_shape(spark, extracted):
    got = objects(publish.documents(extracted, "now"))
    assert got["blank"] == {"document": "blank", "pageCount": 1, "review": None, "sourcePages": None, "tables": [], "pageScores": [], "extractedAt": "now"}
    doc = got["doc"]
    assert doc["pageCount"] == 2 and [t["id"] for t in doc["tables"]] == ["t1", "t2"] and [t["pages"] for t in doc["tables"]] == [[1, 2], [2]]
    first = doc["tables"][0]
    assert first["title"] == "Schedule of Activities" and list(first["columns"][0]) == ["id", "label", "path", "visitNumber", "studyDay", "studyWeek", "window", "markers", "divider", "pages"]
    assert [(c["visitNumber"], c["studyDay"], c["path"], c["pages"]) for c in first["columns"]] == [(str(i + 1), str(7 * i + 1), ["Screening" if i < 2 else "Treatment"], [1]) for i in range(4)]
    rows = {r["label"]: r for r in first["rows"]}
    assert [c["value"] for c in rows["Height"]["cells"]] == ["X"] * 4 and [c["col"] for c in rows["Height"]["cells"]] == [c["id"] for c in first["columns"]]
    assert rows["Physical exam"]["cells"][0] == {"col": "p1c0", "value": "X", "markers": ["b"]}
    assert first["footnotes"] == [{"marker": "b", "printed": "b", "kind": "footnote", "text": "Before the first dose alone", "pages": [1], "continued": False, "appliesTo": [{"target": "cell", "row": rows["Physical exam"]["id"], "col": "p1c0"}]}]
    told = first["provenance"]
    assert (told["readBy"], told["model"], told["rowsAreRuled"], told["geometric"]) == ("geometry", None, False, None) and told["locatorScore"] >= 9 and told["locatorEvidence"][0]["page"] == 1 and told["locatorEvidence"][0]["reasons"]
    assert "Schedule of Activities" in doc["sourcePages"]["1"] and "Height X X X X" in doc["sourcePages"]["1"] and {s["page"] for s in doc["pageScores"]} == {1, 2}
    assert any(a.startswith("another-table") for a in first["ambiguities"])


def test_a_reviewed_table_says_so(spark, extracted):
    def reader(asked):
        col = lambda i: {"id": f"k{i}", "label": f"Visit {i}", "visitNumber": str(i)}
        names = ["Physical exam", "Vital signs", "Blood sample", "Urine sample", "Weight", "Adverse events", "Height"]
        rows = [{"id": n, "kind": "assessment", "label": n, "cells": [{"col": "k1", "value": "X"}]} for n in names]
        return {"tables": [{"title": "Read again", "columns": [col(1), col(2)], "rows": rows, "footnotes": [{"marker": "sCid", "text": "a word", "page": 1}], "ambiguities": []}]}

    unsure = extracted.assessments.withColumn("verdict", publish.F.when(publish.F.col("cand") == 0, "fallback").otherwise(publish.F.col("verdict")))
    got = objects(publish.documents(second.read(second.replace(extracted, assessments=unsure), reader)))["doc"]
    first, other = got["tables"]
    assert (first["title"], first["provenance"]["readBy"], len(first["columns"]), len(first["rows"])) == ("Read again", "review", 2, 7)
    assert first["provenance"]["geometric"]["columns"] == 4 and first["provenance"]["geometric"]["rows"] == 7
    assert first["footnotes"] == [{"marker": "scid", "printed": "scid", "kind": "note", "text": "a word", "pages": [1], "continued": False, "appliesTo": [{"target": "table", "row": None, "col": None}]}]
    assert got["review"]["attempted"] == 1 and {(o["table"], o["outcome"]) for o in got["review"]["outcome"]} == {("t1", "used"), ("t2", "not-needed")} and other["provenance"]["readBy"] == "geometry"


def lines(folder):
    return sorted(line for p in folder.iterdir() if p.is_file() for line in p.read_text().splitlines())


def test_the_sink_writes_each_row_once(spark, tmp_path):
    json_sink.register(spark)
    values = [json.dumps({"document": f"d{i:03d}", "text": "é\n✓"}) for i in range(40)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "value string").repartition(6)
    out = tmp_path / "out"
    frame.write.format(json_sink.FORMAT).mode("append").save(str(out))
    assert lines(out) == sorted(values) and not [p for p in out.iterdir() if p.is_dir()]
    assert sorted(r["document"] for r in spark.read.json(str(out)).collect()) == [f"d{i:03d}" for i in range(40)]
    frame.limit(1).write.format(json_sink.FORMAT).mode("append").save(f"file:{out}")
    assert len(lines(out)) in (40, 41)
    frame.where("value like '%d00%'").write.format(json_sink.FORMAT).mode("overwrite").save(str(out))
    assert lines(out) == sorted(v for v in values if "d00" in v)
    before = lines(out)
    bad = spark.range(8, numPartitions=4).selectExpr("case when id < 6 then '{}' else raise_error('no value') end as value")
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no value"):
            bad.write.format(json_sink.FORMAT).mode(mode).save(str(out))
        # What tasks that were still running wrote is under a name that readers pass over.
        assert lines(out) == before and [p.name for p in out.iterdir() if p.is_dir()] in ([], ["_temporary"])
    with pytest.raises(Exception, match="column value"):
        spark.range(1).write.format(json_sink.FORMAT).mode("append").save(str(out))
    spark.createDataFrame([], "value string").write.format(json_sink.FORMAT).mode("append").save(str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_a_task_that_runs_again_writes_nothing_twice(tmp_path):
    """A job whose tasks fail once and are tried again, in a session that allows it."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import os, pyarrow as pa
from pyspark.sql import SparkSession
from gridframe.sources import json_sink
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
json_sink.register(spark)
def fails_once(batches):
    from pyspark import TaskContext
    for batch in batches:
        yield pa.RecordBatch.from_pydict({{"value": [str(x) for x in batch.column(0).to_pylist()]}})
        flag = f"{tmp_path}/failed-{{TaskContext.get().partitionId()}}"
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("lost")
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
spark.range(40, numPartitions=4).mapInArrow(fails_once, "value string").write.format(json_sink.FORMAT).mode("append").save("{tmp_path}/out")
"""
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert lines(tmp_path / "out") == sorted(str(i) for i in range(40)) and len(list(tmp_path.glob("failed-*"))) == 4
    assert not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]


def test_settings_from_a_file(tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nexport B = 'two words' \nC=\"x\nD=old\nbad line\n=x\n")
    into = {"D": "new"}
    assert env.load(str(tmp_path / ".env"), into) == ["A", "B", "C"] and into == {"A": "1", "B": "two words", "C": '"x', "D": "new"}
    assert env.load(str(tmp_path / "none"), into) == []


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from test_pdf import paper

    monkeypatch.chdir(tmp_path)
    text = b"BT /F1 10 Tf 1 0 0 1 150 760 Tm (Schedule of Activities) Tj"
    y = 700
    for label, xs in [("Visit Number", ["1", "2", "3", "4"]), *[(f"Assessment {chr(97 + r)}", ["X"] * 4) for r in range(6)]]:
        text += b" 1 0 0 1 20 %d Tm (%s) Tj" % (y, label.encode())
        for i, x in enumerate(xs):
            text += b" 1 0 0 1 %d %d Tm (%s) Tj" % (200 + 60 * i, y, x.encode())
        y -= 14
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "001.pdf").write_bytes(paper([text + b" ET"]))
    (tmp_path / "a" / "bad.pdf").write_bytes(b"nothing")
    assert cli.main([f"{tmp_path}/*/*.pdf", "--out", f"{tmp_path}/out", "--no-assist"]) == 0
    got = [json.loads(line) for line in lines(tmp_path / "out")]
    assert sorted(d["document"] for d in got) == [f"{tmp_path}/a/001.pdf", f"{tmp_path}/b/001.pdf"]
    assert all(len(d["tables"]) == 1 and len(d["tables"][0]["rows"]) == 6 and len(d["tables"][0]["columns"]) == 4 for d in got)
    told = capsys.readouterr().out
    assert "a/001.pdf: 1 table(s), check" in told and "bad.pdf: page 0 not read: ValueError: no pages" in told
