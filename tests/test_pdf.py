import random
import zlib

from pyspark.sql import functions as F

from gridframe.sources import pdf


def make(content: bytes, rotate: int = 0) -> bytes:
    packed = zlib.compress(content)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] >>",
        b"<< /Type /Page /Parent 2 0 R /Rotate %d /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>" % rotate,
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [" + b"500 " * 95 + b"] >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>"


CONTENT = rb"""BT /F1 10 Tf 1 0 0 1 100 700 Tm (Visit \(1\) X) Tj 0 -20 Td [(We) -200 (ek)] TJ ET
q 1 0 0 1 10 0 cm 90 650 m 390 650 l S Q 100 500 0.5 150 re f 5 5 40 40 re n"""


def named(df):
    return df.withColumn("doc_id", F.regexp_extract("doc_id", "[^/]*$", 0))


def test_words_and_rules(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make(CONTENT))
    (tmp_path / "b.pdf").write_bytes(make(CONTENT, 90))
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    words, rules, pages = (named(df) for df in pdf.read(spark, str(tmp_path / "*.pdf")))
    got = [tuple(r) for r in words.where("doc_id = 'a.pdf'").orderBy("word_ix").select("text", "x", "y", "w", "h").collect()]
    assert got[:3] == [("Visit", 100, 90, 25, 10), ("(1)", 130, 90, 15, 10), ("X", 150, 90, 5, 10)]
    assert got[3] == ("We", 100, 110, 10, 10) and got[4][:3] == ("ek", 112, 110)
    lines = {(r["orient"], r["pos"], r["lo"], r["hi"]) for r in rules.where("doc_id = 'a.pdf'").collect()}
    assert lines == {("H", 150.0, 100.0, 400.0), ("V", 100.25, 150.0, 300.0)}
    sizes = {r["doc_id"]: (r["width"], r["height"], r["rotated"]) for r in pages.collect()}
    assert sizes == {"a.pdf": (600, 800, False), "b.pdf": (800, 600, True)}
    assert {r["orient"] for r in rules.where("doc_id = 'b.pdf'").collect()} == {"H", "V"}
    assert words.where(F.col("doc_id") == "c.pdf").count() == 0


def objects(*bodies):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(bodies)) + b"trailer << /Root 1 0 R >>"


def stream(head: bytes, content: bytes) -> bytes:
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(content), content)


FONT = b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [" + b"500 " * 95 + b"] >>"


def paper(contents: list[bytes], more: list[bytes] = (), resources: bytes = b"") -> bytes:
    """A document of pages, each with a content stream; further objects begin at 4."""
    first = 4 + len(more)
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(contents)))
    pages = [x for i, c in enumerate(contents) for x in (b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (first + 2 * i + 1), stream(b"", c))]
    tree = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> %s >> >>" % (kids, len(contents), resources)
    return objects(b"<< /Type /Catalog /Pages 2 0 R >>", tree, FONT, *more, *pages)


def rounded(rows):
    return [{k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()} for r in rows]


def content_of(data: bytes):
    got = list(pdf.rows_of("d", data))
    assert not [r for r in got if r["kind"] == "error"], got
    return rounded(sorted(got, key=lambda r: (r["kind"], r.get("text") or "", r.get("x") or 0, r.get("min_x") or 0, r.get("min_y") or 0)))


def plain(rows):
    return [{k: v for k, v in r.items() if k != "ix"} for r in rows]


def test_forms_within_forms_are_what_is_drawn_flat():
    inner = b"BT /F1 10 Tf 1 0 0 1 5 5 Tm (inner) Tj ET 0 0 m 60 0 l S"
    outer = b"q 2 0 0 2 10 20 cm /In Do Q BT /F1 8 Tf 1 0 0 1 0 90 Tm (outer text) Tj ET /Out Do"
    more = [stream(b"/Subtype /Form /Matrix [1 0 0 1 3 4]", inner), stream(b"/Subtype /Form /Resources << /XObject << /In 4 0 R /Out 5 0 R >> /Font << /F1 3 0 R >> >>", outer)]
    nested = paper([b"q 1 0 0 1 100 200 cm /Fm Do Q BT /F1 10 Tf 50 50 Td (page) Tj ET"], more, b"/XObject << /Fm 5 0 R >>")
    flat = paper([b"q 1 0 0 1 100 200 cm q 2 0 0 2 10 20 cm 1 0 0 1 3 4 cm " + inner + b" Q BT /F1 8 Tf 1 0 0 1 0 90 Tm (outer text) Tj ET Q BT /F1 10 Tf 50 50 Td (page) Tj ET"])
    assert plain(content_of(nested)) == plain(content_of(flat)) and len([r for r in content_of(nested) if r["kind"] == "word"]) == 4


def test_forms_inherit_resources_and_the_stack_keeps_text_state():
    # The form has no resources of its own; the font set within q and Q is gone behind them.
    form = stream(b"/Subtype /Form", b"BT /F1 10 Tf 1 0 0 1 0 0 Tm (inherited) Tj ET")
    words = [(r["text"], r["h"]) for r in pdf.rows_of("d", paper([b"/F1 6 Tf q /F1 20 Tf Q 1 0 0 1 50 60 cm /Fm Do BT (small) Tj ET BI /W 1 ID \x00(Tj\xff BT EI BT 0 9 Td (behind) Tj ET"], [form], b"/XObject << /Fm 4 0 R >>")) if r["kind"] == "word"]
    assert words == [("inherited", 10), ("small", 6), ("behind", 6)]


def test_extents_of_curves_are_those_of_many_points():
    rnd = random.Random(3)
    for _ in range(50):
        p, q, r, s = [(rnd.uniform(0, 500), rnd.uniform(0, 700)) for _ in range(4)]
        ops = {"c": "%f %f %f %f %f %f c" % (*q, *r, *s), "v": "%f %f %f %f v" % (*r, *s), "y": "%f %f %f %f y" % (*q, *s)}
        controls = {"c": (p, q, r, s), "v": (p, p, r, s), "y": (p, q, s, s)}
        for op, text in ops.items():
            a, b, c, d = controls[op]
            box = next(x for x in pdf.rows_of("d", paper([b"%f %f m %s S" % (*p, text.encode())])) if x["kind"] == "box")
            at = [tuple((1 - t) ** 3 * a[k] + 3 * (1 - t) ** 2 * t * b[k] + 3 * (1 - t) * t * t * c[k] + t**3 * d[k] for k in (0, 1)) for t in (i / 4000 for i in range(4001))]
            want = {"min_x": min(x for x, _ in at), "max_x": max(x for x, _ in at), "min_y": 800 - max(y for _, y in at), "max_y": 800 - min(y for _, y in at)}
            assert all(abs(box[k] - v) < 1e-3 for k, v in want.items()), (op, box, want)


def folders(tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    page = lambda i: b"BT /F1 10 Tf 100 700 Td (word%d) Tj ET 90 %d m 390 %d l S" % (i, 500 + i, 500 + i)
    (tmp_path / "a" / "x.pdf").write_bytes(paper([page(i) for i in range(7)]))
    (tmp_path / "a" / "deep" / "x.pdf").write_bytes(paper([page(9)]))
    (tmp_path / "a" / "bad.pdf").write_bytes(b"not a pdf")
    (tmp_path / "a" / "locked.pdf").write_bytes(paper([page(1)]).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"))
    (tmp_path / "a" / "note.txt").write_bytes(b"x")
    return str(tmp_path / "a")


def test_data_source(spark, tmp_path):
    root = folders(tmp_path)
    pdf.register(spark)
    every = spark.read.format(pdf.FORMAT).load(root)
    small = spark.read.format(pdf.FORMAT).option("bytesPerPartition", 700).load(root)
    assert small.rdd.getNumPartitions() > 4 and sorted(map(repr, small.collect())) == sorted(map(repr, every.collect()))
    assert {(r["doc_id"], r["error"]) for r in pdf.errors(every).collect()} == {(f"{root}/bad.pdf", "ValueError: no pages"), (f"{root}/locked.pdf", "ValueError: encrypted")}
    words = pdf.relations(every)[0]
    assert sorted((r["doc_id"][len(root) :], r["page"], r["text"]) for r in words.collect()) == [("/deep/x.pdf", 1, "word9"), *[("/x.pdf", i + 1, f"word{i}") for i in range(7)]]
    same = pdf.read(spark, f"{root}/*.pdf")
    for one, two in zip(pdf.relations(spark.read.format(pdf.FORMAT).load(f"{root}/x.pdf")), same, strict=True):
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_filters_and_columns_go_to_the_reader(spark, tmp_path):
    root = folders(tmp_path)
    pdf.register(spark)
    few = spark.read.format(pdf.FORMAT).load(root).where(f"kind = 'word' and page >= 3 and page < 5 and doc_id = '{root}/x.pdf' and text is not null")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["text"] for r in few.collect()) == ["word2", "word3"]
    assert "Filter" in plan and "page" not in plan.split("Filter", 1)[1].split("\n")[0] and "isnotnull(text" in plan
    reader = pdf.PdfReader({"path": root}, spark.read.format(pdf.FORMAT).load(root).schema)
    rest = list(reader.pushFilters([pdf.EqualTo(("doc_id",), f"{root}/deep/x.pdf"), pdf.In(("page",), (1, 4)), pdf.EqualTo(("text",), "x"), pdf.LessThan(("x",), 3.0)]))
    assert [f.attribute for f in rest] == [("text",), ("x",)] and [f for s in reader.partitions() for f in s.files] == [(f"{root}/deep/x.pdf", 0, 1)]
    sizes = spark.read.format(pdf.FORMAT).schema("doc_id string, page int, width int").load(f"{root}/x.pdf")
    assert sorted(map(tuple, sizes.collect())) == [(f"{root}/x.pdf", i, 600) for i in range(1, 8)]
    assert spark.read.format(pdf.FORMAT).load(root).where("page > 90").count() == 0
