"""Relations that Spark and DuckDB read from the same SQL: what is derived from the tables, and a few rows of rare cases."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from gridframe.operators import confidence
from gridframe.plans import derived
from gridframe.sources import layout

DUCK = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "long": "BIGINT"}


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return f"'{x}'"
    return repr(x)


#: The documents' lines in DuckDB; for Spark they are ``layout.doc_lines``.
LINES = "(select doc_id, cast(ix - 1 as integer) as line_ix, text from (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as ix from documents))"


@dataclass(frozen=True)
class Tables:
    """The given tables of a session's data folder."""

    spark: SparkSession
    folder: str

    def read(self, sql: str) -> DataFrame:
        """``sql`` over the tables whose names it has in braces."""
        used = {n: layout.table(self.spark, self.folder, n) for n in ("lineitem", "orders") if "{" + n + "}" in sql}
        if "{lines}" in sql:
            used["lines"] = layout.doc_lines(layout.table(self.spark, self.folder, "documents"))
        return self.spark.sql(sql, **used)


@dataclass(frozen=True)
class Fixture:
    """``columns``: "name type, ..."; strings must not hold quotes or backslashes.  ``derived``: SQL over the tables."""

    columns: str
    rows: list[tuple]
    derived: str = ""

    def _typed(self, kind, quote: str) -> str:
        pairs = [(quote + n + quote, kind(t)) for n, t in (c.split() for c in self.columns.split(","))]
        names = ", ".join(n for n, _ in pairs)
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        typed = "select " + ", ".join(f"cast({n} as {t}) as {n}" for n, t in pairs)
        rare = f"{typed} from (values {values}) as t({names})"
        return f"{rare} union all {typed} from ({self.derived}) as d" if self.derived else rare

    def frame(self, data: Tables) -> DataFrame:
        return data.read(self._typed(lambda t: {"long": "bigint"}.get(t, t), "`"))

    def rare(self, data: Tables) -> DataFrame:
        return replace(self, derived="").frame(data)

    @property
    def sql(self) -> str:
        return f"({self._typed(DUCK.__getitem__, '"')})".format(lineitem="lineitem", orders="orders", lines=LINES)


K = "doc_id string, cand int"

PATHS = Fixture("doc_id string, page int, path_ix int, min_x double, max_x double, min_y double, max_y double", [
    ("a", 1, 0, 10, 200, 50, 51), ("a", 1, 1, 280, 400, 50.5, 51.5), ("a", 1, 2, 481, 500, 50, 51), ("a", 1, 3, 100, 101, 20, 300), ("a", 1, 4, 101, 102.5, 310, 500), ("a", 1, 5, 0, 5, 0, 1),
    ("a", 1, 6, 0, 50, 0, 50), ("b", 2, 0, 10, 22, 10, 12.5), ("b", 2, 1, 10, 12.5, 10, 22), ("b", 2, 2, 10, 90, 400, 400), ("b", 2, 3, 171, 240, 402.5, 402.5), ("b", 2, 4, 10, 60, 406, 406),
])

BOXES = Fixture("box long, a double, b double, c double, d double, e double, f double, min_x double, max_x double, min_y double, max_y double", [
    (1, 1, 0, 0, 1, 0, 0, 1, 2, 3, 4), (2, 0, 1, -1, 0, 100, 0, 10, 20, 30, 40), (3, 2, 0, 0, -2, 0, 792, 5, 6, 7, 9), (4, 1, 0, 0, 1, None, 0, 1, 2, 3, 4), (5, 0.5, 0.5, -0.5, 0.5, 8, 16, 0, 4, 0, 8),
])

ITEMS = Fixture("doc_id string, page int, word_ix int, text string, m0 double, m1 double, m2 double, m3 double, m4 double, m5 double, t0 double, t1 double, width double, height double", [
    ("a", 1, 0, "Visit", 10, 0, 0, 10, 100.256, 200.125, 10, 0, 24.5, 10), ("a", 1, 1, " ", 10, 0, 0, 10, 1, 2, 10, 0, 5, 10), ("a", 1, 2, "Up", 0, 8, -8, 0, 50, 60, 8, 0, 12, 8), ("a", 1, 3, "none", 1, 0, 0, 1, 1, 1, 1, 0, 0, 0),
    ("a", 1, 4, "zero", 3, 4, 0, 12, 10.005, 20.5, 0, 0, 2, 12), ("a", 1, 5, "half", 1, 0, 3, 4, -2.125, 1.375, 2, 0, 9, 5),
])

HEADINGS = Fixture("line_ix long, text string", [
    (1, "Table 3. Schedule of Activities"), (2, "Schedule of Events ........ 14"), (3, "see the Schedule of Events in Attachment 1"), (4, "Study Flow Chart"), (5, "The overview of study assessments is described in Section 5"),
    (6, "TIME AND EVENTS"), (7, "Schedule   of    Assessments"), (8, "Foresee the trial schedule"), (9, "a" * 111), (10, "visit schedule"), (11, "Assessment schedule and a great many other words that make this line much longer than any heading would be in print"),
    (12, "Statistical methods"), (13, "Refer to Table of Events"),
])

PERIODS = Fixture("doc_id string, page int, text string", [
    ("a", 1, "Screening  Baseline Treatment"), ("a", 1, "Follow-up"), ("a", 2, "washout only"), ("a", 3, "End of Treatment / Early Termination visit"), ("b", 1, "nothing"), ("b", 2, "RANDOMISATION and run-in, lead-in"),
])

SCORES = Fixture("doc_id string, page int, score double, marks int, mark_lines int, footnote_lines int", [
    ("a", 1, 6.0, 0, 0, 0), ("a", 2, 10.5, 20, 5, 0), ("a", 3, 14.0, 40, 9, 1), ("a", 4, 8.0, 12, 3, 0), ("a", 5, 2.0, 0, 0, 4), ("a", 6, 2.0, 0, 0, 3), ("a", 7, 2.0, 0, 1, 6), ("a", 9, 9.0, 9, 3, 0), ("a", 10, 9.5, 30, 6, 0), ("a", 11, 3.0, 0, 0, 5),
    ("b", 1, 8.9, 50, 9, 9), ("b", 2, 9.0, 2, 1, 0), ("c", 1, 12.0, 10, 4, 0), ("c", 2, 12.0, 10, 4, 0), ("c", 3, 1.0, 10, 2, 0),
])

EDGES = Fixture("grp string, pos double", [("a", 1), ("a", 2), ("a", 3.5), ("a", 5), ("a", 9), ("b", 10), ("b", 13), ("b", 13.5), ("b", 16), ("b", 16.6), ("c", 7)])

INTERVALS = Fixture("grp string, low double, high double", [("a", 0, 10), ("a", 5, 12), ("a", 20, 25), ("a", 21, 22), ("b", 3, 3), ("b", 3, 8), ("b", 8, 9), ("c", -5, 5), ("c", -1, 1)])

TOKENS = Fixture("ix int, text string", list(enumerate([
    "X", "(X)", "[x]", "3X", "x 2", "Q2W", "q12h", "BID", "PRN", "Yes", "No", "n/a", "NA", "12", "1.5", "1,5", "Xa", "X,b", "Visit", "Weekly", "day", "XABC", "yesterday", "X(a)", "-", "*", "daily", "12345", "X-Y", "1234", "tid", "X abcd", "once", "prn2", "X1234567890123",
])))

BANDS = Fixture("doc_id string, page int, band_ix int, left double, right double, centre double", [
    ("a", 1, 0, 95, 105, 100), ("a", 1, 1, 150, 170, 160), ("a", 1, 2, 210, 230, 220), ("b", 1, 0, 50, 50, 50), ("b", 1, 1, 62, 66, 64),
])

POINTS = Fixture("doc_id string, page int, word_ix int, centre double", [
    ("a", 1, 0, 100), ("a", 1, 1, 127.5), ("a", 1, 2, 128), ("a", 1, 3, 139), ("a", 1, 4, 190), ("a", 1, 5, 262), ("a", 1, 6, 264), ("b", 1, 0, 57), ("b", 1, 1, 36), ("b", 1, 2, 35), ("b", 1, 3, 80.01),
])

VERTICAL = Fixture("doc_id string, page int, word_ix int, text string, x double, y double, w double, h double", [
    *[("a", 1, i, c, 100 + (i % 2), 50 + 11 * i, 6, 9) for i, c in enumerate("RANDOMIZE")], *[("a", 1, 20 + i, "P", 200, 50 + 11 * i, 6, 9) for i in range(7)], *[("a", 1, 40 + i, c, 300, 50 + 40 * i, 6, 9) for i, c in enumerate("ABCDEF")],
    ("a", 1, 60, "Word", 100, 300, 20, 9), *[("b", 2, i, c, 10, 10 * i, 5, 9) for i, c in enumerate("washX")],
])

MARKS = Fixture("doc_id string, page int, word_ix int, text string, x double, y double, w double, h double", [("a", 1, 1, "X", 100, 50, 6, 10), ("a", 1, 2, "3X", 160, 50, 12, 10), ("a", 1, 3, "X", 220, 50, 6, 10)])

LOOSE = Fixture("doc_id string, page int, word_ix int, text string, x double, y double, w double, h double", [
    ("a", 1, 11, "a", 106.5, 48, 3, 6), ("a", 1, 12, "b", 107, 47, 3, 6), ("a", 1, 13, "d", 175.4, 41, 3, 6), ("a", 1, 14, "e", 230, 50, 3, 6), ("a", 1, 15, "abc", 226, 50, 9, 6), ("a", 1, 16, "f", 226, 38, 3, 6), ("a", 1, 17, "g", 226, 50, 3, 11),
])

LINE_WORDS = Fixture("doc_id string, row int, line_ix int, word_ix int, text string, x double, w double", [
    ("a", 1, 0, 0, "Prior", 100, 25), ("a", 1, 0, 1, "to", 128, 10), ("a", 1, 0, 2, "Weekly", 200, 30), ("a", 1, 1, 3, "Day", 110, 15), ("a", 1, 1, 4, "4", 127, 5), ("a", 1, 1, 5, "dosing", 205, 30), ("a", 2, 0, 6, "once", 300, 20),
])

HEADS = Fixture("doc_id string, page int, row int, head_ix int, text string, x0 double, x1 double", [
    ("a", 1, 0, 0, "Screening", 90, 170), ("a", 1, 0, 1, "Treatment", 220, 400), ("a", 1, 0, 2, "EOS", 455, 485), ("a", 1, 1, 0, "1", 98, 102), ("a", 1, 1, 1, "9", 470, 474), ("b", 1, 0, 0, "Run", 95, 125), ("b", 1, 0, 1, "Day", 155, 180),
])

HEAD_BANDS = Fixture("doc_id string, page int, band_ix int, centre double", [
    ("a", 1, 0, 100), ("a", 1, 1, 160), ("a", 1, 2, 220), ("a", 1, 3, 280), ("a", 1, 4, 340), ("a", 1, 5, 400), ("a", 1, 6, 470), ("b", 1, 0, 100), ("b", 1, 1, 160), ("b", 1, 2, 280),
])

HEAD_CELLS = Fixture("doc_id string, page int, cell_ix int, cell_left double, cell_right double", [("a", 1, 0, 70, 190), ("a", 1, 1, 190, 430), ("a", 1, 2, 430, 500)])

HEADER_VALUES = Fixture("doc_id string, cand int, row_ix int, role string, band_ix int, value string", [
    ("a", 0, 0, "period", 0, "Screening"), ("a", 0, 0, "period", 1, "Treatment"), ("a", 0, 1, "visitNumber", 0, "1"), ("a", 0, 1, "visitNumber", 1, "2"), ("a", 0, 2, "studyDay", 0, "-15 to -9"), ("a", 0, 3, "studyDay", 0, "other"), ("a", 0, 3, "window", 1, "3 days"),
    ("a", 0, 4, None, 0, "clinic"), ("a", 0, 5, None, 0, "fasting"), ("a", 0, 4, None, 2, "phone"), ("a", 0, 2, "studyWeek", 3, "12"),
])

CAPTIONS = Fixture("ix long, label string, numeric boolean", [
    (1, "Visit Number", True), (2, "Visit", False), (3, "Visits", True), (4, "Visits", False), (5, "Study Day", True), (6, "Days", True), (7, "ACTIVITY WEEK", True), (8, "Month", False), (9, "Visit Window (days)", False), (10, "Study Period", False),
    (11, "Cycle 1", False), (12, "Vital signs", False), (13, "Timepoint", False), (14, "Phase", False), (15, "Weekly weight", False), (16, "Physical exam day", False),
])

CONTINUED = Fixture("doc_id string, cand int, ord int, id string, page int, key string, width double, centre double, pitch double", [
    ("a", 0, 0, "p1c0", 1, "1", 600, 100, 60), ("a", 0, 1, "p1c1", 1, "2", 600, 160, 60), ("a", 0, 2, "p1c2", 1, "1", 600, 220, 60), ("a", 0, 3, "p2c0", 2, "2", 600, 102, 60), ("a", 0, 4, "p2c1", 2, "7", 600, 160, 60), ("a", 0, 5, "p3c0", 3, None, 600, 128, 60),
    ("a", 0, 6, "p3c1", 3, None, 500, 160, 60), ("a", 0, 7, "p3c2", 3, None, 600, 300, 60),
])

LABELS = Fixture("doc_id string, cand int, ord int, label string", [
    ("a", 0, 0, "Physical Examination"), ("a", 0, 1, "Vital signs"), ("a", 0, 2, "PHYSICAL EXAMINATION"), ("a", 0, 3, "Physical examination (full)"), ("a", 0, 4, "Vital signs (supine)"), ("a", 0, 5, "Vital-signs"), ("a", 0, 6, "Physical examination including neurological status"),
])

ENTRIES = Fixture("doc_id string, page int, entry_ix int, label string, n_values int", [
    ("a", 1, 0, "Orphan", 2), ("a", 1, 1, "SAFETY", 0), ("a", 1, 2, "ECG", 3), ("a", 1, 3, "Labs", 1), ("a", 1, 4, "EFFICACY", 0), ("a", 1, 5, "Scale", 4), ("a", 2, 0, "Next page", 1), ("a", 2, 1, "PK", 0), ("a", 2, 2, "Sample", 1),
])

ASSEMBLE = Fixture("doc_id string, page int, line_ix int, y double, bottom double, label string, n_marks int, other string", [
    ("a", 1, 0, 100, 110, "Physical", 3, ""), ("a", 1, 1, 112, 122, "examination", 0, ""), ("a", 1, 2, 124, 134, "Vital Signs", 0, ""), ("a", 1, 3, 126, 136, "pulse", 2, ""), ("a", 1, 4, 140, 150, "", 0, "weekly"), ("a", 1, 5, 190, 200, "SAFETY", 0, ""),
    ("a", 1, 6, 203, 213, "ASSESSMENTS", 0, ""), ("a", 1, 7, 240, 250, "", 0, "far"),
])

CELLS = Fixture("doc_id string, cand int, row_id string, band_ix int, ord int, value string", [
    ("a", 0, "r1", 0, 2, "X"), ("a", 0, "r1", 0, 1, "Xa"), ("a", 0, "r1", 1, 3, "3X"), ("a", 0, "r2", 0, 5, "X"), ("a", 0, "r2", 0, 4, "(X)"),
])

SPANS = Fixture("doc_id string, cand int, row_id string, band_ix int, text string", [("a", 0, "r1", 0, "Day 4"), ("a", 0, "r1", 1, "3X"), ("a", 0, "r1", 2, "Prior to Day 4"), ("a", 0, "r2", 0, "no"), ("a", 0, "r3", 1, "weekly")])

DEFS = Fixture("doc_id string, page int, line_ix int, y double, h double, text string", [
    ("a", 1, 0, 500, 8, "a. Screening within 14 days"), ("a", 1, 1, 510, 8, "of the first dose."), ("a", 1, 2, 520, 8, "b. Only women of child-"), ("a", 1, 3, 530, 8, "bearing age"), ("a", 1, 4, 540, 8, "c. At sites that can"), ("a", 1, 5, 550, 8, "* If clinically needed"),
    ("a", 1, 6, 560, 8, "Abbreviations: ECG = electrocardiogram; PK = pharmacokinetics"), ("a", 1, 7, 570, 8, "X a - only at visit 2"), ("a", 1, 8, 580, 8, "Page 12"), ("a", 1, 9, 590, 8, "d. never read"), ("b", 1, 0, 100, 8, "1. Numbered prose goes on"), ("b", 1, 1, 110, 8, "2. and on"),
])

PLAUSIBLE = ["a", "b", "*"]

TEXTS = Fixture("doc_id string, cand int, text string, whole boolean", [
    ("a", 0, "Physical exama", False), ("a", 0, "ECGb", False), ("a", 0, "Vital signs c", False), ("a", 0, "Xd", True), ("a", 0, "3e", True), ("a", 0, "P", True), ("a", 0, "X*", True), ("a", 0, "tests", False), ("a", 0, "Weekly 1", True), ("b", 0, "Labs", False),
])

NOTES = Fixture("doc_id string, cand int, page int, ord int, marker string, text string, glossary boolean", [
    ("a", 0, 1, 0, "a", "first part", False), ("a", 0, 1, 1, "a", "second part", False), ("a", 0, 1, 2, "abbreviations", "ECG = x", True), ("a", 0, 2, 0, "a", "reprinted", False), ("a", 0, 2, 1, "abbreviations", "ECG = x; PK = y", True), ("a", 0, 2, 2, "b", "new", False),
])

VALUES = Fixture("doc_id string, cand int, row_id string, col_id string, value string", [
    ("a", 0, "r1", "c1", "Xa"), ("a", 0, "r1", "c2", "X b"), ("a", 0, "r2", "c1", "(c)"), ("a", 0, "r2", "c2", "3a"), ("a", 0, "r3", "c1", "a"), ("a", 0, "r3", "c2", "Weekly"), ("a", 0, "r4", "c1", "X"), ("a", 0, "r4", "c2", "daily"),
])

MARKERS = Fixture("doc_id string, cand int, marker string", [("a", 0, "a"), ("a", 0, "b"), ("a", 0, "c"), ("a", 0, "x"), ("a", 0, "z")])

ROW_LINKS = Fixture("doc_id string, cand int, row_id string, marker string", [("a", 0, "r2", "b"), ("a", 0, "r5", "z")])

#: One table for each check, and a clean one.
T_COLUMNS = Fixture("doc_id string, cand int, ord int, id string, label string, visit_number string, study_day string, study_week string, visit_window string, page int, divider boolean, ruled boolean", [
    ("names", 0, 0, "c0", "Column 1", None, None, None, None, 1, False, True), ("names", 0, 1, "c1", "Column 2", "", None, None, None, 2, False, True), ("names", 0, 2, "c2", "V3", "3", None, None, None, 1, False, True),
    *[("pages", 0, i, f"c{i}", f"V{i}", str(i), None, None, None, 1 if i < 6 else 2, False, False) for i in range(8)], *[("same", 0, i, f"c{i}", "Column 1" if i == 1 else f"V{i}", None if i == 1 else str(i), None, None, None, 1, False, False) for i in range(3)],
    ("blank", 0, 0, "c0", "V1", "1", None, None, None, 1, False, False), ("blank", 0, 1, "c1", "V2", "2", None, None, None, 1, False, False), ("notes", 0, 0, "c0", "V1", "1", "1", None, None, 1, False, False), ("notes", 0, 1, "c1", "R", None, None, None, None, 1, True, False),
    *[("thin", 0, i, f"c{i}", f"V{i}", str(i), None, None, None, 1, False, False) for i in range(10)], ("clean", 0, 0, "c0", "V1", "1", "1", "1", "2", 1, False, False), ("clean", 0, 1, "c1", "V2", "2", None, None, None, None, False, False),
])

T_ROWS = Fixture("doc_id string, cand int, ord int, id string, kind string, label string", [
    *[(d, 0, i, f"r{i}", "assessment", f"Row {i}") for d in ("names", "pages", "notes", "clean") for i in range(3)], *[("same", 0, i, f"r{i}", "assessment", f"Row {i}") for i in range(7)], *[("thin", 0, i, f"r{i}", "assessment", f"Row {i}") for i in range(6)],
    ("blank", 0, 0, "r0", "assessment", " "), ("blank", 0, 1, "r1", "assessment", "Row 1"), ("blank", 0, 2, "r2", "assessment", ""), ("blank", 0, 3, "r3", "category", ""),
])

T_CELLS = Fixture("doc_id string, cand int, row_id string, col_id string, value string", [
    *[(d, 0, f"r{i}", "c0", "X") for d in ("names", "pages", "notes", "clean") for i in range(3)], *[("pages", 0, f"r{i}", f"c{j}", "X") for i in range(3) for j in range(1, 3)], *[("same", 0, f"r{i}", f"c{j}", "X") for i in range(7) for j in range(2)], ("same", 0, "r0", "c2", "X"),
    ("blank", 0, "r0", "c0", "X"), ("blank", 0, "r1", "c0", "X"), ("thin", 0, "r0", "c0", "X"),
])

T_TARGETS = Fixture("doc_id string, cand int, marker string, target string", [("notes", 0, "a", "table"), ("notes", 0, "b", "table"), ("notes", 0, "c", "row"), ("clean", 0, "a", "cell"), ("clean", 0, "b", "table")])

REVIEWED = Fixture("doc_id string, cand int, ord int, id string, label string, visit_number string, study_day string, study_week string, visit_window string, divider boolean", [
    ("a", 0, 0, "n0", "Screening", "1", None, None, None, False), ("a", 0, 1, "n1", "", None, "8", "", None, False), ("a", 0, 2, "n2", "Visit 3", "3", "15", None, None, False), ("a", 0, 3, "n3", "Nothing", None, None, None, None, False),
])

GEOMETRIC = Fixture("doc_id string, cand int, ord int, id string, label string, visit_number string, study_day string, study_week string, visit_window string, divider boolean", [
    ("a", 0, 0, "g0", "SCREENING", "1", "-7", "-1", "2", False), ("a", 0, 1, "g1", "V2", "2", "8", "1", "1", False), ("a", 0, 2, "g2", "Random", None, None, None, None, True), ("a", 0, 3, "g3", "V3b", "3", "99", "2", "3", False), ("a", 0, 4, "g4", "V3", "3", "15", "4", "4", False),
])

DIVIDERS = Fixture("doc_id string, cand int, label string, after int", [("a", 0, "RANDOM", 2), ("a", 0, "START", 0)])

SPLIT_ROWS = Fixture("doc_id string, cand int, ord int, label string, n_cells int, ruled boolean", [
    ("a", 0, 0, "Physical", 3, True), ("a", 0, 1, "examination", 0, True), ("a", 0, 2, "Concomitant", 2, True), ("a", 0, 3, "medication", 0, True), ("a", 0, 4, "review", 0, True), ("a", 0, 5, "Labs", 0, True), ("b", 0, 0, "Physical", 1, False), ("b", 0, 1, "examination", 0, False),
])

DRAWN_LABELS = Fixture("doc_id string, cand int, label string", [("a", 0, "Physical examination"), ("a", 0, "medication review"), ("a", 0, "Concomitant medication review"), ("b", 0, "Physical examination")])

USAGE = Fixture("use_ix long, model string, tokens_in long, tokens_out long", [(1, "large", 41250, 18844), (2, "medium", 40000, 4501), (3, "small", 1, 1), (4, "unknown", 10, 10)])
#: Dollars per million tokens in and out.
RATES = Fixture("model string, rate_in double, rate_out double", [("large", 5, 25), ("medium", 2, 10), ("small", 1, 5)])

PAIRS = Fixture("grp long, pos int, at int", [(1, 0, 3), (1, 1, 1), (1, 2, 2), (1, 3, 5), (1, 4, 4), (2, 0, 9), (2, 1, 8)])

BAGS = Fixture("ix long, printed string, ours string, spanned boolean", [
    (1, "X a", "X", False), (2, "3X weekly", "weekly 3X", False), (3, "Day 4", "Day 5", False), (4, "Day 4", "Day 5", True), (5, "12 12", "12", False), (6, "prior to day 4", "prior to", False), (7, "", "X", False),
])

P_ROWS = Fixture("doc_id string, page int, row int, label string", [("a", 1, 0, "Physical examination"), ("a", 1, 1, "Vital signs supine"), ("a", 1, 2, "X = required"), ("a", 1, 3, "Adverse events"), ("a", 1, 4, "ECG 12 lead")])
O_ROWS = Fixture("doc_id string, page int, label string", [("a", 1, "Physical examination brief"), ("a", 1, "Vital signs"), ("a", 1, "ECG")])

HEADLINES = Fixture("doc_id string, page int, heading string", [("a", 1, "Visit 1"), ("a", 1, "Baseline"), ("a", 1, "Day 14"), ("a", 1, "EOS")])
OWN_HEADS = Fixture("doc_id string, page int, label string", [("a", 1, "Visit 1 (Screening)"), ("a", 1, "14"), ("a", 1, "Follow-up")])

NOTE_TEXTS = Fixture("doc_id string, page int, marker string, text string", [("a", 1, "a", "Only at sites that can draw blood"), ("a", 1, "b", "Screening within fourteen days"), ("a", 1, "c", "Entirely invented words here")])
PAGE_TEXTS = Fixture("doc_id string, page int, text string", [("a", 1, "a. Only at sites that can draw"), ("a", 1, "blood"), ("a", 1, "b. Screening, within the fourteen days")])

CHECKS = Fixture("kind string, skipped string", [("row", None), ("row", None), ("row", "foreign grid"), ("cell", None), ("cell", "no pair"), ("cell", "no pair")])

RAW_COLUMNS = Fixture("doc_id string, cand int, ord int, id string, label string, visit_number string, study_day string, study_week string, visit_window string, divider boolean", [
    ("a", 0, 0, "p1c0", "  Visit   1 ", "1", "", None, " 2  days", None), ("a", 0, 1, None, None, None, "8", "1", "", True), ("a", 0, 2, "", "x", " ", None, None, None, False),
])
RAW_ROWS = Fixture("doc_id string, cand int, ord int, id string, kind string, label string, category string", [("a", 0, 0, "r0", "category", " Safety ", ""), ("a", 0, 1, None, None, "ECG  12", "Safety"), ("a", 0, 2, "r2", "other", None, None)])
RAW_NOTES = Fixture("doc_id string, cand int, ord int, marker string, printed string, text string, continued boolean, n_pages int, n_targets int", [
    ("a", 0, 0, "a", "a.", "one  two", None, 1, 2), ("a", 0, 1, "abbreviations", "", "ECG = x", False, 2, 0), ("a", 0, 2, "X", None, "required", True, 1, 0), ("a", 0, 3, "b", None, "loose", False, 1, 0),
])

PAGE_LINES = Fixture("doc_id string, page int, line_ix int, y double, text string", [
    ("a", 1, 0, 20, "Protocol 12 page 3"), ("a", 1, 1, 40, "Table 2 Schedule of Events"), ("a", 1, 2, 60, "Visit 1 2 3"), ("a", 2, 0, 20, "Table 2 Schedule of Events continued"), ("a", 2, 3, 80, "X X"), ("a", 2, 5, 120, "APPENDIX II Schedule of Assessments"),
    ("a", 3, 2, 44, "Figure 1. Flow chart"), ("a", 3, 13, 300, "Table 9 other"), ("b", 1, 20, 400, "Schedule of Events"), ("b", 1, 21, 420, "Appendix 3 more"),
])

TITLES = Fixture("doc_id string, page int, title string", [("a", 1, "Table 2 Schedule of Events"), ("a", 2, "Table 2 Schedule of Events")])

CUTS = Fixture("doc_id string, page int, orient string, rule_ix int, pos double, lo double, hi double, pieces int, cut double", [
    ("a", 1, "H", 0, 99, 10, 90, 1, 100), ("a", 1, "H", 1, 98.9, 10, 90, 1, 100), ("a", 1, "V", 0, 50, 20, 200, 2, 100), ("a", 1, "V", 1, 60, 20, 80, 1, 100), ("b", 1, "H", 0, 5, 0, 9, 1, 0), ("b", 2, "V", 0, 5, 1, 9, 1, None),
])

LABEL_WORDS = Fixture("doc_id string, row int, word_ix int, text string, h double", [
    ("a", 1, 0, "Physical", 10), ("a", 1, 1, "exam", 10), ("a", 1, 2, "a", 6), ("a", 2, 0, "Vital", 10), ("a", 2, 1, "B", 10), ("a", 3, 0, "ECG", 9), ("a", 3, 1, "*", 8.7), ("a", 3, 2, "†", 8.5),
])

HEADINGS_X = Fixture("doc_id string, page int, head_ix int, text string, x0 double, x1 double", [("a", 1, 0, "End of Treat-", 100, 160), ("a", 1, 1, "Follow", 200, 240), ("a", 1, 2, "Visit", 300, 330)])
PIECES_X = Fixture("doc_id string, page int, piece_ix int, text string, x0 double, x1 double", [("a", 1, 0, "ment", 120, 140), ("a", 1, 1, "up", 215, 225), ("a", 1, 2, "period", 243, 270), ("a", 1, 3, "lost", 400, 420)])

MATRIX = Fixture("doc_id string, page int, r int, c int, text string", [
    ("a", 1, 0, 0, "Activity"), ("a", 1, 0, 1, "Note"), ("a", 1, 0, 2, "Visit 1"), ("a", 1, 0, 3, "Visit 2"), ("a", 1, 1, 0, "Study Day"), ("a", 1, 1, 2, "1"), ("a", 1, 1, 3, "8"), ("a", 1, 2, 0, "Physical exam"), ("a", 1, 2, 1, "full one"), ("a", 1, 2, 2, "X"), ("a", 1, 2, 3, "X"),
    ("a", 1, 3, 0, "Labs"), ("a", 1, 3, 1, "fasting"), ("a", 1, 3, 2, "X"), ("b", 1, 0, 0, "Item"), ("b", 1, 0, 1, "1"), ("b", 1, 1, 0, "unknown"), ("b", 1, 1, 1, "x"), ("b", 1, 1, 2, "X"), ("b", 1, 1, 3, "X"),
])

KNOWN_ROWS = Fixture("doc_id string, page int, label string", [("a", 1, "PHYSICAL EXAM"), ("a", 1, "Labs")])

PHRASES = Fixture("doc_id string, page int, row int, phrase string", [("a", 1, 1, "Prior to Day 4"), ("a", 1, 1, "weekly"), ("a", 1, 2, "monthly"), ("a", 1, 9, "no row")])
PRINTED = Fixture("doc_id string, page int, row int, text string", [("a", 1, 1, "prior to"), ("a", 1, 1, "prior to day 4 only"), ("a", 1, 2, "weekly"), ("a", 1, 2, "X")])

GRIDS = Fixture("doc_id string, page int, n_drawn int, n_paired int, starts_another boolean", [("a", 1, 8, 3, False), ("a", 2, 8, 4, False), ("a", 3, 3, 0, False), ("a", 4, 9, 9, True)])

RANKED = Fixture("doc_id string, cand_ix int, score double", [("a", 0, 9.5), ("a", 1, 9.4), ("b", 0, 20), ("b", 1, 14), ("b", 2, 12), ("b", 3, 12), ("c", 0, 30), ("c", 1, 11.9)])


def packed_tables(data: Tables) -> DataFrame:
    """T_COLUMNS, T_ROWS, T_CELLS and T_TARGETS, a row for each table: orders are dealt out once, the rare ones packed."""
    rare = confidence.pack(cols=T_COLUMNS.rare(data), rows=T_ROWS.rare(data), cells=T_CELLS.rare(data), targets=T_TARGETS.rare(data))
    return rare.unionByName(derived.packed_tables(layout.table(data.spark, data.folder, "lineitem")))


for _name, _sql in derived.SQL.items():
    globals()[_name] = replace(globals()[_name], derived=_sql)
