"""String functions and patterns of schedule pages.

Fixed values: the patterns below are spelled so that Java's and RE2's engines agree on them; the word lists are the
names that such tables, their header rows and their periods go by.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as printed text has it: Java's \s leaves out the no-break and typographic spaces.
SPACE = "[\\s   -     　﻿]+"

#: Fixed values; alternatives of single signs are written as classes of signs, which match the same.
CELL_MARK = r"(?i)^(?:x|\(x\)|\[x\]|[✓✔●•◆■†‡*–—-]|\d{1,2}\s*x|x\s*\d{1,2}|q\d+[wdhm]|b?id|tid|qd|qw|prn|y/n|yes|no|\d{1,3}(?:\.\d+)?)[a-z0-9,)\]*†‡]*$"
CELL_TOKEN = r"(?i)^(?:x|\(x\)|\[x\]|[✓✔●•◆■†‡§*→←↔–—-]|\d{1,3}(?:[.,]\d+)?|\d{1,2}\s*x|x\s*\d{1,2}|q\d+[wdhm]|b?id|tid|qd|qw|prn|y/n|yes|no|n/a|na)[a-z0-9,./)\]*†‡§¶#\s-]*$"
FOOTNOTE_LINE = r"(?i)^(?:[a-z]{1,2}|[0-9]{1,2}|[*†‡§¶#]{1,3}|x[a-z]|\([a-z0-9]{1,2}\))\s*[.):=-]?\s+\S"
FOOTNOTE_DEF = r"(?i)^(?:([*†‡§¶#]{1,3})\s*|([x✓●•]\s*)?([a-z]|\d{1,2}|\([a-z0-9]{1,2}\))\s*(?:[.):=–—-]\s*|\s+))(\S.*)$"
GLOSSARY_LABEL = r"(?i)^(?:abbreviations?|definitions?|legend|key|glossary)\s*:\s*"
NEW_TABLE = r"(?i)^(?:table|appendix|figure|exhibit)\s+[0-9ivxlc]+([^A-Za-z0-9_]|$)"
PAGE_FURNITURE = r"(?i)(?:^|\s)(?:page\s+\d{1,4}\s*$|copyright|©\s*\d{4}|version\s*(?:no\.?|number)?\s*[:.]?\s*\d|confidential|clinical\s+study\s+protocol|protocol\s+(?:no\.?|number)\s*[:.]?)"
TRAILING = r"(?:^|[Xx0-9)s])([a-z]{1,2}|[*†‡§¶#]{1,3})$"
TOC_LEADER = r"\.{4,}\s*\d+\s*$"
TOC_NUMBER = r"\s{3,}\d{1,3}\s*$"
CROSS_REFERENCE = r"(?i)(^|[^A-Za-z0-9_])(see|refer to|described in|listed in|presented in|shown in)([^A-Za-z0-9_]|$)"
HEADER_NUMBER = r"^-?\d{1,3}(?:[.,]\d+)?$"
#: The marks that are words, whole.
WORDY_MARK = r"(?i)^(?:b?id|tid|qd|qw|prn|y/n|yes|no|n/a|na)$"

#: Names of the table.
TITLE_WORDS = [
    "schedule of activities",
    "schedule of assessments",
    "schedule of events",
    "schedule of procedures",
    "schedule of measures",
    "schedule of evaluations",
    "schedule of study procedures",
    "study schedule",
    "visit schedule",
    "time and events",
    "time & events",
    "study flow chart",
    "study flowchart",
    "flow chart",
    "flowchart",
    "table of events",
    "trial schedule",
    "overview of study assessments",
    "study assessments",
    "assessment schedule",
    "schedule of time and events",
]

#: Words that head a header row.
HEADER_WORDS = [
    "visit",
    "study day",
    "study week",
    "day",
    "week",
    "cycle",
    "timepoint",
    "time point",
    "window",
    "visit window",
    "month",
    "hour",
    "period",
    "activity",
    "assessment",
    "assessments",
    "procedure",
    "procedures",
    "evaluation",
]

#: Names of periods.
PERIOD_WORDS = [
    "screening",
    "baseline",
    "randomization",
    "randomisation",
    "treatment",
    "follow-up",
    "follow up",
    "end of treatment",
    "end of study",
    "washout",
    "enrollment",
    "enrolment",
    "discharge",
    "termination",
    "early termination",
    "run-in",
    "lead-in",
    "maintenance",
    "extension",
    "unscheduled",
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space that isn't one plain space alone: only this has to be replaced.  Printed ASCII is passed over first.
LOOSE_SPACE = f"(?![!-~])(?:(?! ){SPACE}| {SPACE})"


def clean(s: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(s, LOOSE_SPACE, " "))


def norm(s: Column) -> Column:
    return F.lower(clean(s))


def lower_each(s: Column) -> Column:
    """Small letters sign by sign, as DuckDB writes them: no final sigma, one sign for a dotted capital I."""
    return F.lower(F.translate(s, "Σİ", "σi"))


def upper_each(s: Column) -> Column:
    """Capitals sign by sign: a sign whose capital is several signs (ß) stays."""
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def label_key(s: Column) -> Column:
    """What identifies a label: its small letters and digits."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def join_wrapped(a: Column, b: Column) -> Column:
    """Two printed pieces of one text: a hyphen at the break joins them without a space."""
    return F.when(a == "", b).when(b == "", a).when(a.rlike(r"-\s*$"), F.concat(F.regexp_replace(a, r"\s+$", ""), b)).otherwise(F.concat_ws(" ", a, b))


def round_half_up(x: Column) -> Column:
    """Half goes towards plus infinity, unlike SQL's round."""
    return F.floor(x + 0.5)


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def follows(marker: Column, before: Column) -> Column:
    """Whether a one-sign marker is the next after ``before`` (a to b, 3 to 4), a leading x aside."""
    bare = lambda m: F.regexp_replace(F.lower(m), "^x(?=.)", "")
    return (F.length(bare(marker)) == 1) & (F.length(bare(before)) == 1) & (F.ascii(bare(marker)) == F.ascii(bare(before)) + 1)
