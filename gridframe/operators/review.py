"""A second reading: what is shown to a reader, and the rule that only what is printed may come back."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions import text as T

#: Answer lengths in tokens with and without haste, and the budget in milliseconds that means haste.
LONG_ANSWER, SHORT_ANSWER, HASTE_MS = 16000, 8000, 90_000
#: Fixed values, in seconds: what a reading needs to be worth starting, what is kept for the work after it, the least
#: wait for an answer, and the pause before a second attempt.
LEAST_S, KEPT_S, WAIT_S, PAUSE_S = 25, 6, 1, 2


@dataclass(frozen=True)
class Provider:
    """Who can be asked: a name, the variables of which one must hold a key, its models, and the reader itself.

    ``reader`` takes a request (text, context, model, max_tokens, thinking, doc_id, cand) and returns an answer, a
    mapping with ``tables`` and perhaps ``usage`` (input and output tokens), or None.
    """

    name: str
    keys: tuple[str, ...]
    model: str
    fast_model: str
    reader: Callable[[dict], dict | None]


@dataclass(frozen=True)
class Reviewer:
    """A provider and how it is asked: until when (seconds of the epoch), how many at a time in a task, how often, and
    where answers are written down.
    """

    provider: Provider
    deadline: float | None = None
    concurrency: int = 4
    attempts: int = 2
    pause: float = PAUSE_S
    ledger: str | None = None


def provider(known: list[Provider], env: dict[str, str] | None = None) -> Provider | None:
    """The provider that GRIDFRAME_REVIEWER names, if it has a key; else the first that has one; else none, and the
    geometry stands.  GRIDFRAME_REVIEW_MODEL and GRIDFRAME_FAST_MODEL replace its models.
    """
    env = dict(os.environ) if env is None else env
    able = [p for p in known if any(env.get(k) for k in p.keys)]
    named = [p for p in able if p.name == env.get("GRIDFRAME_REVIEWER", "").lower()]
    if not able:
        return None
    p = (named or able)[0]
    return Provider(p.name, p.keys, env.get("GRIDFRAME_REVIEW_MODEL") or p.model, env.get("GRIDFRAME_FAST_MODEL") or p.fast_model, p.reader)


def as_reviewer(reader: Reviewer | Callable[[dict], dict | None]) -> Reviewer:
    """A bare reader is asked without a clock or a ledger."""
    return reader if isinstance(reader, Reviewer) else Reviewer(Provider("reader", (), "", "", reader))


def shape(budget_ms: float | None) -> dict:
    """How much to ask for: with little time a short answer of the fast model, without thinking."""
    rushed = budget_ms is not None and budget_ms < HASTE_MS
    return {"rushed": rushed, "max_tokens": SHORT_ANSWER if rushed else LONG_ANSWER, "thinking": not rushed}


def price(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Dollars of each use (4 places) by the rates of the model that was used, per million tokens."""
    dollars = F.col("tokens_in") / 1e6 * F.col("rate_in") + F.col("tokens_out") / 1e6 * F.col("rate_out")
    return usage.join(rates, "model", "left").select(*usage.columns, (F.floor(dollars * 10000 + 0.5) / 10000).alias("dollars"))


def serialise(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Pages as text: of each line its y and its words with their x."""
    words = F.array_join(F.transform("words", lambda w: F.concat(F.floor(w["x"] + 0.5).cast("string"), F.lit(":"), w["text"])), " ")
    one = lines.select(*keys, "line_ix", F.concat(F.lit("y="), F.floor(F.col("y") + 0.5).cast("string"), F.lit(" "), words).alias("line"))
    return one.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_ix", "line"))), lambda l: l["line"]), "\n").alias("text"))


def vocabulary(lines: DataFrame) -> DataFrame:
    """All words and whole lines of each document, once."""
    words = lines.select("doc_id", F.explode("tokens").alias("term"))
    return words.unionByName(lines.select("doc_id", T.clean(F.col("text")).alias("term"))).where("term != ''").distinct()


def vocabulary_arrays(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The words and whole lines of each document (or ``keys``) as one array: one shuffle on the document."""
    each = F.concat("tokens", F.array(T.clean(F.col("text"))))
    return lines.groupBy(*(keys or ["doc_id"])).agg(F.array_distinct(F.flatten(F.collect_list(each))).alias("terms"))


def grounded(cells: DataFrame, terms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells with ``kept``: the value, or every piece of it between white space, is printed in the document.

    ``terms`` has a row for each term (``term``) or one array for each document, or other ``keys`` (``terms``).  What a
    document's cells say and what it prints meet in one row, where the terms that aren't printed are found once for all
    its cells.
    """
    keys = keys or ["doc_id"]
    if "terms" not in terms.columns:
        terms = terms.groupBy(*keys).agg(F.collect_set("term").alias("terms"))
    value = F.coalesce(F.col("value").cast("string"), F.lit(""))
    pieces = F.filter(F.split(T.clean(value), " "), lambda p: p != "")
    asked = cells.select(*keys, F.struct("cell_ix", "value", T.clean(value).alias("whole"), pieces.alias("pieces")).alias("c")).groupBy(*keys).agg(F.collect_list("c").alias("cs"))
    met = asked.join(terms, keys, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    said = F.array_distinct(F.concat(F.flatten(F.transform("cs", lambda c: c["pieces"])), F.transform("cs", lambda c: c["whole"])))
    met = met.select(*keys, "cs", F.array_except(said, F.col("terms")).alias("missing"))
    judged = F.transform("cs", lambda c: F.struct(c["cell_ix"].alias("cell_ix"), c["value"].alias("value"), (~F.array_contains("missing", c["whole"]) | ~F.arrays_overlap(c["pieces"], F.col("missing"))).alias("kept")))
    return met.select(*keys, F.explode(judged).alias("c")).select(*keys, "c.cell_ix", "c.value", "c.kept")


def rejects(checked: DataFrame, n: int = 6) -> DataFrame:
    """How many cells of each document were rejected, and the first ``n`` of them (a report)."""
    bad = F.sort_array(F.collect_list(F.when(~F.col("kept"), F.struct("cell_ix", "value"))))
    return checked.groupBy("doc_id").agg(F.count_if(~F.col("kept")).alias("rejected"), F.array_join(F.transform(F.slice(bad, 1, n), lambda b: b["value"]), "|").alias("first"))


def unescape(s: Column) -> Column:
    """Literal \\uXXXX sequences to their characters."""
    parts = F.regexp_extract_all(s, F.lit(r"\\u[0-9a-fA-F]{4}"), F.lit(0))
    between = F.split(s, r"\\u[0-9a-fA-F]{4}", -1)
    chars = F.transform(parts, lambda p: F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE"))
    return F.array_join(F.flatten(F.zip_with(between, chars, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


#: In the text of an answer, a backslash and the u that it was meant for, both written out as signs.
TWICE_ESCAPED = r"(?<!\\)((?:\\\\)*)\\\\u([0-9a-fA-F]{4})"


def variant(answer: Column) -> Column:
    """An answer's text as a variant, with literal \\uXXXX in strings of any depth as the signs that they name; null
    if it isn't JSON.  Written as text, such a string has its backslash escaped, and taking that escape back is enough.
    """
    return F.try_parse_json(F.regexp_replace(answer, TWICE_ESCAPED, r"$1\\u$2"))


def told(node: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path of a variant, or null where there is nothing of that kind."""
    return F.try_variant_get(node, path, kind)


def listed(node: Column, path: str) -> Column:
    """The list at a path of a variant; an empty one where there is none."""
    return F.coalesce(told(node, path, "array<variant>"), F.array().cast("array<variant>"))


def parse_answers(answers: DataFrame) -> DataFrame:
    """One row for each table of each answer, in order: ``table_ix`` and ``table``, a variant.  An answer without a
    list of tables is a table itself; what isn't an object is left out, and so is what isn't JSON.
    """
    whole = answers.withColumn("whole", variant(F.col("answer"))).where("whole is not null")
    every = F.when(told(F.col("whole"), "$.tables", "array<variant>").isNotNull(), listed(F.col("whole"), "$.tables")).otherwise(F.array("whole"))
    one = whole.select(*[c for c in answers.columns], F.posexplode(every).alias("table_ix", "table"))
    return one.where(F.schema_of_variant("table").startswith("OBJECT"))


class Ledger:
    """Answers by key in a folder that all tasks share, each written once: the first that is there stays.

    A local folder takes it by a link, which fails where there is a file.  Elsewhere a file is moved to its place when
    there is none: of two tasks that ask at the same moment, both may, and later ones read one answer.
    """

    def __init__(self, uri: str):
        from pyarrow import fs

        self.files, self.base = fs.FileSystem.from_uri(uri)
        self.local = isinstance(self.files, fs.LocalFileSystem)

    def place(self, key: str) -> str:
        return f"{self.base}/{key[:2]}/{key}.json"

    def get(self, key: str) -> dict | None:
        try:
            with self.files.open_input_stream(self.place(key)) as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def put(self, key: str, entry: dict) -> dict:
        """Writes ``entry`` unless there is one; what is there then."""
        place = self.place(key)
        own = f"{place}.{uuid.uuid4().hex}"
        self.files.create_dir(place.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(own) as file:
            file.write(json.dumps(entry).encode())
        if self.local:
            try:
                os.link(own, place)
            except FileExistsError:
                pass
            self.files.delete_file(own)
        elif self.get(key) is None:
            self.files.move(own, place)
        else:
            self.files.delete_file(own)
        return self.get(key) or entry


def within(seconds: float | None, work: Callable[[], dict]) -> dict | None:
    """What ``work`` returns, or None if it hasn't by then; it is left to itself and its result is not used."""
    got: list[dict] = []
    thread = threading.Thread(target=lambda: got.append(work()), daemon=True)
    thread.start()
    thread.join(seconds)
    return got[0] if got else None


def asked_once(asked: dict, reviewer: Reviewer, stop: threading.Event) -> dict:
    """One table's reading: up to so many attempts with a pause between them.  Whatever a reader raises means that
    there is no answer; what it was is told.
    """
    why = ""
    for attempt in range(1, reviewer.attempts + 1):
        try:
            answer = reviewer.provider.reader(asked)
        except Exception as error:
            answer, why = None, f"{type(error).__name__}: {error}"[:200]
        if answer is not None:
            return {"answer": answer, "model": asked["model"], "attempts": attempt}
        if attempt < reviewer.attempts and stop.wait(reviewer.pause):
            break
    return {"answer": None, "attempts": attempt, "detail": why}


def review_one(row: dict, reviewer: Reviewer, ledger: Ledger | None) -> dict:
    """The outcome of one request: ``answered``, ``no-answer``, ``skipped-no-time`` or ``abandoned-on-the-clock``."""
    own, left = reviewer.provider, None if reviewer.deadline is None else reviewer.deadline - time.time()
    how = shape(None if left is None else 1000 * left)
    model = own.fast_model if how["rushed"] else own.model
    base = {"doc_id": row["doc_id"], "cand": row["cand"], "model": model, "attempts": 0, "from_ledger": False}
    key = lambda m: hashlib.sha256(json.dumps([own.name, m, row["text"], row["context"]]).encode()).hexdigest()
    entry = next((e for m in dict.fromkeys((own.model, model)) if ledger and (e := ledger.get(key(m)))), None)
    if entry is None:
        if left is not None and left < LEAST_S:
            return {**base, "outcome": "skipped-no-time", "detail": f"{round(left)} s left of the budget"}
        asked = {"doc_id": row["doc_id"], "cand": row["cand"], "text": row["text"], "context": row["context"], "model": model, "max_tokens": how["max_tokens"], "thinking": how["thinking"]}
        stop = threading.Event()
        got = within(None if left is None else max(WAIT_S, left - KEPT_S), lambda: asked_once(asked, reviewer, stop))
        if got is None:
            stop.set()
            return {**base, "outcome": "abandoned-on-the-clock", "detail": ""}
        if got["answer"] is None:
            return {**base, "attempts": got["attempts"], "outcome": "no-answer", "detail": got["detail"]}
        entry = ledger.put(key(model), got) if ledger else got
        base["attempts"] = got["attempts"]
    else:
        base["from_ledger"] = True
    usage = (entry["answer"].get("usage") if isinstance(entry["answer"], dict) else None) or {}
    return {**base, "model": entry["model"], "answer": json.dumps(entry["answer"]), "outcome": "answered", "detail": "", "tokens_in": int(usage.get("input") or 0), "tokens_out": int(usage.get("output") or 0)}


ANSWERS = "doc_id string, cand int, answer string, outcome string, detail string, model string, attempts int, from_ledger boolean, tokens_in long, tokens_out long"


def read_again(pages: DataFrame, reader: Reviewer | Callable[[dict], dict | None] | None = None) -> DataFrame:
    """An outcome for each table to review (doc_id, cand, text, and context if there is one).  Without a reader nothing
    is asked.  A task asks for several tables at a time, each against the clock; what was answered before, for the same
    text by the same model, is read from the ledger, so a task that is run again asks nobody twice.
    """
    names = [c.split()[0] for c in ANSWERS.split(", ")]
    if reader is None:
        kinds = dict(c.split() for c in ANSWERS.split(", "))
        return pages.select("doc_id", "cand", *[(F.lit("not-asked") if c == "outcome" else F.lit(None).cast(kinds[c])).alias(c) for c in names[2:]])
    reviewer = as_reviewer(reader)

    arrow = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}
    schema = pa.schema([(n, arrow[k]) for n, k in (c.split() for c in ANSWERS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger = Ledger(reviewer.ledger) if reviewer.ledger else None
        with ThreadPoolExecutor(reviewer.concurrency) as pool:
            for batch in batches:
                out = pool.map(lambda row: review_one(row, reviewer, ledger), batch.to_pylist())
                yield pa.RecordBatch.from_pylist(list(out), schema=schema)

    context = F.coalesce(F.col("context"), F.lit("")) if "context" in pages.columns else F.lit("")
    return pages.select("doc_id", "cand", "text", context.alias("context")).mapInArrow(run, ANSWERS)
