"""Token counts: how many tokens each whole text has, without keeping an id.

Texts come in Arrow batches that end at a number of bytes, long ones are cut at safe boundaries, and what was cut is
encoded in batches of about ``BATCH_BYTES`` each, of which only the lengths are kept.  A piece that was counted before
is remembered, in two bounded generations, so a frequent word is encoded once a task.

A boundary is safe where the tokenizer surely begins a new piece.  With a byte-level splitter and no normaliser that is
so before white space that follows something else: what a piece holds ends before white space, and the only look ahead,
at the end of white space, never crosses such a place.  It is also so between an ASCII letter and a digit.  Special
strings hold neither white space nor digits, or the file isn't taken for one that can be cut.  Texts for other
tokenizer files, and sentencepiece models, are encoded whole, in batches of the same size.

Inputs: null texts count as empty (0 bytes, 0 tokens); rows that share an id are separate rows; null ids stay; very long
texts are cut as above; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from gridframe.llm import common

#: Bytes of text that go to the library at once, and those above which a piece is cut between letters and digits.
BATCH_BYTES = 1 << 20
LONG = 1 << 16

#: Pieces whose length is remembered: at most so many in each of two generations, none of more than 64 characters.
REMEMBERED = 250_000

#: What Unicode calls white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
LETTER_DIGIT = re.compile("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def cuts_safely(told: dict) -> bool:
    """Whether a tokenizer file's texts can be cut: byte-level with its own splitter, as the text is, no extras."""
    splitter = told.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
    extras = [t for t in told.get("added_tokens", []) if re.search(f"[{SPACE}0-9]", t["content"]) or any(t[k] for k in ("single_word", "lstrip", "rstrip"))]
    others = any(told.get(k) for k in ("normalizer", "truncation", "padding"))
    return bool(plain and not extras and not others and told["model"]["type"] == "BPE" and not told["model"].get("dropout"))


def cut(text: str) -> list[str]:
    """The pieces of a text at its safe boundaries."""
    pieces = PIECE.findall(text)
    if len(text) > LONG and max(map(len, pieces)) > LONG:
        pieces = [x for piece in pieces for x in (shortened(piece) if len(piece) > LONG else [piece])]
    return pieces


def shortened(piece: str) -> Iterator[str]:
    """A long piece in parts of at least ``LONG`` characters, as far as it has letters beside digits."""
    begin = 0
    for at in (m.start() for m in LETTER_DIGIT.finditer(piece)):
        if at - begin >= LONG:
            yield piece[begin:at]
            begin = at
    yield piece[begin:]


def batches_of(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """``texts`` in their order, in batches of about ``most`` bytes, or one text."""
    batch, held = [], 0
    for text in texts:
        size = len(text) if text.isascii() else len(text.encode())
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += size
    if batch:
        yield batch


class Counter:
    """Token counts of whole texts by a tokenizer file (.json) or a sentencepiece model (.model)."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        self.limit, self.young, self.old = limit, {}, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode: Callable = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
            self.safe = False
        else:
            # A task has one core; the library's own threads would take the others'.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: list(map(len, tokenizer.encode_batch(texts, add_special_tokens=False)))
            with open(path, encoding="utf-8") as file:
                self.safe = cuts_safely(json.load(file))

    def lengths(self, texts: list[str]) -> list[int]:
        return [n for batch in batches_of(texts) for n in self.encode(batch)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.lengths(texts)
        pieces, known = [cut(text) for text in texts], self.young
        new = set(chain.from_iterable(pieces)).difference(known)
        again = [piece for piece in new if piece in self.old]
        fresh = [piece for piece in new if piece not in self.old]
        known.update((piece, self.old[piece]) for piece in again)
        known.update(zip(fresh, self.lengths(fresh), strict=True))
        out = [sum(map(known.__getitem__, own)) for own in pieces]
        for piece in fresh:
            if len(piece) > 64:
                del known[piece]
        if len(known) >= self.limit:
            self.young, self.old = {}, known
        return out


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """Kept for the tasks that a Python worker runs in turn."""
    return Counter(path)


def count(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """One row per document: the bytes and tokens of its whole text, and whether these are over ``limit``."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            n = [x for group in batches_of(column.to_pylist(), 2 * BATCH_BYTES) for x in tokens.counts(group)]
            sizes = [len(t) for t in column.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return common.id_and_text(docs).mapInArrow(run, SCHEMA)
