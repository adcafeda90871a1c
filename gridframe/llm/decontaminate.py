"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z were lower-cased.  The automaton recognises all word
sequences inside any item.  A document's words stream through it and, at each word, the length of the longest match
that ends there is known; where it reaches the window length, that window of an item occurs in the document.  Items
shorter than a window count as a whole and are recognised by the automaton's suffix links.

The items are read in blocks of at most ``block_words`` words.  Within a block, automata of at most PART_WORDS words
are built one after the other and laid down as sorted arrays, which take 56 MB for 1,000,000 words of which 50,000
differ (measured; building them took 210 MB at most); a block is what is sent to the executors, so its bound is also that of a worker's memory.  The
documents pass all blocks in turn, and nothing is judged or cut before the last.

Inputs: null and empty texts have no words; very long texts are streamed whole; items without words never occur; items
that repeat, and items that tie, are all reported; null item ids are left out of the reports but their windows hit;
rows that share a doc_id, or are equal, are separate rows; an empty table gives no rows, an empty benchmark no hits;
other columns are ignored by ``report`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common

#: Words of a block, and of one automaton of it.
BLOCK_WORDS, PART_WORDS = 2_000_000, 100_000

WINDOW = 10


def words_of(text: bytes) -> list[bytes]:
    return text.translate(common.PLAIN_WORDS).split()


class Builder:
    """A suffix automaton of several word sequences while it grows; each state knows the longest sequence that leads
    to it and its suffix link."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, seq: array) -> None:
        last = 0
        for x in seq:
            last = self._extend(last, x)

    def _extend(self, last: int, x: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if x in nxt[last]:
            q = nxt[last][x]
            return q if length[q] == length[last] + 1 else self._clone(last, x, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][x]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
        return new

    def _clone(self, p: int, x: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, nxt: dict[int, int], link: int = 0) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1


class Automaton:
    """A finished automaton in sorted arrays: transitions by state and word, and the items of marked states."""

    def __init__(self, sequences: list[tuple[int, array]], window: int):
        built = Builder()
        for _, seq in sequences:
            built.add(seq)
        n = sum(map(len, built.next))
        keys = np.fromiter((state << 32 | x for state, to in enumerate(built.next) for x in to), np.int64, n)
        targets = np.fromiter((t for to in built.next for t in to.values()), np.int32, n)
        order = np.argsort(keys)
        self.window = window
        self.keys, self.targets = array("q", keys[order].tobytes()), array("i", targets[order].tobytes())
        self.link, self.length = array("i", built.link), array("i", built.length)
        del built, keys, targets, order
        windows, shorts = set(), set()
        for item, seq in sequences:
            if 0 < len(seq) < window:
                state = 0
                for x in seq:
                    state = self.target(state, x)
                shorts.add((state, item))
            windows.update((state, item) for state in self._window_states(seq))
        self.windows, self.shorts = (tuple(array("i", (pair[i] for pair in sorted(pairs))) for i in range(2)) for pairs in (windows, shorts))
        #: For each state, the nearest state along the suffix links (itself first) that is a whole short item.
        short = set(self.shorts[0])
        self.short_at = array("i", [-1]) * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__) if short else ():
            self.short_at[state] = state if state in short else self.short_at[self.link[state]]

    def target(self, state: int, x: int) -> int:
        """The state after one more word, -1 if there is none."""
        key = state << 32 | x
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def step(self, state: int, matched: int, x: int) -> tuple[int, int]:
        """The state and matched length after one more word."""
        to = self.target(state, x)
        while state and to < 0:
            state = self.link[state]
            matched = self.length[state]
            to = self.target(state, x)
        return (0, 0) if to < 0 else (to, matched + 1)

    def cut(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match that is at least as long."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _window_states(self, seq: array) -> Iterator[int]:
        state = matched = 0
        for x in seq:
            state, matched = self.step(state, matched, x)
            if matched >= self.window:
                yield self.cut(state, self.window)

    @staticmethod
    def items_at(marks: tuple[array, array], state: int) -> Iterator[int]:
        at = bisect_left(marks[0], state)
        while at < len(marks[0]) and marks[0][at] == state:
            yield marks[1][at]
            at += 1

    def stream(self, words: list[int], begin: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Adds the spans of windows and short items that occur among the words from ``begin``, and their items."""
        state = matched = 0
        for i, x in enumerate(words, begin):
            state, matched = self.step(state, matched, x)
            if matched >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                found.update(self.items_at(self.windows, self.cut(state, self.window)))
            at = self.short_at[state]
            while at > 0:
                if self.length[at] <= matched:
                    spans.append((i + 1 - self.length[at], i + 1))
                    found.update(self.items_at(self.shorts, at))
                at = self.short_at[self.link[at]]


class Block:
    """The automata of a block of items, the words' numbers and which pairs of words stand together in any item."""

    def __init__(self, window: int):
        self.window, self.words = window, 0
        self.ids: dict[bytes, int] = {}
        self.names: list[str | None] = []
        self.sequences: list[array] = []

    def add(self, name: str | None, words: list[bytes]) -> None:
        self.names.append(name)
        self.sequences.append(array("i", (self.ids.setdefault(w, len(self.ids)) for w in words)))
        self.words += len(words)

    def finished(self, part_words: int | None = None) -> "Block":
        """Builds the automata, each of at most ``part_words`` words (or one item)."""
        self.parts: list[Automaton] = []
        part, size = [], 0
        for numbered in enumerate(self.sequences):
            if part and size + len(numbered[1]) > (part_words or PART_WORDS):
                self.parts.append(Automaton(part, self.window))
                part, size = [], 0
            part.append(numbered)
            size += len(numbered[1])
        self.parts += [Automaton(part, self.window)] if size else []
        self.least = min([self.window, *(len(s) for s in self.sequences if len(s))])
        pairs = [np.frombuffer(s, np.int32).astype(np.int64) for s in self.sequences if len(s) > 1]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[s[:-1] << 32 | s[1:] for s in pairs]]))
        self.sequences = []
        return self

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans [start, end) of windows and short items that occur, and the names of the items that they are of.

        Words that aren't in any item, and pairs that stand together in none, end a match, so only runs that are
        long enough for the shortest window are streamed.
        """
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if self.parts and len(words) >= self.least:
            get = self.ids.get
            codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            for begin, end in self._runs(codes):
                run = codes[begin:end].tolist()
                for part in self.parts:
                    part.stream(run, begin, spans, found)
        return sorted(spans), {self.names[i] for i in found}

    def _runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        known = codes >= 0
        joined = known[1:] & known[:-1]
        if self.least > 1:
            pair = codes[:-1] << 32 | np.maximum(codes[1:], 0)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined &= self.pairs[at] == pair
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        if self.least < 2:
            alone = known.copy()
            for a, b in edge.reshape(-1, 2).tolist():
                alone[a : b + 1] = False
            yield from ((int(i), int(i) + 1) for i in np.flatnonzero(alone))
        for a, b in edge.reshape(-1, 2).tolist():
            if b + 1 - a >= self.least:
                yield a, b + 1


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The items in blocks of at most ``block_words`` words (or one item), read one after the other."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block = Block(window)
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        words = words_of(row["text"].encode())
        if block.names and block.words + len(words) > block_words:
            yield block.finished()
            block = Block(window)
        block.add(row["item_id"], words)
    yield block.finished()


def scan(docs: DataFrame, block: Block) -> DataFrame:
    """Adds the block's spans and item ids to the columns ``spans`` and ``items`` of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = [], []
            old_spans, old_items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for text, before, named in zip(common.texts(batch), old_spans, old_items, strict=True):
                own, found = shared.value.matches(words_of(text))
                flat = list(before)
                for a, b in own:
                    if len(flat) > 1 and a <= flat[-1] and a >= flat[-2]:
                        flat[-1] = max(flat[-1], b)
                    else:
                        flat += [a, b]
                spans.append(flat)
                items.append(named + sorted(found - {None}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text", "spans", "items"],
            )

    return docs.mapInArrow(run, "doc_id long, text string, spans array<int>, items array<string>")


def mask(n: int, spans: list[int]) -> np.ndarray:
    edges = np.array(spans, np.int64).reshape(-1, 2)
    return common.covered(n, edges[:, 0], edges[:, 1] - edges[:, 0]) if len(edges) else np.zeros(n, bool)


def with_last(items: Iterator) -> Iterator[tuple[object, bool]]:
    """Each item, and whether it is the last."""
    held = next(items)
    for item in items:
        yield held, False
        held = item
    yield held, True


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, words hit, items with occurring windows, and whether any word is hit."""
    spark = docs.sparkSession
    common.tune(spark)
    out = common.id_and_text(docs).withColumns({"spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for block, last in with_last(blocks(benchmark, window, block_words)):
        if not last:
            out = common.written(scan(out, block), "spans")
            continue
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            nothing = hashlib.sha256(b"").hexdigest()
            for batch in batches:
                rows = []
                for text, before, named in zip(common.texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    words = words_of(text)
                    own, found = shared.value.matches(words)
                    if not own and not before:
                        rows.append((len(words), 0, 0, nothing, False))
                        continue
                    spans = before + [x for span in own for x in span]
                    ids = sorted({*named, *found} - {None})
                    hit = int(mask(len(words), spans).sum())
                    rows.append((len(words), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

        out = out.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without benchmark passages: spans of occurring windows are cut out of the texts, and a document goes
    when more than ``coverage`` of its words are hit, by the items of all blocks together.  Texts without a hit stay as they are, byte for byte; in the
    others the words around a cut stay as they were, with what separates them.  All columns stay.
    """
    common.tune(docs.sparkSession)
    spark = docs.sparkSession
    held = "spans"
    while held in {c.lower() for c in docs.columns}:
        held += "_"
    out = docs.withColumn(held, F.array().cast("array<int>"))
    for block, last in with_last(blocks(benchmark, window, block_words)):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, to = batch.schema.get_field_index("text"), batch.schema.get_field_index(held)
                originals = batch.column(at).cast(pa.binary()).to_pylist()
                # Spans are of the original words in all blocks; only the last block cuts.
                spans = [before + [x for span in shared.value.matches(words_of(text or b""))[0] for x in span] for text, before in zip(originals, batch.column(to).to_pylist(), strict=True)]
                if not last:
                    yield batch.set_column(to, batch.schema.field(to), pa.array(spans, batch.schema.field(to).type))
                    continue
                texts = [cut_out(text, list(zip(found[::2], found[1::2], strict=True)), coverage) if found else text for text, found in zip(originals, spans, strict=True)]
                stay = [kept is not None or text is None for text, kept in zip(originals, texts, strict=True)]
                new = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), new).remove_column(to).filter(pa.array(stay, pa.bool_()))

        out = out.mapInArrow(run, docs.schema) if last else common.written(out.mapInArrow(run, out.schema), "spans")
    return out


def cut_out(text: bytes, spans: list[tuple[int, int]], coverage: float) -> bytes | None:
    """The text without the spans' words; None if more than ``coverage`` of its words are hit."""
    plain = text.translate(common.PLAIN_WORDS)
    inside = np.frombuffer(plain, np.uint8) != 0x20
    begins = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8)])) == 1)
    n = len(begins)
    hit = mask(n, [x for span in spans for x in span])
    if hit.sum() > coverage * n:
        return None
    out, at = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in edge.reshape(-1, 2).tolist():
        out.append(text[at : begins[a]])
        at = int(begins[b]) if b < n else len(text)
    return b"".join([*out, text[at:]])
