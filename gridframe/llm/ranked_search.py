"""Ranked lexical search: the best documents for each item of a query set, by sort-based accumulation.

Items go out in blocks of a bounded number of terms; each block is held against all documents.  A task takes whole
documents, so all that an (item, document) pair gets is in one place: it concatenates the (item, document, impact)
entries of the matched terms, sorts them by their packed key (radix, 16 bits at a time), adds up runs of one key
(``reduceat``) and keeps the best of each item in a heap.  What the tasks kept is dealt out by ranges of (item, score,
id), so that no task gets all that was kept for one item, and the best of each range go to the last ranking.

Scores are 64-bit integers: a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), and a document adds to an item, for
each time the item has the term, weight * (10^9 tf div (1000 tf + 8 m)), m = 100 - b + (b n N div L) with b = 75.

Inputs: null texts have no terms, like empty ones, and neither match nor count; items without terms give no rows; items
that share an id are ranked each on its own; rows of documents that share an id are ranked each on its own; equal scores
by ascending id, null ids last; very long texts are one document, whose entries are worked off in parts of ``ENTRIES``
and one document; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.llm import common

#: Distinct (item, term) pairs of a block (or one item): about 100 bytes each on the driver and in a task.
BLOCK_TERMS = 500_000
#: Entries that a task sorts at once, besides those of one document.
ENTRIES = 2_000_000

BEST, PRICE = 10, 75
MILLION, THOUSAND = 1_000_000_000, 1000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(common.PLAIN_WORDS).split()


class Block:
    """Some items' terms: the vocabulary, and for each term the items that have it and how often they do."""

    def __init__(self, items: list):
        """``items``: rows with item_id, terms and counts."""
        self.names = [row["item_id"] for row in items]
        self.ids: dict[bytes, int] = {}
        at = [(self.ids.setdefault(bytes(term), len(self.ids)), i, n) for i, row in enumerate(items) for term, n in zip(row["terms"], row["counts"], strict=True)]
        entries = np.array(at, np.int64).reshape(-1, 3)
        entries = entries[np.argsort(entries[:, 0], kind="stable")]
        self.begin = np.searchsorted(entries[:, 0], np.arange(len(self.ids) + 1))
        self.item, self.times = entries[:, 1].copy(), entries[:, 2].copy()
        self.weight = np.zeros(len(self.ids), np.int64)

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        for term, n in df.items():
            self.weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))

    def postings(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' terms of the vocabulary: number of the text, of the term, and how often it is there; ascending."""
        get, size = self.ids.get, max(1, len(self.ids))
        codes = [np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)) for words in texts]
        text = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        known = codes >= 0
        key, tf = np.unique(text[known] * size + codes[known], return_counts=True)
        return key // size, key % size, tf.astype(np.int64)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned keys, 16 bits at a time from the lowest; numpy sorts 16-bit numbers by radix."""
    order, top = np.arange(len(keys)), int(keys.max()) if len(keys) else 0
    for shift in range(0, max(1, top.bit_length()), 16):
        digit = (keys[order] >> np.uint64(shift)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def accumulated(block: Block, text: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each (item, text) that share a term: the item, the text and the sum of what the terms add."""
    many = block.begin[term + 1] - block.begin[term]
    at = np.repeat(block.begin[term] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    packed = (block.item[at].astype(np.uint64) << np.uint64(32)) | np.repeat(text, many).astype(np.uint64)
    order = radix_order(packed)
    packed, add = packed[order], (np.repeat(impact, many) * block.times[at])[order]
    if not len(packed):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    key = packed[first]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), np.add.reduceat(add, first)


def parts(begin: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Spans of postings that begin with a new text (where ``begin``) and hold at most ``most`` entries, or one text."""
    edges = [*np.flatnonzero(begin).tolist(), len(size)]
    upto = np.concatenate([[0], np.cumsum(size)])
    a = edges[0]
    for low, high in zip(edges, edges[1:], strict=False):
        if low > a and upto[high] - upto[a] > most:
            yield a, low
            a = low
    if a < len(size):
        yield a, len(size)


class Heaps:
    """The best documents of each item: more score first, then those with an id, then the smaller id."""

    def __init__(self, items: int, best: int):
        self.best, self.heaps, self.least = best, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: list) -> None:
        for i in np.flatnonzero(score >= self.least[item]).tolist():
            heap, doc = self.heaps[item[i]], ids[i]
            entry = (int(score[i]), doc is not None, -(doc or 0))
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.best:
                self.least[item[i]] = heap[0][0]


def item_terms(items: DataFrame) -> DataFrame:
    """Each item with its distinct terms and how often it has them; items without terms go."""
    rows = items.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["item_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array(terms_of(t), object), return_counts=True) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w.tolist() for w, _ in found], pa.list_(pa.binary())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int64()))],
                names=["item_id", "terms", "counts"],
            )

    schema = T.StructType([T.StructField("item_id", kind), *T._parse_datatype_string("terms array<binary>, counts array<long>").fields])
    return rows.mapInArrow(run, schema).where(F.size("terms") > 0)


def blocks(items: DataFrame, block_terms: int) -> Iterator[Block]:
    """The items by hash in blocks of about half of ``block_terms`` terms (or one item); one block is on the driver."""
    held = common.written(item_terms(items), "items")
    total = held.agg(F.sum(F.size("terms"))).first()[0] or 0
    many = -(-2 * total // block_terms) if total > block_terms else min(1, total)
    for i in range(many):
        rows = held.where(F.pmod(F.xxhash64("terms", "counts"), F.lit(many)) == i).collect()
        if rows:
            yield Block(sorted(rows, key=lambda r: (r["item_id"] is None, str(r["item_id"]))))


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, dict[int, int]]:
    """Documents with terms, all their terms, and in how many documents each term of the block is.  A task gives a row
    for each term of the vocabulary at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n_docs, n_terms = np.zeros(len(shared.value.ids), np.int64), 0, 0
        for batch in batches:
            words = [terms_of(text) for text in common.texts(batch)]
            n_docs += sum(map(bool, words))
            n_terms += sum(map(len, words))
            found += np.bincount(shared.value.postings(words)[1], minlength=len(found))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[n_docs, n_terms], found[some]]))], names=["term", "n"])

    sums = dict(map(tuple, docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    return sums.pop(-1, 0), sums.pop(-2, 0), sums


def best_of_tasks(docs: DataFrame, block: Block, number: int, kind: T.DataType, best: int, entries: int) -> DataFrame:
    """For each task and item of the block, the task's best documents with a score above 0."""
    documents, length, df = statistics(docs, block)
    block.weigh(documents, df)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("item", T.LongType()), T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        heaps, many = Heaps(len(block.names), best), np.diff(block.begin)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            words = [terms_of(text) for text in common.texts(batch)]
            n = np.fromiter(map(len, words), np.int64, len(words))
            m = 100 - PRICE + PRICE * n * documents // max(1, length)
            text, term, tf = block.postings(words)
            impact = block.weight[term] * (MILLION * tf // (THOUSAND * tf + 8 * m[text]))
            if not len(text):
                continue
            new = np.concatenate([[True], text[1:] != text[:-1]])
            for a, b in parts(new, many[term], entries):
                item, at, score = accumulated(block, text[a:b], term[a:b], impact[a:b])
                heaps.add(item, score, [ids[i] for i in at.tolist()])
        rows = [(number, i, block.names[i], -low if there else None, score) for i, heap in enumerate(heaps.heaps) for score, there, low in heap]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return docs.mapInArrow(run, schema)


def by_rank() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS, entries: int = ENTRIES) -> DataFrame:
    """For each item its ``best`` documents: item_id, rank (from 1), doc_id, score."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    common.tune(spark)
    texts, found = common.id_and_text(docs), []
    for number, block in enumerate(blocks(items, block_terms)):
        found.append(common.written(best_of_tasks(texts, block, number, kind, best, entries), "best"))
    if not found:
        schema = T.StructType([T.StructField("item_id", kind), *T._parse_datatype_string("rank int, doc_id long, score long").fields])
        return spark.createDataFrame([], schema)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    ranged = rows.repartitionByRange("block", "item", *by_rank())
    rank = F.row_number().over(Window.partitionBy("block", "item").orderBy(*by_rank()))
    return ranged.withColumn("rank", rank).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
