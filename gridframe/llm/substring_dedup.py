"""Substring dedup by de Bruijn compaction of token k-mers.

The edges of the graph are all windows of ``size`` consecutive words.  Consecutive edges that share a minimiser (the
least-hashed short word sequence inside the window, the same wherever the window stands) make one path, so a text is
a chain of such paths and a window belongs to exactly one.  Compaction then runs on paths, not on windows:

1. minimisers are counted; a window can only repeat where its minimiser does, the rest leaves;
2. equal paths (same minimiser, same words) are joined: a path found twice or more is one non-branching path of the
   graph and all its windows repeat;
3. a minimiser with two or more different paths is a branch; only there single windows are compared, one
   representative of each different path against the others;
4. verified spans go back to their source coordinates and the covered words are removed.

Nothing is ever paired within a group: all steps count by key with partial sums, or join to one row per key, so a
passage that a third of the rows share costs as much as any other.

Equality is judged on 64-bit hashes of the words within groups that already agree on a second 64-bit hash (the
minimiser's), that is on 128 bits.  Texts travel compressed.

Inputs: null and empty texts have no words and keep nothing; texts of fewer words than a window are kept whole; rows
that repeat (same id, same text or not) are separate places, so their long windows repeat and go; null ids are kept
as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common

SIZE = 35
MINIMISER = 8

PATH_SCHEMA = "anchor long, path long, doc long, text_key long, place long"


class Paths:
    """The paths of one text: minimiser hash, path hash, first window and number of windows of each."""

    def __init__(self, size: int, k: int):
        self.size, self.k = size, min(k, size)
        self.words, self.sums, self.other = common.WordHashes(), common.SpanHashes(0), common.SpanHashes(1)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        if len(words) < self.size:
            return None
        hashes = self.words.of(words)
        prefix = self.sums.prefix(hashes)
        grams = self.sums.windows(prefix, self.k)
        wide = self.size - self.k + 1
        n = len(words) - self.size + 1
        at = np.empty(n, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(grams, wide)
        for i in range(0, n, 65536):
            at[i : i + 65536] = np.argmin(view[i : i + 65536], axis=1)
        at += np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.concatenate([first, [n]]))
        prefix2 = self.other.prefix(common.mixed(hashes))
        path = self.other.spans(prefix2, first, first + count - 1 + self.size)
        return grams[at[first]].view(np.int64), path.view(np.int64), first, count, prefix2


def pack(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window and number of windows (at most the window's size) in one number."""
    return (first << 16) | count


def compressed(docs: DataFrame) -> DataFrame:
    """doc, text_key, packed text of each row; rows of equal id and text share their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [press.compress(t) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc", "text_key", "packed"])

    return keyed(docs).mapInArrow(run, "doc long, text_key long, packed binary")


def keyed(docs: DataFrame) -> DataFrame:
    rows = common.id_and_text(docs)
    return rows.select(F.col("doc_id").alias("doc"), "text", F.xxhash64("text").alias("text_key"))


def paths(docs: DataFrame, size: int, k: int) -> DataFrame:
    """All paths of all texts with their coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Paths(size, k)
        for batch in batches:
            anchors, spans, rows, places = [], [], [], []
            for i, text in enumerate(common.texts(batch)):
                if (found := make.of(text.split())) is not None:
                    anchors.append(found[0])
                    spans.append(found[1])
                    rows.append(np.full(len(found[0]), i))
                    places.append(pack(found[2], found[3]))
            if anchors:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(anchors)), pa.array(np.concatenate(spans)), batch.column(0).take(take), batch.column(2).take(take), pa.array(np.concatenate(places))],
                    names=["anchor", "path", "doc", "text_key", "place"],
                )

    return keyed(docs).mapInArrow(run, PATH_SCHEMA)


def minimiser_counts(docs: DataFrame, size: int, k: int) -> DataFrame:
    """Minimisers that stand in two places or more.  Each batch is summed before it leaves Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Paths(size, k)
        for batch in batches:
            found = [x[0] for t in common.texts(batch) if (x := make.of(t.split())) is not None]
            if found:
                anchors, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(n.astype(np.int32))], names=["anchor", "n"])

    return keyed(docs).mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def branch_windows(work: DataFrame, size: int, k: int) -> DataFrame:
    """The windows of the asked paths: ``work`` has a packed text and ``asked``, its paths' places and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, make = zstandard.ZstdDecompressor(), Paths(size, k)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, (packed, asked) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                found = make.of(press.decompress(packed).split())
                weight = {x["place"]: x["weight"] for x in asked}
                wanted = np.isin(pack(found[2], found[3]), np.fromiter(weight, np.int64, len(weight)))
                first, count = found[2][wanted], found[3][wanted]
                starts = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                out[0].append(np.repeat(found[0][wanted], count))
                out[1].append(make.other.spans(found[4], starts, starts + size).view(np.int64))
                out[2].append(np.repeat(np.array([weight[p] for p in pack(first, count).tolist()], np.int32), count))
                out[3].append(np.full(len(starts), i))
                out[4].append(starts.astype(np.int32))
            if out[0]:
                joined = [np.concatenate(x) for x in out]
                take = pa.array(joined[3])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(joined[0]), pa.array(joined[1]), pa.array(joined[2]), batch.column(0).take(take), batch.column(1).take(take), pa.array(joined[4])],
                    names=["anchor", "window", "weight", "doc", "text_key", "start"],
                )

    return work.select("doc", "text_key", "packed", "asked").mapInArrow(run, "anchor long, window long, weight int, doc long, text_key long, start int")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc"].eqNullSafe(b["doc"]) & (a["text_key"] == b["text_key"])


def repeated_spans(docs: DataFrame, texts: DataFrame, size: int, k: int) -> DataFrame:
    """doc, text_key and the word spans [start, stop) of repeated windows, overlapping where windows do."""
    # Written on its own, so that the join's sides are plain exchanges and a frequent minimiser's can be split.
    repeated = common.written(minimiser_counts(docs, size, k), "minimisers")
    found = common.written(paths(docs, size, k).join(repeated, "anchor", "left_semi"), "paths")
    kinds = found.groupBy("anchor", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "text_key", "place")).alias("first")
    )
    kinds = common.written(kinds, "path-kinds")
    branches = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    whole = found.join(kinds.where("n > 1").select("anchor", "path"), ["anchor", "path"], "left_semi").select(
        "doc", "text_key", F.shiftright("place", 16).cast("int").alias("start"), (F.shiftright("place", 16) + F.col("place").bitwiseAND(0xFFFF) - 1 + size).cast("int").alias("stop")
    )
    asked = (
        kinds.join(branches, "anchor", "left_semi")
        .select("first.doc", "first.text_key", F.struct(F.col("first.place").alias("place"), F.least(F.col("n"), F.lit(2)).cast("int").alias("weight")).alias("asked"))
        .groupBy("doc", "text_key")
        .agg(F.collect_set("asked").alias("asked"))
    )
    # A row that repeats has paths of weight 2 alone, and those may well be counted for each of its rows.
    work = texts.join(asked, same_row(texts, asked)).select(texts["doc"], texts["text_key"], "packed", "asked")
    windows = common.written(branch_windows(work, size, k), "windows")
    again = windows.groupBy("anchor", "window").agg(F.sum("weight").alias("places")).where("places > 1").select("anchor", "window")
    single = windows.where("weight = 1").join(again, ["anchor", "window"], "left_semi").select("doc", "text_key", "start", (F.col("start") + size).alias("stop"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, size: int = SIZE, k: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (kept words joined by one space) of each row."""
    return _finished(docs, size, k, digest=False)


def digests(docs: DataFrame, size: int = SIZE, k: int = MINIMISER) -> DataFrame:
    """As remove_repeats, with the SHA-256 of the kept text in its place."""
    return _finished(docs, size, k, digest=True)


def _finished(docs: DataFrame, size: int, k: int, digest: bool) -> DataFrame:
    common.tune(docs.sparkSession)
    last = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            total, removed, kept = [], [], []
            for packed, starts, stops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = press.decompress(packed).split()
                gone = 0
                if starts:
                    a = np.array(starts, np.int64)
                    hit = common.covered(len(words), a, np.array(stops, np.int64) - a)
                    gone = int(hit.sum())
                    kept_words = [words[i] for i in np.flatnonzero(~hit).tolist()]
                else:
                    kept_words = words
                text = b" ".join(kept_words)
                total.append(len(words))
                removed.append(gone)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", last],
            )

    texts = compressed(docs)
    spans = repeated_spans(docs, texts, size, k).groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = texts.join(spans, same_row(texts, spans), "left").select(texts["doc"], "packed", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")
