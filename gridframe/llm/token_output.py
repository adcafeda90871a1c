"""Token-ID output: whole texts as lists of token ids in Parquet, in ascending id order or in the order of the input.

File format: one Parquet folder.  ``tokens`` (list of int) is dictionary-encoded; ``doc_id``, ``start_in_part`` and
``n_tokens`` are plain columns without a dictionary, which the version-2 writer packs as deltas.  Row groups and
pages have set sizes, and where the rows of a file ascend by ``doc_id``, the page index lets a reader of a few
documents, or of the metadata alone, skip the rest.

Ids are those of the whole texts.  Of a tokenizer whose file states the normaliser and the splitter that ``PLAIN``
does, pieces of a text are encoded and remembered; of any other the library encodes each text as a whole.

Inputs: null texts count as empty (the end id only); very long texts are encoded piece by piece; rows that share an id are separate rows, ordered by the text's hash; null
ids come first; an empty table gives an empty folder with a schema; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridframe.llm import common

SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, tokens array<int>"

#: Writer settings: sizes of row groups and pages, version-2 pages, a dictionary for the ids alone.
WRITER = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "compression": "snappy",
}


def byte_signs() -> dict[int, int]:
    """The signs that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: 256 + i for i, b in enumerate(rest)}


BYTE_SIGNS = byte_signs()


class Remembered(dict):
    """What ``make`` gave for short keys, in two generations: when the young one has ``limit`` entries it becomes the
    old one, and what is asked for again returns, so memory is bounded and frequent keys stay.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def make(self, key: bytes) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: The normaliser and splitter of a tokenizer file by which a text's ids are those of its pieces in turn.
PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def splits_plainly(path: str) -> bool:
    """Whether a tokenizer file is one whose pieces can be encoded on their own: its special tokens begin with <|."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = all(t["content"].startswith("<|") and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in told["added_tokens"])
    return special and all(told[k] == v for k, v in PLAIN.items()) and told["model"]["type"] == "BPE" and told["model"]["dropout"] is None


class ChunkIds(Remembered):
    """Bytes between white space, and the pieces of such, to the little-endian bytes of their ids.

    The tokenizer drops white space, makes letters small and starts a new piece wherever letters end or begin, but
    for apostrophes and special tokens.  So the ids of a text are those of its chunks in turn, and those of a chunk
    the ids of its runs of letters and of other signs; chunks where that isn't plain (apostrophes, signs that turn
    into other kinds of signs when made small) go to the library whole.
    """

    RUNS = re.compile(rb"[a-zA-Z\x80-\xff]+|[^a-zA-Z\x80-\xff]+")

    def __init__(self, path: str, limit: int = 250_000):
        super().__init__(limit)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.plain = self.tokenizer.model, splits_plainly(path)

    def make(self, key: bytes) -> bytes:
        if not key.isalpha() and b"'" not in key and b"<|" not in key:
            runs = self.RUNS.findall(key)
            if len(runs) > 1 and (key.isascii() or all(x.isascii() or x.decode().lower().isalpha() for x in runs)):
                return b"".join(map(self.__getitem__, runs))
        return self.piece(key)

    def piece(self, key: bytes) -> bytes:
        text = key.decode().lower()
        if text.isalpha() and (text.isascii() or max(text) < "\u0250"):
            # One piece: normalising and splitting would leave it as it is, so the library's model is asked at once.
            signs = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_SIGNS)
            ids = array("I", [t.id for t in self.model.tokenize(signs)])
            if sys.byteorder == "big":
                ids.byteswap()
            return ids.tobytes()
        return np.asarray(self.tokenizer.encode(key.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        if not self.plain:
            return np.asarray(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        # A special token is one only as it is written.
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


@functools.lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    """Kept for the tasks that a Python worker runs in turn."""
    return ChunkIds(path)


def encoder(tokenizer_path: str, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()
    arrow = pa.schema(
        [("part", pa.int32()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, at = chunk_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = [ids.of(text) + end for text in common.texts(batch)]
            n = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
            upto = np.concatenate([[0], np.cumsum(n)])
            tokens = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part, np.int32)), batch.column(batch.schema.get_field_index("doc_id")), pa.array(at + upto[:-1]), pa.array(n), tokens],
                schema=arrow,
            )
            at += int(upto[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, order: list[str] | None = None) -> None:
    """Encodes all texts and writes them under ``path``, by ``order`` (columns of ``docs``; by default the id and the
    text's hash).  Ranges of the order are dealt out, so one task never has them all.
    """
    common.tune(docs.sparkSession)
    rows = common.id_and_text(docs, *(order or [])).withColumn("tie", F.xxhash64("text"))
    by = order or ["doc_id", "tie"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered.mapInArrow(encoder(tokenizer_path, end_id), SCHEMA).write.options(**WRITER).parquet(path)


STORED = ["stored_part", "stored_file", "stored_row"]


def as_stored(docs: DataFrame) -> DataFrame:
    """Ids and texts with the columns ``STORED``: the place of each row in the files that ``docs`` was read from, whose
    numbers ascend as the rows did when Spark wrote them.  What isn't read from files is written first.
    """
    place = [F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0)), F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        return docs.select("doc_id", "text", *[c.alias(n) for c, n in zip(place, STORED, strict=True)])
    except AnalysisException:
        docs = common.written(docs.select("doc_id", "text"), "stored")
        return docs.select("doc_id", "text", *[c.alias(n) for c, n in zip(place, STORED, strict=True)])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; columns and row groups that aren't asked for aren't read."""
    return spark.read.schema(SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of a few documents: the filter is pushed to the files, where statistics of row groups and the page
    index leave out what can't hold them.
    """
    return read_tokens(spark, path).where(F.col("doc_id").isin(*ids))


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """How many ids stand before each file's part: one row per part, from the metadata columns alone."""
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("tokens"))
        values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4").view(np.uint8)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4
        crcs, begin = [], 0
        for end in ends.tolist():
            crcs.append(zlib.crc32(values[begin:end]))
            begin = end
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("part", "doc_id", "start_in_part", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(crcs, pa.int64())], names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: where its ids start among all, how many they are, and their checksum, read from the files."""
    rows = read_tokens(spark, path).mapInArrow(digest, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(spark, path), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
