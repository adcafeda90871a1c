"""Helpers that the corpus operators share: tables, shared scratch folders, Arrow batches, word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts can be long, so a batch is kept far below the default of 10,000 rows.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20

#: Keys with more than a HEAVY-th of the rows (and LIGHT rows) are heavy: there are fewer than HEAVY of them.
HEAVY, LIGHT = 10_000, 100_000

#: Bytes of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z were lower-cased: the rest becomes a space.
#: A byte of 0x80 or more is always a part of a word character, so working on UTF-8 bytes gives the same words.
PLAIN_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches, in rows and in bytes, so that the memory of a Python worker doesn't hang on the length
    of texts: a batch ends with the text that makes it reach ``BATCH_BYTES``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            base = tempfile.mkdtemp(prefix="gridframe-")
            atexit.register(shutil.rmtree, base, True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Paths that were given out and not removed yet.
_paths: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    _paths.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _paths[-1]


def scratch_mark() -> int:
    """How many paths there are: what was given out since then can be removed when nothing reads it any more."""
    return len(_paths)


def remove_scratch(spark: SparkSession, begin: int, end: int) -> None:
    """Removes the scratch tables from mark ``begin`` to ``end``, wherever the shared folder is."""
    for path in _paths[begin:end]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    del _paths[begin:end]


#: With it, the shuffle files of a query go when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends there and lost executors cost nothing.  What was
    shuffled for it is removed, since only the table is read from then on.
    """
    spark = df.sparkSession
    path, before = scratch(spark, what), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        path = df._written_to
        at = _paths.index(path)
        remove_scratch(df.sparkSession, at, at + 1)


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", heavy: int = HEAVY, light: int = LIGHT, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``table``, which has one row for each key: no key's rows meet in one task.  ``rows``, or
    ``counted`` with the same keys, is a written table.

    Heavy keys are counted first (with partial sums).  Fewer than ``heavy`` keys can hold more than that share of the
    rows, so their rows of ``table`` are broadcast whatever the input's size; all others are shuffled by key.
    """
    counted = rows if counted is None else counted
    least = max(counted.count() / heavy, light)
    crowded = F.broadcast(counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(*keys))
    few = rows.join(crowded, keys, "left_anti").join(table, keys, how)
    hot = rows.join(crowded, keys, "left_semi").join(F.broadcast(table.join(crowded, keys, "left_semi")), keys, how)
    return few.unionByName(hot)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashable(docs: DataFrame, columns: list[str]) -> list[str]:
    """Of the columns, those that Spark hashes."""
    kinds = dict(docs.dtypes)
    return [c for c in columns if "map<" not in kinds[c] and "variant" not in kinds[c]]


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the id and the whole text (null: empty), so that no other column can clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """Word bytes to eight bytes of a 64-bit hash; emptied when ``limit`` words are held."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        import xxhash

        self.limit, self.digest = limit, xxhash.xxh3_64_digest

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self.digest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.uint64)


class SpanHashes:
    """Hashes of any span of words in constant time each: prefix sums of h[i] * B**-i modulo 2**64.

    The hash of words [a, b) is (S[b] - S[a]) * B**a, the same wherever the words stand.
    """

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, which: int = 0):
        self.base = self.BASES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        self._powers(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.down[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.up[start])

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Of all windows of k words."""
        n = len(prefix) - k
        return mixed((prefix[k:] - prefix[:n]) * self.up[:n]) if n > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all of the sum's."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def covered(n: int, starts: np.ndarray, length) -> np.ndarray:
    """A mask of the positions of [0, n) that lie in a span [start, start + length)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:n]) > 0
