"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

A text's terms are its words (A-Z made small and signs left out, hashed to ``WORDS`` classes), the shapes of its words
(runs of capitals, small letters, digits and other letters as one sign, punctuation as it is, hashed to ``SHAPES``
classes), and repeats (a word that equals the one before it, or one of the eight before it, a line that was there
before).  A bounded sample of labelled documents gives the term weights (logarithmic counts times inverse document
frequency) and, by a singular value decomposition, the latent space.  The sample's vectors are sent to the executors;
each document's cosine with all of them is an exact product, computed for a block of documents at once, and the
``neighbours`` nearest vote for their labels.  A vote weighs the cosine to the power of ``POWER``, so that near
neighbours count more than many distant ones; a negative cosine weighs nothing.

Bounds: ``SAMPLE`` labelled documents (as term counts: texts don't reach the driver), TERMS terms and ``RANK``
dimensions; what is broadcast is therefore at most SAMPLE x RANK + TERMS x RANK numbers.

Inputs: null and empty texts have no terms and get the sample's share of label 1, as do texts without a neighbour of
positive weight; very long texts are counted whole; labels count once per id (the highest), null labels and null ids
not at all; without any label all scores are 0.5; of equally near neighbours those that come first in the sample
(ordered by hashes of id and text) vote; rows that share an id, or are equal, are separate rows; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common

SAMPLE = 4000
RANK = 64
NEIGHBOURS = 25
POWER = 4

#: Classes of shapes and of words; the repeats are EXTRA terms more.
SHAPES, WORDS, EXTRA = 4092, 12_288, 4
TERMS = SHAPES + WORDS + EXTRA

SIGNS = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b for b in range(256)
)


@functools.lru_cache(maxsize=1)
def terms_met() -> "Terms":
    """Kept for the tasks that a Python worker runs in turn."""
    return Terms()


def shape(word: bytes) -> bytes:
    """Each run of a sign is written once."""
    out, last = bytearray(), -1
    for b in word.translate(SIGNS):
        if b != last:
            out.append(b)
            last = b
    return bytes(out)


class Terms(dict):
    """A word's term numbers: of its shape, and of its letters and digits."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.limit:
            self.clear()
        plain = word.translate(common.PLAIN_WORDS).strip()
        value = (zlib.crc32(shape(word)) % SHAPES, SHAPES + EXTRA + zlib.crc32(plain) % WORDS if plain else -1)
        if len(word) <= 64:
            self[word] = value
        return value

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and how often the text has each."""
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        each = Counter(words)
        terms = np.array([self[w] for w in each], np.int64)
        often = np.fromiter(each.values(), np.float64, len(each))
        total = np.bincount(terms[:, 0], often, TERMS)
        worded = terms[:, 1] >= 0
        total += np.bincount(terms[worded, 1], often[worded], TERMS)
        hashes = np.fromiter(map(hash, words), np.int64, n)
        near = np.zeros(n, bool)
        for gap in range(1, min(9, n)):
            near[gap:] |= hashes[gap:] == hashes[:-gap]
        lines = [x for x in text.split(b"\n") if x.strip()]
        total[SHAPES : SHAPES + EXTRA] = (int((hashes[1:] == hashes[:-1]).sum()), int(near.sum()), len(lines) - len(set(lines)), n if n < 10 else 0)
        ids = np.flatnonzero(total)
        return ids.astype(np.int32), total[ids].astype(np.float32)


def weighed(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The sum of the vectors, each times its value: too small for the threads that a matrix product would wake."""
    return np.einsum("i,ij->j", values, vectors)


def leading(rows: list[tuple[np.ndarray, np.ndarray]], rank: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of the matrix of the rows' term numbers and values, by subspace iteration
    from a fixed start.  Bases are made orthonormal by their small matrices of products.
    """

    def turned(x: np.ndarray) -> np.ndarray:
        """The columns turned to their principal axes (the longest first) and made orthonormal."""
        squares, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
        order = np.argsort(squares)[::-1]
        keep = order[squares[order] > squares[order[0]] * 1e-12]
        return (x @ (axes[:, keep] / np.sqrt(squares[keep]))).astype(np.float32)

    basis = np.random.default_rng(0).standard_normal((TERMS, min(rank + 8, len(rows)))).astype(np.float32)
    for _ in range(rounds):
        left = turned(np.array([weighed(values, basis[ids]) for ids, values in rows]))
        basis = np.zeros((TERMS, left.shape[1]), np.float32)
        for (ids, values), row in zip(rows, left, strict=True):
            basis[ids] += values[:, None] * row
        basis = turned(basis)
    return basis[:, :rank]


class Space:
    """Term weights, the latent projection, and the sample's vectors and labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]):
        self.prior = float(np.mean(labels)) if labels else 0.5
        df = np.zeros(TERMS)
        for ids, _ in rows:
            df[ids] += 1
        self.weight = np.log((1 + len(rows)) / (1 + df)) + 1
        scaled = [(ids, self._scaled(ids, n)) for ids, n in rows]
        if not any(len(ids) for ids, _ in rows):
            self.project, self.vectors, self.labels = np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32)
            return
        self.project = leading(scaled, RANK)
        vectors = np.array([weighed(values, self.project[ids]) for ids, values in scaled])
        length = np.linalg.norm(vectors, axis=1)
        here = length > 0
        self.vectors = (vectors[here] / length[here, None]).astype(np.float32)
        self.labels = np.array(labels, np.float32)[here]

    def _scaled(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.weight[ids] if len(ids) else n
        norm = np.sqrt((x * x).sum())
        return (x / norm if norm else x).astype(np.float32)

    def latent(self, terms: Terms, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.project.shape[1]), np.float32)
        for i, text in enumerate(texts):
            ids, n = terms.counts(text)
            if len(ids):
                out[i] = weighed(self._scaled(ids, n), self.project[ids])
        return out

    def scores(self, terms: Terms, texts: list[bytes], neighbours: int) -> np.ndarray:
        """One exact block product; the nearest vote."""
        x = self.latent(terms, texts)
        length = np.linalg.norm(x, axis=1)
        out = np.full(len(texts), self.prior)
        rows = np.flatnonzero(length > 0)
        if not len(rows) or not len(self.labels):
            return out
        cosines = (x[rows] / length[rows, None]) @ self.vectors.T
        # Rounded, so that equal texts tie whatever block they come in; the sample's order decides then.
        cosines = np.round(cosines, 5)
        near = np.argsort(-cosines, axis=1, kind="stable")[:, :neighbours]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        voted = total > 0
        out[rows[voted]] = np.clip((weight * self.labels[near]).sum(axis=1)[voted] / total[voted], 0, 1)
        return out


def held_out() -> Column:
    """A third of the ids, which is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    """The space of at most ``sample`` labelled documents: those with the least hashes of their ids."""
    common.tune(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    learnt = known.where(~held_out())
    n = learnt.count()
    # Thinned by hash to about twice the sample before ranking, so that what meets in one task is bounded.
    thin = learnt.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < 2.0 * sample / max(n, 1) * float(1 << 30))
    chosen = thin.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids; their texts become term counts where they are.
    rows = common.id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.col("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = terms_met()
        for batch in batches:
            found = [terms.counts(t) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), batch.column(3), batch.column(4), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.float32()))],
                names=["h", "doc_id", "t", "quality", "ids", "n"],
            )

    counted = rows.mapInArrow(run, "h long, doc_id long, t long, quality int, ids array<int>, n array<float>")
    found = counted.orderBy("h", "doc_id", "t").limit(sample).toArrow()
    ids, n = ([x.values.to_numpy(zero_copy_only=False) for x in found.column(c)] for c in ("ids", "n"))
    return Space(list(zip(ids, n, strict=True)), found.column("quality").to_pylist())


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    space = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = terms_met()
        for batch in batches:
            score = space.value.scores(terms, common.texts(batch), neighbours)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return common.id_and_text(docs).withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
