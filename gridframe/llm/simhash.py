"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance, by the generalised pigeonhole rule.

Fingerprint: words are the runs outside white space of the text with A-Z lower-cased; of each shingle of three words
(all words if there are fewer) XXH64 with seed 42 is taken; a bit is 1 if it is set in over half of the hashes.

Linking works on the different fingerprints.  Bits that go together in the data are grouped into one partition, so
that the values of a partition are few and the partitions are close to independent.  With ``parts`` partitions whose
thresholds sum to ``distance`` - ``parts`` + 1, two fingerprints within ``distance`` are within the threshold in at
least one partition; a threshold of -1 leaves a partition out.  A dynamic programme gives each partition the threshold
that makes the sum of probes and estimated candidates least.  Each fingerprint is indexed by its values and probes
the values within the thresholds; what meets is verified.

A value that more than ``crowd`` fingerprints share or probe isn't paired: all of them emit the points within half
the distance around them.  Two fingerprints are within the distance exactly if they share such a point, and a point
has no more members than there are points around it, so this way is exact and linear however large the group is: 65
points for each such fingerprint at distance 2, which at a scale where most values of a partition are crowded is what
each fingerprint costs.

Inputs: null and empty texts have the fingerprint zero and are linked like any other; very long texts are hashed whole;
a bit set in just half of the hashes is 0; rows that share an id are one document in the links; rows without an id get a fingerprint and no component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common
from gridframe.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n <= size:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    n, total = len(hashes), np.zeros(BITS, np.int64)
    if not n:
        return 0
    for i in range(0, n, 4096):
        block = hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((majority(shingle_hashes(t, size)) for t in common.texts(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and how often each pair of bits is set together: 64 x 64 sums over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], names=["n", "together"])

    sums = prints.select("fp").mapInArrow(run, "n long, together array<long>")
    row = sums.select("n", F.posexplode("together").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS, np.int64)
    for r in row:
        out[r["i"]] = r["c"]
    return (row[0]["n"] if row else 0), out.reshape(BITS, BITS)


def grouped_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of equal width: each starts at the bit with the strongest ties and takes the bits tied most to it."""
    mean = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    ties = np.abs(together / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(ties, 0)
    left, out = list(range(BITS)), []
    for part in range(parts):
        width = len(left) // (parts - part)
        group = [max(left, key=lambda b: (ties[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (ties[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds of each partition (an index of ``costs`` less one) that sum to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for i, c in enumerate(row):
                if (used + i - 1) not in step or step[used + i - 1][0] > cost + c:
                    step[used + i - 1] = (cost + c, [*chosen, i - 1])
        best = step
    return best[total][1]


def value_of(bits: list[int], fp: Column) -> Column:
    """The bits of a partition; they stay at their places, which is as good a key as any."""
    return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def flips(bits: list[int], reach: int) -> list[int]:
    """Masks that flip at most ``reach`` of the bits."""
    out = [0]
    for _ in range(reach):
        out = list({m ^ (1 << b) for m in out for b in bits} | set(out))
    return sorted(_signed(m) for m in out)


def plan(prints: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds.  Candidates are estimated from how many fingerprints share each value: the sum of
    squared counts, times the number of values probed.  For each number of partitions the programme is solved; the
    cheapest plan wins.
    """
    n, together = bit_counts(prints)
    best: tuple[float, list[list[int]], list[int]] | None = None
    for parts in range(2, distance + 3):
        groups = grouped_bits(n, together, parts)
        squares = prints.select(
            F.explode(F.array(*[F.struct(F.lit(i).alias("part"), value_of(g, F.col("fp")).alias("key")) for i, g in enumerate(groups)])).alias("e")
        ).groupBy("e").agg(F.count(F.lit(1)).alias("c")).groupBy("e.part").agg(F.sum(F.col("c") * F.col("c")).alias("s"))
        met = {r["part"]: r["s"] for r in squares.collect()}
        costs = []
        for i, g in enumerate(groups):
            probes = [0] + [len(flips(g, t)) for t in range(distance + 1)]
            costs.append([0.0] + [p * n + p * max(met.get(i, 0), n) for p in probes[1:]])
        chosen = allocate(costs, distance - parts + 1)
        cost = sum(costs[i][t + 1] for i, t in enumerate(chosen))
        if best is None or cost < best[0]:
            best = (cost, groups, chosen)
    return best[1], best[2]


def links(prints: DataFrame, distance: int = 2, crowd: int = 128) -> DataFrame:
    """Links u > v between different fingerprints within ``distance`` that leave no such pair unconnected."""
    groups, thresholds = plan(prints, distance)
    fp = F.col("fp")

    def probes(part: int, bits: list[int], threshold: int) -> Column:
        masks = F.array(*[F.lit(m) for m in flips(bits, threshold)])
        return F.transform(masks, lambda m: F.struct(F.lit(part).alias("part"), value_of(bits, fp).bitwiseXOR(m).alias("key"), (m == 0).alias("own")))

    entries = F.concat(*[probes(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0])
    rows = prints.select("fp", F.explode(entries).alias("e")).select("fp", "e.part", "e.key", "e.own")
    rows = common.written(rows, "probes")
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = rows.join(sizes.where(F.col("n") <= crowd), ["part", "key"]).select("part", "key", "fp", "own")
    left, right = few.where("own").alias("a"), few.alias("b")
    near = (
        left.join(right, ["part", "key"])
        .where((F.col("a.fp") != F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance))
        .select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v"))
    )
    many = rows.join(sizes.where(F.col("n") > crowd), ["part", "key"], "left_semi").select("fp").distinct()
    return near.unionByName(shared_points(many, distance)).distinct()


def shared_points(prints: DataFrame, distance: int) -> DataFrame:
    """Links of each fingerprint to the least one that shares a point within half the distance (rounded up) of both.

    For an odd distance, sharing a point allows one bit too many, so what is linked is verified pair by pair within
    the point's bounded group.
    """
    reach = (distance + 1) // 2
    points = prints.select("fp", F.explode(F.transform(F.array(*[F.lit(m) for m in flips(list(range(BITS)), reach)]), lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    if distance % 2:
        a, b = points.alias("a"), points.alias("b")
        pairs = a.join(b, "z").where((F.col("a.fp") > F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance))
        return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    groups = points.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    starred = groups.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    return starred.where("u != v").distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, size: int = SHINGLE, crowd: int = 128) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable) of each row."""
    rows = common.written(fingerprints(docs, size), "fingerprints")
    heads = rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("most"))
    heads = common.written(heads, "fingerprint-heads")
    found = links(heads.select("fp"), distance, crowd)
    least = heads.select("fp", "head")
    edges = (
        found.join(least.withColumnsRenamed({"fp": "u", "head": "hu"}), "u")
        .join(least.withColumnsRenamed({"fp": "v", "head": "hv"}), "v")
        .select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    )
    # An id that several rows share ties the fingerprints of these rows together.
    shared = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("doc_id")
    ties = rows.join(shared, "doc_id", "left_semi").join(least, "fp").select(F.col("doc_id").alias("u"), F.col("head").alias("v"))
    found = components(edges.unionByName(ties))
    heads = least.join(found, F.col("head") == F.col("node"), "left").select("fp", F.coalesce("component", "head").alias("component_id"))
    out = rows.join(heads, "fp", "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, distance: int = 2, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group: the one with the least id.  Rows without an id stay."""
    groups = near_duplicates(docs, distance, size)
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
