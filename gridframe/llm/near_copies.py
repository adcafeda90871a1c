"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 4/5, found exactly.

This is what the SimHash operator is for where a similarity is asked: its links connect what lies within ``BITS`` of a
fingerprint of five-word shingles, each link is verified by the sets, and prefix filtering finds the pairs that are
similar enough though their fingerprints differ more (at a similarity of 4/5 about ten bits of 64 do, which no
partition of the bits can be probed for).

Words are the runs outside white space of the text with A-Z lower-cased; a text of fewer words has one shingle, all of
them.  Shingles stand for themselves by their XXH64.  Texts with the same set are one node.

Of two sets that are similar enough, the first n - ceil(4/5 n) + 1 members in any order that all sets share have one in
common, so these prefixes are the keys.  The order has what a sample of the texts has often last, so that a passage
that many share is rarely a key; the sample moves costs, never results.  What meets at a key is compared by size, by
the key's place in both sets (were it the first that they share, what follows must still be enough), by a 512-bit
parity sketch (the bits that differ are never more than the members that differ) and then by the sets.

Only components matter.  At each key all sets are first compared with its least set, which is the same for most keys
of a crowd; then, where a key still has sets that aren't connected, with one of them that is the key's own; and then
those that are left with each other, sets of about the same size alone.

Inputs: null and empty texts have the empty set and are copies of each other; very long texts are hashed whole; an
empty table gives no rows; other columns are ignored by ``groups`` and kept by ``keep_one``.  In ``groups`` rows that
share an id are one document, and rows without an id have no line but connect what they are similar to.  For
``keep_one`` each row is a document, with an id or without, and rows that are equal in id and text are copies: of each
group the one with the least id stays (rows without an id after all others), of equal ids the least hash of the text,
of equal rows the least hash of all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common, simhash
from gridframe.llm.components import components
from gridframe.llm.simhash import shingle_hashes

SHINGLE = 5

#: The least similarity, as a fraction.
SHARE = (4, 5)

#: Rows of the sample that orders the shingles, about, and the most shingles that it orders (16 bytes each).
SAMPLE_ROWS, MOST_ORDERED = 25_000, 500_000

SKETCH = 8

#: Members of sets that a task that verifies pairs keeps, besides those of one set.
HELD = 4_000_000

#: Bits of a fingerprint within which the SimHash operator links.
BITS = 2


def sample_order(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that a sample has more than twice, the rarest first."""
    rows = common.id_and_text(docs)
    n = rows.count()
    thinned = rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, size)) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["key"])

    often = thinned.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    top = often.orderBy(F.desc("c"), "key").limit(MOST_ORDERED).select("key").toArrow()["key"].to_numpy()
    return np.ascontiguousarray(top[::-1], np.int64).view(np.uint64)


def ordered_prefix(members: np.ndarray, known: np.ndarray, rank: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The first n - ceil(share * n) + 1 of the set's members; ``known`` is sorted and ``rank`` its places from 1."""
    n = len(members)
    if not n:
        return members
    place = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, members), len(known) - 1)
        place = np.where(known[at] == members, rank[at], 0)
    return members[np.lexsort((members, place))[: n - -(-share[0] * n // share[1]) + 1]]


def parities(members: np.ndarray) -> np.ndarray:
    """Per residue of the hash, whether an odd number of members has it, as ``SKETCH`` longs."""
    odd = np.bincount((members & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets(docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, text hash, fingerprint, set hash ``h``, set size ``n``, sketch and prefix of each row."""
    from xxhash import xxh64_intdigest

    order = sample_order(docs, size)
    by_key = np.argsort(order)
    shared = docs.sparkSession.sparkContext.broadcast((order[by_key], by_key + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            hashes = [shingle_hashes(t, size) for t in common.texts(batch)]
            members = list(map(np.unique, hashes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(np.array(list(map(simhash.majority, hashes)), np.uint64).view(np.int64)),
                    pa.array(np.array([xxh64_intdigest(m.tobytes()) for m in members], np.uint64).view(np.int64)),
                    pa.array([len(m) for m in members], pa.int64()),
                    pa.array([parities(m) for m in members], pa.list_(pa.int64())),
                    pa.array([ordered_prefix(m, known, rank, share).view(np.int64) for m in members], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "fp", "h", "n", "sketch", "prefix"],
            )

    rows = common.id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, h long, n long, sketch array<long>, prefix array<long>").withColumn("place", place())


def place() -> Column:
    """What finds a row's text again beside its hash: its id, or the hash where it has none."""
    return F.coalesce("doc_id", "text_hash")


def may_reach(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether sizes and sketches allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH)), F.lit(0))
    low, high = share
    return (F.least(n, m) * high >= F.greatest(n, m) * low) & (differ * (high + low) <= (n + m) * (high - low))


def sizes_fit(n: Column, m: Column, share: tuple[int, int]) -> Column:
    return F.least(n, m) * share[1] >= F.greatest(n, m) * share[0]


def places_fit(n: Column, at: Column, m: Column, m_at: Column, share: tuple[int, int]) -> Column:
    """Whether two sets whose first common member stands at these places can share enough."""
    least = (n + m) * share[0]
    return ((n - at) * (share[0] + share[1]) >= least) & ((m - m_at) * (share[0] + share[1]) >= least)


def compressed(docs: DataFrame) -> DataFrame:
    """place, text_hash and the packed text of each row: texts are joined twice, so they travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(press.compress, common.texts(batch)), pa.binary())], names=["place", "text_hash", "packed"])

    rows = common.id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.select(place().alias("place"), "text_hash", "text").mapInArrow(run, "place long, text_hash long, packed binary")


def verified(pairs: DataFrame, texts: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of set hashes whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, known, held = zstandard.ZstdDecompressor(), {}, 0

        def members(h: int, packed: bytes) -> np.ndarray:
            """A set's members; those of late are kept, since the pairs of one set come after one another."""
            nonlocal held
            if h not in known:
                if held > HELD:
                    known.clear()
                    held = 0
                known[h] = np.unique(shingle_hashes(press.decompress(packed), size))
                held += len(known[h])
            return known[h]

        for batch in batches:
            stay = []
            for u, v, a, b in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                x, y = members(u, a), members(v, b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                stay.append(both * share[1] >= (len(x) + len(y) - both) * share[0])
            yield batch.select(["u", "v"]).filter(pa.array(stay, pa.bool_()))

    one = texts.select(F.col("h").alias("u"), F.col("packed").alias("ut"))
    other = texts.select(F.col("h").alias("v"), F.col("packed").alias("vt"))
    return pairs.join(one, "u").join(other, "v").select("u", "v", "ut", "vt").mapInArrow(run, "u long, v long")


def prepared(docs: DataFrame, size: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The set hash of each row, and one row with all that is known of it for each set."""
    full = common.written(sets(docs, size, share), "near-sets")
    rows = common.written(full.select("doc_id", "text_hash", "h"), "near-hashes")
    heads = full.groupBy("h").agg(F.min(F.struct("place", "text_hash", "fp", "n", "sketch", "prefix")).alias("r")).select("h", "r.*")
    heads = common.written(heads, "near-heads")
    common.dropped(full)
    return rows, heads


def links(heads: DataFrame, docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """Links between set hashes that leave no two similar sets unconnected."""
    # Equal rows of ``docs`` are dropped where the join has put them together.
    texts = common.written(compressed(docs).join(heads.select("h", "place", "text_hash"), ["place", "text_hash"]).dropDuplicates(["place", "text_hash"]).select("h", "packed"), "near-texts")
    shape = heads.select("h", F.struct("n", "sketch").alias("shape"))

    def similar(pairs: DataFrame) -> DataFrame:
        """Of the pairs (u, v), those that are similar enough."""
        met = pairs.distinct().join(shape.select(F.col("h").alias("u"), F.col("shape").alias("a")), "u").join(shape.select(F.col("h").alias("v"), F.col("shape").alias("b")), "v")
        # Written before texts meet them, so that what was shuffled to find the pairs is gone by then.
        some = common.written(met.where(may_reach("a", "b", share)).select("u", "v"), "near-pairs")
        return common.written(verified(some, texts, size, share), "near-links")

    def in_parts(found: DataFrame, of: DataFrame) -> DataFrame:
        """``of`` with the component of each set so far, ``part``."""
        parts = common.written(components(found), "near-parts")
        return of.join(parts.withColumnsRenamed({"node": "h", "component": "part"}), "h", "left").withColumn("part", F.coalesce("part", "h"))

    def apart(entries: DataFrame, by: Column | None = None) -> DataFrame:
        """The entries of keys whose sets aren't all connected yet, each with one of its key's sets (the least ``by``, or
        by component), and whether it is to be compared with that: not connected, and sizes and places allow it.
        """
        told = [F.col("part").alias("one_part"), F.col("h").alias("one"), F.col("n").alias("m"), F.col("at").alias("m_at")]
        first, last = F.min(F.struct(*([] if by is None else [by.alias("by")]), *told)).alias("first"), F.max("part").alias("hi")
        # Of the least component, no least one has to be carried beside the greatest.
        lo = [] if by is None else [F.min("part").alias("lo")]
        mixed = entries.groupBy("key").agg(first, last, *lo).where("first.one_part != hi" if by is None else "lo != hi").select("key", "first.one", "first.one_part", "first.m", "first.m_at")
        asked = (F.col("part") != F.col("one_part")) & sizes_fit(F.col("n"), F.col("m"), share) & places_fit(F.col("n"), F.col("at"), F.col("m"), F.col("m_at"), share)
        return common.written(entries.join(mixed, "key").select("h", "key", "n", "at", F.when(asked, F.col("one")).alias("one")), "near-apart")

    def to_one(now: DataFrame) -> DataFrame:
        return now.where("one is not null").select(F.col("h").alias("u"), F.col("one").alias("v"))

    # The SimHash operator's links, by one set for each fingerprint, and the sets of one fingerprint.
    one = common.written(heads.groupBy("fp").agg(F.min("h").alias("one")), "near-prints")
    wide = simhash.links(one.select("fp"), BITS)
    wide = wide.join(one.select(F.col("fp").alias("u"), F.col("one").alias("a")), "u").join(one.select(F.col("fp").alias("v"), F.col("one").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = heads.join(one, "fp").where("h != one").select(F.col("h").alias("u"), F.col("one").alias("v"))
    found = similar(wide.unionByName(same))

    # What is connected carries its component into its entries, so entries are shuffled by their key alone; from then
    # on only those of keys with several components are left.
    sized = in_parts(found, heads.select("h", "n", "prefix"))
    entries = sized.select("h", F.col("n").cast("int").alias("n"), "part", F.posexplode("prefix").alias("at", "key"))
    # The first time, the least of all: it is the same for most keys of a crowd.  Then one that is the key's own.
    first = apart(entries)
    found = found.unionByName(similar(to_one(first)))
    second = apart(in_parts(found, first.select("h", "key", "n", "at")), F.xxhash64("h", "key"))
    common.dropped(first)
    found = found.unionByName(similar(to_one(second)))
    left = apart(in_parts(found, second.select("h", "key", "n", "at")))
    common.dropped(second)
    now = in_parts(found, left.select("h", "key", "at")).join(shape, "h")
    # Sizes that the similarity allows are in the same class or in neighbouring ones.
    of_size = F.floor(F.log(F.greatest(F.col("shape.n"), F.lit(1))) / F.log(F.lit(share[1] / share[0])))
    a = now.select("key", "h", "at", "part", "shape", F.explode(F.array(of_size - 1, of_size, of_size + 1)).alias("class")).alias("a")
    b = now.select("key", "h", "at", "part", "shape", of_size.alias("class")).alias("b")
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.part") < F.col("b.part")) & places_fit(F.col("a.shape.n"), F.col("a.at"), F.col("b.shape.n"), F.col("b.at"), share) & may_reach("a.shape", "b.shape", share))
    found = found.unionByName(similar(cross.select(F.col("a.h").alias("u"), F.col("b.h").alias("v"))))
    common.dropped(left, texts)
    return found


def grouped(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, text_hash and group (the least set hash that ``edges`` reach) of each row of ``rows``, a written table."""
    parts = common.written(components(edges), "near-groups").withColumnsRenamed({"node": "h", "component": "group"})
    met = common.join_by_key(rows.select("doc_id", "text_hash", "h"), parts, ["h"], "left", counted=rows)
    return common.written(met.select("doc_id", "text_hash", F.coalesce("group", "h").alias("group")), "near-rows")


def groups(docs: DataFrame, size: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable) of each document with an id."""
    common.tune(docs.sparkSession)
    rows, heads = prepared(docs, size, share)
    # The sets of an id that several rows share.
    pairs = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("v"), F.max("h").alias("u")).where("u != v").select("doc_id", "v")
    ties = rows.join(pairs, "doc_id").select(F.col("h").alias("u"), "v")
    named = grouped(rows, links(heads, docs, size, share).unionByName(ties)).where("doc_id is not null")
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return common.join_by_key(named.select("doc_id", "group"), least, ["group"], counted=named).select("doc_id", "component_id").distinct()


def keep_one(docs: DataFrame, size: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` with one row of each group."""
    common.tune(docs.sparkSession)
    rows, heads = prepared(docs, size, share)
    met = grouped(rows, links(heads, docs, size, share))
    one = met.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("one")).select("one.doc_id", "one.text_hash")
    one = common.written(one, "near-one")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    gone = common.written(met.select("doc_id", "text_hash").distinct().join(one, same(met, one), "left_anti"), "near-gone")
    again = met.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = common.written(again.join(one, same(again, one), "left_semi"), "near-again")

    def among(some: DataFrame, how: str, of: DataFrame) -> DataFrame:
        keys = some.select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_text"))
        text = F.xxhash64(F.coalesce(of["text"].cast("string"), F.lit("")))
        return of.join(keys, of["doc_id"].cast("long").eqNullSafe(keys["_near_id"]) & (text == keys["_near_text"]), how)

    stay = among(gone, "left_anti", docs)
    if again.isEmpty():
        return stay
    # Equal rows: the least hash of all columns, of those that are left of each.
    doubled = among(again, "left_semi", docs).groupBy("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_near_text"))
    each = doubled.agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.xxhash64(*[docs[c] for c in common.hashable(docs, docs.columns)])).alias("_near_row")).select("_near_row.*")
    return among(again, "left_anti", stay).unionByName(each)
