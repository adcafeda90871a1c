"""Source divergence audit: how far the word use of a language's sources lies apart, exactly, by a heavy-light split.

Of each language the terms in at least ``LEAST`` of its documents are kept; each (language, source) gives every kept
term a smoothed share p, and each language one, q.  Two sources differ by the sum of abs(p - p') over all kept terms.

That sum is V * abs(b - b'), with b the share of a term that a source doesn't have, plus a correction for each term
that either has.  Terms that many sources have (a third of the language's) are heavy: their shares stand in dense
numpy tiles of sources by terms.  For rare terms the corrections of one source's postings against all others' b come
from sorted prefix sums, and only pairs of postings of one term are corrected once more.  Both parts are 64-bit sums of
integers and are added without error.

A tile has about ``TILE`` heavy or ``RARE_TILE`` rare terms and at most two blocks of about ``SOURCES`` sources, dealt by
hash, so no task gets a whole language or source.  Counts are added up per task before they are shuffled.

Inputs: null text, lang and source are ''; a group without kept terms is still there (its pairs are too; value 0 where
the language keeps no term); rows that share an id are separate documents; ties by the item's UTF-8 bytes; a very long
text is one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm import common

LEAST, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
TILE, RARE_TILE, SOURCES, MANY = 256, 1024, 256, 3
#: Distinct (group, term) counts that a task holds before it gives them on.
HELD = 300_000

#: Bytes of the term class [^\x00-\x40\x5B-\x60\x7B-\x7F] after A-Z were lower-cased; the rest becomes a space.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """Per (lang, source, term): occurrences and documents.  The term '' stands for the group and its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict = defaultdict(Counter)
        having: dict = defaultdict(Counter)

        def given() -> pa.RecordBatch:
            rows = [(*group, term.decode(), times[group].get(term, 0), n) for group, found in having.items() for term, n in found.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            times.clear()
            having.clear()
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch), strict=True):
                words = text.translate(LETTERS).split()
                times[lang, source].update(words)
                having[lang, source].update({b"", *words})
            if sum(map(len, having.values())) > HELD:
                yield given()
        yield given()

    whole = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = whole.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 V)) without overflow; null where a language keeps no term."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    down = F.nullif(total + SMOOTH * kept, F.lit(0)).cast("decimal(19,0)")
    return F.call_function("div", up, down) + 1


def tile_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What one tile adds to the pairs of its sources.  Rows without a term are the sources themselves: p is b, and
    ``kept`` the number of kept terms in the one tile of a pair that adds V * abs(b - b').
    """
    lang, heavy, _, low, high = key
    bare = rows["term"].isna()
    groups, posts = rows[bare].sort_values("source"), rows[~bare]
    names, b, block = groups["source"].to_numpy(), groups["p"].to_numpy(np.int64), groups["block"].to_numpy()
    size = len(names)
    apart = np.abs(b[:, None] - b[None, :])
    total = groups["kept"].to_numpy(np.int64)[0] * apart if size else apart
    if len(posts):
        g = pd.Index(names).get_indexer(posts["source"])
        term, terms = pd.factorize(posts["term"])
        p = posts["p"].to_numpy(np.int64)
        total = total + (dense if heavy else sparse)(g, term, p, b, len(terms), apart)
    i, j = np.nonzero((block[:, None] == low) & (block[None, :] == high) if low != high else np.arange(size)[:, None] < np.arange(size)[None, :])
    return pd.DataFrame({"lang": lang, "one": names[i], "other": names[j], "value": total[i, j]})


def dense(g: np.ndarray, term: np.ndarray, p: np.ndarray, b: np.ndarray, n_terms: int, apart: np.ndarray) -> np.ndarray:
    """All sources by all terms of the tile, and the distance of each two rows."""
    tile = np.repeat(b[:, None], n_terms, axis=1)
    tile[g, term] = p
    out = np.zeros_like(apart)
    for i in range(len(b)):
        out[i] = np.abs(tile - tile[i]).sum(axis=1)
    return out - n_terms * apart


def sparse(g: np.ndarray, term: np.ndarray, p: np.ndarray, b: np.ndarray, n_terms: int, apart: np.ndarray) -> np.ndarray:
    """One-sided corrections from each source's sorted shares, then those of two postings of a term."""
    size = len(b)
    alone = np.zeros((size, size), np.int64)
    order = np.lexsort((p, g))
    edges = np.searchsorted(g[order], np.arange(size + 1))
    for i in range(size):
        own = p[order[edges[i] : edges[i + 1]]]
        upto = np.concatenate([[0], np.cumsum(own)])
        under = np.searchsorted(own, b)
        alone[i] = b * under - upto[under] + (upto[-1] - upto[under]) - b * (len(own) - under) - len(own) * apart[i]
    out = alone + alone.T
    order = np.lexsort((g, term))
    g, term, p = g[order], term[order], p[order]
    for d in range(1, int(np.bincount(term).max())):
        same = np.flatnonzero(term[d:] == term[:-d])
        i, j, pi, pj = g[same], g[same + d], p[same], p[same + d]
        both = np.abs(pi - pj) - np.abs(pi - b[j]) - np.abs(b[i] - pj) + apart[i, j]
        np.add.at(out, (i, j), both)
        np.add.at(out, (j, i), both)
    return out


def ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value")).withColumn("rank", rank)
    return out.where(F.col("rank") <= top) if top else out


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, tile: int = TILE, rare_tile: int = RARE_TILE, sources: int = SOURCES) -> DataFrame:
    """Rows of (lang, source, part, item, value, rank).  Part ``pair``: all other sources of the language; part
    ``term``: the ``top`` terms that the source uses more than its language does.
    """
    common.tune(docs.sparkSession)
    counts = common.written(counted(docs), "counts")
    words = counts.where("term <> ''")
    vocabulary = words.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("in_lang"), F.count(F.lit(1)).alias("having")).where(F.col("df") >= least)
    vocabulary = common.written(vocabulary.select("lang", "term", "in_lang", "having"), "vocabulary")
    kept = common.written(words.drop("docs").join(vocabulary, ["lang", "term"]), "kept")

    # One row per group, with its language's numbers: sources, kept terms, tiles of either kind, blocks of sources.
    per_lang = counts.where("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    heavy = F.col("having") * MANY >= F.col("n_sources")
    # Terms are counted by the number of their sources before they meet their language's row.
    shares = vocabulary.groupBy("lang", "having").agg(F.count(F.lit(1)).alias("n"), F.sum("in_lang").alias("in_lang")).join(per_lang, "lang")
    shares = shares.groupBy("lang").agg(F.sum("n").alias("n_kept"), F.sum("in_lang").alias("lang_total"), F.sum(F.when(heavy, F.col("n")).otherwise(0)).alias("n_heavy"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(per_lang, "lang").join(shares, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
    up = lambda n, size: F.ceil(n / size).cast("long")
    groups = groups.withColumns({
        "tiles_heavy": F.greatest(F.lit(1), up(F.col("n_heavy"), tile)),
        "tiles_rare": up(F.col("n_kept") - F.col("n_heavy"), rare_tile),
        "blocks": up(F.col("n_sources"), sources),
        "bare": F.coalesce(share(F.lit(0), F.col("total"), F.col("n_kept")), F.lit(0)),
    })
    groups = common.written(groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")), "groups")

    posts = common.join_by_key(kept, groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("n_kept"))).withColumn("heavy", heavy)
    over = posts.withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("n_kept"))).where("p > q")
    terms = ranked(over.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term", top)

    placed = posts.withColumn("tile", F.pmod(F.xxhash64("term"), F.when(F.col("heavy"), F.col("tiles_heavy")).otherwise(F.col("tiles_rare")))).withColumn("kept", F.lit(0).cast("long"))
    kinds = F.array(F.struct(F.lit(True).alias("heavy"), F.col("tiles_heavy").alias("n")), F.struct(F.lit(False).alias("heavy"), F.col("tiles_rare").alias("n")))
    bare = groups.withColumn("kind", F.explode(kinds)).where("kind.n > 0").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kind.n") - 1)))
    bare = bare.withColumns({"heavy": F.col("kind.heavy"), "term": F.lit(None).cast("string"), "p": F.col("bare"), "kept": F.when(F.col("kind.heavy") & (F.col("tile") == 0), F.col("n_kept")).otherwise(0)})
    columns = ["lang", "source", "term", "p", "block", "blocks", "heavy", "tile", "kept"]
    dealt = placed.select(columns).unionByName(bare.select(columns)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "heavy", "tile", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "source", "term", "p", "block", "kept")
    sums = dealt.groupBy("lang", "heavy", "tile", "low", "high").applyInPandas(tile_sums, "lang string, one string, other string, value long").groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    pairs = sums.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value")
    return ranked(pairs, "pair").unionByName(terms)
