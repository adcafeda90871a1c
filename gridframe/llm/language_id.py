"""Language identification by Bayesian fusion of evidence.

Evidence of one row: the text's likelihood under a character-trigram model of each language, the language that the
row declares (a markup attribute, or a table's own column), the country suffix of its address, and its host.  The
last three aren't trusted as given: grouped aggregation over all rows of what the texts say gives

- how often each declaration goes with each language (with smoothing), and
- a prior for each host, smoothed towards its suffix's, which is smoothed towards the whole corpus's.

From each of these sums a row's own vote is taken out before they judge it.  The posterior is the product.  A row is
rejected when it has no letter, or when its best language's posterior is below ``least`` or isn't wanted.

The text model is trained on a bounded sample: at most ``SAMPLE`` rows of each candidate language, those with the
least hashes, counted where they are: only sums by language and trigram class reach the driver.  Candidates are the
declared languages of at least ``LEAST_ROWS`` rows with a text, the ``LANGUAGES`` with most rows of them, so the table of
``FEATURES`` trigram classes x languages has at most 2**25 numbers, and tags that hardly any row has cost nothing.  A row
whose declared language has no model isn't rejected for it: where no candidate reaches ``least``, it is of the language
that it declares.  In a documents table the declaration is the column that also names the training rows; it is weighed
by how often the texts agree with it.

A row carries the languages that are within ``NEAR`` of its likeliest one by the text (in natural logarithms), as pairs,
and only these can be its language; sums by group are sums of such pairs.

Inputs: null and empty texts have no letter and are rejected, as are texts of digits, signs, emoji and the like; very
long texts are read whole, and the weight of their words is damped; of languages with equal posteriors the first by
name is taken; a null declaration, suffix or host is a value of its own; rows that share an id, or are equal, are
separate rows; an empty table gives no rows, and without a candidate rows with a letter keep the language that they
declare, while others are rejected; other columns are ignored, and kept by ``kept_documents``.
"""

from __future__ import annotations

import html
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm import common

#: Rows of each candidate that train the model, at most; the rows that make a candidate, and most candidates; classes.
SAMPLE, LEAST_ROWS, LANGUAGES = 500, 4, 512
FEATURES = 1 << 16

#: How far behind the likeliest language by its text a row's languages may be, and the least share that is summed.
NEAR, LEAST_SHARE = 30.0, 1e-6

#: A word's likelihoods aren't independent of the next word's: their sum is damped by this many words.
DAMP = 40.0

#: Words whose trigrams are made at once.
RUN = 20_000

#: Bytes of letters and marks, and those that may be; what isn't one separates words.
BREAKS = bytes(b if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Signs:
    """What each code point is: 1 a letter, 2 a mark, 3 neither; looked up once for each that is met."""

    def __init__(self):
        self.kinds = np.zeros(0x110000, np.uint8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kinds[codes]
        if not kinds.all():
            for code in np.unique(codes[kinds == 0]).tolist():
                self.kinds[code] = 1 if chr(code).isalpha() else 2 if unicodedata.category(chr(code))[0] == "M" else 3
            kinds = self.kinds[codes]
        return kinds


def trigrams(words: list[bytes], features: int, signs: Signs) -> tuple[np.ndarray, np.ndarray]:
    """The trigram classes of words, one word's after the other, and how many each has: none without a letter.

    Letters are made small; what is neither letter nor mark separates runs within a word, and each run has a space
    before and after it.
    """
    codes = np.frombuffer(b"\n".join(words).decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.concatenate([[10], codes, [10]]).astype(np.uint64)
    kinds = signs.of(codes)
    word = np.cumsum(codes == 10) - 1
    lettered = np.bincount(word[kinds == 1], minlength=len(words) + 1) > 0
    codes[kinds == 3] = 32
    middle = np.flatnonzero((kinds[1:-1] < 3) & lettered[word[1:-1]]) + 1
    mixed = common.mixed((codes[middle - 1] << np.uint64(42)) | (codes[middle] << np.uint64(21)) | codes[middle + 1])
    return (mixed % np.uint64(features)).astype(np.int64), np.bincount(word[middle], minlength=len(words))[: len(words)]


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """declared and text of at most ``per_language`` rows for each candidate language.

    A language's rows are thinned by their hash to about twice what is wanted before any is ranked, so what meets
    in one task is bounded by the sample, whatever the table's size.
    """
    named = docs.where("declared is not null and declared != '' and text != ''")
    counts = named.groupBy("declared").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= LEAST_ROWS).orderBy(F.desc("of"), "declared").limit(LANGUAGES)
    # One row for each candidate.
    hashed = named.withColumn("h", F.xxhash64("row_id", "text")).join(F.broadcast(counts), "declared")
    thin = hashed.where(F.pmod("h", F.lit(1 << 30)) < F.lit(2.0 * per_language) / F.col("of") * float(1 << 30))
    place = F.row_number().over(Window.partitionBy("declared").orderBy("h"))
    return thin.withColumn("place", place).where(F.col("place") <= per_language).select("declared", "text")


def train(docs: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the logarithm of each trigram class's share in each of them, from rows with a declaration."""
    common.tune(docs.sparkSession)
    picked = common.written(sample(docs, per_language), "language-sample")
    names = sorted(r["declared"] for r in picked.select("declared").distinct().collect())
    features = FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs()
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), common.texts(batch), strict=True):
                words = text.translate(BREAKS).split()
                for begin in range(0, len(words), RUN):
                    found, _ = trigrams(words[begin : begin + RUN], features, signs)
                    sums[lang] = sums.get(lang, 0) + np.bincount(found, minlength=features)
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["declared", "class", "n"])

    counts = picked.mapInArrow(run, "declared string, class int, n long").groupBy("declared", "class").agg(F.sum("n").alias("n"))
    table = np.zeros((features, max(1, len(names))), np.float32)
    # One row for each language, with its classes' sums.
    for row in counts.groupBy("declared").agg(F.collect_list("class").alias("at"), F.collect_list("n").alias("n")).toLocalIterator():
        table[np.array(row["at"], np.int64), names.index(row["declared"])] = row["n"]
    table += 0.1
    for i in range(table.shape[1]):  # one language after the other, so that no second table of doubles is made
        table[:, i] = np.log(table[:, i] / table[:, i].sum(dtype=np.float64))
    return names, table


class Likelihoods(dict):
    """A word to its row in a growing table of log likelihoods, and whether it has a letter.  Held words are dropped
    when there are ``limit`` of them.
    """

    def __init__(self, table: np.ndarray, limit: int = 100_000, most_values: int = 6_400_000):
        super().__init__()
        self.table, self.limit, self.signs = table, max(1, min(limit, most_values // table.shape[1])), Signs()
        self.values, self.lexical = np.zeros((1024, table.shape[1]), np.float32), np.zeros(1024, bool)

    def likelihood(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' log likelihoods, and which of them have a letter."""
        found, n = trigrams(words, len(self.table), self.signs)
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        begins = np.cumsum(n) - n
        if len(found):
            out[n > 0] = np.add.reduceat(self.table[found], begins[n > 0], axis=0)
        return out, n > 0

    def learn(self, words: list[bytes]) -> None:
        for begin in range(0, len(words), RUN):
            part = words[begin : begin + RUN]
            at = len(self)
            while at + len(part) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
                self.lexical = np.concatenate([self.lexical, np.zeros_like(self.lexical)])
            self.values[at : at + len(part)], self.lexical[at : at + len(part)] = self.likelihood(part)
            self.update(zip(part, range(at, at + len(part)), strict=True))

    def of(self, text: bytes) -> tuple[int, np.ndarray]:
        """How many words with a letter the text has, and its damped log likelihoods."""
        total, n = np.zeros(self.table.shape[1]), 0
        words = text.translate(BREAKS).split()
        # Scripts without spaces make long words: they count like any other, but aren't held.
        long = [w for w in words if len(w) > 64]
        if long:
            words = [w for w in words if len(w) <= 64]
            for w in long:
                value, lexical = self.likelihood([w])
                total += value[0]
                n += int(lexical[0])
        for begin in range(0, len(words), self.limit):
            part = words[begin : begin + self.limit]
            new = [w for w in dict.fromkeys(part) if w not in self]
            if len(self) + len(new) > self.limit:
                self.clear()
                new = list(dict.fromkeys(part))
            if new:
                self.learn(new)
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            total += self.values[at].sum(axis=0, dtype=np.float64)
            n += int(self.lexical[at].sum())
        return n, (total * (DAMP / (DAMP + n))).astype(np.float32)


class Model:
    """What is sent to the executors; the words that were met stay with it in a worker for its next tasks."""

    def __init__(self, table: np.ndarray):
        self.table, self.met = table, None

    def likelihoods(self) -> Likelihoods:
        if self.met is None:
            self.met = Likelihoods(self.table)
        return self.met


def pairs(at: list[np.ndarray], values: list[np.ndarray], name: str) -> pa.ListArray:
    """Lists of (language, value) structs."""
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *at]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *values]))], names=["l", name])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, at)]), pa.int32()), flat)


def text_evidence(rows: DataFrame, table: np.ndarray, entities: bool) -> DataFrame:
    """row columns without the text, with the number of words with a letter, the log likelihoods of the languages near
    the likeliest (``likely``), and what the text says: their shares that count (``said``).  Both are empty without a
    letter.  With ``entities``, character entities of markup are decoded first.
    """
    shared = rows.sparkSession.sparkContext.broadcast(Model(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.likelihoods()
        for batch in batches:
            texts = common.texts(batch)
            if entities:
                texts = [html.unescape(t.decode()).encode("utf-8", "replace") if b"&" in t else t for t in texts]
            found, near, logs, told, shares = [], [], [], [], []
            for n, x in map(model.of, texts):
                found.append(n)
                x = x.astype(np.float64) - x.max()
                p = np.exp(x)
                p /= p.sum()
                near.append(np.flatnonzero(x >= -NEAR) if n else np.zeros(0, np.int64))
                logs.append(x[near[-1]])
                told.append(np.flatnonzero(p >= LEAST_SHARE) if n else np.zeros(0, np.int64))
                shares.append(p[told[-1]])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in ("row_id", "text_key", "declared", "suffix", "host")], pa.array(found, pa.int64()), pairs(near, logs, "v"), pairs(told, shares, "p")],
                names=["row_id", "text_key", "declared", "suffix", "host", "n_lexical", "likely", "said"],
            )

    return rows.select("row_id", F.xxhash64("text").alias("text_key"), "declared", "suffix", "host", "text").mapInArrow(run, "row_id long, text_key long, declared string, suffix string, host string, n_lexical long, likely array<struct<l:int,v:double>>, said array<struct<l:int,p:double>>")


def _sums(said: DataFrame, name: str, *by: str) -> DataFrame:
    """Soft counts by a group, a map of its languages (``name``), and their total (``name``_total): partial sums leave
    the tasks, so a host of any size is cheap, and a group holds the languages that it has.
    """
    sums = said.groupBy(*by, "l").agg(F.sum("p").alias("p"))
    return sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("l", "p"))).alias(name), F.sum("p").alias(f"{name}_total"))


def identify(rows: DataFrame, names: list[str], table: np.ndarray, strength: float = 20.0, least: float = 0.7, wanted: list[str] | None = None, entities: bool = False) -> DataFrame:
    """row_id, text_key, lang, posterior, text_lang, n_lexical, kept of each row of (row_id, text, declared, suffix, host)."""
    n = max(1, len(names))
    filled = rows.select("row_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "declared", "suffix", "host")])
    seen = common.written(text_evidence(filled, table, entities), "language-evidence")
    # Only rows with letters say something about their group.
    said = seen.select("declared", "suffix", "host", F.explode("said").alias("s")).select("declared", "suffix", "host", "s.l", "s.p")
    sums = {r["l"]: r["p"] for r in said.groupBy("l").agg(F.sum("p").alias("p")).collect()}
    corpus = [sums.get(i, 0.0) for i in range(n)]
    suffixes = _sums(said, "by_suffix", "suffix")
    hosts = _sums(said, "by_host", "host", "suffix").join(suffixes, "suffix")
    declared = _sums(said, "by_declared", "declared").drop("by_declared_total")
    # One host or declaration may have a third of the rows.
    joined = common.join_by_key(seen, hosts, ["host", "suffix"], "left")
    joined = common.join_by_key(joined, declared, ["declared"], "left", counted=seen)

    def fused(c: Column) -> Column:
        """A language's logarithm: its likelihood, its prior at the host, and how it goes with the declaration, each
        without the row's own vote.
        """
        own = F.coalesce(F.get(F.filter("said", lambda s: s["l"] == c["l"]), F.lit(0))["p"], F.lit(0.0))
        of = lambda name: F.greatest(F.coalesce(F.try_element_at(F.col(name), c["l"]), F.lit(0.0)) - own, F.lit(0.0))
        total = lambda name: F.greatest(F.coalesce(F.col(f"{name}_total"), F.lit(0.0)) - F.col("own_total"), F.lit(0.0)) + strength
        whole = F.get(F.lit([(x + strength / n) / (sum(corpus) + strength) for x in corpus]), c["l"])
        prior = (of("by_host") + strength * (of("by_suffix") + strength * whole) / total("by_suffix")) / total("by_host")
        # P(declared | language): the share of the language's soft counts that has the declaration.
        every = F.greatest(F.get(F.lit(corpus), c["l"]) - own, F.lit(0.0)) + strength
        given = F.when(F.col("declared") == "", F.lit(1.0)).otherwise((of("by_declared") + 0.5) / every)
        return F.struct((c["v"] + F.log(prior) + F.log(given)).alias("v"), (-c["l"]).alias("l"))

    joined = joined.withColumn("own_total", F.aggregate("said", F.lit(0.0), lambda a, s: a + s["p"]))
    best = lambda logs: common.let(F.array_max(logs), lambda top: F.struct(F.try_divide(F.lit(1.0), F.aggregate(logs, F.lit(0.0), lambda a, c: a + F.exp(c["v"] - top["v"]))).alias("posterior"), (-top["l"]).alias("at")))
    by_text = -F.array_max(F.transform("likely", lambda c: F.struct(c["v"].alias("v"), (-c["l"]).alias("l"))))["l"]
    out = joined.select("row_id", "text_key", "declared", "n_lexical", by_text.alias("by_text"), common.let(F.transform("likely", fused), best).alias("best"))
    labels = F.lit(names) if names else F.array(F.lit(None).cast("string"))
    lettered = F.col("n_lexical") > 0
    posterior = F.when(lettered & F.lit(bool(names)), F.col("best.posterior")).otherwise(0.0)
    own_word = lettered & (F.col("declared") != "") & (~F.col("declared").isin(names) if names else F.lit(True)) & (posterior < least)
    lang = F.when(own_word, F.col("declared")).when(lettered, F.get(labels, F.col("best.at")))
    known = F.lit(True) if wanted is None else lang.isin(*wanted)
    kept = F.coalesce(lettered & (own_word | (posterior >= least)) & known, F.lit(False))
    return out.select("row_id", "text_key", lang.alias("lang"), posterior.alias("posterior"), F.when(lettered, F.get(labels, F.col("by_text"))).alias("text_lang"), "n_lexical", kept.alias("kept"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence of a documents table: its language column is the declaration, its source the host."""
    return docs.select(
        F.col("doc_id").cast("long").alias("row_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), primary(F.col("lang")).alias("declared"), F.lit("").alias("suffix"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: the markup's language attribute, the address's host and suffix, the text without markup
    (with its character entities, which are decoded where it is read)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]*)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("row_id"),
        body.alias("text"),
        primary(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z\-]+)", 1)).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"),
        host.alias("host"),
    )


def primary(tag: Column) -> Column:
    """The first part of a language tag, in small letters."""
    return F.lower(F.substring_index(F.coalesce(tag.cast("string"), F.lit("")), "-", 1))


def documents(docs: DataFrame, least: float = 0.7, wanted: list[str] | None = None) -> DataFrame:
    """doc_id and verdict of each row."""
    rows = of_documents(docs)
    names, table = train(rows)
    return identify(rows, names, table, least=least, wanted=wanted).withColumnRenamed("row_id", "doc_id")


def kept_documents(docs: DataFrame, least: float = 0.7, wanted: list[str] | None = None) -> DataFrame:
    """``docs`` without the rows that are rejected; a row is known by its id and its text."""
    gone = documents(docs, least, wanted).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(text) == gone["gone_text"]), "left_anti")


def pages(web: DataFrame, docs: DataFrame, least: float = 0.7) -> DataFrame:
    """The pages' languages, with a text model from documents."""
    names, table = train(of_documents(docs))
    return identify(of_pages(web), names, table, least=least, entities=True).withColumnRenamed("row_id", "page_id")
