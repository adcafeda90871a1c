"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern per kind.  Each distinct entity (kind and canonical form, so that spellings of one
phone number or capitalisations of one address are the same entity) gets a keyed replacement of its kind; its
characters keep their class, so script, case, grouping and length stay; a card number keeps a valid check digit, an
IBAN valid check digits.  Every occurrence in the corpus gets the same replacement, in its own format.

Names are found by a title.  Each word of a name is an entity of its own, those before the first space of several as
given names of the title's gender (in Latin letters their surrogates end in "a" after a feminine title and in another
letter after a masculine one), the others as surnames; a double name with a hyphen has two words of one kind.  Letters
may carry combining marks, and both spellings of a letter are one; capitals may stand within a word (McDonald, O'Brien).
A text's titled mentions give it its name words, and these are replaced wherever they stand in that text as whole words,
with a title or without: "Mrs. Maria Lopez", "Mrs. Lopez" and "Maria Lopez" stay one person.  A name word that the text
also has in small letters (will, may) is replaced behind a title alone.

A phone number with a country code is another entity than the same digits without a plus sign, and keeps its code and a
bracketed trunk zero; with the country code 1 it is the entity that its last ten digits are without it.

Distinctness: replacements are proposed from a keyed SHA-512 of the entity.  A proposal that equals any entity of the
corpus, or one already given, or that two entities share, is drawn again for all but the first of them, until none
is left.  From the fifth draw on a proposal grows (a letter or digit every fourth draw; an address of four numbers
becomes a longer one), so every entity ends with one, however many short entities of one shape there are.  What the
loop keeps is one row per distinct entity, in the shared folder.

Inputs: null texts stay null; texts without entities stay as they are; rows that repeat get the same text; null ids
are allowed; equal proposals go to the least entity in text order; very long texts are scanned whole, by patterns
that try each run of signs once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common

#: Titles of each gender in the four languages of the corpus.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Señora", "Madame"], "m": ["Mr", "Herr", "Sr", "Señor", "Monsieur"]}

_ALL = "|".join(sorted(TITLES["f"] + TITLES["m"], key=len, reverse=True))

#: Kind and pattern, in the order in which they are tried at a place.  Groups don't capture.
KINDS = [
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", r"(?<!\d)(?:\d{4}[ \-]?){3}\d{4}(?!\d)|(?<!\d)3[47]\d{13}(?!\d)"),
    ("phone", r"(?<![\dA-Za-z])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<!\d)\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)"),
]

PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)

#: A word of a name: capitals, each with small letters after it, perhaps a capital and an apostrophe before them.
NAME_WORD = r"(?:\p{Lu}\p{M}*['’])?(?:\p{Lu}\p{M}*[\p{Ll}\p{M}]+)+"

#: A title and the words of a name after it.
NAME = rf"(?<![\p{{L}}\p{{M}}])(?:{_ALL})\.? {NAME_WORD}(?:[ \-]{NAME_WORD})*"

#: Letters with marks, and what they are made of: by Unicode's own table, from Latin to extended Greek.
COMPOSED = {unicodedata.normalize("NFD", c): c for c in map(chr, range(0xC0, 0x2000)) if unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)) == c != unicodedata.normalize("NFD", c)}

#: Country codes of one and two digits; all others have three.
SHORT_CODES = r"^(?:[17]|2[07]|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458])"

#: A quick test that ``PATTERN`` implies: every kind holds a digit or an @, but for secrets that are letters alone.
HINT = r"[@0-9]|[a-f]{40}|AKIA[A-Z]{16}|gh[pousr]_[A-Za-z]{36}"

#: Letters of a script and a case, to draw from.
ALPHABETS = [
    ("0123456789", "digit"),
    ("aeiou", "vowel"),
    ("bcdfghklmnprstvwz", "consonant"),
    ("AEIOU", "Vowel"),
    ("BCDFGHKLMNPRSTVWZ", "Consonant"),
    ("αεηιου", "greek vowel"),
    ("βγδζθκλμνπρτφχ", "greek consonant"),
    ("аеиоуя", "cyrillic vowel"),
    ("бвгдзклмнпрстфх", "cyrillic consonant"),
]
MEMBERS = {
    "digit": "0123456789",
    "vowel": "aeiouyáéíóúàèìòùâêîôûäëïöüãõåæøœ",
    "consonant": "bcdfghjklmnpqrstvwxzçñßšžčř",
    "Vowel": "AEIOUYÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÃÕÅÆØŒ",
    "Consonant": "BCDFGHJKLMNPQRSTVWXZÇÑŠŽČŘ",
    "greek vowel": "αεηιουωάέήίόύώ",
    "greek consonant": "βγδζθκλμνξπρσςτφχψ",
    "cyrillic vowel": "аеёиоуыэюя",
    "cyrillic consonant": "бвгджзйклмнпрстфхцчшщ",
}

#: Draws before a proposal begins to grow, and between one more sign and the next.
GROWS_AFTER = 4


def _mapped(word: Column, pattern: str, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(F.regexp_extract_all(word, F.lit(pattern), F.lit(0)), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")


def marks_joined(word: Column) -> Column:
    """A word with its combining marks in its letters, where there is such a letter."""
    return F.when(word.rlike(r"\p{M}"), _mapped(word, r"(?s).\p{M}*", COMPOSED)).otherwise(word)


def marks_apart(word: Column) -> Column:
    """A word with its letters' marks behind them."""
    return F.when(word.rlike(r"[^\x00-\x7F]"), _mapped(word, "(?s).", {c: apart for apart, c in COMPOSED.items()})).otherwise(word)


def name_words(text: Column) -> Column:
    """word, key and form of each name word of a text's titled mentions: ``g:f:`` or ``g:m:`` for a given name, ``s:``
    for a surname, then the word with joined marks, its key.  Sorted, so that of a word's forms the first is taken.
    """

    def of(raw: Column) -> Column:
        groups = F.split(F.regexp_replace(raw, rf"^(?:{_ALL})\.? ", ""), " ")
        gender = F.when(raw.rlike(rf"^(?:{'|'.join(TITLES['f'])})\.? "), F.lit("f")).otherwise(F.lit("m"))

        def words(group: Column, i: Column) -> Column:
            role = F.when((i == 0) & (F.size(groups) > 1), F.concat(F.lit("g:"), gender, F.lit(":"))).otherwise(F.lit("s:"))
            return F.transform(F.split(group, "-"), lambda w: common.let(marks_joined(w), lambda key: F.struct(w.alias("word"), key.alias("key"), F.concat(role, key).alias("form"))))

        return F.flatten(F.transform(groups, words))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), of))))


def pattern_of(names: Column, text: Column) -> Column:
    """What is looked for in a text: the kinds, and its name words as whole words (letters, marks and apostrophes), in
    either spelling, the longest first; those that the text has in small letters too behind a title alone.
    """
    every = F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n["word"], n["key"], marks_apart(n["key"])))))
    longest = F.transform(F.array_sort(F.transform(every, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])
    common_word = lambda w: F.regexp_like(text, F.concat(F.lit("(?<![\\p{L}\\p{M}])"), F.lower(w), F.lit("(?![\\p{L}\\p{M}])")))

    def of(words: Column) -> Column:
        plain, doubtful = F.filter(words, lambda w: ~common_word(w)), F.filter(words, common_word)
        some = lambda ws, before: F.when(F.size(ws) == 0, F.lit("")).otherwise(F.concat(F.lit(f"|(?<![\\p{{L}}\\p{{M}}]){before}(?:"), F.array_join(ws, "|"), F.lit(")(?![\\p{L}\\p{M}])")))
        return F.concat(F.lit(PATTERN), some(plain, ""), some(doubtful, rf"(?<=(?:{_ALL})\.? )"))

    return F.when(F.size(names) == 0, F.lit(PATTERN)).otherwise(common.let(longest, of))


def kind_of(raw: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(KINDS):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def digits_of(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\D", "")


def has_code(raw: Column) -> Column:
    """A number of ten digits after the country code 1."""
    return raw.startswith("+1") & (F.length(digits_of(raw)) == 11)


def without_trunk(raw: Column) -> Column:
    """A number with a country code, its bracketed trunk zero out of the digits' way."""
    return F.when(raw.startswith("+"), F.regexp_replace(raw, r"\(0\)", "(o)")).otherwise(raw)


def code_length(form: Column) -> Column:
    """The digits of a number's country code: those that its plus sign stands before, or, of a longer number without
    one, what stands before its last ten."""
    short = F.regexp_extract(F.substring(form, F.lit(2), F.length(form)), SHORT_CODES, 0)
    return F.when(form.startswith("+"), F.when(short != "", F.length(short)).otherwise(3)).otherwise(F.greatest(F.length(form) - 10, F.lit(0)))


def canonical(kind: Column, raw: Column, names: Column) -> Column:
    """One form for all spellings: digits alone, small letters, a name word with its role."""
    return (
        F.when(kind == "name", F.get(F.filter(names, lambda n: n["key"] == marks_joined(raw)), F.lit(0))["form"])
        .when((kind == "phone") & has_code(raw), F.substring(digits_of(raw), 2, 10))
        .when((kind == "phone") & raw.startswith("+"), F.concat(F.lit("+"), digits_of(without_trunk(raw))))
        .when(kind.isin("phone", "card", "ssn"), digits_of(raw))
        .when(kind == "email", F.lower(raw))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .otherwise(raw)
    )


def core_of(kind: Column, form: Column) -> Column:
    """The form as it stands in texts: what a surrogate must not be."""
    return F.when(kind == "name", F.regexp_replace(form, "^(?:g:[fm]|s):", "")).otherwise(form)


def _drawn(digest: Column, i: Column, n) -> Column:
    """A number below n from the i-th (of 62) pair of hex digits and its successor."""
    return F.conv(F.substr(digest, (i % 62) * 2 + 1, F.lit(4)), 16, 10).cast("int") % n


def _like(digest: Column, text: Column, hex_only: bool = False) -> Column:
    """The text with each character replaced by a drawn one of its class; a letter of another script by one of the
    letters that the text has, in its own case."""
    own = F.array_distinct(F.filter(F.split(F.lower(text), ""), lambda x: x.rlike(r"\p{L}")))

    def one(c: Column, i: Column) -> Column:
        if hex_only:
            return F.when(c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), _drawn(digest, i, 16) + 1, F.lit(1))).otherwise(c)
        letter = F.get(own, _drawn(digest, i, F.greatest(F.size(own), F.lit(1))))
        out = F.when(c.rlike(r"\p{L}"), F.when(c != F.lower(c), F.upper(letter)).otherwise(letter)).otherwise(c)
        for letters, name in reversed(ALPHABETS):
            out = F.when((c != "") & (F.instr(F.lit(MEMBERS[name]), c) > 0), F.substr(F.lit(letters), _drawn(digest, i, len(letters)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(number: Column) -> Column:
    """The number with its last digit set so that the check sum is right."""
    n = F.length(number)
    body = F.substring(number, F.lit(1), n - 1)
    digits = F.transform(F.split(body, ""), lambda c: c.cast("int"))
    size = n - 1
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when((size - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))
    )
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def iban_remainder(iban: Column) -> Column:
    """The number that an IBAN stands for, modulo 97: 1 if its check digits are right."""
    turned = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    step = lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step)


def _checked(country: Column, account: Column) -> Column:
    """The IBAN of an account, with its check digits."""
    digits = F.lpad((98 - iban_remainder(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    return F.concat(country, digits, account)


def proposal(kind: Column, form: Column, key: str, attempt: int) -> Column:
    """A canonical replacement of the entity."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, form, F.lit(str(attempt))), 512)
    more = attempt // GROWS_AFTER
    core = core_of(kind, form)
    rest = lambda c, begin: F.substring(c, F.lit(begin), F.length(c))
    zeros = F.lit("0" * more)
    host = F.substring_index(form, "@", -1)
    host_digest = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("host"), host), 512)
    tld = F.substring_index(host, ".", -1)
    local = _like(digest, F.concat(F.substring_index(form, "@", 1), F.lit("a" * more)))
    email = F.concat(local, F.lit("@"), _like(host_digest, F.substring(host, F.lit(1), F.length(host) - F.length(tld) - 1)), F.lit("."), tld)
    octets = F.array_join(F.transform(F.array(*[F.lit(i * 2) for i in range(4)]), lambda i: (_drawn(digest, i, 254) + 1).cast("string")), ".")
    groups = F.concat_ws(":", F.concat(F.lit("fd"), F.substring(digest, 1, 2)), *[F.substring(digest, 3 + 4 * i, 4) for i in range(7)])
    card = _luhn(F.concat(F.substring(form, 1, 1), rest(_like(digest, F.concat(form, zeros)), 2)))
    plus, code = F.when(form.startswith("+"), "+").otherwise(""), code_length(form)
    number = F.regexp_replace(form, r"^\+", "")
    phone = F.concat(plus, F.substring(number, F.lit(1), code), (_drawn(digest, F.lit(40), 8) + 2).cast("string"), F.substring(_like(digest, F.concat(number, zeros)), code + 2, F.length(number) + more))
    iban = _checked(F.substring(form, 1, 2), rest(_like(digest, F.concat(form, zeros)), 5))
    # A surname keeps its last letter where names end alike in many languages; a given name ends as its gender's do.
    head = _like(digest, F.concat(F.substring(core, F.lit(1), F.length(core) - 1), F.substring(F.repeat(F.lower(core), F.lit(more)), 1, more)))
    tail, drawn = F.substring(core, -1, 1), _like(digest, F.concat(core, F.lit(""))).substr(F.length(core), F.lit(1))
    latin = F.instr(F.lit(MEMBERS["vowel"] + MEMBERS["consonant"]), tail) > 0
    tail = (
        F.when(latin & form.startswith("g:f:"), F.lit("a"))
        .when(latin & form.startswith("g:m:"), F.substr(F.lit("bdklmnorst"), _drawn(digest, F.lit(45), 10) + 1, F.lit(1)))
        .when(tail.isin("a", "o"), tail)
        .otherwise(drawn)
    )
    ssn = F.concat((_drawn(digest, F.lit(41), 8) + 1).cast("string"), rest(_like(digest, F.concat(form, zeros)), 2))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", groups if more else octets)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "iban", iban)
        .when(kind == "name", F.concat(head, tail))
        .when(kind == "ssn", ssn)
        .when(form.rlike("^[0-9a-f]+$"), _like(digest, F.concat(form, zeros), hex_only=True))
        .otherwise(F.concat(F.substring(form, 1, 4), rest(_like(digest, F.concat(form, zeros)), 5)))
    )


def _laid(raw: Column, form: Column, place: str, other: str) -> Column:
    """The form's signs at the places of the occurrence that match ``place``; what is left of it follows."""
    seen = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), other, ""))
    filled = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike(place), F.substr(form, seen(i), F.lit(1))).otherwise(c)), "")
    return F.concat(filled, F.substring(form, F.length(F.regexp_replace(raw, other, "")) + 1, F.length(form)))


def poured(kind: Column, raw: Column, form: Column) -> Column:
    """The canonical replacement in the format of an occurrence."""
    number = F.when((kind == "phone") & has_code(raw), F.concat(F.lit("1"), form)).otherwise(F.regexp_replace(form, r"^\+", ""))
    cased = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(F.substr(raw, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(_laid(without_trunk(raw), number, "[0-9]", r"\D"), r"\(o\)", "(0)"))
        .when(kind == "email", cased)
        .when(kind == "iban", _laid(raw, form, "[^ ]", " "))
        .otherwise(form)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, form, surrogate of each distinct entity; no surrogate is shared or is itself an entity."""
    own = entities.select("kind", core_of(F.col("kind"), F.col("form")).alias("surrogate")).distinct()
    pending, given, attempt = entities, None, 0
    # Small rows that cost much to draw for: dealt over tasks by number, which isn't coalesced by size.
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        drawn = pending.repartition(tasks, "kind", "form").withColumn("surrogate", proposal(F.col("kind"), F.col("form"), key, attempt))
        free = drawn.join(own, ["kind", "surrogate"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("form").alias("form")).select("kind", "form", "surrogate")
        given = common.written(won if given is None else given.unionByName(won), "surrogates")
        pending, attempt = entities.join(given, ["kind", "form"], "left_anti"), attempt + 1
        if pending.isEmpty():
            return given


def replace(docs: DataFrame, key: str = "gridframe") -> DataFrame:
    """doc_id, text with surrogates, number of entities, and their kinds (sorted, comma-joined) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.withColumn("names", name_words(F.col("text")))
    hinted = F.col("text").rlike(HINT) | (F.size("names") > 0)
    found = F.when(hinted, F.regexp_extract_all("text", pattern_of(F.col("names"), F.col("text")), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = named.withColumn("found", found)
    plain = marked.where("text is null or size(found) = 0").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    holding = marked.where("text is not null and size(found) > 0").withColumn("text_key", F.xxhash64("text"))
    holding = common.written(holding, "texts-with-entities")
    spots = holding.select("doc_id", "text_key", "names", F.posexplode("found").alias("at", "raw")).withColumn("kind", kind_of(F.col("raw")))
    spots = spots.select("doc_id", "text_key", "at", "raw", "kind", canonical(F.col("kind"), F.col("raw"), F.col("names")).alias("form"))
    spots = common.written(spots, "entities")
    entities = common.written(spots.select("kind", "form").distinct(), "distinct-entities")
    given = surrogates(entities, key)
    # Rows of equal id and text have the same entities: a place counts once.
    met = common.join_by_key(spots, given, ["kind", "form"])
    placed = met.select("doc_id", "text_key", F.struct("at", poured(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new"), "kind").alias("e"))
    news = placed.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("e")).alias("news"))
    joined = holding.join(news.withColumnsRenamed({"doc_id": "d", "text_key": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
    pieces = F.split("text", pattern_of(F.col("names"), F.col("text")), -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, F.col("news.new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = joined.select(
        "doc_id", whole.alias("text"), F.size("news").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("news.kind")), ",").alias("kinds")
    )
    return plain.unionByName(changed)
