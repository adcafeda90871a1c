"""License scans by diagonal voting, with DataFrame functions only.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased.  Each template's rolling word k-grams
(k is 2 for templates of up to four words, else 3) are hashed with their positions; the hashes of all k-grams of all
texts join them.  A hit at text word p and template word q votes for the diagonal p - q.  Votes are gathered per text,
template and diagonal.  Words put in or left out move the rest of a notice to a neighbouring diagonal, so each diagonal
is merged with those up to ``NEAR`` after it; what is merged never grows beyond that, so a long run of stray hits
can't swallow a notice.  A merged span is verified by the share of the template's k-grams that stand in it, each
counted once however often it is repeated, and by its length.  A base phrase stands at a diagonal if all its k-grams
vote there.

Templates are phrases, one-sentence notices and whole license texts.  Their hashes are sent to all executors: their
number is fixed by the lists below, not by the data.  Words are compared by 64-bit hashes of k-grams of such hashes.

Inputs: null and empty texts have no words; rows that share an id, or are equal, are separate rows; of equally good
spans all labels are given and the score is the same; very long texts are scanned whole, with 16 bytes held for each
word; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases: label and words.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

#: Further templates: label and the words of a notice.
TEMPLATES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license as published by the free software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
]

#: Whole license texts, which anyone may copy.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THIRD = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEXTS = [
    ("mit", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS} or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_THIRD} {_BSD_END}"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_AS_IS} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
]

#: Diagonals this close are one span; the share of k-grams that verifies it; its length in template lengths.
NEAR = 3
COVERAGE = 0.8
STRETCH = 1.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = -1


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def grams_of(hashes: Column, n: Column, k: int) -> Column:
    """The hashes of all k-grams; the word count goes in, so k-grams of different lengths never meet."""
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, base, grams (how many it has), words, at, gram: one row per template position, and one
    row that every text meets."""
    rows = [f"({i}, '{label}', {str(i < len(BASE)).lower()}, '{phrase}')" for i, (label, phrase) in enumerate([*BASE, *TEMPLATES, *TEXTS])]
    values = spark.sql("select * from values " + ", ".join(rows) + " as t(template, label, base, phrase)")
    values = values.withColumn("hashes", F.transform(F.split("phrase", " "), lambda w: F.xxhash64(w))).withColumn("words", F.size("hashes"))
    grams = F.when(F.col("words") <= 4, grams_of(F.col("hashes"), F.col("words"), 2)).otherwise(grams_of(F.col("hashes"), F.col("words"), 3))
    hashed = values.select("template", "label", "base", F.size(grams).alias("grams"), "words", F.posexplode(grams).alias("at", "gram"))
    mark = spark.sql(f"select {MARK} as template, '' as label, false as base, 0 as grams, 0 as words, 0 as at, {MARK}L as gram")
    return hashed.unionByName(mark)


def text_grams(docs: DataFrame) -> DataFrame:
    """doc_row, doc_id, n_words, pos, gram: all rolling k-grams of all texts, and one mark for each text.

    The position of a 2-gram is its first word; that of a 3-gram is shifted by the number of 2-grams.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("doc_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"),
    )
    rows = rows.select("doc_row", "doc_id", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))

    grams = lambda k: grams_of(F.col("hashes"), F.col("n_words"), k)
    every = F.concat(grams(2), grams(3), F.array(F.lit(MARK).cast("long")))
    return rows.select("doc_row", "doc_id", "n_words", F.posexplode(every).alias("pos", "gram"))


def votes(docs: DataFrame) -> DataFrame:
    """Votes per text, template and diagonal."""
    hits = text_grams(docs).join(F.broadcast(template_grams(docs.sparkSession)), "gram")
    short = F.greatest(F.col("n_words") - 1, F.lit(0))
    first = F.when(F.col("words") <= 4, F.col("pos")).otherwise(F.col("pos") - short)
    return (
        hits.withColumn("diagonal", F.when(F.col("template") != MARK, first - F.col("at")))
        .groupBy("doc_row", "doc_id", "n_words", "template", "label", "base", "grams", "words", "diagonal")
        .agg(F.count(F.lit(1)).alias("votes"), F.sort_array(F.collect_set("at")).alias("ats"))
    )


def spans(docs: DataFrame) -> DataFrame:
    """Merged diagonals: one row per text, template and diagonal with its coverage, begin and end word, whether it is
    verified, and whether it is the first of the neighbouring verified ones.

    A base phrase's full diagonals stay as they are.  Each text also has one row without a template.
    """
    by = Window.partitionBy("doc_row", "template").orderBy("diagonal")
    near = by.rangeBetween(0, NEAR)
    found = votes(docs).where("template = -1 or not base or votes = grams")
    found = found.withColumns({"low": F.col("diagonal") + F.get("ats", F.lit(0)), "high": F.col("diagonal") + F.element_at("ats", -1)})
    merged = found.withColumns(
        {
            # NEAR + 1 diagonals at most, each with at most the template's positions.
            "met": F.when(F.col("base"), F.col("votes")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(near))))),
            "begin": F.when(F.col("base"), F.col("low")).otherwise(F.min("low").over(near)),
            "last": F.when(F.col("base"), F.col("high")).otherwise(F.max("high").over(near)),
        }
    )
    k = F.when(F.col("words") <= 4, 2).otherwise(3)
    merged = merged.withColumn("end", F.col("last") + k).withColumn("coverage", F.when(F.col("template") == MARK, 0.0).otherwise(F.col("met") / F.col("grams")))
    merged = merged.withColumn("verified", (F.col("template") != MARK) & (F.col("coverage") >= COVERAGE) & (F.col("end") - F.col("begin") <= STRETCH * F.col("words")))
    before = F.last(F.when(F.col("verified"), F.col("diagonal")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return merged.withColumn("opens", F.col("verified") & (F.col("base") | before.isNull() | (F.col("diagonal") - before > NEAR)))


def scan(docs: DataFrame) -> DataFrame:
    """One row per text: words, places of base phrases, labels and a score (the best coverage of any template)."""
    base, verified = F.col("base"), F.col("verified")
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    return (
        spans(docs)
        .groupBy("doc_row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, True)).alias("n_base"),
            F.min(F.when(base, F.col("begin"))).alias("first_word"),
            F.max(F.when(base, F.col("begin"))).alias("last_word"),
            joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
            joined(F.collect_set(F.when(verified, F.col("label")))).alias("labels"),
            F.max("coverage").alias("score"),
            F.count(F.when(F.col("opens") & ~base, True)).alias("n_spans"),
        )
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            "n_base",
            F.col("first_word").cast("long").alias("first_word"),
            F.col("last_word").cast("long").alias("last_word"),
            "base_labels",
            "labels",
            "score",
            "n_spans",
        )
    )
