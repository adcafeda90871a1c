"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import (
    common,
    decontaminate,
    divergence,
    language_id,
    license_scan,
    mixing,
    pii,
    quality_knn,
    quality_rules,
    ranked_search,
    simhash,
    substring_dedup,
    token_counts,
    token_output,
)

#: The end id that op2 appends to each document.
END_ID = 2

#: Target weights of op10 and of the pipeline's mix; sources that aren't named are pooled with weight 1.
MIX = {"src0": 8, **{f"src{i}": 4 for i in range(1, 8)}, **{f"src{i}": 2 for i in range(8, 20)}}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    token_output.write_tokens(common.table(spark, sf_dir, "documents"), path, tokenizer_file(), END_ID)
    return token_output.digests(spark, path)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(common.table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(common.table(spark, sf_dir, "documents"))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.documents(common.table(spark, sf_dir, "documents")).drop("text_key")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.pages(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "documents")).drop("text_key")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"), distance=2)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(common.table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.placed(common.table(spark, sf_dir, "documents"), MIX, carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "mix_source", "block", "in_block", "slot", "release", "deadline")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(common.table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_output": op2_token_output,
    "op3_license_scan": op3_license_scan,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality_knn": op6_quality_knn,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_ranked_search": op11_ranked_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_counts": op13_token_counts,
    "language_id_pages": language_id_pages,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5_SQL = f"""with d as (select row_number() over () as r, doc_id, {PLAIN} as ws from documents),
b as (select item_id, {PLAIN} as ws from benchmark), k as (select item_id, ws, least({decontaminate.WINDOW}, len(ws)) as k from b where len(ws) > 0),
iw as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as w from (select *, unnest(range(1, len(ws) - k + 2)) as i from k)),
dw as (select r, k, i, array_to_string(ws[i:i + k - 1], ' ') as w from (select r, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, (select distinct k from k))),
h as (select r, i, dw.k, item_id from dw join iw on iw.k = dw.k and iw.w = dw.w),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from h) group by r),
t as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join t using (r)"""

OP7_SQL = f"""with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from documents),
w as (select r, i, md5(array_to_string(ws[i:i + {substring_dedup.SIZE - 1}], ' ')) as w from (select r, ws, unnest(range(1, len(ws) - {substring_dedup.SIZE - 2})) as i from d where len(ws) >= {substring_dedup.SIZE})),
again as (select w from w group by w having count(*) > 1),
hit as (select distinct r, unnest(range(i, i + {substring_dedup.SIZE})) as p from w where w in (select w from again)),
each as (select r, generate_subscripts(ws, 1) as p, unnest(ws) as x from d),
kept as (select r, string_agg(x, ' ' order by p) as t from each anti join hit using (r, p) group by r), n as (select r, count(*) as n from hit group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (r) left join n using (r)"""

GRID_SQL = "[" + ", ".join(map(str, quality_rules.GRID)) + "]"
METRICS_SQL = ", ".join(f"{{'rule': '{rule}', 'metric': ({metric})::double}}" for rule, metric in sorted(quality_rules.RULES.items()))
N_RULES = len(quality_rules.RULES)

#: Cutoffs: the last of the grid before the first whose exact binomial tail is too heavy, per stratum and rule.
OP9_SQL = f"""with d as (select row_number() over () as r, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
s as (select r, doc_id, stratum, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
w as (select r, i, array_to_string(ws[i:i + {quality_rules.WINDOW - 1}], ' ') as w from (select r, ws, unnest(range(1, len(ws) - {quality_rules.WINDOW - 2})) as i from s where len(ws) >= {quality_rules.WINDOW})),
again as (select r, w from w group by r, w having count(*) > 1),
rep as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(i, i + {quality_rules.WINDOW})) as p from w join again using (r, w)) group by r),
f as (select r, doc_id, stratum, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls)::bigint as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_upper from s left join rep using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f),
m as (select r, doc_id, stratum, base_failed, u.rule as rule, u.metric as metric from (select *, unnest([{METRICS_SQL}]) as u from b)),
good as (select doc_id from labels where doc_id is not null and quality is not null group by doc_id having max(quality) = 1),
held as (select * from m where not base_failed and doc_id in (select doc_id from good)),
grid as (select unnest(range(1, {len(quality_rules.GRID)} + 1)) as g, unnest({GRID_SQL}) as cutoff),
k as (select stratum, rule, g, cutoff, count(*) as n, count(*) filter (metric > cutoff) as k from held, grid group by all),
p as (select *, 0.02::double / {N_RULES} as p, 0.05::double / ({N_RULES} * (select count(distinct stratum) from held)) as level from k),
tail as (select *, k > n * p or (case when k >= n then 1.0 else (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))) from (select unnest(range(0, k + 1)) as i)) end) > level as fails from p),
stop as (select stratum, rule, coalesce(min(g) filter (fails), {len(quality_rules.GRID)} + 1) as g from tail group by stratum, rule),
cut as (select stop.stratum, stop.rule, cutoff from stop join grid on grid.g = stop.g - 1),
fired as (select r, string_agg(rule, ',' order by rule) as rejected_by from m join cut using (stratum, rule) where metric > cutoff group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rejected_by is null as kept, coalesce(rejected_by, '') as rejected_by from b left join fired using (r)"""

TEMPLATES_SQL = ", ".join(f"({i}, '{label}', {str(i < len(license_scan.BASE)).lower()}, '{phrase}')" for i, (label, phrase) in enumerate([*license_scan.BASE, *license_scan.TEMPLATES, *license_scan.TEXTS]))

OP3_SQL = f"""with t as (select *, case when len(ts) <= 4 then 2 else 3 end as k from (select template, label, base, string_split(phrase, ' ') as ts from (values {TEMPLATES_SQL}) as v(template, label, base, phrase))),
tg as (select template, label, base, k, len(ts) as words, len(ts) - k + 1 as grams, q, array_to_string(ts[q + 1:q + k], ' ') as g from (select *, unnest(range(0, len(ts) - k + 1)) as q from t)),
d as (select row_number() over () as r, doc_id, {PLAIN} as ws from documents),
dg as (select r, k, p, array_to_string(ws[p + 1:p + k], ' ') as g from (select r, ws, k, unnest(range(0, len(ws) - k + 1)) as p from d, (values (2), (3)) as x(k) where len(ws) >= k)),
v as (select r, template, label, base, tg.k as k, words, grams, p - q as dia, list(q) as qs, count(*) as votes, min(p) as low, max(p) as high from dg join tg on dg.k = tg.k and dg.g = tg.g group by all),
f as (select * from v where not base or votes = grams),
m as (select *, case when base then votes else len(list_distinct(flatten(list(qs) over near))) end as met, case when base then low else min(low) over near end as beginning, case when base then high else max(high) over near end as last_gram
  from f window near as (partition by r, template order by dia range between current row and {license_scan.NEAR} following)),
c as (select *, met / grams as coverage, met / grams >= {license_scan.COVERAGE} and last_gram + k - beginning <= {license_scan.STRETCH} * words as verified from m),
o as (select *, max(case when verified then dia end) over (partition by r, template order by dia rows between unbounded preceding and 1 preceding) as earlier from c),
a as (select r, count(*) filter (base) as n_base, min(beginning) filter (base) as first_word, max(beginning) filter (base) as last_word, string_agg(distinct label, ',' order by label) filter (base) as base_labels,
  string_agg(distinct label, ',' order by label) filter (verified) as labels, max(coverage) as score, count(*) filter (verified and not base and (earlier is null or dia - earlier > {license_scan.NEAR})) as n_spans from o group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score, coalesce(n_spans, 0)::bigint as n_spans
from d left join a using (r)"""

OP11_SQL = f"""with d as (select row_number() over () as r, doc_id, {PLAIN} as ws from documents), n as (select count(*) as n, sum(len(ws))::bigint as l from d where len(ws) > 0),
b as (select row_number() over () as q, item_id, {PLAIN} as ws from benchmark), qt as (select q, term, count(*) as times from (select q, unnest(ws) as term from b) group by all),
tf as (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) where term in (select term from qt) group by all),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, n group by term, n),
m as (select r, doc_id, 100 - {ranked_search.PRICE} + ({ranked_search.PRICE} * len(ws)::bigint * n) // l as m from d, n where len(ws) > 0),
s as (select q, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from qt join tf using (term) join w using (term) join m using (r) group by q, r),
k as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id asc nulls last) as rank from s join m using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from k join b using (q) where rank <= {ranked_search.BEST}"""

LETTER_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {LETTER_WORDS} as ws from documents),
w as (select r, lang, source, unnest(ws) as term from d), g as (select distinct lang, source from d),
k as (select lang, term, count(*) as total from w group by lang, term having count(distinct r) >= {divergence.LEAST}),
c as (select lang, source, term, count(*) as c from w join k using (lang, term) group by all),
v as (select lang, count(*) as v, sum(total) as n from k group by lang), gn as (select lang, source, sum(c) as n from c group by all),
p as (select lang, source, term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 5)) // (coalesce(gn.n, 0) + 5 * v) as p, 1 + (1000000000::hugeint * (total + 5)) // (v.n + 5 * v) as q
  from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join gn using (lang, source)),
f as (select a.lang as lang, a.source as source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
o as (select * from pairs union all select lang, source, 'term', term, (p - q)::bigint from p where c > 0 and p > q),
k2 as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from o)
select lang, source, part, item, value, rank::int as rank from k2 where part = 'pair' or rank <= {divergence.TOP}"""

#: The others are trained models, connected components, schedules and encodings, which SQL can't state.
ORACLES: dict = {"op11_ranked_search": OP11_SQL, "op12_source_divergence": OP12_SQL, "op3_license_scan": OP3_SQL, "op5_decontaminate": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op9_quality_rules": OP9_SQL}
