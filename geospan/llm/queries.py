"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.llm import decontaminate, divergence, exact_dedup, filter_audit, html_text, language_id, lm_score
from geospan.llm import near_dedup, packing, quality_rules, substring_dedup, toxicity, url_filter
from geospan.llm.common import held_out, table

#: Host and path rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]
VOCABULARY, TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", 2, 1024


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.train_dictionaries(docs.filter(~held_out("doc_id", 4)))
    return language_id.identify(docs.select("doc_id", "text"), learned).select(
        "doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring_dedup.remove_spans(docs, substring_dedup.repeated_spans(docs))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "block_score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm_score.train(docs.filter(~held_out("doc_id", 7)))
    return lm_score.score_texts(docs, model).withColumn("held_out", held_out("doc_id", 7))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                        public_tokenizers.PATTERN, END_ID, capacity=CAPACITY,
                        added=packing.added_tokens(public_tokenizers.path(TOKENIZER)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4))
    model = toxicity.train(docs, labels)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", held_out("doc_id", 4).alias("held_out"), F.col("toxicity").alias("score"),
        F.col("toxic").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_order_minhash, op3_language, op4_substring, op5_url_filter,
                                   op6_lm_score, op7_decontaminate, op8_exact_dedup, op9_pack, op10_toxicity,
                                   op11_divergence, op12_quality_rules, op13_filter_audit)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op8_exact_dedup": f"""
with d as (select doc_id, sha256({_FOLD}) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)""",
    "op4_substring": """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
f as (select h, min(doc_id) as lo from g group by h),
c as (select distinct g.doc_id, unnest(range(i, i + 13)) as i from g join f using (h) where lo < g.doc_id),
r as (select doc_id, list(i) as gone, count(*) as n from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(r.n, 0)::bigint as n_removed,
  sha256(array_to_string(case when r.n is null then w else list_filter(w, lambda x, k: not list_contains(gone, k)) end, ' '))
    as kept_sha256
from d left join r on r.doc_id = d.doc_id""",
    "op7_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(@d, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(@d, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
p as (select item, least(len(w), 13) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i, w from b where len(w) > 0),
q as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as phrase from p),
g as (select d.doc_id, k.n, i, array_to_string(w[i:i + k.n - 1], ' ') as phrase
  from (select distinct n from q) k, lateral (select doc_id, w, unnest(range(1, len(w) - k.n + 2)) as i
    from d) d),
h as (select g.doc_id, g.i, g.n, q.item from g join q on g.n = q.n and g.phrase = q.phrase),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
t as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items
  from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id""".replace("@d", _FOLD),
    "op11_divergence": r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(@d, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as lang_n from t group by lang, term having count(distinct r) >= 30),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by lang, source, term),
v as (select lang, count(*) as v, sum(lang_n) as total from k group by lang),
g as (select s.lang, s.source, coalesce(v.v, 0) as v, coalesce(sum(c.n), 0) as total, coalesce(v.total, 0) as lang_total
  from (select distinct lang, source from d) s left join v using (lang)
  left join c on c.lang = s.lang and c.source = s.source group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)::hugeint) // (g.total + 5 * g.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.lang_n + 5)::hugeint) // (g.lang_total + 5 * g.v)::hugeint as q
  from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item,
    coalesce((select sum(abs(x.p - y.p)) from p x join p y on x.term = y.term and y.lang = a.lang and y.source = b.source
      where x.lang = a.lang and x.source = a.source), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source),
ranked as (
  select lang, source, 'pair' as part, item, value,
    row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', term, (p - q)::bigint,
    row_number() over (partition by lang, source order by p - q desc, term) from p where n > 0 and p > q)
select lang, source, part, item, value, rank::integer as rank from ranked where part = 'pair' or rank <= 50""".replace("@d", _FOLD),
    "op13_filter_audit": r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    doc_id > min(doc_id) over (partition by coalesce(text, '')) as repeated from documents),
m as (select doc_id, part,
    (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(repeated, false)::int as mask from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from m left join l using (doc_id) group by part, mask),
b as (select letter, 1 << i as bit from (select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest(range(5)) as i)),
o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from b a, b, b c, b d, b e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (select filter_order, step, bits[step] as bit, list_sum(bits[1:step])::bigint as after from o, unnest(range(1, 6)) as u(step)),
r as (select part, filter_order, step, bit,
    sum(n) filter (mask & after = 0) as kept, sum(n) filter (mask & after = bit) as removed,
    sum(n) filter (mask & bit > 0 and mask & after <> bit) as redundant, sum(n) filter (mask = bit) as unique_fails,
    sum(good) filter (mask & after = bit) as good_lost, sum(toxic) filter (mask & after = bit) as toxic_lost
  from c, s group by all)
select part, filter_order, step::integer as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, bit))::bigint as shapley
from r""",
}
