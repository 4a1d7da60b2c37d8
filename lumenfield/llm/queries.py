"""The queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, html_extract, language_model, line_dedup, near_dup, packing, prefix_trie, quality_classifier, quality_rules, source_divergence, suffix_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge_narrow(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=suffix_dedup.PASSAGE_WORDS)
    passages = F.size("passages").cast("long").alias("n_passages")  # what 400 bytes leave: repeated passages of over 50 words
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), passages)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "quality"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_read(spark, sf_dir, "embeddings"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_read(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.shared_openings(*prefix_trie.numbered_turns(_read(spark, sf_dir, "conversations"))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_minhash_near_dedup, op4_best_fit_packing, op5_suffix_array_dedup, op6_language_model, op7_quality_classifier, op8_embedding_near_dedup, op9_html_extraction, op10_line_dedup, op11_source_divergence, op12_prefix_trie, op13_exact_dedup)}


_OP1 = r"""
with w as (
  select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as tri,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
r as (
  select doc_id, count(distinct p) as n_repeat_words from (
    select doc_id, unnest([i, i + 1, i + 2]) as p from (
      select doc_id, i, count(*) over (partition by rid, x) as c from (
        select doc_id, rid, unnest(tri) as x, unnest(range(1, len(tri) + 1)) as i from (select *, row_number() over () as rid from g) a) b) d
    where c >= 2) e group by doc_id),
c as (
  select g.doc_id, source, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from g left join r on g.doc_id = r.doc_id),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from c),
h as (select source, count(*) as n, sum(cast(base_failed as int)) as f from b where source is not null group by source),
p as (select avg(f / n) as m, var_samp(f / n) as v, avg(1.0 / n) as inv from h),
q as (select m, case when v > m * (1 - m) * inv then greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 0.0) when v is null then 0.0 else 1000.0 end as s from p),
k as (select source, (f + m * s) / (n + s) as rate from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and coalesce(rate <= 0.5, true)) as kept
from b left join k on b.source = k.source
"""

_OP10 = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos from documents),
k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
d as (select k.doc_id, pos, line, coalesce(first < doc_id, false) as dropped from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, cast(sum(cast(dropped as int)) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from d group by doc_id
"""


_OP8 = r"""
with recursive e as (
  select a.vec_id as src, b.vec_id as dst from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.93),
c as (select vec_id as node, vec_id as seen from embeddings union select c.node, e.dst from c join e on c.seen = e.src),
m as (select node, min(seen) as component_id from c group by node)
select v.vec_id, coalesce(n, 0) as n_links, component_id, v.vec_id = component_id as kept
from embeddings v join m on v.vec_id = m.node left join (select src, count(*) as n from e group by src) d on v.vec_id = d.src
"""


_OP11 = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
o as (select r, lang, source, unnest(terms) as term from d),
k as (select lang, term, count(*) as lang_n from o group by lang, term having count(distinct r) >= 30),
v as (select lang, count(*) as v, sum(lang_n) as lang_total from k group by lang),
c as (select o.lang, o.source, o.term, count(*) as n from o join k on o.lang = k.lang and o.term = k.term group by o.lang, o.source, o.term),
g as (select distinct lang, source from d),
t as (select lang, source, sum(n) as total from c group by lang, source),
p as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n,
    1 + (1000000000 * (cast(coalesce(n, 0) as hugeint) + 5)) // (cast(coalesce(total, 0) as hugeint) + 5 * v) as p,
    1 + (1000000000 * (cast(lang_n as hugeint) + 5)) // (cast(lang_total as hugeint) + 5 * v) as q
  from g join k on g.lang = k.lang join v on g.lang = v.lang left join t on g.lang = t.lang and g.source = t.source
    left join c on g.lang = c.lang and g.source = c.source and k.term = c.term),
s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
u as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on a.lang = s.lang and a.source = s.source and b.source = s.item
  union all select lang, source, 'term', term, cast(p - q as bigint) from p where n > 0 and p > q)
select lang, source, part, item, value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from u) x
where part = 'pair' or rank <= 50
"""

_OP12 = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) as turn
  from conversations where conv_id is not null),
o as (select conv_id, list(turn order by place) as own from t group by conv_id),
h as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(conv_id::varchar) + 1), lambda i: unicode(substr(conv_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 6 as h from o),
s as (select h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) as seq from h left join o b on b.conv_id = h.conv_id - h.conv_id % 100),
p as (select conv_id, unnest(range(0, len(seq) + 1)) as depth, seq from s),
q as (select conv_id, depth, len(seq) as n, seq[1:depth] as node, seq[1:depth - 1] as above from p),
m as (
  select depth, node, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = n), '')) as ends_sha256
  from q group by depth, node),
k as (select m.*, coalesce(c.n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * length(node[depth].x) end as own
  from m left join (select depth - 1 as d, above as a, count(*) as n_children from m where depth > 0 group by all) c on c.d = m.depth and c.a = m.node),
u as (select unnest(range(0, depth + 1)) as depth, node, own, n_children from k),
r as (select depth, node[1:depth] as node, sum(own) as saved_tokens, sum(cast(n_children = 0 as int)) as n_leaves from u group by depth, node[1:depth])
select k.conv_id, k.depth, z.conv_id as parent_conv_id, k.n_convs, k.n_children, cast(r.n_leaves as bigint) as n_leaves, cast(r.saved_tokens as bigint) as saved_tokens, k.ends_sha256
from k join r on k.depth = r.depth and k.node = r.node left join k z on z.depth = k.depth - 1 and z.node = k.above
"""

_OP13 = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "op8_embedding_near_dedup": _OP8, "op10_line_dedup": _OP10, "op11_source_divergence": _OP11, "op12_prefix_trie": _OP12, "op13_exact_dedup": _OP13}
