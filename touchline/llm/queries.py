"""The registered queries of this subpackage: each runs its operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import collocations as N
from touchline.llm import decontamination as D
from touchline.llm import hard_negatives as H
from touchline.llm import jaccard_join as J
from touchline.llm import license_scan as S
from touchline.llm import lm_scoring as L
from touchline.llm import packing as K
from touchline.llm import pii as P
from touchline.llm import quality_classifier as C
from touchline.llm import quality_rules as Q
from touchline.llm import token_counts as T
from touchline.llm import token_output as O
from touchline.llm import url_filters as U
from touchline.llm.tokens import public

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_STOPS = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)
QUALITY_SQL = rf"""
with split as (
  select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as ws,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls
  from documents),
spans as (select doc_id, unnest(range(1, len(ws) - 6)) as i, ws from split where len(ws) >= 8),
windows as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as w from spans),
again as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt
  from (select *, count(*) over (partition by doc_id, w) as c from windows) where c > 1),
repeats as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n from again group by doc_id),
stutters as (select doc_id, sum(case when ws[i] = ws[i - 1] then 1 else 0 end) as n
  from (select doc_id, ws, unnest(range(2, len(ws) + 1)) as i from split) group by doc_id),
counts as (
  select s.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    (length(array_to_string(ws, '')) - length(regexp_replace(array_to_string(ws, ''), '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words,
    len([x for x in ws if x in ({_STOPS})])::bigint as n_stop_words,
    len([x for x in ws if regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]')])::bigint as n_shouted,
    coalesce(t.n, 0)::bigint as n_stuttered
  from split s left join repeats r using (doc_id) left join stutters t using (doc_id)),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    array_to_string([x for x in [
      case when n_words < 20 then 'length' end,
      case when 100 * n_repeat_words > 30 * n_words then 'repeated_windows' end,
      case when 100 * word_chars < 200 * n_words or 100 * word_chars > 1500 * n_words then 'word_length' end,
      case when 100 * n_symbols > 20 * n_words then 'symbols' end,
      case when 100 * n_stop_words < 3 * n_words then 'stop_words' end,
      case when 100 * n_dup_lines > 50 * n_lines then 'duplicate_lines' end,
      case when 100 * n_shouted > 50 * n_words then 'shouted_words' end,
      case when 100 * n_stuttered > 30 * n_words then 'stuttered_words' end] if x is not null], ',') as failed_rules
  from counts)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_shouted, n_stuttered, base_failed,
  failed_rules = '' as kept, failed_rules
from judged
"""


@register("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return Q.quality_verdicts(table(spark, folder, "documents"))


JACCARD_SQL = r"""
with recursive words as (
  select doc_id, [x for x in regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as ws
  from documents),
places as (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) as i from words where len(ws) > 0),
shingles as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g from places),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from common join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select doc_id as u, doc_id as v from documents union select r.u, l.v from reach r join links l on r.v = l.u),
roots as (select u as doc_id, min(v) as component_id from reach group by u)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, r.component_id
from documents d join roots r using (doc_id) left join sizes s using (doc_id)
"""


@register("op2_jaccard_join", JACCARD_SQL)
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return J.jaccard_components(table(spark, folder, "documents"))


LEAKS_SQL = r"""
with d as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as ws from documents),
b as (
  select item_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as ws from benchmark),
phrases as (
  select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[i:i + 9], ' ') as p
  from (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) as i from b where len(ws) > 0)),
sizes as (select distinct n from phrases),
places as (select doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) as i from d, sizes where len(ws) >= n),
hits as (select doc_id, i, places.n, item_id from places join phrases on places.n = phrases.n and array_to_string(ws[i:i + places.n - 1], ' ') = p),
hit_words as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(i, i + n)) as w from hits) group by doc_id),
met as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ks
  from (select distinct doc_id, item_id::varchar as k from hits) group by doc_id),
ordered as (select *, max(i + n) over (partition by doc_id order by i, n rows between unbounded preceding and 1 preceding) as seen
  from (select distinct doc_id, i, n from hits)),
runs as (select *, sum(case when seen is null or i > seen then 1 else 0 end) over (partition by doc_id order by i, n) as run from ordered),
spans as (select doc_id, string_agg(s, ',' order by a) as spans
  from (select doc_id, min(i) - 1 as a, (min(i) - 1) || ':' || (max(i + n) - 1) as s from runs group by doc_id, run) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ks, '')) as items_sha256, n_hit is not null as contaminated, coalesce(spans, '') as spans
from d left join hit_words using (doc_id) left join met using (doc_id) left join spans using (doc_id)
"""


@register("op9_decontamination", LEAKS_SQL)
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return D.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op3_pii")
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return P.personal_data(table(spark, folder, "documents"))


@register("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = K.token_pieces(table(spark, folder, "documents"), public("word_bpe_49k.json"))
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return K.packed_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return C.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return L.document_scores(table(spark, folder, "documents"))


@register("op7_url_filters")
def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return U.url_verdicts(table(spark, folder, "pages"))


_NOTICES = ", ".join(f"('{name}', '{text}')" for name, text in S.TEMPLATES.items())
LICENSES_SQL = rf"""
with templates(name, text) as (values {_NOTICES}),
words as (
  select 'd' as kind, doc_id::varchar as k, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as ws from documents
  union all
  select 't', name, [x for x in regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] from templates),
places as (select kind, k, ws, unnest(range(1, len(ws) - 3)) as i from words where len(ws) >= 5),
shingles as (select kind, k, i, array_to_string(ws[i:i + 4], ' ') as g from places),
own as (select distinct k as name, g from shingles where kind = 't'),
sizes as (select name, count(*) as size from own group by name),
hits as (select s.k, s.i, s.g, o.name, z.size from shingles s join own o using (g) join sizes z using (name) where s.kind = 'd'),
good as (
  select a.k, a.name, a.i from hits a join hits b on a.k = b.k and a.name = b.name and b.i >= a.i and b.i < a.i + 2 * a.size
  group by a.k, a.name, a.i, a.size having 100 * count(distinct b.g) >= 80 * a.size),
named as (select k, count(distinct name) as n, string_agg(distinct name, ',' order by name) as names from good group by k)
select d.doc_id, coalesce(n, 0)::bigint as n_licenses, coalesce(names, '') as licenses
from documents d left join named on d.doc_id::varchar = k
"""


@register("op10_license_scan", LICENSES_SQL)
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return S.licenses(table(spark, folder, "documents"))


@register("op8_token_output")
def op8_token_output(spark: SparkSession, folder: str) -> DataFrame:
    path = O.token_files(table(spark, folder, "documents"), public("byte_bpe_50k.json"))
    return O.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@register("op13_token_counts")
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return T.token_counts(table(spark, folder, "documents"), public("byte_bpe_50k.json"), limit=1024)


HARD_NEGATIVES_SQL = """
with v as (
  select vec_id as id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, [floor(256 * x::double) for x in embedding] as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
anchors as (select distinct id, label, q from v where id % 100 = 0),
positives as (
  select * from (
    select *, row_number() over (partition by anchor_id, label, q order by score desc, positive_id) as place
    from (select a.id as anchor_id, a.label, a.q, b.id as positive_id, list_inner_product(a.q, b.q)::bigint as score
      from anchors a join v b on a.label = b.label and a.id <> b.id))
  where place <= 5),
negatives as (
  select anchor_id, positive_id, score as positive_score, b.id as negative_id, list_inner_product(p.q, b.q)::bigint as negative_score, p.label, p.q, p.place
  from positives p join v b on p.label <> b.label),
ranked as (
  select *, row_number() over (partition by anchor_id, label, q, place order by negative_score desc, negative_id) as r
  from negatives where 30 * positive_score <= 100 * negative_score and 100 * negative_score <= 90 * positive_score)
select anchor_id, positive_id, r::int as rank, negative_id, positive_score, negative_score from ranked where r <= 10
"""


@register("op12_hard_negatives", HARD_NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return H.hard_negatives(table(spark, folder, "embeddings"), label, F.col("_id") % 100 == 0)


COLLOCATIONS_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
split as (select lang, [x for x in regexp_split_to_array(p, '[\x20\x09]+') if x <> ''] as ws from pieces),
totals as (select lang, sum(len(ws))::bigint as n from split group by lang),
grams as (select lang, size, unnest([array_to_string(ws[i:i + size - 1], ' ') for i in range(1, len(ws) - size + 2)]) as phrase
  from split, (values (1), (2), (3)) as sizes(size) where len(ws) >= size),
counts as materialized (select lang, size, phrase, count(*)::bigint as f from grams group by all having count(*) >= 10),
parts as materialized (
  select lang, phrase, f as a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as tail
  from counts join (values (1), (2)) as ks(k) on k < size),
cuts as (
  select p.lang, p.phrase, a, k, l.f as l, r.f as r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score
  from parts p join counts l on l.lang = p.lang and l.phrase = p.head join counts r on r.lang = p.lang and r.phrase = p.tail),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as o from cuts) where o = 1),
around as (
  select lang, phrase, max(f) as f from (
    select lang, f, unnest([array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') for i in [1, 2]]) as phrase from counts where size = 3)
  group by lang, phrase),
kept as (select b.* from best b left join around o on o.lang = b.lang and o.phrase = b.phrase where o.f is null or 100 * o.f < 50 * b.a)
select * from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join totals using (lang))
where rank <= 2000
"""


@register("op11_collocations", COLLOCATIONS_SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return N.collocations(table(spark, folder, "documents"))
