"""Each corpus operator as a query on the supplied tables, and the SQL it has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from caseloom.llm import byte_bpe, decontaminate, hard_negatives, html_extract, licenses, line_dedup, near_dedup, packing, quality_classifier, quality_rules, secrets, url_filter, whitening
from caseloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")), n_grades=3)
    graded = quality_classifier.grade_documents(docs, model)
    return graded.select("doc_id", "score", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"),
                         (F.col("tails")[0] >= 0.5).alias("kept"))


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


ORACLES["op2_url_filters"] = r"""
with split as (
  select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(r_host, r_path, r_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select page_id, r_host || r_path as rule, r_verdict,
         row_number() over (partition by page_id order by length(r_host) desc, length(r_path) desc) as nth
  from split join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select s.page_id, coalesce(s.host, '') as host, coalesce(s.path, '') as path, f.rule, coalesce(f.r_verdict, 'allow') as verdict
from split s left join fits f on s.page_id = f.page_id and f.nth = 1
"""


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


#: Words as the contracts of operators 3 and 4 read them, from a text whose A-Z are lower-cased.
_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op3_decontamination"] = f"""
with recursive items as (select cast(item_id as varchar) as item_id, {_WORDS_SQL} as words from benchmark),
sized as (select item_id, words, least(len(words), 13) as size from items where len(words) > 0),
item_windows as (
  select distinct item_id, size, array_to_string(words[pos:pos + size - 1], ' ') as run
  from (select item_id, words, size, unnest(range(1, len(words) - size + 2)) as pos from sized)),
docs as (select row_number() over () as nth, doc_id, {_WORDS_SQL} as words from documents),
sizes as (select distinct size from item_windows),
places as (
  select nth, size, pos, array_to_string(words[pos:pos + size - 1], ' ') as run
  from (select nth, words, size, unnest(range(1, len(words) - size + 2)) as pos from docs join sizes on len(words) >= size)),
met as (select nth, pos, size, item_id from places join item_windows using (size, run)),
hit as (select nth, count(distinct word) as n_hit from (select nth, unnest(range(pos, pos + size)) as word from met) group by nth),
named as (select nth, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from met group by nth)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from docs left join hit using (nth) left join named using (nth)
"""


@query
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda d: d["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), licenses.words_before(F.array_min(starts)).alias("first_word"),
        licenses.words_before(F.array_max(starts)).alias("last_word"), licenses.labels_of(F.col("base")).alias("base_labels"),
        licenses.labels_of(F.concat("base", "notices")).alias("labels"), "score")


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


#: The fixed measures of a text, then the thresholds of its group: quantiles of bucketed values, a group of under 200
#: documents taking its language's, a language as small the corpus's.
ORACLES["op6_quality_rules"] = r"""
with docs as (
  select row_number() over () as nth, doc_id, lang, source, coalesce(text, '') as t from documents),
words as (select nth, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from docs),
lines as (
  select nth, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select nth, unnest(string_split(t, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]') group by nth),
windows as (
  select nth, pos, array_to_string(w[pos:pos + 4], ' ') as run from (select nth, w, unnest(range(1, len(w) - 3)) as pos from words)),
repeated as (
  select nth, count(distinct word) as n_repeat_words from (
    select nth, unnest(range(pos, pos + 5)) as word from (select nth, pos, count(*) over (partition by nth, run) as n from windows) where n > 1)
  group by nth),
base as (
  select d.nth, doc_id, lang, source, len(w)::bigint as n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
  from docs d join words using (nth) left join lines using (nth) left join repeated using (nth)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base),
fences(measure, least, reach, share, below) as (values ('word_length', 10, 12, 0.75, true), ('symbols', 3, 8, 0.75, false), ('dup_lines', 60, 5, 0.95, false), ('repeats', 30, 3, 0.98, false)),
measured as (
  select nth, lang, source, base_failed, n_words, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) as measure,
    unnest([word_chars * 100 // greatest(n_words, 1), n_symbols * 100 // greatest(n_words, 1), n_dup_lines * 1000 // greatest(n_lines, 1),
            n_repeat_words * 1000 // greatest(n_words, 1)]) as value from judged),
bucketed as (
  select *, case when value < 1024 then value::double else 1024 * pow(2.0, floor((log2(value) - 10) * 128) / 128) end as held
  from measured where not base_failed and n_words > 0),
groups as (
  select 0 as level, lang, source, measure, count(*) as docs, list_sort(list(held)) as held from bucketed group by lang, source, measure
  union all select 1, lang, null, measure, count(*), list_sort(list(held)) from bucketed group by lang, measure
  union all select 2, null, null, measure, count(*), list_sort(list(held)) from bucketed group by measure),
quantiles as (
  select level, lang, source, g.measure, docs, least, reach, held[greatest(1, ceil(round(docs * (1 - share), 9)))::int] as low,
    held[greatest(1, ceil(docs * 0.5))::int] as mid, held[greatest(1, ceil(round(docs * share, 9)))::int] as high
  from groups g join fences f on g.measure = f.measure),
chosen as (
  select k.lang, k.source, q.measure, arg_min(q, case when q.docs >= 200 then q.level else 20 - q.level end) as q
  from (select distinct lang, source from bucketed) k join quantiles q
    on q.level = 2 or q.lang is not distinct from k.lang and (q.level = 1 or q.source is not distinct from k.source)
  group by k.lang, k.source, q.measure),
limits as (
  select lang, source, measure, q.mid - q.reach * case when q.mid > q.low then q.mid - q.low else q.least end as lower_limit,
    q.mid + q.reach * case when q.high > q.mid then q.high - q.mid else q.least end as upper_limit from chosen),
outside as (
  select m.nth, bool_or(coalesce(m.value > l.upper_limit or f.below and m.value < l.lower_limit, false)) as out
  from measured m join fences f on m.measure = f.measure
  left join limits l on l.measure = m.measure and l.lang is not distinct from m.lang and l.source is not distinct from m.source group by m.nth)
select doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, not base_failed and not out as kept
from judged join outside using (nth)
"""


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("ids")


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


@query
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), secrets.new_ledger(spark))
    kinds = [r.kind for r in secrets.RULES if r.base]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(secrets.shown(base), 256).alias("base_sha256"), secrets.shown(F.col("spans")).alias("spans"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op10_line_dedup"] = r"""
with docs as (select row_number() over () as nth, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
cut as (select nth, doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from docs),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from cut),
shared as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(s.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (s.key is null), '')) as kept_sha256
from keyed k left join shared s on k.key = s.key group by nth, doc_id
"""


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = byte_bpe.decode_documents(encoded.drop("text"), vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.prepare(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = whitening.fit(rows)
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    each = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"),
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepare(table(spark, sf_dir, "embeddings"), label=label)
    mined = hard_negatives.mine_hard_negatives(rows, rows.where("vec_id % 50 = 0"))
    scores = {c: F.expr(f"try_cast({c} as bigint)") for c in ("positive_score", "negative_score")}
    return mined.withColumns(scores)


ORACLES["op13_hard_negatives"] = r"""
with taken as (
  select row_number() over () as nth, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * c::double) for c in embedding] as x
  from embeddings
  where label is not null and embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
scored as (
  select a.nth, a.vec_id as anchor_id, r.nth as other, r.vec_id as id, a.label = r.label as same, list_dot_product(a.x, r.x)::bigint as score
  from taken a join taken r on a.nth <> r.nth
  where a.vec_id % 50 = 0),
positives as (
  select nth, anchor_id, id as positive_id, other as positive, score as positive_score
  from scored where same
  qualify row_number() over (partition by nth order by score desc, id, other) <= 5),
fits as (
  select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
         row_number() over (partition by p.nth, p.positive order by s.score desc, s.id, s.other) as rank
  from positives p join scored s on s.nth = p.nth and not s.same and 100 * s.score between 50 * p.positive_score and 95 * p.positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from fits where rank <= 3
"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
