"""Queries of the training-data operators: name -> Spark job ``(spark, sf_dir) -> DataFrame``, and DuckDB SQL
for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kanon.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


@query("op1_licences")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.licences import licences

    return licences(load(spark, sf_dir, "documents"))


@query("op2_ngram_jaccard")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.ngram_jaccard import jaccard_components

    return jaccard_components(load(spark, sf_dir, "documents"))


_OP3_SQL = r"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null),
last as (select conv_id, max(turn) filter (where role = 'assistant') as lt from t group by conv_id),
reply as (select t.conv_id, max(t.text) as text from t join last on t.conv_id = last.conv_id and t.turn = last.lt and t.role = 'assistant' group by t.conv_id),
sides as (
  select conv_id as pair_id, 'chosen' as side, turn, role, text from t
  union all
  select t.conv_id, 'rejected', turn, role, text from t join last using (conv_id) where lt is null or turn < lt
  union all
  select last.conv_id, 'rejected', lt, 'assistant', reply.text from last join reply on reply.conv_id = xor(last.conv_id, 1) where lt is not null
),
n as (select *, row_number() over (partition by pair_id, side order by turn, role, text) as k from sides),
cmp as (
  select p.pair_id, coalesce(min(case when c.role is distinct from r.role or c.text is distinct from r.text then k.k end) - 1, max(k.k)) as pre
  from (select distinct pair_id from n) p
  join (select distinct pair_id, k from n) k on k.pair_id = p.pair_id
  left join n c on c.pair_id = k.pair_id and c.k = k.k and c.side = 'chosen'
  left join n r on r.pair_id = k.pair_id and r.k = k.k and r.side = 'rejected'
  group by p.pair_id
),
r as (
  select n.*, pre, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) as line,
         length(replace(role, '<|', '< |')) + 13 as head
  from n join cmp using (pair_id)
),
m as (
  select *, coalesce(sum(length(line)) over (partition by pair_id, side order by k rows between unbounded preceding and 1 preceding), 0) as before
  from r where k > pre
),
agg as (
  select pair_id, side, string_agg(line, '' order by k) as body,
         string_agg((before + head)::bigint || '-' || (before + length(line) - 1)::bigint, ',' order by k) filter (where role = 'assistant') as mask
  from m group by pair_id, side
)
select cmp.pair_id, cmp.pre::int as n_prompt_turns, coalesce(pp.prompt, '') as prompt,
       coalesce(c.body, '') as chosen, coalesce(j.body, '') as rejected, coalesce(c.mask, '') as chosen_spans, coalesce(j.mask, '') as rejected_spans
from cmp
left join (select pair_id, string_agg(line, '' order by k) as prompt from r where side = 'chosen' and k <= pre group by pair_id) pp on pp.pair_id = cmp.pair_id
left join agg c on c.pair_id = cmp.pair_id and c.side = 'chosen'
left join agg j on j.pair_id = cmp.pair_id and j.side = 'rejected'
"""


@query("op3_chat_formatting", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kanon.llm.preference import format_pairs, swapped_reply_pairs

    out = format_pairs(swapped_reply_pairs(load(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_mask").alias("chosen_spans"), spans("rejected_mask").alias("rejected_spans"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.fm_quality import score_documents, train

    docs = load(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, load(spark, sf_dir, "labels")))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.line_rules import quality_rules

    return quality_rules(load(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.pieces import encode_documents

    return encode_documents(load(spark, sf_dir, "documents"))


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.sharding import shard_rows

    return shard_rows(load(spark, sf_dir, "documents"))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.secret_scan import secret_spans

    return secret_spans(load(spark, sf_dir, "documents"))


# Words, windows and hits stated directly: windows are joined to the documents' word sequences by value.
_OP10_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
),
win as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from iw where len(w) > 0)
),
dwin as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, (select distinct k from win) where len(w) >= k)
),
hits as (select doc_id, item_id, i, dwin.k from dwin join win on dwin.k = win.k and dwin.s = win.s),
hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
hi as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hw using (doc_id) left join hi using (doc_id)
"""


@query("op10_decontamination", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.decontaminate import contamination

    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("item_ids", "byte_spans")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.suffix_dedup import repeated_spans

    return repeated_spans(load(spark, sf_dir, "documents")).drop("spans")


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.spelling_variants import misspelled, variants, word_counts

    return variants(word_counts(load(spark, sf_dir, "documents"), misspell=misspelled))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kanon.llm.periodic_runs import periodic_runs, replayed, run_digests

    return run_digests(periodic_runs(load(spark, sf_dir, "documents"), replay=replayed))


@query("op13_nearest_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kanon.llm.rp_forest import nearest

    return nearest(load(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)
