"""Hard negatives and triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import mining, runs, validate
from docloom.operators.runs import MSMARCO_BANDS
from docloom.plans import bridge
from docloom.plans.registry import query
from docloom.plans.retrieval import _truth

BAND_QUOTAS = [(1, 20, 3), (21, 100, 2), (101, 200, 3)]

_TRUTH = "truth as (select q.qid, d.docid from queries q join docs d on q.item_id = d.doc_id // 20)"
_TARGET = "tgt as (select 'd' || doc_id as docid, source || '/' || lang || '/' || (doc_id % 50) as target from documents where doc_id % 14 <> 0)"
_STATE = f"""{_TRUTH}, {_TARGET}, own as (select distinct t.qid, target from truth t join tgt using (docid)),
 j as (select r.qid, r.docid, r.rank, r.score, g.target, t.docid is not null as pos, o.target is not null as taken from run r left join truth t using (qid, docid) left join tgt g using (docid) left join own o on o.qid = r.qid and o.target = g.target where r.qid in (select qid from truth)),
 s as (select *, case when pos then 'positive' when target is null then 'unknown' when taken then 'same_target' end as st from j),
 cand as (select qid, docid, rank, score, target, coalesce(st, case when row_number() over (partition by qid, st is null, target order by rank) = 1 then 'usable' else 'duplicate' end) as state from s)"""


def _targets(spark, d):
    return bridge.originals(spark, d).where("doc_id % 14 <> 0").select(F.col("text_id").alias("docid"), F.col("structure").alias("target"))


def _candidates(spark, d):
    return mining.judged_candidates(bridge.run(spark, d), _truth(spark, d), _targets(spark, d))


@query(f"with {_STATE} select qid, docid, rank::int as rank, target from cand where state = 'usable'", ("run",))
def usable_candidates(spark, d):
    return _candidates(spark, d).where("state = 'usable'").select("qid", "docid", "rank", "target")


@query(f"with {_STATE} select state, count(*) as n from cand group by 1", ("run",))
def usable_candidates_stats(spark, d):
    return _candidates(spark, d).groupBy("state").agg(F.count("*").alias("n"))


_DRAW = f"""with {_STATE}, u as (select qid, docid, rank, case when rank <= 20 then 0 when rank <= 100 then 1 when rank <= 200 then 2 end as band from cand where state = 'usable' and {{extra}}),
 p as (select *, row_number() over (partition by qid, band order by sha256('7|' || qid || '|' || coalesce(band::varchar, '-') || '|' || docid), docid) <= case band when 0 then 3 when 1 then 2 else 3 end and band is not null as picked from u),
 n as (select *, count(*) filter (picked) over (partition by qid) as n_picked from p)"""
_ALL, _SOME = "true", "(rank < 101 or ascii(substr(qid, 2)) % 3 <> 0)"


@query(_DRAW.format(extra=_SOME) + " select qid, docid, rank::int as rank, band::int as band from n where n_picked = 8 and picked", ("run",))
def stratified_negatives(spark, d):
    rows = _candidates(spark, d).where("state = 'usable' and (rank < 101 or ascii(substring(qid, 2)) % 3 <> 0)").select("qid", "docid", "rank")
    return mining.stratified(rows, BAND_QUOTAS, "7")


@query(_DRAW.format(extra=_SOME) + ", f as (select *, row_number() over (partition by qid, picked order by sha256('7|' || qid || '|fill|' || docid), docid) as spare from n), g as (select *, picked or spare <= 8 - n_picked as used from f), h as (select *, count(*) filter (used) over (partition by qid) as n_used from g) select qid, docid, rank::int as rank, band::int as band from h where n_used = 8 and used", ("run",))
def stratified_negatives_fill(spark, d):
    rows = _candidates(spark, d).where("state = 'usable' and (rank < 101 or ascii(substring(qid, 2)) % 3 <> 0)").select("qid", "docid", "rank")
    return mining.stratified(rows, BAND_QUOTAS, "7", fill=True)


_MS = f"""with {_TRUTH}, hits as (select r.qid, r.docid, r.rank, case when rank <= 100 then 'top' when rank <= 500 then 'mid' when rank <= 1000 then 'low' end as band from run r where qid in (select qid from truth) and (qid, docid) not in (select qid, docid from truth)),
 p as (select * from hits where band is not null qualify row_number() over (partition by qid, band order by sha256('3|' || qid || '|' || band || '|' || docid), docid) <= case band when 'low' then 12 else 10 end),
 n as (select * from p qualify count(*) over (partition by qid) >= 32),
 pos as (select qid, arg_min(docid, (sha256('3|' || qid || '|' || docid), docid)) as pos from truth group by 1),
 t as (select n.qid, pos, n.docid as neg from n join pos using (qid) where substr(n.docid, 2)::bigint % 50 <> 49)"""


def _msmarco(spark, d):
    truth = _truth(spark, d)
    hits = runs.minus_positives(bridge.run(spark, d, 1000), truth)
    drawn = mining.msmarco_sample(hits, 32, MSMARCO_BANDS, "3")
    # documents that are not there go after the quotas were judged
    there = bridge.docs(spark, d).where("doc_id % 50 <> 49").select(F.col("docid").alias("neg"))
    return drawn.join(mining.one_positive(truth, "3"), "qid").select("qid", "pos", F.col("docid").alias("neg")).join(there, "neg", "left_semi").select("qid", "pos", "neg")


@query(_MS + " select qid, pos, neg from t", ("run",), k=1000)
def msmarco_triples(spark, d):
    return _msmarco(spark, d)


@query(_MS + " select (select count(distinct qid) from truth) as n_queries, count(distinct qid) as n_kept, count(*) as n_triples from t", ("run",), k=1000)
def msmarco_triples_stats(spark, d):
    asked = _truth(spark, d).agg(F.countDistinct("qid").alias("n_queries"))
    return asked.join(F.broadcast(_msmarco(spark, d).agg(F.countDistinct("qid").alias("n_kept"), F.count("*").alias("n_triples"))))


_NQ = f"""with {_TRUTH}, r as (select qid, docid, row_number() over (partition by qid order by score desc, docid) as place from run where qid in (select qid from truth)),
 b as (select qid, docid, case when place <= 100 then 'top' when place <= 500 then 'mid' else 'low' end as band from r where place <= 1000 and (qid, docid) not in (select qid, docid from truth)),
 a as (select *, row_number() over (partition by qid, band order by sha256('5|' || qid || '|' || band || '|' || docid), docid) as pos from b),
 f as (select qid, docid, band, pos::int as pick from a where pos <= 2),
 sz as (select qid, count(*) as size from a where band = 'top' group by 1), h as (select qid, count(*) as have from f group by 1),
 dr as (select qid, size, unnest(range(1, 7 - coalesce(have, 0) + 1))::int as pick from sz left join h using (qid)),
 sl as (select qid, pick, ('0x' || substr(sha256('5|' || qid || '|fill|' || pick), 1, 8))::bigint % size + 1 as slot from dr)"""


@query(_NQ + " select qid, docid, band, pick from f union all select sl.qid, a.docid, 'fill', sl.pick from sl join a on a.qid = sl.qid and a.band = 'top' and a.pos = sl.slot", ("run",), k=1000)
def nq_triples(spark, d):
    return mining.nq_sample(bridge.run(spark, d, 1000).select("qid", "docid", "score"), _truth(spark, d), 7, "5")


_UNI = f"""with {_TRUTH}, hits as (select r.qid, r.docid from run r where qid in (select qid from truth) and (qid, docid) not in (select qid, docid from truth)),
 uni as (select * from hits qualify count(*) over (partition by qid) >= 5 and row_number() over (partition by qid order by sha256('9|' || qid || '|' || docid), docid) <= 5),
 pos as (select qid, arg_min(docid, (sha256('9|' || qid || '|' || docid), docid)) as pos from truth group by 1), tri as (select uni.qid, pos, docid as neg from uni join pos using (qid))"""


def _triples(spark, d):
    truth = _truth(spark, d)
    hits = runs.minus_positives(bridge.run(spark, d), truth).select("qid", "docid")
    return mining.uniform_sample(hits, 5, "9").join(mining.one_positive(truth, "9"), "qid").select("qid", "pos", F.col("docid").alias("neg"))


@query(_UNI + " select qid, docid from uni", ("run",))
def uniform_negatives(spark, d):
    hits = runs.minus_positives(bridge.run(spark, d), _truth(spark, d)).select("qid", "docid")
    return mining.uniform_sample(hits, 5, "9")


@query(_UNI + " select t.qid, query, t.pos, p.title as pos_title, t.neg, n.title as neg_title from tri t join queries q using (qid) join docs p on p.docid = t.pos join docs n on n.docid = t.neg", ("run",))
def triples_denormalized(spark, d):
    titles = bridge.docs(spark, d).select("docid", "title")
    pos, neg = titles.toDF("pos", "pos_title"), titles.toDF("neg", "neg_title")
    return _triples(spark, d).join(bridge.queries(spark, d).select("qid", "query"), "qid").join(pos, "pos").join(neg, "neg").select("qid", "query", "pos", "pos_title", "neg", "neg_title")


@query(f"with {_TRUTH}, pos as (select qid, arg_min(docid, (sha256('2|' || qid || '|' || docid), docid)) as pos from truth group by 1) select r.qid, query, pos, r.docid as neg from run r join pos using (qid) join queries using (qid) where rank = 5 and (r.qid, r.docid) not in (select qid, docid from truth)", ("run",))
def triples_fixed_rank(spark, d):
    truth = _truth(spark, d)
    at = runs.minus_positives(bridge.run(spark, d, 5).where("rank = 5"), truth).select("qid", F.col("docid").alias("neg"))
    return at.join(mining.one_positive(truth, "2"), "qid").join(bridge.queries(spark, d).select("qid", "query"), "qid").select("qid", "query", "pos", "neg")


@query(_UNI + ", c as (select docid, array_to_string(code, ',') as code from codes where substr(docid, 2)::bigint % 3 <> 0) select qid, p.code as pos_code, n.code as neg_code, t.neg from tri t join c p on p.docid = t.pos join c n on n.docid = t.neg", ("run", "codes"))
def triples_with_codes(spark, d):
    codes = bridge.codes(spark, d).where("cast(substring(docid, 2) as bigint) % 3 <> 0").select("docid", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))
    return _triples(spark, d).join(codes.toDF("pos", "pos_code"), "pos").join(codes.toDF("neg", "neg_code"), "neg").select("qid", "pos_code", "neg_code", "neg")


_URLS = f"""with {_TRUTH}, {_TARGET.replace(" where doc_id % 14 <> 0", "")}, ps as (select qid, list(distinct target order by target) as positives from truth join tgt using (docid) group by 1),
 res as (select r.qid, s.target as source_url, positives, g.target as url, r.rank from run r join queries using (qid) join ps using (qid) join tgt s on s.docid = 'd' || (item_id * 3) join tgt g on g.docid = r.docid),
 u as (select qid, url, min(rank) as rank, any_value(case when list_contains(positives, source_url) then source_url else positives[1] end) as chosen from res where not list_contains(positives, url) and url <> source_url and len(positives) > 0 group by 1, 2),
 p as (select *, case when rank <= 20 then 0 when rank <= 100 then 1 else 2 end as band from u), k as (select * from p qualify row_number() over (partition by qid, band order by sha256('4|' || qid || '|' || band || '|' || url), url) <= case band when 1 then 2 else 3 end)"""


@query(_URLS + " select qid, chosen, url as rejected, rank::int as rank from k qualify count(*) over (partition by qid) = 8", ("run",))
def url_dpo_pairs(spark, d):
    tgt = bridge.originals(spark, d).select(F.col("text_id").alias("docid"), F.col("structure").alias("target"))
    ps = _truth(spark, d).join(tgt, "docid").groupBy("qid").agg(F.array_sort(F.collect_set("target")).alias("positives"))
    source = bridge.queries(spark, d).select("qid", F.concat(F.lit("d"), F.col("item_id") * 3).alias("docid")).join(tgt, "docid").select("qid", F.col("target").alias("source_url"))
    res = bridge.run(spark, d).join(tgt, "docid").select("qid", F.col("target").alias("url"), "rank").join(ps, "qid").join(source, "qid")
    return mining.url_pairs(res, BAND_QUOTAS, "4")


@query(f"""with {_TRUTH}, ps as (select qid, list(docid order by docid) as positives from truth group by 1),
 pairs as (select r.qid as query_key, case when item_id % 9 = 0 then '' when item_id % 9 = 1 then 'p' || rank else 'p' end as prompt, 'd' || (item_id * 3) as chosen, case when rank = 4 then '' else docid end as rejected, positives from run r join queries using (qid) join ps using (qid) where rank <= 40),
 v as (select *, min(prompt) over (partition by query_key, chosen) = max(prompt) over (partition by query_key, chosen) as one from pairs),
 w as (select query_key, chosen, rejected, case when prompt = '' then 'no_prompt' when not one then 'several_prompts' when rejected = '' then 'no_rejected' when list_contains(positives, rejected) then 'rejected_positive' when chosen = rejected then 'same' end as reason from v)
 select * from w where reason is not null""", ("run",))
def dpo_violations(spark, d):
    ps = _truth(spark, d).groupBy("qid").agg(F.array_sort(F.collect_set("docid")).alias("positives"))
    r = bridge.run(spark, d, 40).join(bridge.queries(spark, d).select("qid", "item_id"), "qid").join(ps, "qid")
    kind = F.col("item_id") % 9
    prompt = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("p"), "rank")).otherwise("p")
    pairs = r.select(F.col("qid").alias("query_key"), prompt.alias("prompt"), F.concat(F.lit("d"), F.col("item_id") * 3).alias("chosen"), F.when(F.col("rank") == 4, "").otherwise(F.col("docid")).alias("rejected"), "positives")
    return validate.pair_violations(pairs)
