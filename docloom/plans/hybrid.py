"""Hybrid preference groups, and candidates from a model's beams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import hybrid
from docloom.operators.mining import draw
from docloom.plans import bridge
from docloom.plans.mining import _TARGET, _candidates, _targets
from docloom.plans.registry import query
from docloom.plans.retrieval import _truth

_INPUT = f"""{_TARGET.replace(" where doc_id % 14 <> 0", "")},
 base as (select qid as query_key, 'd' || (item_id * 3) as chosen, docid as rejected, target, rank, item_id from run join queries using (qid) join tgt using (docid) where docid <> 'd' || (item_id * 3)),
 bm as (select query_key, chosen, rejected, target, rank as bm25_rank from base where item_id % 7 <> 6 and (rank <= 50 and item_id % 6 <> 1 or rank between 101 and 140 and item_id % 6 <> 2) and (item_id % 8 <> 3 or rank <= 5)),
 mo as (select query_key, chosen, rejected, target, row_number() over (partition by query_key order by sha256('m|' || query_key || '|' || rejected), rejected) as model_rank, item_id from base where rank between 30 and 60 and item_id % 10 <> 9),
 md as (select * from mo where model_rank <= case when item_id % 4 = 0 then 2 else 6 end)"""


def _inputs(spark, d):
    tgt = bridge.originals(spark, d).select(F.col("text_id").alias("docid"), F.col("structure").alias("target"))
    r = bridge.run(spark, d).join(bridge.queries(spark, d).select("qid", "item_id"), "qid").join(tgt, "docid")
    base = r.select(F.col("qid").alias("query_key"), F.concat(F.lit("d"), F.col("item_id") * 3).alias("chosen"), F.col("docid").alias("rejected"), "target", "rank", "item_id").where("chosen <> rejected")
    bm = base.where("item_id % 7 <> 6 and (rank <= 50 and item_id % 6 <> 1 or rank between 101 and 140 and item_id % 6 <> 2) and (item_id % 8 <> 3 or rank <= 5)")
    place = F.row_number().over(Window.partitionBy("query_key").orderBy(draw(F.lit("m"), "query_key", "rejected"), "rejected"))
    md = base.where("rank between 30 and 60 and item_id % 10 <> 9").withColumn("model_rank", place).where("model_rank <= case when item_id % 4 = 0 then 2 else 6 end")
    return bm.select("query_key", "chosen", "rejected", "target", F.col("rank").alias("bm25_rank")), md.select("query_key", "chosen", "rejected", "target", "model_rank")


def _sql(bm="bm", md="md", exact="false"):
    return f"""keys as (select distinct query_key, chosen from {bm}),
 pk as (select m.* from {md} m semi join keys using (query_key, chosen) qualify row_number() over (partition by m.query_key, m.chosen order by model_rank, m.rejected) <= 4),
 mk as (select pk.*, b.bm25_rank as also from pk left join {bm} b using (query_key, chosen, rejected)),
 pool as (select b.*, case when bm25_rank <= 20 then 'top' when bm25_rank <= 100 then 'mid' else 'low' end as band from {bm} b anti join pk using (query_key, chosen, rejected) anti join pk using (query_key, chosen, target)),
 fst as (select *, row_number() over (partition by query_key, chosen, band order by sha256('11|' || query_key || '|' || chosen || '|' || band || '|' || rejected), rejected) <= case band when 'top' then 2 else 1 end as first from pool),
 hv as (select query_key, chosen, coalesce(n, 0) as n_model from keys left join (select query_key, chosen, count(*) as n from pk group by 1, 2) using (query_key, chosen)),
 at_ as (select f.*, n_model, row_number() over (partition by query_key, chosen order by case when not first then 3 when band = 'top' then 0 when band = 'mid' then 1 else 2 end, case when first then sha256('11|' || query_key || '|' || chosen || '|' || band || '|' || rejected) else sha256('11|' || query_key || '|' || chosen || '|fill|' || rejected) end, rejected) as place from fst f join hv using (query_key, chosen)),
 fl as (select * from at_ where place <= 8 - n_model),
 grp as (select query_key, chosen, n_model, coalesce(n, 0) as n_bm25, case when {exact} and n_model < 4 then 'model_shortfall' when coalesce(n, 0) + n_model < 8 then 'bm25_shortfall' when n_model = 4 then 'exact' else 'fallback' end as outcome from hv left join (select query_key, chosen, count(*) as n from fl group by 1, 2) using (query_key, chosen)),
 prs as (select query_key, chosen, rejected, case when also is null then 'model_confusion' else 'model_confusion+bm25' end as source, model_rank::int as model_rank, null::int as bm25_rank, also::int as also_bm25_rank from mk union all select query_key, chosen, rejected, 'bm25', null, bm25_rank::int, null from fl),
 fin as (select p.* from prs p semi join (select query_key, chosen from grp where outcome in ('exact', 'fallback')) using (query_key, chosen))"""


@query(f"with {_INPUT}, {_sql()} select * from fin", ("run",))
def hybrid_pairs(spark, d):
    return hybrid.combine(*_inputs(spark, d))[0]


@query(f"with {_INPUT}, {_sql(exact='true')} select * from fin", ("run",))
def hybrid_pairs_exact_mix(spark, d):
    return hybrid.combine(*_inputs(spark, d), exact=True)[0]


@query(f"with {_INPUT}, ex as (select 'd' || doc_id as id from documents where doc_id % 10 = 3), bx as (select * from bm where chosen not in (select id from ex) and rejected not in (select id from ex)), mx as (select * from md where chosen not in (select id from ex) and rejected not in (select id from ex)), {_sql('bx', 'mx')} select * from fin", ("run",))
def hybrid_with_exclusions(spark, d):
    out = bridge.docs(spark, d).where("doc_id % 10 = 3").select(F.col("docid").alias("id"))
    return hybrid.combine(*(hybrid.without(x, out) for x in _inputs(spark, d)))[0]


@query(f"with {_INPUT}, {_sql()} select (select count(*) from keys) as bm25_groups, (select count(*) from (select distinct query_key, chosen from md) anti join keys using (query_key, chosen)) as model_only, (select count(*) from grp where outcome = 'exact') as exact, (select count(*) from grp where outcome = 'fallback') as fallback, (select count(*) from grp where outcome = 'bm25_shortfall') as bm25_shortfall, (select count(*) from fin) as n_pairs, (select count(*) from fin where source = 'model_confusion+bm25') as overlap", ("run",))
def hybrid_stats(spark, d):
    bm, md = _inputs(spark, d)
    pairs, groups = hybrid.combine(bm, md)
    only = md.select(*hybrid.GROUP).distinct().join(bm.select(*hybrid.GROUP).distinct(), hybrid.GROUP, "left_anti").agg(F.count("*").alias("model_only"))
    g = groups.agg(F.count("*").alias("bm25_groups"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("exact", "fallback", "bm25_shortfall")))
    p = pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("source") == "model_confusion+bm25").alias("overlap"))
    return g.join(F.broadcast(only)).join(F.broadcast(p)).select("bm25_groups", "model_only", "exact", "fallback", "bm25_shortfall", "n_pairs", "overlap")


_BEAMS = f"""truth as (select q.qid, d.docid from queries q join docs d on q.item_id = d.doc_id // 20), {_TARGET},
 cd as (select docid, array_to_string(code, ',') as code from codes), tc as (select code, min(target) as target from cd join tgt using (docid) group by 1 having count(distinct target) < 4),
 beams as (select qid, rank, code from run join cd using (docid) where rank <= 15), ps as (select distinct qid, target from truth join tgt using (docid)),
 j as (select b.*, t.target, case when t.target is null then 'unmapped' when p.target is not null then 'positive' end as st from beams b left join tc t using (code) left join ps p on p.qid = b.qid and p.target = t.target),
 s as (select *, coalesce(st, case when row_number() over (partition by qid, st is null, target order by rank) = 1 then 'selected' else 'duplicate' end) as state from j),
 h as (select *, count(*) filter (state = 'selected') over (partition by qid order by rank) - (state = 'selected')::int as taken from s), seen as (select * from h where taken < 4)"""


def _beams(spark, d):
    codes = bridge.codes(spark, d).select("docid", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))
    tgt = _targets(spark, d)
    by_code = codes.join(tgt, "docid").groupBy("code").agg(F.min("target").alias("target"), F.countDistinct("target").alias("n")).where("n < 4").select("code", "target")
    beams = bridge.run(spark, d, 15).join(codes, "docid").select("qid", "rank", "code")
    return hybrid.select_beams(beams, by_code, _truth(spark, d).join(tgt, "docid").select("qid", "target"), 4)


@query(f"with {_BEAMS} select qid, rank::int as rank, target from seen where state = 'selected'", ("run", "codes"))
def model_candidates(spark, d):
    return _beams(spark, d).where("state = 'selected'").select("qid", "rank", "target")


@query(f"with {_BEAMS} select state, count(*) as n, count(*) filter (rank = 1) as at_top from seen group by 1", ("run", "codes"))
def model_candidates_stats(spark, d):
    return _beams(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("at_top"))
