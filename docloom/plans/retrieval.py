"""Indexing, search, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import bm25, metrics, runs, validate
from docloom.plans import bridge
from docloom.plans.registry import query


def _contents(spark, d):
    return bridge.docs(spark, d).select("docid", F.col("body").alias("contents"))


@query("select qid, docid, rank::int as rank, score from run", ("run",))
def bm25_topk(spark, d):
    return bridge.run(spark, d)


@query("select qid, docid, rank::int as rank, score from run", ("run",), k1=2.16, b=0.61, k=1000)
def bm25_topk_dev_params(spark, d):
    return bridge.run(spark, d, 1000, 2.16, 0.61)


@query("select docid, term, tf from tf", ("tf",))
def postings(spark, d):
    return bm25.postings(_contents(spark, d))


@query("select n, round(avgdl, 6) as avgdl from stats", ("stats",))
def corpus_stats(spark, d):
    return bm25.corpus_stats(_contents(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("select round(avg(coalesce(rr, 0)), 6) as mrr from (select qid from qrels group by qid) left join (select r.qid, max(1.0::double / rank) as rr from run r join qrels using (qid, docid) group by 1) using (qid)", ("run", "qrels"))
def run_mrr(spark, d):
    got = metrics.per_query(bridge.run(spark, d), bridge.qrels(spark, d))
    return got.agg(F.round(F.avg("mrr"), 6).alias("mrr"))


@query("select r.qid, r.docid, rank::int as rank, score from run r semi join (select distinct qid from qrels) using (qid) anti join qrels using (qid, docid)", ("run", "qrels"))
def run_minus_positives(spark, d):
    return runs.minus_positives(bridge.run(spark, d), bridge.qrels(spark, d)).select("qid", "docid", "rank", "score")


@query("select qid from queries where qid not in (select qid from run where rank <= 5 and score > 30)", ("run",))
def queries_without_run(spark, d):
    return bridge.queries(spark, d).select("qid").join(bridge.run(spark, d, 5).where("score > 30").select("qid"), "qid", "left_anti")


@query("select q.qid, q.docid from qrels q where docid not in (select docid from docs where doc_id % 2 = 0)", ("qrels",))
def missing_positives(spark, d):
    have = bridge.docs(spark, d).where("doc_id % 2 = 0").select("docid")
    return bridge.qrels(spark, d).select("qid", "docid").join(have, "docid", "left_anti").select("qid", "docid")


@query("select qid, query from queries order by item_id limit 10", ("queries",))
def limit_queries(spark, d):
    return bridge.queries(spark, d).orderBy("item_id").limit(10).select("qid", "query")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn)::int as rank from conversations")
def implicit_rank(spark, d):
    rows = bridge.table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("line_no"))
    return runs.implicit_rank(rows).select(F.col("qid").alias("conv_id"), F.col("line_no").alias("turn"), "rank")


@query("select event_id, user_id from (select event_id, user_id, event_type, lag((user_id, event_type)) over (order by event_id) as b from events) where b > (user_id, event_type)")
def unsorted_groups(spark, d):
    rows = bridge.table(spark, d, "events").select("event_id", "user_id", "event_type")
    return validate.unsorted(rows, "event_id", ["user_id", "event_type"]).select("event_id", "user_id")


@query("with l as (select doc_id as line_no, source as qid from documents), g as (select qid, line_no - row_number() over (partition by qid order by line_no) as i from l group by qid, line_no) select qid, count(distinct i) as n_islands from g group by 1 having count(distinct i) > 1")
def noncontiguous_queries(spark, d):
    return runs.noncontiguous(bridge.table(spark, d, "documents").select(F.col("doc_id").alias("line_no"), F.col("source").alias("qid")))


@query("select n, count(*) as n_queries from (select qid, count(*) as n from run where score > 12 group by qid) group by n", ("run",))
def candidate_histogram(spark, d):
    return bridge.run(spark, d).where("score > 12").groupBy("qid").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_queries"))


_PREDICTIONS = "p as (select qid, docid, rank from run union all select qid, docid, 201 from run where rank = 1), truth as (select q.qid, d.docid from queries q join docs d on q.item_id = d.doc_id // 20), nt as (select qid, count(*) as n from truth group by 1), "
_PER_QUERY = (
    _PREDICTIONS
    + """j as (select p.*, t.docid is not null as rel, t.docid is not null and row_number() over (partition by p.qid, p.docid order by rank) = 1 as first from p left join truth t using (qid, docid) where qid in (select qid from nt)),
 h as (select *, sum(first::int) over (partition by qid order by rank) as so_far from j),
 a as (select qid, max(1.0::double / rank) filter (rel) as mrr, max(1.0::double / rank) filter (rel and rank <= 10) as mrr_10, sum(so_far::double / rank) filter (first and rank <= 20) as map_20, """
    + ", ".join([f"sum(1.0::double / log2(rank + 1)) filter (rel and rank <= {k}) as ndcg_{k}" for k in metrics.NDCG_AT] + [f"count(*) filter (first and rank <= {k})::double / greatest(1, least(count(*), {k})) as p_{k}" for k in metrics.P_AT] + [f"count(*) filter (rel and rank <= {k})::double as r_{k}" for k in metrics.R_AT] + [f"max((rel and rank <= {k})::int)::double as hit_{k}" for k in metrics.HIT_AT])
    + " from h group by qid), i as (select qid, n, list_sum(list_transform(range(1, n + 1), lambda x: 1.0::double / log2(x + 1))) as ideal from nt),\n m as (select qid, "
    + ", ".join(f"coalesce({n}{' / greatest(1, n)' if n == 'map_20' else ' / greatest(0.3, ideal)' if n.startswith('ndcg') else ' / n' if n.startswith('r_') else ''}, 0)::double as {n}" for n in metrics.NAMES)
    + " from i left join a using (qid))"
)


def _predictions(run):
    """A run, with each query's first document once more at its end."""
    return run.select("qid", "docid", "rank").unionByName(run.where("rank = 1").select("qid", "docid", F.lit(201).alias("rank")))


def _truth(spark, d):
    """Twenty documents a query."""
    q = bridge.queries(spark, d).select("qid", "item_id")
    return q.join(bridge.docs(spark, d).select("docid", F.expr("doc_id div 20").alias("item_id")), "item_id").select("qid", "docid")


def _measured(spark, d, **params):
    return metrics.per_query(_predictions(bridge.run(spark, d, **params)), _truth(spark, d))


@query("with " + _PER_QUERY + " select qid, " + ", ".join(f"round({n}, 6) as {n}" for n in metrics.NAMES) + " from m", ("run",))
def metrics_per_query(spark, d):
    return _measured(spark, d).select("qid", *(F.round(n, 6).alias(n) for n in metrics.NAMES))


@query("with " + _PER_QUERY + " select " + ", ".join(f"round(avg({n}), 6) as {n}" for n in metrics.NAMES) + " from m", ("run",))
def metrics_mean(spark, d):
    return metrics.means(_measured(spark, d)).select(*(F.round(n, 6).alias(n) for n in metrics.NAMES))


_TESTED = ("mrr", "map_20", "ndcg_20")
_RUN2 = "run2 as (select qid, docid, row_number() over (partition by qid order by s desc, docid) as rank from (select qid, docid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 2.16 * (1 - 0.61 + 0.61 * len / avgdl))), 6) as s from qterms join tf using (term) join df using (term) join dl using (docid), stats group by 1, 2) qualify rank <= 200), "
_BOTH = _PER_QUERY + ", " + _RUN2 + _PER_QUERY.replace("from run ", "from run2 ").replace("truth as (select q.qid, d.docid from queries q join docs d on q.item_id = d.doc_id // 20), nt as (select qid, count(*) as n from truth group by 1), ", "").replace("p as (select qid, docid, rank from run2 union", "p2 as (select qid, docid, rank from run2 union").replace("from p left", "from p2 left").replace("select p.*", "select p2.*").replace("partition by p.qid, p.docid", "partition by p2.qid, p2.docid").replace("j as (", "j2 as (").replace("from j)", "from j2)").replace("h as (", "h2 as (").replace("from h group", "from h2 group").replace(" a as (", " a2 as (").replace("join a using", "join a2 using").replace(", i as (select qid, n, list_sum(list_transform(range(1, n + 1), lambda x: 1.0::double / log2(x + 1))) as ideal from nt)", "").replace(" m as (", " m2 as (")
_DIFF = ", dd as (" + " union all ".join(f"select '{n}' as metric, m.{n} - m2.{n} as d from m join m2 using (qid)" for n in _TESTED) + ")"


def _differences(spark, d):
    return metrics.paired(_measured(spark, d), _measured(spark, d, k1=2.16, b=0.61), _TESTED)


@query("with " + _BOTH + _DIFF + " select metric, count(*) as n, round(avg(d), 6) as mean_diff, round(case when stddev_samp(d) > 0 then avg(d) / (stddev_samp(d) / sqrt(count(*))) end, 4) as t from dd group by 1", ("run",))
def paired_ttest_stat(spark, d):
    return metrics.t_statistic(_differences(spark, d)).select("metric", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 4).alias("t"))


@query("with " + _BOTH + _DIFF + ", r as (select metric, d, rank() over (partition by metric order by round(abs(d), 9)) + (count(*) over (partition by metric, round(abs(d), 9)) - 1) / 2.0::double as r from dd where d <> 0) select metric, count(*) as n, coalesce(sum(r) filter (d > 0), 0)::double as w_plus, coalesce(sum(r) filter (d < 0), 0)::double as w_minus, least(w_plus, w_minus) as w from r group by 1", ("run",))
def wilcoxon_stat(spark, d):
    return metrics.wilcoxon(_differences(spark, d))
