"""Positives of queries, and their identifiers in other namespaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import numbering, positives
from docloom.plans import bridge
from docloom.plans.registry import query

_GROUPS = "with g as (select doc_id as pos, lower(substr(query_text, 8)) as query, text_id from originals where length(query_text) > 7), s as (select query, list(distinct text_id order by text_id) as positives from g group by 1) "


def _groups(spark, d):
    q = F.lower(F.expr("substring(query_text, 8)"))
    return bridge.originals(spark, d).where("length(query_text) > 7").select(F.col("doc_id").alias("pos"), q.alias("query"), "text_id")


@query(_GROUPS + "select query, array_to_string(positives, ' ') as positives from s", ("originals",))
def query_positive_sets(spark, d):
    return positives.query_sets(_groups(spark, d)).select("query", positives.joined("positives").alias("positives"))


_EDGES = "with recursive e as (select doc_id as id, 'a' || substr(text, 1, 12) as g from documents union select doc_id, 'b' || source || (doc_id // 40) from documents where doc_id % 20 < 2), "


@query(_EDGES[:-2] + ", r as (select id, id as component from e union select b.id, r.component from r join e a on a.id = r.id join e b on b.g = a.g) select id, min(component) as component from r group by id")
def positive_components(spark, d):
    rows = bridge.table(spark, d, "documents")
    n = F.col("doc_id")
    same = rows.select(n.alias("id"), F.concat(F.lit("a"), F.substring("text", 1, 12)).alias("group"))
    near = rows.where("doc_id % 20 < 2").select(n.alias("id"), F.concat(F.lit("b"), "source", F.floor(n / 40)).alias("group"))
    return positives.components(same.unionByName(near))


@query(_GROUPS + "select count(*) filter (len(positives) > 1) as n_groups, coalesce(max(len(positives)) filter (len(positives) > 1), 1)::int as largest, coalesce(sum(len(positives)) filter (len(positives) > 1), 0)::bigint as n_ids from s", ("originals",))
def multilabel_stats(spark, d):
    return positives.multilabel_stats(positives.query_sets(_groups(spark, d)))


_MAP = """with raw as (select doc_id * 10 as pos, lang || (doc_id % 50) as query, 'd' || (doc_id % 300) as text_id from documents union all select doc_id * 10 + 1, source, 'd' || (doc_id % 200) from documents),
 first as (select query, text_id, min(pos) as pos from raw group by 1, 2),
 grp as (select query, min(pos) as at_, list(text_id order by pos) as positives from first group by 1),
 pm as (select text_id, arg_max(positives, at_) as positives from first join grp using (query) group by 1) """


def _map_rows(spark, d):
    rows = bridge.table(spark, d, "documents")
    n = F.col("doc_id")
    one = rows.select((n * 10).alias("pos"), F.concat("lang", n % 50).alias("query"), F.concat(F.lit("d"), n % 300).alias("text_id"))
    two = rows.select((n * 10 + 1).alias("pos"), F.col("source").alias("query"), F.concat(F.lit("d"), n % 200).alias("text_id"))
    return one.unionByName(two)


@query(_MAP + "select text_id, array_to_string(positives, ' ') as positives from pm")
def positive_map_last_wins(spark, d):
    return positives.positive_map(_map_rows(spark, d)).select("text_id", positives.joined("positives").alias("positives"))


@query(_MAP + "select row_no, 'd' || raw_id as text_id, array_to_string(coalesce(positives, ['d' || raw_id]), ' ') as positives, positives is null as missed from augment left join pm on text_id = 'd' || raw_id", ("augment",))
def attach_positives(spark, d):
    return _attached(spark, d).select("row_no", "text_id", positives.joined("positives").alias("positives"), "missed")


def _attached(spark, d):
    rows = bridge.augment(spark, d).select("row_no", F.concat(F.lit("d"), "raw_id").alias("text_id"))
    return positives.attach(rows, positives.positive_map(_map_rows(spark, d)))


@query(_MAP + "select count(*) as n_rows, count(*) filter (len(positives) > 1) as multi, count(*) filter (positives is null) as missed from augment left join pm on text_id = 'd' || raw_id", ("augment",))
def attach_positives_stats(spark, d):
    return _attached(spark, d).agg(F.count("*").alias("n_rows"), F.count_if(F.size("positives") > 1).alias("multi"), F.count_if("missed").alias("missed"))


@query("select min(doc_id) as id from originals where length(query_text) > 7 group by lower(substr(query_text, 8))", ("originals",))
def dedup_positive_groups(spark, d):
    rows = _groups(spark, d).select(F.col("pos").alias("id"), F.col("query").alias("group"))
    return positives.first_of_component(rows.select("id").distinct().withColumn("at", F.col("id")), positives.components(rows), "at").select("id")


_AUG = "a as (select case when doc_id % 4 = 0 then lower(split_part(text, chr(10), 1)) || ' ' else string_split(text, chr(10))[-1] end as text, doc_id::varchar as numeric_id from documents where doc_id % 7 <> 0), o as (select numeric_id, substr(query_text, 8) as query from originals where doc_id % 11 <> 0)"


@query(f"with {_AUG}, k as (select * from a where numeric_id in (select numeric_id from o)) select numeric_id, text, false as is_original from k union all select numeric_id, query, true from o where numeric_id in (select numeric_id from k) and not exists (select 1 from k where k.numeric_id = o.numeric_id and lower(trim(k.text)) = lower(trim(o.query)))", ("originals",))
def merge_queries(spark, d):
    rows = bridge.table(spark, d, "documents").where("doc_id % 7 <> 0")
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lower(F.substring_index("text", "\n", 1)), F.lit(" "))).otherwise(F.substring_index("text", "\n", -1))
    augmented = rows.select(said.alias("text"), F.col("doc_id").cast("string").alias("numeric_id"))
    originals = bridge.originals(spark, d).where("doc_id % 11 <> 0").select("numeric_id", F.expr("substring(query_text, 8)").alias("query"))
    return positives.merge_queries(augmented, originals)


@query("select 'vault-' || lpad((row_number() over (order by row_no) - 1)::varchar, 9, '0') as query_key, row_no from augment where numeric_id <> ''", ("augment",))
def query_keys(spark, d):
    rows = bridge.augment(spark, d).where("numeric_id <> ''").select("row_no")
    got = numbering.numbered(rows, [F.col("row_no")], "n")
    return got.select(F.format_string("vault-%09d", "n").alias("query_key"), "row_no")


_STRUCT = "st as (select url as key, structure from originals where doc_id % 6 <> 0 union all select numeric_id, structure || 'x' from originals where doc_id % 5 = 0)"


@query(f"with {_STRUCT}, k as (select text_id, unnest([url, numeric_id]) as key from originals) select text_id, coalesce(string_agg(distinct structure, ' ' order by structure), '') as structures from k left join st using (key) group by 1", ("originals",))
def docs_with_structure(spark, d):
    return _docs_with_structure(spark, d).select("text_id", positives.joined("structures").alias("structures"))


def _docs_with_structure(spark, d):
    o = bridge.originals(spark, d)
    st = o.where("doc_id % 6 <> 0").select(F.col("url").alias("key"), "structure").unionByName(o.where("doc_id % 5 = 0").select(F.col("numeric_id").alias("key"), F.concat("structure", F.lit("x")).alias("structure")))
    return positives.with_structures(o.select("text_id", F.array("url", "numeric_id").alias("keys")), st)


@query(f"with {_STRUCT}, k as (select text_id, unnest([url, numeric_id]) as key from originals), c as (select text_id, count(distinct structure) as n from k left join st using (key) group by 1) select count(*) filter (n = 1) as unique_, count(*) filter (n = 0) as none_, count(*) filter (n > 1) as ambiguous from c", ("originals",))
def structure_coverage(spark, d):
    n = F.size("structures")
    return _docs_with_structure(spark, d).agg(F.count_if(n == 1).alias("unique_"), F.count_if(n == 0).alias("none_"), F.count_if(n > 1).alias("ambiguous"))


_MERGE = """with b as (select url, structure from originals where doc_id % 6 <> 0), l as (select text_id, url from originals where doc_id % 8 <> 3),
 rws as (select doc_id as row_no, url, [text_id, 'd' || (doc_id // 2)] as text_ids from originals),
 br as (select row_no, structure from (select row_no, unnest(text_ids) as text_id from rws) left join (select text_id, structure from l join b using (url)) using (text_id)),
 s as (select row_no, list(distinct structure order by structure) filter (structure is not null) as bridged, count(*) filter (structure is null) as unbridged from br group by 1),
 m as (select row_no, url, b.structure, list_concat(case when b.structure is not null then [b.structure] else [] end, list_filter(coalesce(bridged, []), lambda x: b.structure is null or x <> b.structure)) as positives,
   case when b.structure is null then 'no_structure' when unbridged > 0 then 'no_bridge' end as reason from rws left join b using (url) left join s using (row_no)) """


def _merged(spark, d):
    o = bridge.originals(spark, d)
    rows = o.select(F.col("doc_id").alias("row_no"), "url", F.array(F.col("text_id"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2))).alias("text_ids"))
    return positives.merge_structure(rows, o.where("doc_id % 6 <> 0").select("url", "structure"), o.where("doc_id % 8 <> 3").select("text_id", "url"))


@query(_MERGE + "select row_no, structure, array_to_string(positives, ' ') as positives from m where reason is null", ("originals",))
def merge_structure(spark, d):
    return _merged(spark, d).where("reason is null").select("row_no", "structure", positives.joined("positives").alias("positives"))


@query(_MERGE + "select row_no, unnest(positives) as structure from m where reason is null", ("originals",))
def merge_structure_expanded(spark, d):
    return _merged(spark, d).where("reason is null").select("row_no", F.explode("positives").alias("structure"))


@query(_MERGE + "select row_no, url, reason from m where reason is not null", ("originals",))
def merge_structure_missing(spark, d):
    return _merged(spark, d).where("reason is not null").select("row_no", "url", "reason")


_PAIRS = """u as (select text_id, url from originals where doc_id % 9 <> 4 union all select text_id, url || '#2' from originals where doc_id % 13 = 0 union all select 'd' || (doc_id + 1), url from originals where doc_id % 17 = 2 and doc_id % 9 = 3),
 su as (select text_id, min(url) as url from u group by 1 having count(distinct url) = 1), pr as (select qid as query_key, 'd' || (item_id * 3) as chosen, docid as rejected from run join queries using (qid) where rank <= 20),
 pu as (select pr.*, a.url as chosen_url, b.url as rejected_url, case when a.url is null or b.url is null then 'unmapped' when a.url = b.url then 'same' else 'ok' end as status from pr left join su a on a.text_id = chosen left join su b on b.text_id = rejected) """


def _pairs_urls(spark, d):
    o = bridge.originals(spark, d)
    u = o.where("doc_id % 9 <> 4").select("text_id", "url").unionByName(o.where("doc_id % 13 = 0").select("text_id", F.concat("url", F.lit("#2")).alias("url")))
    u = u.unionByName(o.where("doc_id % 17 = 2 and doc_id % 9 = 3").select(F.concat(F.lit("d"), F.col("doc_id") + 1).alias("text_id"), "url"))
    r = bridge.run(spark, d, 20).join(bridge.queries(spark, d).select("qid", "item_id"), "qid")
    pairs = r.select(F.col("qid").alias("query_key"), F.concat(F.lit("d"), F.col("item_id") * 3).alias("chosen"), F.col("docid").alias("rejected"))
    return positives.pairs_to_url(pairs, positives.single_urls(u))


@query(f"with {_PAIRS} select query_key, chosen_url, rejected_url, chosen, rejected from pu where status = 'ok'", ("run", "originals"))
def pairs_to_url(spark, d):
    return _pairs_urls(spark, d).where("status = 'ok'").select("query_key", "chosen_url", "rejected_url", "chosen", "rejected")


@query(f"with {_PAIRS} select status, count(*) as n from pu group by 1", ("run", "originals"))
def pairs_to_url_stats(spark, d):
    return _pairs_urls(spark, d).groupBy("status").agg(F.count("*").alias("n"))


_RELABEL = """with dd as (select text_id, url, structure from originals union all select text_id, url, structure || 'y' from originals where doc_id % 10 = 7),
 q as (select doc_id as query_key, text_id as target, case when doc_id % 12 = 5 then 'nowhere' else url end as url, [text_id, 'd' || (doc_id // 3)] as positives from originals),
 x as (select url, ['extra/' || (doc_id % 3)] as extra from originals where doc_id % 4 = 1),
 od as (select text_id, list(distinct structure order by structure) as s from dd group by 1), bu as (select url, min(structure) as by_url from dd group by 1),
 via as (select query_key, list(distinct structure order by structure) as via from (select query_key, unnest(positives) as text_id from q) join dd using (text_id) group by 1),
 r as (select query_key, case when len(s) = 1 then s[1] end as chosen, coalesce(via, []) as via, coalesce(extra, []) as extra, by_url from q left join od on od.text_id = target left join via using (query_key) left join x using (url) left join bu using (url)),
 rl as (select query_key, chosen, list_concat(case when chosen is null then [] else [chosen] end, list_filter(via, lambda v: chosen is null or v <> chosen), extra) as positives, coalesce(by_url = chosen, false) as agrees from r) """


def _relabelled(spark, d):
    o = bridge.originals(spark, d)
    docs = o.select("text_id", "url", "structure").unionByName(o.where("doc_id % 10 = 7").select("text_id", "url", F.concat("structure", F.lit("y")).alias("structure")))
    q = o.select(F.col("doc_id").alias("query_key"), F.col("text_id").alias("target"), F.when(F.col("doc_id") % 12 == 5, "nowhere").otherwise(F.col("url")).alias("url"), F.array(F.col("text_id"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 3))).alias("positives"))
    extra = o.where("doc_id % 4 = 1").select("url", F.array(F.concat(F.lit("extra/"), F.col("doc_id") % 3)).alias("positives"))
    return positives.relabel(q, docs, extra)


@query(_RELABEL + "select query_key, chosen, array_to_string(positives, ' ') as positives, agrees from rl", ("originals",))
def relabel_queries(spark, d):
    return _relabelled(spark, d).select("query_key", "chosen", positives.joined("positives").alias("positives"), "agrees")


@query(_RELABEL + "select count(*) as n_queries, count(*) filter (chosen is null) as no_choice, count(*) filter (chosen is not null and not agrees) as disagree, count(*) filter (len(positives) > 1) as multi from rl", ("originals",))
def relabel_stats(spark, d):
    return _relabelled(spark, d).agg(F.count("*").alias("n_queries"), F.count_if(F.col("chosen").isNull()).alias("no_choice"), F.count_if(F.col("chosen").isNotNull() & ~F.col("agrees")).alias("disagree"), F.count_if(F.size("positives") > 1).alias("multi"))


@query("select structure as target, string_agg(text_id, ' ' order by text_id) as owners from originals group by 1", ("originals",))
def target_owners(spark, d):
    return bridge.originals(spark, d).groupBy(F.col("structure").alias("target")).agg(F.array_join(F.array_sort(F.collect_set("text_id")), " ").alias("owners"))


@query("with t as (select text_id, case when doc_id % 14 = 0 then 0 when doc_id % 15 = 0 then 2 else 1 end as n, structure from originals), s as (select structure, count(*) as n from t where n = 1 group by 1) select (select count(*) filter (n <> 1) from t) as invalid_docs, count(*) as n_targets, count(*) filter (n > 1) as shared, coalesce(sum(n) filter (n > 1), 0)::bigint as docs_in_shared, coalesce(sum(n - 1) filter (n > 1), 0)::bigint as surplus from s", ("originals",))
def target_collision_stats(spark, d):
    from docloom.operators.mining import collision_stats

    n = F.col("doc_id")
    own = F.when(n % 14 == 0, F.array().cast("array<string>")).when(n % 15 == 0, F.array(F.col("structure"), F.col("url"))).otherwise(F.array("structure"))
    return collision_stats(bridge.originals(spark, d).select("text_id", own.alias("targets")))
