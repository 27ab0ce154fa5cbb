"""Choosing and splitting a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import corpus, numbering
from docloom.plans import bridge
from docloom.plans.projections import _VOCAB, vocabulary
from docloom.plans.registry import query

_COUNTS = "with c as (select coalesce(s.docid, k.docid) as docid, coalesce(k.n, 0) as clicks from shelf s full join (select docid, count(*) as n from clicks group by 1) k on s.docid = k.docid) "


@query(_COUNTS + "select docid, clicks from c", ("shelf", "clicks"))
def doc_click_counts(spark, d):
    return corpus.click_counts(bridge.shelf(spark, d), bridge.clicks(spark, d))


@query("select docid, title from shelf semi join clicks using (docid)", ("shelf", "clicks"))
def clicked_docs(spark, d):
    return bridge.shelf(spark, d).join(bridge.clicks(spark, d).select("docid"), "docid", "left_semi").select("docid", "title")


@query(_COUNTS + "select docid, clicks, title from c join shelf using (docid) where clicks > 0 order by clicks desc, docid limit 300", ("shelf", "clicks"))
def top_clicked_docs(spark, d):
    shelf = bridge.shelf(spark, d)
    counted = corpus.click_counts(shelf, bridge.clicks(spark, d)).where("clicks > 0")
    best = counted.join(shelf.select("docid", "title"), "docid").orderBy(F.desc("clicks"), "docid").limit(300)  # top-k
    return best.select("docid", "clicks", "title")


@query(_VOCAB + ", d as (select term, count(*) as df from (select distinct docid, unnest(regexp_extract_all(lower(title || ' ' || body), '[\\p{L}\\p{N}]+')) as term from docs) group by 1) select v.term, coalesce(d.df, 0) as df, round(ln((select count(*) from docs) / (coalesce(d.df, 0) + 1)), 6) as idf from v left join d using (term)", ("df",))
def term_idf(spark, d):
    return corpus.term_idf(bridge.docs(spark, d), vocabulary(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("with t as (select docid, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')[1:1024] as w from docs), u as (select docid, len(w) as len, unnest(w) as term from t) select docid, term, round(count(*)::double / len, 9) as tf from u group by docid, term, len", ("docs",))
def term_tf(spark, d):
    return corpus.term_tf(bridge.docs(spark, d)).select("docid", "term", F.round("tf", 9).alias("tf"))


@query("select conv_id, string_agg(role, ',' order by turn) as roles, count(*) as n from conversations group by 1")
def group_lists(spark, d):
    return bridge.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(numbering.in_order("role", "turn"), ",").alias("roles"), F.count("*").alias("n"))


_SPLIT = "with r as (select case when page_id % 5 = 0 then 'dev' else 'train' end as split, page_id as position, title, docid from ptab) "


def _split_titles(spark, d):
    return bridge.pages(spark, d).select(F.when(F.col("page_id") % 5 == 0, "dev").otherwise("train").alias("split"), F.col("page_id").alias("position"), "title", "docid")


@query(_SPLIT + "select title, docid, split from r qualify row_number() over (partition by title order by case split when 'train' then 0 else 1 end, position) = 1", ("ptab",))
def dedup_title_first(spark, d):
    return corpus.first_titles(_split_titles(spark, d), ("train", "dev")).select("title", "docid", "split")


_IDS = "i as (select title, row_number() over (order by min(position), title) - 1 as title_id from r group by title) "


@query(_SPLIT + ", " + _IDS + "select title, title_id from i", ("ptab",))
def title_ids(spark, d):
    return corpus.title_ids(_split_titles(spark, d))


@query(_SPLIT + ", " + _IDS + "select docid, title_id from r join i using (title)", ("ptab",))
def title_id_join(spark, d):
    rows = _split_titles(spark, d)
    return rows.join(corpus.title_ids(rows), "title").select("docid", "title_id")


@query("select docid, 'train' as split from docs where doc_id % 3 <> 0 union all select docid, 'dev' from docs where doc_id % 3 = 0 union all select docid, 'pages' from ptab", ("docs", "ptab"))
def union_splits(spark, d):
    docs = bridge.docs(spark, d)
    train, dev = docs.where("doc_id % 3 <> 0").select("docid", F.lit("train").alias("split")), docs.where("doc_id % 3 = 0").select("docid", F.lit("dev").alias("split"))
    return train.unionByName(dev).unionByName(bridge.pages(spark, d).select("docid", F.lit("pages").alias("split")))


@query("select docid, case when ('0x' || substr(sha256('13|' || docid), 1, 8))::bigint % 100 < 1 then 'valid' else 'train' end as split from docs", ("docs",))
def train_valid_split(spark, d):
    return bridge.docs(spark, d).select("docid", F.when(corpus.in_share(F.col("docid"), 1, "13"), "valid").otherwise("train").alias("split"))


@query("select '[' || docid || ']' as token, 32128 + row_number() over (order by docid) - 1 as id from docs", ("docs",))
def docid_vocab(spark, d):
    rows = bridge.docs(spark, d).select("docid", text.normalize_docid("docid").alias("token"))
    return numbering.numbered(rows, [F.col("docid")], "id", 32128).select("token", "id")


@query("with t as (select distinct docid, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) as term from docs), e as (select docid, (ascii(term) * 31 + length(term)) % 500 as vec_id from t), s as (select docid, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from e join embeddings using (vec_id) union all select docid, generate_subscripts(embedding, 1), unnest(embedding)::double from (select distinct docid from t), (select embedding from embeddings where vec_id = 0)) select docid, i::int as i, round(avg(v), 6) as v from s group by 1, 2", ("docs",))
def docid_embed_mean(spark, d):
    from docloom.operators.docids import mean_embedding

    terms = bridge.docs(spark, d).select("docid", F.explode(F.array_distinct(text.tokenize("title"))).alias("term"))
    vectors = bridge.table(spark, d, "embeddings").select("vec_id", "embedding")
    keyed = terms.select("docid", ((F.ascii("term") * 31 + F.length("term")) % 500).cast("long").alias("vec_id"))
    got = mean_embedding(keyed, vectors, 0)
    return got.select("docid", "i", F.round("v", 6).alias("v"))
