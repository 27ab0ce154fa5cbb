"""Training and evaluation instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import corpus, hooks, instances
from docloom.plans import bridge
from docloom.plans.projections import _VOCAB, vocabulary
from docloom.plans.registry import query

_CHUNKS = r"""recursive s as (select docid, list_filter(list_transform(list_filter(list_transform(regexp_extract_all(body, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_extract_all(lower(x), '[\p{L}\p{N}]+')), lambda t: len(t) > 0) as sents, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') as title from docs),
 f as (select docid, 0 as i, title as cur, null::varchar[] as emitted, 0 as n, sents, title from s
   union all select docid, i + 1, case when full_ then title else cur2 end, case when full_ or last_ then list_append(cur2[1:63], '</s>') end, n + (full_ or last_)::int, sents, title
   from (select *, list_concat(cur, sents[i + 1]) as cur2, len(list_concat(cur, sents[i + 1])) >= 63 as full_, i + 1 = len(sents) as last_ from f where i < len(sents) and n < 3)),
 chunks as (select docid, n - 1 as n, array_to_string(emitted, ' ') as tokens from f where emitted is not null)"""


@query("with " + _CHUNKS + " select docid, n::int as n, tokens from chunks", ("docs",))
def passage_chunks(spark, d):
    return instances.passages(bridge.docs(spark, d)).select("docid", "n", F.array_join("tokens", " ").alias("tokens"))


_TERMS = (
    _VOCAB[5:]
    + r""", idf as (select v.term, ln((select count(*) from docs) / (coalesce(x.df, 0) + 1)) as idf from v left join (select term, count(*) as df from (select distinct docid, unnest(regexp_extract_all(lower(title || ' ' || body), '[\p{L}\p{N}]+')) as term from docs) group by 1) x using (term)),
 w as (select docid, regexp_extract_all(lower(concat_ws(' ', title, body)), '[\p{L}\p{N}]+')[1:1024] as w from docs),
 o as (select docid, len(w) as len, generate_subscripts(w, 1) as pos, unnest(w) as term from w),
 sc as (select docid, pos, term, round(count(*) over (partition by docid, term) / len::double * idf, 9) as score from o join idf using (term)),
 th as (select docid, count(*) as n, list(score order by score desc)[least(63, count(*))] as threshold from sc group by 1 having count(*) >= 10),
 terms as (select docid, array_to_string(list_append(list(term order by pos)[1:63], '</s>'), ' ') as tokens from sc join th using (docid) where score >= threshold group by 1 having count(distinct term) >= 2)"""
)


@query("with " + _TERMS + " select docid, tokens from terms", ("docs", "df"))
def sampled_terms(spark, d):
    docs = bridge.docs(spark, d)
    idf = corpus.term_idf(docs, vocabulary(spark, d))
    return instances.sampled_terms(docs, idf).select("docid", F.array_join("tokens", " ").alias("tokens"))


_CODE = "array_to_string(code, ',')"


def _codes(spark, d):
    return bridge.codes(spark, d).select("docid", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


@query(f"select q.docid, q.qid, query, {_CODE} as code from qrels q join queries using (qid) join codes using (docid)", ("qrels", "codes"))
def query_instances(spark, d):
    return instances.query_instances(bridge.qrels(spark, d), bridge.queries(spark, d), _codes(spark, d))


@query(f"select q.docid, q.qid, query, {_CODE} as code from qrels q join queries using (qid) join codes using (docid)", ("qrels", "codes"))
def eval_query_instances(spark, d):
    judged = bridge.qrels(spark, d).select("qid", "docid")
    unknown = judged.select(F.concat(F.lit("x"), "qid").alias("qid"), "docid")
    return instances.query_instances(judged.unionByName(unknown), bridge.queries(spark, d), _codes(spark, d), strict=False)


@query("select docid, array_to_string(code, ',') as source_code, array_to_string(list_reverse(code), ',') as label_code from codes", ("codes",))
def enhanced_docid_instances(spark, d):
    other = bridge.codes(spark, d).select("docid", F.array_join(F.reverse("code").cast("array<string>"), ",").alias("code"))
    return instances.recoded(_codes(spark, d), other)


def _pseudo(spark, d):
    """A pseudo-query a document: its last line; some name documents that are not there."""
    rows = bridge.docs(spark, d)
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("[X"), "doc_id", F.lit("]"))).otherwise(F.concat(F.lit("[D"), "doc_id", F.lit("]")))
    return rows.select(text.normalize_docid(name).alias("docid"), F.substring_index("body", "\n", -1).alias("query"))


def _bracketed(spark, d):
    return _codes(spark, d).withColumn("docid", text.normalize_docid("docid"))


@query(f"select '[' || docid || ']' as docid, string_split(body, chr(10))[-1] as query, {_CODE} as code from docs join codes using (docid) where doc_id % 10 <> 0", ("docs", "codes"))
def fake_query_instances(spark, d):
    return _pseudo(spark, d).join(_bracketed(spark, d), "docid").select("docid", "query", "code")


@query("select '[x' || doc_id || ']' as docid, string_split(body, chr(10))[-1] as query from docs where doc_id % 10 = 0", ("docs",))
def fake_query_skipped(spark, d):
    return _pseudo(spark, d).join(_bracketed(spark, d).select("docid"), "docid", "left_anti").select("docid", "query")


@query("with " + _CHUNKS + ", " + _TERMS + " select docid, 'passage' as kind, len(string_split(tokens, ' '))::int as n from chunks union all select docid, 'terms', len(string_split(tokens, ' '))::int from terms union all select docid, 'docid', len(code)::int from codes", ("docs", "df", "codes"))
def pretrain_union(spark, d):
    docs = bridge.docs(spark, d)
    passages = instances.passages(docs).select("docid", F.lit("passage").alias("kind"), F.size("tokens").alias("n"))
    terms = instances.sampled_terms(docs, corpus.term_idf(docs, vocabulary(spark, d))).select("docid", F.lit("terms").alias("kind"), F.size("tokens").alias("n"))
    return passages.unionByName(terms).unionByName(bridge.codes(spark, d).select("docid", F.lit("docid").alias("kind"), F.size("code").alias("n")))


@query(r"select docid, (row_number() over (partition by docid order by sha256('5|' || docid || '|' || n), n))::int - 1 as sample, sentence as query from (select docid, unnest(range(0, len(s))) as n, unnest(s) as sentence from (select docid, list_filter(list_transform(regexp_extract_all(body, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') as s from docs)) qualify sample < 10", ("docs",))
def pseudo_queries(spark, d):
    return hooks.pseudo_queries(bridge.docs(spark, d).select("docid", F.col("body").alias("contents")))


@query(r"select docid, array_to_string(list_concat(list_transform(list_slice(coalesce(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), []), 1, 15), lambda t: ('0x' || substr(md5(t), 1, 4))::int), [1]), ',') as prompt_ids, least(16, len(coalesce(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), [])) + 1)::int as n_mask, array_to_string(code, ',') as chosen, array_to_string(list_reverse(code), ',') as rejected from docs join codes using (docid)", ("docs", "codes"))
def preference_tokens(spark, d):
    cut = lambda c: F.transform(text.tokenize(c), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"))
    pairs = bridge.docs(spark, d).select("docid", F.col("title").alias("prompt")).join(bridge.codes(spark, d).select("docid", F.col("code").alias("chosen"), F.reverse("code").alias("rejected")), "docid")
    got = hooks.preference_tokens(pairs, cut, 16)
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return got.select("docid", flat("prompt_input_ids").alias("prompt_ids"), F.size("prompt_attention_mask").alias("n_mask"), flat("chosen_labels").alias("chosen"), flat("rejected_labels").alias("rejected"))
