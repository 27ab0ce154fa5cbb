"""The stored index: built once for a folder of tables, searched by later queries and sessions."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from docloom.functions.text import tokenize
from docloom.operators import index
from docloom.operators.numbering import shared_folder
from docloom.plans import bridge
from docloom.plans.registry import query


def _index(spark, d):
    docs = bridge.docs(spark, d).select("docid", F.col("body").alias("contents"))
    at = f"{shared_folder(spark)}/docloom-index-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    return index.opened(docs, at, contents="body of documents")


@query("select qid, docid, rank::int as rank, score from run", ("run",))
def index_search(spark, d):
    return index.search(_index(spark, d), bridge.queries(spark, d))


@query("select qid, docid, rank::int as rank, score from run", ("run",), k1=2.16, b=0.61, k=10)
def index_search_top10(spark, d):
    return index.search(_index(spark, d), bridge.queries(spark, d), 10, 2.16, 0.61)


_PHRASES = r"""toks as (select docid, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') as t from docs),
 asked as (select qid as pid, regexp_extract_all(lower(query), '[\p{L}\p{N}]+')[2:4] as p from queries),
 spots as (select docid, t[i] as a, t[i + 1] as b, t[i + 2] as c from (select docid, t, unnest(range(1, len(t) + 1)) as i from toks)),
 three as (select docid, array_to_string(list_filter([a, b, c], lambda x: x is not null), ' ') as w from spots),
 two as (select docid, a || ' ' || b as w from spots where b is not null), one as (select docid, a as w from spots),
 sized as (select pid, len(p) as n, array_to_string(p, ' ') as w from asked)"""


@query(f"with {_PHRASES} select pid, docid, count(*) as n from (select pid, docid from sized join three using (w) where n = 3 and len(string_split(w, ' ')) = 3 union all select pid, docid from sized join two using (w) where n = 2 union all select pid, docid from sized join one using (w) where n = 1) group by 1, 2", ("docs", "queries"))
def index_phrases(spark, d):
    """Documents that hold the second to fourth word of a query one after the other, and how often."""
    asked = bridge.queries(spark, d).select(F.col("qid").alias("pid"), F.array_join(F.slice(tokenize("query"), 2, 3), " ").alias("phrase"))
    return index.phrases(_index(spark, d), asked)
