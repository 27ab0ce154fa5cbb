"""Normalisation, validation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import arrays, text
from docloom.operators import corpus, nq, resolve, validate
from docloom.plans import bridge
from docloom.plans.registry import query


def _messy(c):
    return F.concat(F.lit("  qUERY :\t "), c, F.lit("  \n x "))


@query(r"select docid, lower(trim(regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') || ' x')) as query from docs", ("docs",))
def normalize_query(spark, d):
    return bridge.docs(spark, d).select("docid", text.normalize_query(_messy(F.col("title"))).alias("query"))


@query(r"select docid, trim(trim(regexp_replace(title, '\s+', ' ', 'g')) || ' x') as prompt from docs", ("docs",))
def clean_prompt(spark, d):
    return bridge.docs(spark, d).select("docid", text.clean_prompt(_messy(F.col("title"))).alias("prompt"))


@query("select docid, array_to_string(list_transform(code, lambda x: x::varchar), ',') as given, string_agg(x, ',' order by i) as ids from (select docid, code, x, min(i) as i from (select docid, code, unnest([code[3], code[1], code[3], code[2], code[1]])::varchar as x, unnest(range(5)) as i from codes) group by docid, code, x) group by docid, code", ("codes",))
def id_list_normalize(spark, d):
    c = F.col("code").cast("array<string>")
    raw = F.concat(F.array(F.get(c, F.lit(2)), F.lit(""), F.get(c, F.lit(0)), F.lit(None).cast("string")), F.array(F.get(c, F.lit(2)), F.get(c, F.lit(1)), F.get(c, F.lit(0))))
    return bridge.codes(spark, d).select("docid", F.array_join(c, ",").alias("given"), F.array_join(text.ids(raw), ",").alias("ids"))


@query(
    """select text_id, kind, target from (select text_id, unnest(['text_id', 'url', 'structure']) as kind,
    unnest([text_id, case (substr(text_id, 2)::int) % 3 when 0 then url || ' ' || structure when 1 then url else url end, structure]) as target from originals)""",
    ("originals",),
)
def document_targets(spark, d):
    n = F.col("doc_id") % 3
    rows = bridge.originals(spark, d).select(
        "text_id",
        F.when(n == 0, F.array("url", "structure")).alias("url_based_ids"),
        F.when(n == 1, F.col("url")).alias("url_based_id"),
        F.when(n == 2, F.col("url")).alias("url_id"),
        F.when(n == 0, F.array("structure")).alias("structure_ids"),
        F.col("structure").alias("structure_id"),
    )
    return resolve.document_targets(rows)


@query("select docid, '[' || docid || ']' as normal from docs", ("docs",))
def normalize_docid(spark, d):
    given = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[D"), F.col("doc_id"), F.lit("]"))).otherwise(F.col("docid"))
    return bridge.docs(spark, d).select("docid", text.normalize_docid(given).alias("normal"))


_URL = r"""with u as (select docid, page_id, title, list_filter(string_split(replace(regexp_replace(lower(trim({url})), '^https?://', ''), '-', ' '), '/'), lambda s: s <> '') as segs from ptab),
 r as (select *, len(segs) > 0 and len(list_filter(segs, lambda s: not regexp_full_match(s, '\p{{N}}+') and s not in ('index', 'page', 'item', 'view', 'default', 'home') and length(s) > 2)) * 2 > len(segs) as rich, lower(trim({title})) as name from u),
 m as (select docid, rich, case when rich then 'url' when name <> '' and len(segs) > 0 then 'title_domain' when name <> '' then 'title' else 'skipped' end as made,
   case when rich then array_to_string(list_concat(list_reverse(segs[2:]), [segs[1]]), ' ') when name <> '' and len(segs) > 0 then name || ' ' || segs[1] when name <> '' then name end as text from r)
"""
_SHORT = "case when page_id % 3 = 0 then regexp_replace(url, '(//[^/]*)/.*', '\\1/7/index/12') when page_id % 11 = 0 then '' else url end"
_BLANK = "case when page_id % 5 = 0 then '' else title end"


def _url_rows(spark, d):
    n = F.col("page_id")
    url = F.when(n % 3 == 0, F.regexp_replace("url", "(//[^/]*)/.*", "$1/7/index/12")).when(n % 11 == 0, "").otherwise(F.col("url"))
    return bridge.pages(spark, d).select("docid", url.alias("url"), F.when(n % 5 == 0, "").otherwise(F.col("title")).alias("title"))


@query(_URL.format(url=_SHORT, title=_BLANK) + "select docid, rich from m", ("ptab",))
def url_semantic_rich(spark, d):
    segments = text.url_segments(F.col("url"))
    return _url_rows(spark, d).select("docid", ((F.size(segments) > 0) & text.url_is_rich(segments)).alias("rich"))


@query(_URL.format(url=_SHORT, title=_BLANK) + "select docid, text from m where made <> 'skipped'", ("ptab",))
def url_title_docid(spark, d):
    made, source = text.url_title(F.col("url"), F.col("title"))
    return _url_rows(spark, d).where(source != "skipped").select("docid", made.alias("text"))


@query(_URL.format(url=_SHORT, title=_BLANK) + "select docid, made as source from m where made <> 'skipped'", ("ptab",))
def url_title_docid_source(spark, d):
    source = text.url_title(F.col("url"), F.col("title"))[1]
    return _url_rows(spark, d).where(source != "skipped").select("docid", source.alias("source"))


@query(_URL.format(url=_SHORT, title=_BLANK) + "select docid, 'no url and no title' as reason from m where made = 'skipped'", ("ptab",))
def url_docid_skipped(spark, d):
    source = text.url_title(F.col("url"), F.col("title"))[1]
    return _url_rows(spark, d).where(source == "skipped").select("docid", F.lit("no url and no title").alias("reason"))


_PREF = """with p as (select conv_id, max(text) filter (turn = 0) as prompt, max(text) filter (turn = 1) as chosen, max(case when conv_id % 4 = 0 then null when conv_id % 4 = 1 then '  ' else text end) filter (turn = 2) as rejected from conversations group by 1),
 c as (select conv_id, trim(coalesce(prompt, '')) as prompt, trim(coalesce(chosen, '')) as chosen, trim(coalesce(rejected, '')) as rejected from p)
"""


def _preferences(spark, d):
    n = F.col("conv_id") % 4
    at = lambda k, v: F.max(F.when(F.col("turn") == k, v))
    said = F.when(n == 0, F.lit(None)).when(n == 1, "  ").otherwise(F.col("text"))
    return bridge.table(spark, d, "conversations").groupBy("conv_id").agg(at(0, F.col("text")).alias("prompt"), at(1, F.col("text")).alias("chosen"), at(2, said).alias("rejected"))


@query(_PREF + "select * from c where prompt <> '' and chosen <> '' and rejected <> '' and chosen <> rejected")
def clean_preferences(spark, d):
    return resolve.clean_preferences(_preferences(spark, d), ["conv_id"])


@query(_PREF + "select count(*) as n_rows, count(*) filter (prompt <> '' and chosen <> '' and rejected <> '' and chosen <> rejected) as kept, count(*) filter (not (prompt <> '' and chosen <> '' and rejected <> '' and chosen <> rejected)) as dropped from c")
def clean_preferences_stats(spark, d):
    return resolve.preference_stats(_preferences(spark, d))


@query("select text_id, unnest(['query', 'code', 'other']) as kind from originals", ("originals",))
def classify_prefix(spark, d):
    rows = bridge.originals(spark, d)
    texts = F.explode(F.array(F.lower("query_text"), "code_text", "repo")).alias("text")
    return rows.select("text_id", texts).select("text_id", text.kind_of("text").alias("kind"))


def _resolved(spark, d, mode):
    known = bridge.originals(spark, d).where("doc_id % 4 <> 1").select("text_id", "numeric_id", "url")
    return resolve.targets(bridge.augment(spark, d), known, mode, F.concat(F.lit("d"), "raw_id")).select("row_no", "target", "how")


_RESOLVE = """with known as (select text_id, numeric_id, url from originals where doc_id % 4 <> 1),
 j as (select a.row_no, n.text_id as by_numeric, r.text_id as by_raw, u.text_id as by_url, k.text_id as is_known, a.raw_id from augment a
   left join known n on a.numeric_id <> '' and n.numeric_id = a.numeric_id left join known r on r.numeric_id = a.raw_id
   left join known u on a.url <> '' and u.url = a.url left join known k on k.text_id = 'd' || a.raw_id)
"""


@query(_RESOLVE + "select row_no, coalesce(by_numeric, by_raw, is_known) as target, case when by_numeric is not null then 'numeric_id' when by_raw is not null then 'raw_numeric' when is_known is not null then 'text_id' else 'none' end as how from j", ("originals", "augment"))
def resolve_target_auto(spark, d):
    return _resolved(spark, d, "auto")


@query(_RESOLVE + "select row_no, coalesce(by_numeric, by_raw) as target, case when by_numeric is not null then 'numeric_id' when by_raw is not null then 'raw_numeric' else 'none' end as how from j", ("originals", "augment"))
def resolve_target_numeric(spark, d):
    return _resolved(spark, d, "numeric_id")


@query(_RESOLVE + "select row_no, coalesce(by_numeric, 'd' || raw_id) as target, case when by_numeric is not null then 'numeric_id' else 'text_id' end as how from j", ("originals", "augment"))
def resolve_target_text_id(spark, d):
    return _resolved(spark, d, "text_id")


@query(_RESOLVE + "select row_no, by_url as target, case when by_url is not null then 'url' else 'none' end as how from j", ("originals", "augment"))
def resolve_target_url(spark, d):
    return _resolved(spark, d, "url")


_CONTENTS = """with rws as (select 'g' || (doc_id % 200) as text_id, doc_id, {meta} as meta, trim(substr(code_text, 7), ' ' || chr(10) || chr(9) || chr(13)) as code from originals),
 s as (select text_id, doc_id, 0 as part, meta as section from rws where meta <> '' union all select text_id, doc_id, 1, code from rws),
 f as (select text_id, section, min(doc_id * 2 + part) as pos from s group by 1, 2)
select text_id, sha256(string_agg(section, chr(10) || chr(10) order by pos)) as digest, count(*) as n from f group by 1"""


def _contents(spark, d, metadata):
    rows = bridge.originals(spark, d).withColumn("text_id", F.concat(F.lit("g"), F.col("doc_id") % 200)).withColumn("params", F.array(F.col("identifier"), F.lit("opts")))
    got = resolve.code_contents(rows, "doc_id", metadata)
    return got.select("text_id", F.sha2("contents", 256).alias("digest"), "n")


@query(_CONTENTS.format(meta="concat_ws(chr(10), repo, replace(path, '/', ' '), identifier, identifier || ' opts', replace(url, '/', ' '))"), ("originals",))
def code_contents(spark, d):
    return _contents(spark, d, True)


@query(_CONTENTS.format(meta="''"), ("originals",))
def code_contents_code_only(spark, d):
    return _contents(spark, d, False)


@query("select qid, query from queries", ("queries",))
def to_queries(spark, d):
    return bridge.queries(spark, d).select("qid", "query")


@query("select qid, '0' as zero, docid, rel::int as rel from qrels", ("qrels",))
def to_qrels(spark, d):
    return bridge.qrels(spark, d).select("qid", F.lit("0").alias("zero"), "docid", "rel")


@query("select docid, url, title, length(html) as n from ptab", ("ptab",))
def to_docs(spark, d):
    return bridge.pages(spark, d).select("docid", "url", "title", F.length("html").cast("long").alias("n"))


_SQ = "trim(regexp_replace(regexp_replace({x}, '<[^<]+?>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("select docid, " + _SQ.format(x="regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)") + " as title, " + _SQ.format(x="regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1)") + " as abstract, sha256(" + _SQ.format(x="regexp_extract(html, '(?is)</p>(.*)</ul>', 1)") + ") as content from ptab", ("ptab",))
def html_extract_fields(spark, d):
    title, abstract, content = nq.html_fields(F.col("html"))
    return bridge.pages(spark, d).select("docid", title.alias("title"), abstract.alias("abstract"), F.sha2(content, 256).alias("content"))


_VOCAB = "with v as (select term, row_number() over (order by term) + 1 as id from (select term from df where df >= 20 order by df desc, term limit 500))"


def vocabulary(spark, d, size=500):
    return corpus.frequent_terms(bridge.docs(spark, d), size)


@query(_VOCAB + r", t as (select docid, generate_subscripts(w, 1) as i, unnest(w) as term from (select docid, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') as w from docs)) select docid, string_agg(coalesce(id, 1)::varchar, ',' order by i) as ids from t left join v using (term) group by docid", ("df",))
def tokens_to_ids(spark, d):
    rows = bridge.docs(spark, d).select("docid", F.posexplode(text.tokenize("title")).alias("i", "term"))
    return resolve.tokens_to_ids(rows, vocabulary(spark, d)).select("docid", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_TARGETS = "with t as (select text_id as target, list_concat(code, case when doc_id % 9 = 0 then [9, 9] else [] end) as tokens from originals join codes on docid = text_id), "
_TK = "array_to_string(list_transform(tokens, lambda x: x::varchar), ',')"


def _targets(spark, d):
    rows = bridge.originals(spark, d).join(bridge.codes(spark, d).withColumnRenamed("docid", "text_id"), "text_id")
    return rows.select(F.col("text_id").alias("target"), F.concat("code", F.when(F.col("doc_id") % 9 == 0, F.array(F.lit(9), F.lit(9))).otherwise(F.array().cast("array<int>"))).alias("tokens"))


@query(_TARGETS + f"k as (select target, {_TK} as tokens from t where len(tokens) <= 4) select tokens, count(*) as n, string_agg(target, ' ' order by target) as targets from k group by tokens having count(*) > 1", ("originals", "codes"))
def target_collisions(spark, d):
    return resolve.target_index(_targets(spark, d), 4).where("n > 1").select("tokens", "n", F.array_join("targets", " ").alias("targets"))


@query(_TARGETS[:-2] + " select target, len(tokens)::int as n from t where len(tokens) > 4", ("originals", "codes"))
def target_overlength(spark, d):
    return resolve.overlong_targets(_targets(spark, d), 4)


@query(_TARGETS + f"k as (select target, {_TK} as tokens from t where len(tokens) <= 4) select tokens, min(target) as target from k group by tokens having count(*) = 1", ("originals", "codes"))
def target_index(spark, d):
    return resolve.target_index(_targets(spark, d), 4).where("n = 1").select("tokens", F.get("targets", F.lit(0)).alias("target"))


@query("select structure as key, count(distinct identifier) as n_values from originals group by 1 having count(distinct identifier) > 1", ("originals",))
def fd_violations(spark, d):
    return validate.dependency_violations(bridge.originals(spark, d), "structure", "identifier")


_GEN = "with g as (select docid, list_concat([0], code, [1, 0, code[1]]) as t from codes) "
_GJ = "array_to_string(list_transform({x}, lambda v: v::varchar), ',')"


def _generated(spark, d):
    return bridge.codes(spark, d).select("docid", F.concat(F.array(F.lit(0)), "code", F.array(F.lit(1), F.lit(0), F.get("code", F.lit(0)))).alias("t"))


@query("with g as (select docid, list_concat(code, [1, 0, code[1]]) as u from codes), z as (select docid, case when list_position(u, 0) is null or list_position(u, 0) = 0 then u else u[1 : list_position(u, 0)::bigint - 1] end as p from g) select docid, " + _GJ.format(x="case when coalesce(list_position(p, 1), 0) = 0 then p else p[1 : list_position(p, 1)::bigint] end") + " as code from z", ("codes",))
def canonical_codes_model(spark, d):
    return _generated(spark, d).select("docid", resolve.canonical_model(F.col("t")).alias("code"))


@query(_GEN + ", p as (select docid, list_filter(t, lambda v: v <> 0) as p from g) select docid, " + _GJ.format(x="case when coalesce(list_position(p, 1), 0) = 0 then p else p[1 : list_position(p, 1)::bigint] end") + " as code from p", ("codes",))
def canonical_codes_msmarco(spark, d):
    return _generated(spark, d).select("docid", resolve.canonical_msmarco(F.col("t")).alias("code"))


@query(_GEN + "select docid, " + _GJ.format(x="list_filter(t, lambda v: v <> 0 and v <> 1)") + " as code from g", ("codes",))
def canonical_codes_nq(spark, d):
    return _generated(spark, d).select("docid", resolve.canonical_nq(F.col("t")).alias("code"))


@query(r"select docid, unnest(range(1, len(s) + 1))::int - 1 as n, unnest(s) as sentence from (select docid, list_filter(list_transform(regexp_extract_all(body, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') as s from docs)", ("docs",))
def sentence_split(spark, d):
    return bridge.docs(spark, d).select("docid", F.posexplode(text.sentences("body")).alias("n", "sentence"))


@query(r"select docid, array_to_string(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), ' ') as tokens from docs", ("docs",))
def tokenize(spark, d):
    return bridge.docs(spark, d).select("docid", F.array_join(text.tokenize("title"), " ").alias("tokens"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")
def vector_l2(spark, d):
    return bridge.table(spark, d, "embeddings").select("vec_id", F.round(arrays.norm(F.col("embedding")), 6).alias("norm"))


@query("with q as (select embedding as e from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(embedding::double[], e::double[]), 6) as cosine from embeddings, q")
def vector_cosine(spark, d):
    e = bridge.table(spark, d, "embeddings")
    one = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return e.join(one).select("vec_id", F.round(arrays.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("select event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.v'), 'none') as k from events")
def json_field(spark, d):
    props = F.col("props")
    return bridge.table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(props, "$.k"), F.get_json_object(props, "$.v"), F.lit("none")).alias("k"))


@query("select docid, array_to_string(list_transform(code, lambda x: case when x = 0 then '-100' else x::varchar end), ',') || ',-100,-100' as labels from codes", ("codes",))
def collate_labels(spark, d):
    return bridge.codes(spark, d).select("docid", F.array_join(arrays.collate_labels(F.col("code"), 5).cast("array<string>"), ",").alias("labels"))


@query("select l_orderkey, l_linenumber, round(sum(ln(1 + exp(-0.4 * ((-l_extendedprice / 10000 + l_tax * 10) - (-l_quantity / 10 + l_discount * 10))))), 6) as loss from lineitem group by 1, 2")
def dpo_loss(spark, d):
    rows = bridge.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (-F.col("l_extendedprice") / 10000).alias("chosen"), (-F.col("l_tax") * 10).alias("chosen_ref"), (-F.col("l_quantity") / 10).alias("rejected"), (-F.col("l_discount") * 10).alias("rejected_ref"))
    loss = resolve.preference_loss(F.col("chosen"), F.col("chosen_ref"), F.col("rejected"), F.col("rejected_ref"), 0.4)
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum(loss), 6).alias("loss"))
