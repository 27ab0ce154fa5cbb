"""Reading and looking up: judgements, runs, codes, nested records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import arrays, text
from docloom.operators import nq, numbering, runs, validate
from docloom.plans import bridge
from docloom.plans.registry import query
from docloom.sources import readers, sinks


@query("select qid, docid from clicks where n % 2 = 1", ("clicks",))
def qrels_positive(spark, d):
    return bridge.clicks(spark, d).withColumn("rel", F.col("n") % 2).where("rel = 1").select("qid", "docid")


@query("select qid, arg_max(docid, (n, docid)) as docid from clicks group by qid", ("clicks",))
def qrels_last_wins(spark, d):
    return numbering.last_wins(bridge.clicks(spark, d), ["qid"], F.struct("n", "docid")).select("qid", "docid")


@query("select q.qid, docid, title from qrels q join docs using (docid)", ("qrels",))
def doc_lookup_by_id(spark, d):
    return bridge.qrels(spark, d).join(bridge.docs(spark, d).select("docid", "title"), "docid").select("qid", "docid", "title")


@query("select qid, docid, rank::int as rank, case when rank <= 100 then 'top' when rank <= 500 then 'mid' else 'low' end as band from run where rank <= 1000", ("run",), k=1000)
def run_rank_bands(spark, d):
    return bridge.run(spark, d, 1000).select("qid", "docid", "rank", runs.band_of(F.col("rank")).alias("band")).where("band is not null")


@query("select qid, string_agg(docid, ' ' order by score desc, docid) as docids, count(*) as n from run group by qid", ("run",))
def run_scores_grouped(spark, d):
    order = F.struct((-F.col("score")).alias("s"), F.col("docid").alias("d"))
    return bridge.run(spark, d).groupBy("qid").agg(F.array_join(numbering.in_order("docid", order), " ").alias("docids"), F.count("*").alias("n"))


_LINES = """select item, line_no, line from (
    select item_id as item, (item_id * 1000 + rank * 2) as line_no, case item_id % 3 when 0 then qid || ' Q0 ' || docid || ' ' || rank || ' ' || floor(score)::bigint || '.25 tag'
      when 1 then qid || ' ' || docid || ' ' || rank else qid || '  ' || docid || ' ' || floor(score)::bigint || '.75' end as line, rank from run join queries using (qid) where rank <= 20
    ) union all select item_id, item_id * 1000 + rank * 2 + 1, case item_id % 3 when 0 then qid || ' Q0 ' || docid || ' 99 0.5 tag' when 1 then qid || ' ' || docid || ' 99' else qid || ' ' || docid || ' 0.5' end
    from run join queries using (qid) where rank % 7 = 3 and rank <= 20"""


def run_lines(spark, d):
    """A run file's lines in all three layouts, with repeated documents."""
    r = bridge.run(spark, d, 20).join(bridge.queries(spark, d).select("qid", "item_id"), "qid")
    kind, score = F.col("item_id") % 3, F.floor("score").cast("string")
    line = F.when(kind == 0, F.concat_ws(" ", "qid", F.lit("Q0"), "docid", "rank", F.concat(score, F.lit(".25")), F.lit("tag"))).when(kind == 1, F.concat_ws(" ", "qid", "docid", "rank")).otherwise(F.concat("qid", F.lit("  "), "docid", F.lit(" "), score, F.lit(".75")))
    again = F.when(kind == 0, F.concat("qid", F.lit(" Q0 "), "docid", F.lit(" 99 0.5 tag"))).when(kind == 1, F.concat("qid", F.lit(" "), "docid", F.lit(" 99"))).otherwise(F.concat("qid", F.lit(" "), "docid", F.lit(" 0.5")))
    at = F.col("item_id") * 1000 + F.col("rank") * 2
    return r.select(at.alias("line_no"), line.alias("line")).unionByName(r.where("rank % 7 = 3").select((at + 1).alias("line_no"), again.alias("line")))


@query(
    f"""with lines as ({_LINES}), f as (select line_no, regexp_split_to_array(trim(line), '\\s+') as f from lines),
    p as (select *, f[1] as qid, case when len(f) >= 6 and f[2] = 'Q0' then 'trec' when regexp_full_match(f[3], '-?[0-9]+') then 'rank' else 'score' end as layout from f),
    r as (select qid, layout, case layout when 'trec' then f[3] else f[2] end as docid, line_no,
      case layout when 'trec' then f[4]::int when 'rank' then f[3]::int else row_number() over (partition by qid order by line_no) end as rank,
      case layout when 'trec' then f[5]::double when 'score' then f[3]::double end as score from p)
    select qid, docid, rank::int as rank, score, layout from r qualify row_number() over (partition by qid, docid order by line_no) = 1""",
    ("run",),
    k=20,
)
def run_autodetect(spark, d):
    return runs.parse_run(run_lines(spark, d))


@query("select page_id % 100 as id, arg_max(url, page_id) as url from ptab where url <> '' group by 1", ("ptab",))
def nq_doc_urls(spark, d):
    rows = bridge.pages(spark, d).where("url is not null and url <> ''").select((F.col("page_id") % 100).alias("id"), "url", "page_id")
    return numbering.last_wins(rows, ["id"], "page_id").select("id", "url")


@query("select row_number() over (order by page_id) - 1 + 1000 as query_id, docid, title from ptab", ("ptab",))
def nq_query_ids(spark, d):
    rows = bridge.pages(spark, d).select("page_id", "docid", "title")
    return numbering.numbered(rows, [F.col("page_id")], "query_id", 1000).select("query_id", "docid", "title")


_SPACED = "trim(regexp_replace(replace(replace(html, '<', ' <'), '>', '> '), '\\s+', ' ', 'g'))"
_PLAIN = "trim(regexp_replace(replace(regexp_replace(array_to_string(list_filter(string_split(t, ' ')[{span}], lambda x: x is not null), ' '), '<[^<]+?>', '', 'g'), chr(10), ''), '\\s+', ' ', 'g'))"
_TAGS = "trim(regexp_replace(regexp_replace({x}, '<[^<]+?>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "with n as (select title, page_id, url, " + _SPACED + " as t from ptab), f as (select title as query, page_id::varchar as id, " + _PLAIN.format(span="4 : 12") + " as long_answer, " + _PLAIN.format(span="5 : 6") + " as short_answer, "
    + _TAGS.format(x="regexp_extract(t, '(?is)<h1[^>]*>(.*?)</h1>', 1)") + " as title, " + _TAGS.format(x="regexp_extract(t, '(?is)<p[^>]*>(.*?)</p>', 1)") + " as abstract, " + _TAGS.format(x="regexp_extract(t, '(?is)</p>(.*)</ul>', 1)") + " as content, url as document_url from n) select *, title || abstract || content as doc_tac, 'en' as language from f",
    ("ptab",),
)
def nq_flatten(spark, d):
    return nq.flatten_train(nq.nested_from_pages(bridge.pages(spark, d)))


@query("select '[' || docid || ']' as docid, array_to_string(code, ',') as code from codes", ("codes",))
def docid_codes(spark, d):
    upper = bridge.codes(spark, d).withColumn("docid", F.upper("docid"))
    return upper.select(text.normalize_docid("docid").alias("docid"), F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


@query("select array_to_string(code, ',') as code_key, string_agg(docid, ' ' order by docid) as docids, count(*) as n from codes group by 1", ("codes",))
def code_to_docids_msmarco(spark, d):
    return arrays.code_owners(bridge.codes(spark, d), F.col("code"))


@query("select array_to_string(list_filter(code, lambda x: x <> 0 and x <> 1), ',') as code_key, string_agg(docid, ' ' order by docid) as docids, count(*) as n from codes group by 1", ("codes",))
def code_to_docids_nq(spark, d):
    return arrays.code_owners(bridge.codes(spark, d), F.filter("code", lambda x: ~x.isin(0, 1)))


@query("select docid, array_to_string(code, ',') || ',0,0' as input_ids, '1,1,1,0,0' as attention_mask from codes", ("codes",))
def pad_instances(spark, d):
    padded, mask = arrays.padded(F.col("code"), 5, 0)
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    return bridge.codes(spark, d).select("docid", join(padded).alias("input_ids"), join(mask).alias("attention_mask"))


@query("select docid, title as text from docs", ("docs",))
def strip_prompt_prefix(spark, d):
    marked = F.concat(F.when(F.col("doc_id") % 2 == 0, "Passage: ").otherwise("Question: "), "title")
    return bridge.docs(spark, d).select("docid", F.regexp_replace(marked, "^(Passage|Question): ", "").alias("text"))


@query("select substr(docid, 2) as id, l.lang, 'Generate a ' || l.lang || ' question: ' || title as prompt from docs, (select unnest(['en', 'ar', 'fi', 'ja', 'ko', 'ru', 'te']) as lang) l", ("docs",))
def docgen_lang_cross(spark, d):
    # seven fixed languages a row: an explode, no join
    langs = F.explode(F.array(*map(F.lit, ("en", "ar", "fi", "ja", "ko", "ru", "te")))).alias("lang")
    rows = bridge.docs(spark, d).select(F.regexp_replace("docid", "^[dD]", "").alias("id"), "title", langs)
    return rows.select("id", "lang", F.concat(F.lit("Generate a "), "lang", F.lit(" question: "), "title").alias("prompt"))


@query("select structure as url, arg_min(text_id, doc_id) as text_id, arg_min(length(code_text), doc_id) as n from originals group by 1", ("originals",))
def url_docs_first_wins(spark, d):
    rows = bridge.originals(spark, d).select(F.col("structure").alias("url"), "text_id", F.length("code_text").cast("long").alias("n"), "doc_id")
    return numbering.first_wins(validate.require(rows, F.col("url") != "", "a code row has no URL"), ["url"], "doc_id").select("url", "text_id", "n")


@query(
    """select count(*) as n_rows, count(*) filter (numeric_id = '') as missing_key, count(*) filter (numeric_id <> '' and url = '') as missing_target,
    count(distinct numeric_id) filter (numeric_id <> '' and url <> '') as n_keys, 0::bigint as n_conflicts from augment""",
    ("augment",),
)
def structure_map_stats(spark, d):
    return validate.map_stats(bridge.augment(spark, d), "numeric_id", "url")


@query("select row_no as row_number, text, case when numeric_id = '' and url = '' then 'no_id' end as reason from augment where numeric_id = '' and url = ''", ("augment",))
def unmapped_queries(spark, d):
    rows = bridge.augment(spark, d).withColumn("reason", F.when((F.col("numeric_id") == "") & (F.col("url") == ""), "no_id"))
    return rows.where("reason is not null").select(F.col("row_no").alias("row_number"), "text", "reason")


@query("select docid from docs where doc_id % 4 <> 0", ("docs",))
def resume_anti_join(spark, d):
    all_docs = bridge.docs(spark, d).select("docid", "doc_id")
    return all_docs.select("docid").join(all_docs.where("doc_id % 4 = 0").select("docid"), "docid", "left_anti")


@query("select 'd' || doc_id as id, source as contents from documents where doc_id % 7 <> 0 and doc_id % 5 <> 0")
def json_project_skip_bad(spark, d):
    """Lines of JSON, of which some are cut off and some lack their content."""
    n = F.col("doc_id")
    whole = F.to_json(F.struct(F.concat(F.lit("d"), n).alias("id"), F.when(n % 5 != 0, F.col("source")).alias("content")))
    cut = F.when(n % 7 == 0, F.expr("left(x, length(x) - 1)")).otherwise(F.col("x"))
    made = bridge.table(spark, d, "documents").withColumn("x", whole).select(cut.alias("line"))
    there, fields = text.project_json(F.col("line"), {"id": "id", "content": "contents"})
    return made.where(there).select(*fields)


def _written(spark, name, write):
    """Where write(path) put files of a layout, in the shared folder."""
    path = f"{numbering.shared_folder(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    write(path)
    return path


@query("select qid, trim(regexp_replace(query, '[\t\r\n]+', ' ', 'g')) as query from queries where qid <> ''", ("queries",))
def scan_queries_tsv(spark, d):
    """The queries written as tab-separated lines, some twice with another text first, and read back: the last line wins."""
    rows = bridge.queries(spark, d).select("qid", F.trim("query").alias("query"))
    path = _written(spark, "queries", lambda p: sinks.tsv(rows.select("qid", F.lit("an older text").alias("query")).unionByName(rows).coalesce(1), p))
    return readers.queries_tsv(spark, path)


@query("select conv_id, turn, role, text from conversations")
def json_records(spark, d):
    """The turns written as JSON lines and read back as records whose fields have no kind beforehand."""
    rows = bridge.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    record = readers.json_records(spark, _written(spark, "records", lambda p: sinks.jsonl(rows, p)))
    return record.select(*(F.variant_get("record", f"$.{c}", kind).alias(c) for c, kind in rows.dtypes))


@query("select conv_id, row_number() over (partition by part order by spot) as line_no, md5(line) as line from (select conv_id % 3 as part, conv_id * 1000 + turn as spot, conv_id, conv_id || ' ' || turn || ' ' || role as line from conversations)")
def numbered_lines(spark, d):
    """The turns written as lines of three files, in order, and numbered as they are read in ranges."""
    rows = bridge.table(spark, d, "conversations").select((F.col("conv_id") % 3).alias("part"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.concat_ws(" ", "conv_id", "turn", "role").alias("line"))

    def write(path):
        for part in range(3):
            rows.where(F.col("part") == part).orderBy("at").coalesce(1).select("line").write.text(f"{path}/{part}")

    path = _written(spark, "lines", write)
    return readers.lines_numbered(spark, f"{path}/*/part-*").select(F.substring_index("line", " ", 1).cast("long").alias("conv_id"), "line_no", F.md5("line").alias("line"))
