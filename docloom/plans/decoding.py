"""Constrained decoding and what it finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import trie
from docloom.plans import bridge
from docloom.plans.registry import query

_TOKENS = "select list_concat(code, case when substr(docid, 2)::bigint % 4 = 0 then [1] else [] end) as tokens from codes"
_STR = "array_to_string(list_transform({x}, lambda v: v::varchar), ',')"
_TRIE = f"sq as ({_TOKENS}), px as (select tokens, unnest(range(len(tokens))) as n from sq), tr as (select {_STR.format(x='tokens[1 : n]')} as prefix, list(distinct tokens[n + 1] order by tokens[n + 1]) as nxt from px group by 1)"


def _sequences(spark, d):
    n = F.expr("cast(substring(docid, 2) as bigint)")
    return bridge.codes(spark, d).select(F.concat("code", F.when(n % 4 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("tokens"))


@query(f"with {_TRIE} select prefix, array_to_string(nxt, ',') as next from tr", ("codes",))
def trie_next_tokens(spark, d):
    return trie.next_tokens(_sequences(spark, d)).select("prefix", trie.text(F.col("next")).alias("next"))


@query(f"with {_TRIE}, q as (select distinct case when substr(docid, 2)::bigint % 5 = 0 then code[1] || ',99' else code[1] || ',' || code[2] end as prefix from codes) select prefix, coalesce(array_to_string(nxt, ','), '0') as next from q left join tr using (prefix)", ("codes",))
def trie_prefix_lookup(spark, d):
    first, second = F.get("code", F.lit(0)), F.get("code", F.lit(1))
    asked = bridge.codes(spark, d).select(F.array(first, F.when(F.expr("cast(substring(docid, 2) as bigint) % 5 = 0"), 99).otherwise(second)).alias("tokens"))
    got = trie.following(trie.numbered_steps(_sequences(spark, d)), asked)
    return got.select(trie.text(F.col("tokens")).alias("prefix"), trie.text(F.col("next")).alias("next"))


@query(f"with {_TRIE} select distinct {_STR.format(x='tokens')} as sequence from sq where {_STR.format(x='tokens')} not in (select prefix from tr)", ("codes",))
def trie_sequences(spark, d):
    s = _sequences(spark, d)
    return trie.leaves(s, trie.next_tokens(s))


@query(f"with {_TRIE}, s2 as (select [7, v] as tokens from (select distinct code[3] as v from codes)), p2 as (select tokens, unnest(range(2)) as n from s2), t2 as (select {_STR.format(x='tokens[1 : n]')} as prefix, list(distinct tokens[n + 1] order by tokens[n + 1]) as nxt from p2 group by 1), o as (select prefix, case when list_contains(nxt, 1) then list_sort(list_distinct(list_concat(list_filter(nxt, lambda v: v <> 1), (select nxt from t2 where prefix = '')))) else nxt end as nxt from tr union all select * from t2 where prefix <> '' and prefix not in (select prefix from tr)) select prefix, array_to_string(nxt, ',') as next from o", ("codes",))
def trie_append(spark, d):
    second = bridge.codes(spark, d).select(F.array(F.lit(7), F.get("code", F.lit(2))).alias("tokens"))
    got = trie.appended(trie.next_tokens(_sequences(spark, d)), trie.next_tokens(second), 1)
    return got.select("prefix", trie.text(F.col("next")).alias("next"))


def toy_score(qid, prefix, token):
    """A stand-in for a model: a hash of query, prefix and token, between 0 and 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", qid, prefix, token.cast("string")), 256), 1, 6), 16, 10).cast("double") / 16777216.0


_LEVEL = """g{i} as (select qid, case when l.prefix = '' then token::varchar else l.prefix || ',' || token end as prefix, round(total + ('0x' || substr(sha256(qid || '|' || l.prefix || '|' || token), 1, 6))::bigint / 16777216.0::double, 6) as total from l{j} l join st on st.prefix = l.prefix where open),
 b{i} as (select qid, prefix, total, prefix in (select prefix from tr) as open from g{i} union all select qid, prefix, total, open from l{j} where not open), l{i} as (select * from b{i} qualify row_number() over (partition by qid order by total desc, prefix) <= 5)"""


@query(f"with {_TRIE}, st as (select prefix, unnest(nxt) as token from tr), l0 as (select qid, '' as prefix, 0.0::double as total, true as open from queries), " + ", ".join(_LEVEL.format(i=i + 1, j=i) for i in range(4)) + " select qid, row_number() over (partition by qid order by total desc, prefix)::int as rank, prefix as sequence, total from l4", ("codes", "queries"))
def constrained_beam(spark, d):
    return trie.beam_search(bridge.queries(spark, d), trie.numbered_steps(_sequences(spark, d)), toy_score, 5, 4)


_LOOK = """gen as (select qid, rank, case when rank % 3 = 0 then array_to_string(code, ',') || ',1' when rank % 3 = 1 then array_to_string(code, ',') else '88,' || rank end as code from run join codes using (docid) where rank <= 9),
 kc as (select array_to_string(code, ',') || case when substr(docid, 2)::bigint % 2 = 0 then ',1' else '' end as code, docid from codes),
 al as (select *, case when code like '%,1' then substr(code, 1, length(code) - 2) else code || ',1' end as alt from gen),
 us as (select qid, rank, code as asked, case when code in (select code from kc) then code when alt in (select code from kc) then alt end as code, case when code in (select code from kc) then 'primary' when alt in (select code from kc) then 'alternate' else 'none' end as how from al),
 lk as (select qid, rank, asked as code, docid, row_number() over (partition by qid, rank order by sha256('6|' || qid || '|' || coalesce(docid, '')), docid) as place, how from us left join kc using (code))"""


def _looked_up(spark, d):
    plain = F.array_join(F.col("code").cast("array<string>"), ",")
    r = F.col("rank")
    gen = bridge.run(spark, d, 9).join(bridge.codes(spark, d), "docid").select("qid", "rank", F.when(r % 3 == 0, F.concat(plain, F.lit(",1"))).when(r % 3 == 1, plain).otherwise(F.concat(F.lit("88,"), r)).alias("code"))
    even = F.expr("cast(substring(docid, 2) as bigint) % 2 = 0")
    known = bridge.codes(spark, d).select(F.concat(plain, F.when(even, ",1").otherwise("")).alias("code"), "docid")
    return trie.lookup_codes(gen, known, "6")


@query(f"with {_LOOK} select qid, rank::int as rank, code, docid, place::int as place, how from lk", ("run", "codes"))
def code_lookup_fallback(spark, d):
    return _looked_up(spark, d)


@query(f"with {_LOOK}, b as (select distinct qid, rank, code, how from lk) select count(distinct qid) as n_queries, count(distinct qid) filter (how <> 'none') as matched, count(*) filter (how = 'none') as failed, count(distinct code) filter (how = 'none') as unresolved from b", ("run", "codes"))
def match_stats(spark, d):
    beams = _looked_up(spark, d).select("qid", "rank", "code", "how").distinct()
    none = F.col("how") == "none"
    return beams.agg(F.countDistinct("qid").alias("n_queries"), F.countDistinct(F.when(~none, F.col("qid"))).alias("matched"), F.count_if(none).alias("failed"), F.countDistinct(F.when(none, F.col("code"))).alias("unresolved"))
