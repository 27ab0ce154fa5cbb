"""The queries that SQL can express, for DuckDB."""

OP4_SQL = r"""
with w as (
  select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') as ws from documents
), p as (
  select r, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35
), h as (
  select p.r, p.i, array_to_string(ws[p.i : p.i + 34], ' ') as t from p join w using (r)
), d as (select t from h group by t having count(*) > 1),
g as (select distinct r, i + k as i from h semi join d using (t), (select unnest(range(0, 35)) as k)),
words as (select r, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from w),
left_over as (select r, string_agg(word, ' ' order by i) as kept, count(*) as n from words anti join g using (r, i) group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join left_over using (r)
"""

OP5_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 32) as bigint) as formatted_chars
from t group by conv_id
"""

OP6_SQL = r"""
with p as (
  select page_id, page_id % 7 as k, page_id // 40 as v,
    (case page_id % 2 when 0 then 'http://' else 'https://www.' end) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+/[^/?#]*)', 1) || case page_id % 3 when 0 then '' when 1 then '/' else '#top' end as url
  from pages
), c as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from p
), n as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as url_key
  from c
), s as (
  select a.page_id, a.url_key, a.k, a.v, b.page_id as q, b.v as w,
    case when b.page_id is null then 'no_response' when a.k = 6 or a.v = b.v then 'resolved' else 'validator_mismatch' end as status
  from (select * from n where k not in (0, 3)) a asof left join (select * from n where k in (0, 3)) b on a.url_key = b.url_key and a.page_id > b.page_id
)
select page_id as record_id, url_key, page_id * 10 as ts, case when status = 'resolved' then q end as response_id, case when status = 'resolved' then q * 10 end as response_ts, status,
  case when status = 'resolved' then 'content-type=text/html;date=u' || page_id || ';etag=' || (case when k in (5, 6) then '' else 'W/' end) || '"v' || w || '";last-modified=t' || w end as headers
from s
"""

#: The words of a text (null: none) and its lines; measurements and rules are those of quality.py.
OP3_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) as ls
  from documents
), spots as (
  select r, unnest(range(1, len(ws) - 1)) as i from d where len(ws) >= 3
), w as (
  select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as t from spots join d using (r)
), again as (
  select r, count(distinct i + k) as n from (select r, i from w join (select r, t from w group by r, t having count(*) > 1) using (r, t)), (select unnest(range(0, 3)) as k) group by r
), m as (
  select doc_id, len(ws) as n_words, length(regexp_replace(text, '[ \x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(n, 0) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper,
    length(regexp_replace(text, '[^a-z]', '', 'g')) as n_lower, length(regexp_replace(text, '[^!]', '', 'g')) as n_bang,
    len(list_distinct(ws)) as n_distinct_words, len(list_filter(ws, lambda x: strlen(x) > 40)) as n_long_words,
    length(regexp_replace(text, '[^\x00-\x08\x0E-\x1F\x{FFFD}]', '', 'g')) as n_control
  from d left join again using (r)
), f as (select *, {bits} as fail_bits from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  (fail_bits & {base}) <> 0 as base_failed, (fail_bits & {all}) = 0 as kept, fail_bits
from f
"""

OP8_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents
), w as (
  select r, doc_id, i, substr(x, 2 * i - 1, 2) as byte, case when 2 * i + 98 <= length(x) then substr(x, 2 * i - 1, 100) end as s
  from (select *, unnest(range(1, length(x) // 2 + 1)) as i from d)
), first_in as (select s, min(doc_id) as m from w where s is not null group by s),
g as (select r, i, byte, coalesce(m < doc_id, false) as later from w left join first_in using (s)),
c as (select r, i, byte, coalesce(max(case when later then i end) over (partition by r order by i rows between 49 preceding and current row) is not null, false) as gone from g),
e as (select *, gone and not coalesce(lag(gone) over (partition by r order by i), false) as opens from c),
t as (select r, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans, string_agg(byte, '' order by i) filter (not gone) as kept from e group by r)
select doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join t using (r)
"""

#: CRC-32 of UTF-8 strings (x: hex digits of their bytes), by the table of its bytes.
_CRC = r"""
steps as (
  select b, list_reduce([b] || list_transform(range(0, 8), lambda i: 0::bigint), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c
  from (select unnest(range(0, 256))::bigint as b)
), crc_table as (select list(c order by b) as crc from steps)
"""
_CRC_OF = r"xor(list_reduce([4294967295::bigint] || list_transform(range(1, len({x}) // 2 + 1), lambda i: ('0x' || substr({x}, 2 * i - 1, 2))::bigint), lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1])), 4294967295::bigint)"

OP11_SQL = (
    "with "
    + _CRC
    + r"""
, texts as (
  select 0 as part, row_number() over () as r, doc_id, text from documents union all select 1, row_number() over (), null, text from benchmark
), w as (
  select part, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) as word from texts
), b as (
  select word, {crc} % 10000 as bucket from (select distinct word, hex(encode(word)) as x from w), crc_table
), f as (select part, r, bucket from w join b using (word)),
n as (select bucket, count(*) filter (part = 0) as s, count(*) filter (part = 1) as t from f group by bucket),
a as (select coalesce(sum(s), 0)::double as s_all, coalesce(sum(t), 0)::double as t_all from n),
g as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain from n, a),
v as (select r, count(*) as n, sum(gain)::bigint as weight from f join g using (bucket) where part = 0 group by r),
d as (
  select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint::double as h
  from texts left join v using (r) where part = 0
), e as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from d),
z as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) as place, count(*) filter (n_features >= 20) over () as n from e
)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from z
""".replace("{crc}", _CRC_OF.replace("{x}", "x"))
)

#: States of the grammar: 0 nothing, 1 system, 2 user, 3 assistant said last. From the end, each state has the least pair of
#: costs and edits; f holds costs and edits without an insertion first, which may come once or twice.
_REPAIR_STEP = ", ".join(
    f"least({{{{'c': 4 + s{i}.c, 'e': 'D' || s{i}.e}}}}, {{{{'c': case when forced then 1000000000 else 3 + more + s{n}.c end, 'e': 'R' || s{n}.e}}}}, {{{{'c': case when forced then 1000000000 {keeps} else 1000000000 end, 'e': 'K' || case {ends} else '' end}}}}) as f{i}"
    for i, n, keeps, ends in (
        (0, 2, "when q = 's' then more + s1.c when q = 'u' then more + s2.c", "q when 's' then s1.e when 'u' then s2.e"),
        (1, 2, "when q = 'u' then more + s2.c", "q when 'u' then s2.e"),
        (2, 3, "when q = 'a' then more + s3.c", "q when 'a' then s3.e"),
        (3, 2, "when q = 'u' then more + s2.c", "q when 'u' then s2.e"),
    )
).replace("{{", "{").replace("}}", "}")
_REPAIR_INSERT = ", ".join(
    f"least(f{i}, {{'c': 3 + f{n}.c, 'e': 'I' || f{n}.e}}, {{'c': 6 + f{m}.c, 'e': 'II' || f{m}.e}}) as s{i}" for i, n, m in ((0, 2, 3), (1, 2, 3), (2, 3, 2), (3, 2, 3))
)
OP13_SQL = (
    "with recursive "
    + _CRC
    + r"""
, c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as x from conversations
), k as (select *, {crc} % 20 as d from c, crc_table),
m as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
    case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(0, case d when 0 then 0 when 3 then 2 else 1 end)) as copy
  from k
), o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, trim(text, E' \t\n\x0b\x0c\r') as bare from m),
p as (
  select *, left(role, 1) as q, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) as was
  from o
), n as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (i > 1 and was || q not in ('su', 'ua', 'au')) as illegal
  from p group by conv_id
), back as (
  select conv_id, n as i, {'c': 0::bigint, 'e': ''} as s0, {'c': 6::bigint, 'e': 'II'} as s1, {'c': 3::bigint, 'e': 'I'} as s2, {'c': 0::bigint, 'e': ''} as s3 from n
  union all
  select conv_id, i, {insert} from (
    select p.conv_id, p.i - 1 as i, fault in ('blank', 'duplicate') as forced, (case when fault = 'truncated' then 3 else 0 end)::bigint as more, q, {step}
    from back join p on p.conv_id is not distinct from back.conv_id and p.i = back.i
  )
), best as (select conv_id, s0.c as cost, s0.e as audit from back where i = 0),
edits as (select conv_id, audit, unnest(range(1, len(audit) + 1)) as j from best),
spots as (
  select conv_id, j, substr(audit, j, 1) as e, 1 + len(replace(left(audit, j - 1), 'I', '')) as i, len(replace(left(audit, j), 'D', '')) as out from edits
), sys as (
  -- whether the first turn kept is the system's
  select a.conv_id, bool_or(a.e = 'K' and a.out = 1 and p.q = 's') as s from spots a join p on p.conv_id is not distinct from a.conv_id and p.i = a.i group by a.conv_id
), turns as (
  select a.conv_id, a.j, case when a.e = 'K' then p.role when (a.out - coalesce(s, false)::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when a.e = 'I' then '' else p.text end as line
  from spots a left join p on p.conv_id is not distinct from a.conv_id and p.i = a.i left join sys on sys.conv_id is not distinct from a.conv_id where a.e <> 'D'
), said as (select conv_id, string_agg(line, chr(10) order by j) as t from turns group by conv_id),
every as (select distinct conv_id from conversations)
select every.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from every left join n on n.conv_id is not distinct from every.conv_id left join best on best.conv_id is not distinct from every.conv_id left join said on said.conv_id is not distinct from every.conv_id
""".replace("{crc}", _CRC_OF.replace("{x}", "x")).replace("{insert}", _REPAIR_INSERT).replace("{step}", _REPAIR_STEP)
)
