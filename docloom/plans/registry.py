"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Logical tables over the driver's tables, as SQL.
TABLES = {
    "docs": "select 'd' || doc_id as docid, doc_id, split_part(text, chr(10), 1) as title, text as body, lang, source from documents",
    "queries": "select 'q' || item_id as qid, item_id, text as query from benchmark",
    "qrels": "select q.qid, d.docid, 1 as rel from queries q join docs d on contains(d.body, substr(q.query, 10, 60))",
    "ptab": "select 'p' || page_id as docid, page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, html from pages",
    "clicks": "select 'o' || l_orderkey as qid, 'part' || l_partkey as docid, l_linenumber as n from lineitem",
    "shelf": "select 'part' || p_partkey as docid, p_partkey, p_name as title, p_brand as brand from part",
    "tf": r"select docid, term, count(*) as tf from (select docid, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) as term from docs) group by docid, term",
    "dl": "select docid, sum(tf) as len from tf group by docid",
    "df": "select term, count(*) as df from tf group by term",
    "stats": "select (select count(*) from docs) as n, (select sum(len) from dl)::double / (select count(*) from docs) as avgdl",
    "qterms": r"select distinct qid, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) as term from queries",
    "run": """select qid, docid, rank, score from (
        select qid, docid, score, row_number() over (partition by qid order by score desc, docid) as rank from (
          select qid, docid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {k1} * (1 - {b} + {b} * len / avgdl))), 6) as score
          from qterms join tf using (term) join df using (term) join dl using (docid), stats group by qid, docid)) where rank <= {k}""",
    "originals": """select doc_id, 'd' || doc_id as text_id, doc_id::varchar as numeric_id, source || '/' || lang || '/' || doc_id as url, source || '/' || lang || '/' || (doc_id % 50) as structure,
        source as repo, source || '/' || lang || '.rb' as path, 'f' || (doc_id % 13) as identifier, lang as language, 'Query: ' || split_part(text, chr(10), 1) as query_text,
        'Code: ' || coalesce(nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), ''), 'pass') as code_text from documents""",
    "augment": """select doc_id as row_no, doc_id::varchar as raw_id, case when doc_id % 5 = 0 then '' else doc_id::varchar end as numeric_id,
        case when doc_id % 3 = 0 then '' else source || '/' || lang || '/' || doc_id end as url, string_split(text, chr(10))[-1] as text from documents""",
    "codes": "select 'd' || doc_id as docid, [source_no, lang_no, (doc_id % 7)::int] as code from (select doc_id, (substr(source, 4))::int + 2 as source_no, (length(lang) + ascii(lang) % 5)::int as lang_no from documents)",
}
#: Which tables a table reads, in the order in which they must stand.
NEEDS = {"qrels": ["queries", "docs"], "tf": ["docs"], "dl": ["docs", "tf"], "df": ["docs", "tf"], "stats": ["docs", "tf", "dl"], "qterms": ["queries"], "run": ["docs", "queries", "tf", "dl", "df", "stats", "qterms"]}


def ctes(*names: str, k1: float = 0.82, b: float = 0.68, k: int = 200) -> str:
    """WITH clause (without the word) that defines these logical tables and what they need."""
    order: list[str] = []
    for x in names:
        for y in [*NEEDS.get(x, []), x]:
            if y not in order:
                order.append(y)
    return ",\n".join(f"{x} as ({TABLES[x].format(k1=k1, b=b, k=k) if x == 'run' else TABLES[x]})" for x in order)


def query(sql: str | None = None, tables: tuple[str, ...] = (), **params) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, and the SQL that must agree."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ctes(*tables, **params) if tables else ""
            body = sql.strip()
            if head and body.lower().startswith("with recursive "):
                body = f"with recursive {head},\n{body[15:]}"
            elif head:
                body = f"with {head},\n{body[5:]}" if body.lower().startswith("with ") else f"with {head}\n{body}"
            ORACLES[f.__name__] = body
        return f

    return register
