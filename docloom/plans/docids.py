"""Document identifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import arrays, text
from docloom.operators import docids, vectors
from docloom.plans import bridge
from docloom.plans.projections import _BLANK, _SHORT, _URL, _url_rows
from docloom.plans.registry import query

M, WIDTH, KS = 8, 8, 16


def _vectors(spark, d):
    return bridge.table(spark, d, "embeddings").select("vec_id", "embedding")


def _ordered(spark, d, lo, hi):
    """The vectors lo <= id < hi as one array in order of id: a codebook has a fixed number of words."""
    rows = _vectors(spark, d).where(F.col("vec_id").between(lo, hi - 1))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("words"))


def _words(spark, d, lo, hi):
    return vectors.words_of(_vectors(spark, d).where(F.col("vec_id").between(lo, hi - 1)), "vec_id", "embedding")


def _pq(spark, d):
    """Vectors with their codes, and the codebook of each subspace."""
    words = _ordered(spark, d, 0, KS)
    book = words.select(F.transform(F.sequence(F.lit(0), F.lit(M - 1)), lambda m: F.transform("words", lambda w: F.slice(w, m * WIDTH + 1, F.lit(WIDTH)))).alias("book"))
    return vectors.encode(_vectors(spark, d), "embedding", np.split(_words(spark, d, 0, KS), M, axis=1)).join(F.broadcast(book))


def _rq(spark, d):
    books = [_words(spark, d, i * KS, (i + 1) * KS) for i in range(3)]
    got = vectors.encode(_vectors(spark, d), "embedding", books, residual=True)
    for i in range(3):
        got = got.join(F.broadcast(_ordered(spark, d, i * KS, (i + 1) * KS).withColumnRenamed("words", f"book{i}")))
    return got


_PQ = f"""with v as (select vec_id, unnest(range({M}))::int as m, embedding::double[] as e from embeddings),
 s as (select vec_id, m, e[m * {WIDTH} + 1 : m * {WIDTH} + {WIDTH}] as x from v),
 k as (select s.vec_id, s.m, c.vec_id as code, round(list_sum(list_transform(list_zip(s.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) as dist from s join s c on s.m = c.m and c.vec_id < {KS}),
 n as (select vec_id, m, arg_min(code, (dist, code))::int as code from k group by 1, 2)"""
_RQ = "with recursive r0 as (select vec_id, embedding::double[] as e from embeddings)" + "".join(
    f""", k{i} as (select r.vec_id, arg_min(b.vec_id - {i * KS}, (round(list_sum(list_transform(list_zip(r.e, b.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), b.vec_id)) as code from r{i} r, embeddings b where b.vec_id between {i * KS} and {i * KS + KS - 1} group by 1),
 r{i + 1} as (select r.vec_id, list_transform(list_zip(r.e, b.embedding::double[]), lambda p: p[1] - p[2]) as e from r{i} r join k{i} using (vec_id) join embeddings b on b.vec_id = code + {i * KS})"""
    for i in range(3)
)


@query("select docid, 32128 + row_number() over (order by doc_id) - 1 as id from docs", ("docs",))
def atomic_docid(spark, d):
    return docids.atomic(bridge.docs(spark, d).select("docid", "doc_id"), "doc_id").select("docid", "id")


@query(_PQ + " select vec_id, m, code from n")
def pq_encode(spark, d):
    return _pq(spark, d).select("vec_id", F.posexplode("codes").alias("m", "code"))


@query(_RQ.replace("with recursive", "with") + " select vec_id, k0.code || ',' || k1.code || ',' || k2.code as codes from k0 join k1 using (vec_id) join k2 using (vec_id)")
def rq_encode(spark, d):
    return _rq(spark, d).select("vec_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query(_PQ + f" select vec_id, string_agg((code + m * {KS} + 32128)::varchar, ',' order by m) as docid from n group by 1")
def pq_docid(spark, d):
    code = arrays.offset_codes(F.col("codes"), docids.VOCAB, KS)
    return _pq(spark, d).select("vec_id", F.array_join(code.cast("array<string>"), ",").alias("docid"))


@query("select docid, (code[1] + 32128) || ',' || (code[2] + 256 + 32128) || ',' || (code[3] + 512 + 32128) as tokens from codes", ("codes",))
def pq_code_offset(spark, d):
    return bridge.codes(spark, d).select("docid", F.array_join(arrays.offset_codes(F.col("code"), docids.VOCAB, 256).cast("array<string>"), ",").alias("tokens"))


@query("select docid, array_to_string(code, ',') as code from codes", ("codes",))
def pq_code_decode(spark, d):
    tokens = arrays.offset_codes(F.col("code"), docids.VOCAB, 256)
    return bridge.codes(spark, d).select("docid", F.array_join(arrays.decode_offsets(tokens, docids.VOCAB, 256).cast("array<string>"), ",").alias("code"))


def token_ids(tokens):
    """Stand-in vocabulary: an id from a token's first character and length."""
    return F.transform(tokens, lambda t: (F.ascii(t) * 31 + F.length(t)) % 1000 + 2)


_IDS = "list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda t: (ascii(t) * 31 + length(t)) % 1000 + 2)"


@query(_URL.format(url=_SHORT, title=_BLANK) + "select docid, array_to_string(list_append(" + _IDS.format(x="text") + "[1:98], 1), ',') as code from m where made <> 'skipped'", ("ptab",))
def url_docid_codes(spark, d):
    made, source = text.url_title(F.col("url"), F.col("title"))
    rows = _url_rows(spark, d).where(source != "skipped").select("docid", made.alias("text"))
    code = docids.text_codes(token_ids(text.tokenize("text")), 99)
    return rows.select("docid", F.array_join(code.cast("array<string>"), ",").alias("code"))


@query("with s as (select docid, list_filter(list_transform(regexp_extract_all(body, '[^.!?\\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')[1] as summary from docs) select docid, array_to_string(list_append(" + _IDS.format(x="summary") + "[1:127], 1), ',') as code from s where summary is not null", ("docs",))
def summary_docid(spark, d):
    rows = bridge.docs(spark, d).select("docid", F.get(text.sentences("body"), F.lit(0)).alias("summary")).where("summary is not null")
    return rows.select("docid", F.array_join(docids.text_codes(token_ids(text.tokenize("summary")), 128).cast("array<string>"), ",").alias("code"))


@query(_PQ + f", w as (select vec_id, m, unnest(range({WIDTH}))::int as j, code from n) select w.vec_id, m * {WIDTH} + j as i, round(b.embedding[m * {WIDTH} + j + 1]::double, 6) as v from w join embeddings b on b.vec_id = code")
def pq_reconstruct(spark, d):
    rows = _pq(spark, d).select("vec_id", F.posexplode(docids.pq_rebuilt(F.col("codes"), F.col("book"))).alias("i", "v"))
    return rows.select("vec_id", "i", F.round(F.col("v").cast("double"), 6).alias("v"))


@query(_RQ.replace("with recursive", "with") + ", s as (select vec_id, unnest(range(64))::int as i, e.embedding, r3.e as rest from embeddings e join r3 using (vec_id)) select vec_id, i, round(embedding[i + 1]::double - rest[i + 1], 6) as v from s")
def rq_reconstruct(spark, d):
    got = _rq(spark, d)
    words = F.array(*(F.get(F.col(f"book{i}"), F.get("codes", F.lit(i))) for i in range(3)))
    rows = got.select("vec_id", F.posexplode(docids.sums(words)).alias("i", "v"))
    return rows.select("vec_id", "i", F.round("v", 6).alias("v"))


@query(_PQ + f", w as (select vec_id, string_agg('', '') as z, list(b.e order by m) as parts from (select n.vec_id, n.m, x.e[n.m * {WIDTH} + 1 : n.m * {WIDTH} + {WIDTH}] as e from n join (select vec_id, embedding::double[] as e from embeddings) x on x.vec_id = n.code) b group by 1) select vec_id, round(list_cosine_similarity(e.embedding::double[], flatten(parts)), 6) as cosine from w join embeddings e using (vec_id)")
def quantization_similarity(spark, d):
    return _pq(spark, d).select("vec_id", F.round(arrays.cosine(F.col("embedding"), docids.pq_rebuilt(F.col("codes"), F.col("book"))), 6).alias("cosine"))


_COSINES = "with c as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as cosine from embeddings q join embeddings e on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)"


def _neighbours(spark, d, k):
    """The query set is every vector whose id is divisible by 50, against all vectors."""
    v = _vectors(spark, d)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.neighbours(vectors.Lists(v, "vec_id", "embedding"), asked, k)


@query(_COSINES + " select query_id, arg_min(vec_id, (-cosine, vec_id)) as nearest, round(max(cosine), 6) as cosine from c group by 1")
def cosine_nearest(spark, d):
    return _neighbours(spark, d, 1).select("query_id", F.col("vec_id").alias("nearest"), F.round("cosine", 6).alias("cosine"))


@query(_COSINES + " select query_id, (row_number() over (partition by query_id order by cosine desc, vec_id))::int as rank, vec_id, round(cosine, 6) as cosine from c qualify rank <= 10")
def vector_neighbours(spark, d):
    return _neighbours(spark, d, 10).select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))


_FAR = "round(list_sum(list_transform(list_zip({x}, {y}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9)"


def _lloyd_sql(name: str, rows: str, rounds: int) -> str:
    """CTEs of Lloyd steps over rows(vec_id, m, x) from words {name}0(m, code, x): {name}1, {name}2 and so on."""
    out = ""
    for r in range(1, rounds + 1):
        out += f""", {name}n{r} as (select v.vec_id, v.m, arg_min(b.code, ({_FAR.format(x="v.x", y="b.x")}, b.code)) as code from {rows} v join {name}{r - 1} b using (m) group by 1, 2),
 {name}s{r} as (select m, code, i, sum(floor(x * 16777216 + 0.5)::hugeint)::double / 16777216 / count(*) as v from (select n.m, n.code, generate_subscripts(v.x, 1) as i, unnest(v.x) as x from {rows} v join {name}n{r} n using (vec_id, m)) group by 1, 2, 3),
 {name}{r} as (select b.m, b.code, coalesce(s.x, b.x) as x from {name}{r - 1} b left join (select m, code, list(v order by i) as x from {name}s{r} group by 1, 2) s using (m, code))"""
    return out


_SEEDED = "(select row_number() over (order by md5('{seed}|' || vec_id)) - 1 as code, * from {rows} qualify code < 16)"
_BOOK = "select m::int as part, code::int as code, (i - 1)::int as i, round(v, 6) as v from (select m, code, generate_subscripts(x, 1) as i, unnest(x) as v from {name})"
TRAIN_ROUNDS = 3


@query("with v as (select vec_id, m, (embedding::double[])[m * 16 + 1 : m * 16 + 16] as x from embeddings, (select unnest(range(4)) as m)), p0 as (select m, code, x from " + _SEEDED.format(seed="42", rows="embeddings") + " join v using (vec_id))" + _lloyd_sql("p", "v", TRAIN_ROUNDS) + " " + _BOOK.format(name=f"p{TRAIN_ROUNDS}"))
def pq_train(spark, d):
    books = vectors.product_books(_vectors(spark, d), "vec_id", "embedding", 4, KS, TRAIN_ROUNDS)
    return vectors.book_rows(spark, books).withColumn("v", F.round("v", 6))


_REST = "select v.vec_id, 0 as m, list_transform(list_zip(v.x, b.x), lambda p: p[1] - p[2]) as x from (select v.vec_id, any_value(v.x) as x, arg_min(b.code, ({far}, b.code)) as code from {rows} v cross join {book} b group by 1) v join {book} b using (code)"


@query("with v as (select vec_id, 0 as m, embedding::double[] as x from embeddings), p0 as (select m, code, x from " + _SEEDED.format(seed="42.0", rows="v") + ")" + _lloyd_sql("p", "v", TRAIN_ROUNDS) + ", w as (" + _REST.format(far=_FAR.format(x="v.x", y="b.x"), rows="v", book=f"p{TRAIN_ROUNDS}") + "), q0 as (select m, code, x from " + _SEEDED.format(seed="42.1", rows="w") + ")" + _lloyd_sql("q", "w", TRAIN_ROUNDS) + f", z as (select 0 as m, code, x from p{TRAIN_ROUNDS} union all select 1, code, x from q{TRAIN_ROUNDS}) " + _BOOK.format(name="z"))
def rq_train(spark, d):
    books = vectors.residual_books(_vectors(spark, d), "vec_id", "embedding", 2, KS, TRAIN_ROUNDS)
    return vectors.book_rows(spark, books).withColumn("v", F.round("v", 6))
