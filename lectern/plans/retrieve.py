"""Queries over scoring, ranking, fusion, contexts, citations and conversations, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import context as cx
from lectern.operators import dense, dialog, fusion, sparse
from lectern.plans.fixtures import view, with_views
from lectern.plans.prepare import NL, strip
from lectern.sources.staging import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def _tokens(x: str) -> str:
    """DuckDB's list of tokens."""
    runs = f"regexp_extract_all(lower({x}), '([a-z0-9]+|[가-힣]+)', 1)"
    pair = "list_transform(generate_series(1, length(r) - 1), lambda i: substring(r, i, 2))"
    return f"flatten(list_transform({runs}, lambda r: case when length(r) > 1 and r >= '가' then {pair} else [r] end))"


def _place(df: DataFrame) -> DataFrame:
    """Scores at six places."""
    return df.withColumn("score", F.round("score", 6))


@query(f"select doc_id, len({_tokens('raw_text')}) as n, md5(array_to_string({_tokens('raw_text')}, ' ')) as digest from pages_v")
def q5_1_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.tokenize(F.col("raw_text"))
    return view(spark, sf_dir, "pages_v").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


_BM25 = f"""tok as (select chunk_id, {_tokens('text')} ts from chunks_v),
len_ as (select chunk_id, len(ts) len from tok), corpus as (select count(*) n, coalesce(nullif(avg(len), 0), 1.0) avg_len from len_),
post as (select term, chunk_id, count(*) tf from (select chunk_id, unnest(ts) term from tok) group by 1, 2),
terms as (select term, count(*) df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) idf from post, corpus group by term, n)"""
_SPARSE = f"""{_BM25}, ask as (select qid, unnest(list_distinct({_tokens('question')})) term from asked_v),
sparse as (select qid, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) score
  from ask join terms using (term) join post using (term) join len_ using (chunk_id), corpus group by 1, 2)"""


_ALL_SPARSE = _SPARSE
_SPARSE = _SPARSE.replace("chunks_v", "index_v")  # hybrid search: of the chunks that have a vector


def _named(spark: SparkSession, sf_dir: str, name: str, chunks: DataFrame) -> sparse.BM25Index:
    """This application's index of the given tables: the first query that needs it builds it, later ones read it."""
    place = f"{shared_dir(spark)}/bm25-{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    return sparse.named_bm25(chunks.select("chunk_id", "text"), place, name)


def _all_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, sparse.BM25Index]:
    """Questions, all documents as chunks, and their index."""
    chunks = view(spark, sf_dir, "chunks_v")
    return view(spark, sf_dir, "asked_v"), chunks, _named(spark, sf_dir, "all", chunks)


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, sparse.BM25Index]:
    """Questions, the chunks that have a vector, and their index."""
    chunks = view(spark, sf_dir, "index_v")
    return view(spark, sf_dir, "asked_v"), chunks, _named(spark, sf_dir, "with_vectors", chunks)


@query(f"with {_BM25} select term, df, round(idf, 6) as idf from terms")
def q5_2_bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.bm25_index(view(spark, sf_dir, "chunks_v")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_BM25} select chunk_id, len_.len, count(term) as n_terms, coalesce(max(tf), 0) as max_tf from len_ left join post using (chunk_id) group by 1, 2")
def q5_2_bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _all_index(spark, sf_dir)[2]
    rows = index.lengths.join(index.postings, "chunk_id", "left").groupBy("chunk_id", "len")
    return rows.agg(F.count("term").alias("n_terms"), F.coalesce(F.max("tf"), F.lit(0)).cast("long").alias("max_tf")).withColumn("len", F.col("len").cast("long"))


def _ranked(source: str, k: int) -> str:
    return f"(select *, row_number() over (partition by qid order by round(score, 9) desc, chunk_id) as rank from {source} qualify rank <= {k})"


@query(f"with {_ALL_SPARSE} select qid, rank, chunk_id, round(score, 6) as score from {_ranked('sparse', 10)}")
def q5_3_bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, _, index = _all_index(spark, sf_dir)
    return _place(fusion.top_k(sparse.bm25_topk(asked, index, 10), 10)).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {_ALL_SPARSE} select qid, count(*) as n, round(sum(score), 5) as total from sparse group by 1")
def q5_3_bm25_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score, not only the best."""
    asked, _, index = _all_index(spark, sf_dir)
    return sparse.bm25_scores(asked, index).groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 5).alias("total"))


@query("""with n as (select vec_id, embedding::double[] v from embeddings), m as (select *, sqrt(list_inner_product(v, v)) l from n)
select vec_id, round(v[1] / l, 6) as first, round(v[64] / l, 6) as last, round(list_sum(list_transform(v, lambda x: abs(x / l))), 6) as l1 from m""")
def q5_4_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("v", tx.l2_normalize(F.col("embedding")))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    return rows.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"), F.round(size, 6).alias("l1"))


_DENSE = "dense as (select q.qid, c.chunk_id, list_inner_product(q.embedding::double[], c.embedding::double[]) score from asked_v q, index_v c)"


@query(f"with {_DENSE} select qid, rank, chunk_id, round(score, 6) as score from {_ranked('dense', 50)}")
def q5_5_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks = view(spark, sf_dir, "asked_v"), view(spark, sf_dir, "index_v")
    return _place(fusion.top_k(dense.dense_topk(asked, chunks, 50), 50)).withColumn("rank", F.col("rank").cast("long"))


_QLANG = "case when regexp_matches(question, '[가-힣]') then 'ko' else 'en' end"
_FACTOR = f"(case when c.lang in ('ko', 'en') and c.lang <> {_QLANG} then 0.7 else 1.0 end)::double"


@query(f"""with {_DENSE}, pool as {_ranked('dense', 50)}, pen as (select qid, chunk_id, score * {_FACTOR} as score from pool join asked_v using (qid) join index_v c using (chunk_id))
select qid, count(*) as n, round(sum(score), 6) as total from pen group by 1""")
def q5_6_language_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks = view(spark, sf_dir, "asked_v"), view(spark, sf_dir, "index_v")
    rows = fusion.language_penalty(dense.dense_topk(asked, chunks, 50), asked, chunks)
    return rows.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query(f"""with {_DENSE}, pen as (select qid, chunk_id, score * {_FACTOR} as score from dense join asked_v using (qid) join index_v c using (chunk_id))
select qid, rank, chunk_id, round(score, 6) as score from {_ranked('pen', 5)}""")
def q5_7_search_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks = view(spark, sf_dir, "asked_v"), view(spark, sf_dir, "index_v")
    return _place(fusion.search_dense(asked, chunks, 5, meta=True)).withColumn("rank", F.col("rank").cast("long"))


_POOLS = f"""{_SPARSE}, {_DENSE},
every as (select q.qid, c.chunk_id, coalesce(score, 0) score from asked_v q cross join index_v c left join sparse using (qid, chunk_id)),
pool_d as {_ranked('dense', 50)}, pool_s as {_ranked('every', 50)}"""


@query(f"""with {_ALL_SPARSE}, every as (select q.qid, c.chunk_id, coalesce(score, 0) score from asked_v q cross join chunks_v c left join sparse using (qid, chunk_id))
select qid, rank, chunk_id, round(score, 6) as score from {_ranked('every', 50)}""")
def q5_8_rank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks, index = _all_index(spark, sf_dir)
    return _place(fusion.rank_pool(sparse.bm25_topk(asked, index, 50), 50, asked, chunks)).withColumn("rank", F.col("rank").cast("long"))


def _rrf(factor: str = "1.0") -> str:
    return f"""{_POOLS}, fused as (select qid, chunk_id, coalesce(1.0::double / (60 + d.rank), 0) + coalesce(1.0::double / (60 + s.rank), 0) score, d.rank dr, s.rank sr
  from pool_d d full join pool_s s using (qid, chunk_id)),
weighed as (select f.qid, f.chunk_id, f.score * {factor} as score, dr, sr from fused f join asked_v using (qid) join index_v c using (chunk_id)),
best as (select *, row_number() over (partition by qid order by round(score, 12) desc, dr nulls last, sr nulls last) rank from weighed)"""


@query(f"with {_rrf()} select qid, chunk_id, round(score, 6) as score from weighed")
def q5_9_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks, index = _index(spark, sf_dir)
    legs = [fusion.top_k(dense.dense_topk(asked, chunks, 50), 50), fusion.rank_pool(sparse.bm25_topk(asked, index, 50), 50, asked, chunks)]
    return _place(fusion.rrf(legs)).select("qid", "chunk_id", "score")


@query(f"with {_rrf(_FACTOR)} select qid, rank, chunk_id, round(least(score / (2.0 / 61.0), 1.0), 6) as score from best where rank <= 5")
def q5_10_search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks, index = _index(spark, sf_dir)
    return _place(fusion.search_hybrid(asked, chunks, index, 5, meta=True)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {_rrf()} select qid, rank, chunk_id, round(least(score / (2.0 / 61.0), 1.0), 6) as score, doc, page, md5(text) as digest, date
from best join index_v using (chunk_id) where rank <= 10""")
def q5_11_hits_with_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks, index = _index(spark, sf_dir)
    hits = fusion.hits_with_chunks(fusion.search_hybrid(asked, chunks, index, 10), chunks)
    return _place(hits).select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "doc", "page", F.md5("text").alias("digest"), "date")


@query("select qid, count(distinct case when date <> '미상' then date end) >= 2 as conflict from hits_v group by 1")
def q5_12_date_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.date_conflicts(view(spark, sf_dir, "hits_v"))


_CONTEXT = f"""blocks as (select *, min(rank) over (partition by qid, doc) best, concat('[', rank, '] ', doc, ' p.', page, ' (작성일 ', date, ')', {NL}, text) block from hits_v),
ctx as (select qid, string_agg(block, concat({NL}, {NL}) order by best, page, rank) as context from blocks group by 1)"""


@query(f"with {_CONTEXT} select qid, context from ctx")
def q5_13_build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.build_context(view(spark, sf_dir, "hits_v"))


@query(f"""with b as (select *, concat('[', rank, '] ', doc, ' p.', page, {NL}, text) block from hits_v)
select qid, string_agg(block, concat({NL}, {NL}) order by rank) as context from b group by 1""")
def q5_13_build_context_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.build_context(view(spark, sf_dir, "hits_v"), meta=False, ordered=False)


@query(f"""with {_CONTEXT}, con as (select qid, count(distinct case when date <> '미상' then date end) >= 2 as conflict from hits_v group by 1),
hist as (select conv_id qid, string_agg(text, ' / ' order by turn) history from conversations group by 1 having max(turn) >= 3)
select q.qid, md5(case when history is null then concat('R:', case when conflict then 'newest first' else '' end, {NL}, context, {NL}, 'Q:', question)
  else concat('H:', history, {NL}, 'R:', case when conflict then 'newest first' else '' end, {NL}, context, {NL}, 'Q:', question) end) as digest
from questions_v q left join ctx using (qid) left join con using (qid) left join hist using (qid)""")
def q5_14_build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, questions = view(spark, sf_dir, "hits_v"), view(spark, sf_dir, "questions_v")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " / ")
    history = rows.groupBy(F.col("conv_id").alias("qid")).agg(said.alias("history"), F.max("turn").alias("last")).where("last >= 3").drop("last")
    plain = "R:{rules}\n{context}\nQ:{question}"
    prompts = cx.build_prompt(questions, cx.build_context(hits), cx.date_conflicts(hits), plain, "newest first", history, "H:{history}\n" + plain)
    return prompts.select("qid", F.md5("prompt").alias("digest"))


_CITED = """marks as (select aid, qid, flatten(list_transform(regexp_extract_all(answer, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda m: list_transform(string_split(m, ','), lambda x: trim(x)::bigint))) ns from answers_v),
each_ as (select aid, qid, unnest(ns) num, generate_subscripts(ns, 1) pos from marks),
first_ as (select aid, qid, num, min(pos) pos from each_ group by 1, 2, 3),
paged as (select aid, f.qid, doc, page, min(pos) pos, string_agg(num, ',' order by pos) nums, string_agg(concat('[', num, ']'), '' order by pos) marks
  from first_ f join hits_v h on h.qid = f.qid and h.rank = f.num group by 1, 2, 3, 4),
cites as (select *, row_number() over (partition by aid order by pos) ord from paged)"""


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    answers, hits = view(spark, sf_dir, "answers_v"), view(spark, sf_dir, "hits_v")
    return cx.cited(answers, hits), answers, hits


@query(f"with {_CITED} select aid, ord, doc, page, nums from cites")
def q5_15_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cited(spark, sf_dir)[0]
    return rows.select("aid", F.col("ord").cast("long").alias("ord"), "doc", "page", F.array_join(F.col("nums").cast("array<string>"), ",").alias("nums"))


@query(f"""with {_CITED}, dated as (select qid, doc, page, arg_min(date, rank) date from hits_v group by 1, 2, 3)
select answers_v.aid, coalesce(string_agg(concat(marks, ' ', c.doc, ' p.', c.page, ', ', date), ' · ' order by ord), '') as sources
from answers_v left join (select cites.*, date from cites join dated using (qid, doc, page)) c using (aid) group by 1""".replace("coalesce(string_agg(concat(", "coalesce(string_agg(concat(").replace("' · ' order by ord)", "' · ' order by ord) filter (c.aid is not null)"))
def q5_16_source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.source_lines(*_cited(spark, sf_dir))


@query(f"""with {_CITED} select aid, ord, doc, page, coalesce(page between 1 and n, false) as valid from cites
left join (select source as doc, count(*) as n from documents where source <> 'src3' group by 1) using (doc) where ord <= 2""")
def q5_17_cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source <> 'src3'").groupBy(F.col("source").alias("doc")).agg(F.count("*").alias("page_count"))
    return cx.cited_pages(_cited(spark, sf_dir)[0], known, 2).withColumn("ord", F.col("ord").cast("long"))


@query("""select qid, rank, concat(substring(text, 1, 80), '...') as preview, round(least(greatest(score * 80 - 0.3, 0.0), 1.0), 6) as shown, qid % 2 = 0 as rewritten
from hits_v join questions_v using (qid)""")
def q5_18_hit_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = view(spark, sf_dir, "hits_v").withColumn("score", F.col("score") * 80 - 0.3)
    asked = view(spark, sf_dir, "questions_v").withColumn("query", F.when(F.col("qid") % 2 == 0, F.concat("question", F.lit("?"))).otherwise(F.col("question")))
    return cx.hit_preview(hits, asked).withColumn("shown", F.round("shown", 6))


@query("select conv_id, turn, question, regexp_replace(answer, ' \\[1, 2\\] end \\[3\\]$', '') as answer from turns_v")
def q7_1_pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog.pair_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_HISTORY = f"""said as (select conv_id, turn, question, concat('Q: ', question, {NL}, 'A: ', substring(regexp_replace(answer, '\\[\\d+(?:\\s*,\\s*\\d+)*\\]', '', 'g'), 1, 200)) pair from turns_v),
hist as (select a.conv_id, a.turn, any_value(a.question) question, coalesce(string_agg(b.pair, {NL} order by b.turn), '(없음)') as history
  from said a left join (select *, row_number() over (partition by conv_id order by turn) n from said) b
    on b.conv_id = a.conv_id and b.turn < a.turn and b.n >= (select count(*) from said c where c.conv_id = a.conv_id and c.turn < a.turn) - 3 group by 1, 2)"""


@query(f"with {_HISTORY} select conv_id, turn, history from hist")
def q7_2_format_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog.format_history(view(spark, sf_dir, "turns_v"))


_RAW = f"case (conv_id + turn) % 4 when 0 then concat('\"', substring(question, 1, 40), '\"', {NL}, 'more') when 1 then '' when 2 then question else null end"
_LINE = strip(f"trim({strip(f'split_part(raw, {NL}, 1)')}, '\"')")
_REWRITE = f"case when history <> '(없음)' and length({_LINE}) between 1 and 120 then {_LINE} else question end"


def _rewrites(turns: DataFrame) -> DataFrame:
    kind = (F.col("conv_id") + F.col("turn")) % 4
    raw = F.when(kind == 0, F.concat(F.lit('"'), F.substring("question", 1, 40), F.lit('"\nmore'))).when(kind == 1, "").when(kind == 2, F.col("question"))
    return turns.select("conv_id", "turn", raw.alias("raw"))


@query(f"with {_HISTORY}, r as (select *, {_RAW} raw from hist) select conv_id, turn, {_REWRITE} as query from r")
def q7_3_accept_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = view(spark, sf_dir, "turns_v")
    return dialog.multi_turn_queries(turns, _rewrites(turns)).select("conv_id", "turn", "query")


_PRIOR = "case item_id % 4 when 0 then concat('직전 질문: ', substring(text, 1, 30), ' ') when 1 then substring(text, 1, 30) when 2 then '' else null end"


@query(f"with c as (select item_id, {_PRIOR} c from benchmark) select item_id, case when c <> '' then {strip('c[coalesce(nullif(position(' + chr(39) + '직전 질문:' + chr(39) + ' in c), 0) + 6, 1):]')} end as prior from c")
def q7_4_prior_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id") % 4
    ctx = F.when(k == 0, F.concat(F.lit("직전 질문: "), F.substring("text", 1, 30), F.lit(" "))).when(k == 1, F.substring("text", 1, 30)).when(k == 2, "")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", dialog.prior_question(ctx).alias("prior"))


@query(f"""with {_HISTORY}, r as (select *, {_RAW} raw from hist), rw as (select concat(conv_id, ':', turn) as qid, {_REWRITE} as question from r),
asked_t as (select qid, question from rw), {_BM25}, ask as (select qid, unnest(list_distinct({_tokens('question')})) term from asked_t),
sparse as (select qid, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) score
  from ask join terms using (term) join post using (term) join len_ using (chunk_id), corpus group by 1, 2)
select qid, rank, chunk_id, round(score, 6) as score from {_ranked('sparse', 5)}""")
def q7_5_multi_turn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = view(spark, sf_dir, "turns_v")
    asked = dialog.multi_turn_queries(turns, _rewrites(turns)).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), F.col("query").alias("question"))
    index = _all_index(spark, sf_dir)[2]
    return _place(fusion.top_k(sparse.bm25_topk(asked, index, 5), 5)).withColumn("rank", F.col("rank").cast("long"))
