"""Queries over metrics, reports, judging and files, with their SQL."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import chunks as ck
from lectern.operators import ask, dialog, judging, metrics
from lectern.plans.fixtures import view, with_views
from lectern.operators import pages as pg
from lectern.plans.prepare import NL, _RESOLVED, _headings, _reads, _sql_blocks, _sql_fixed, norm, squash
from lectern.plans.retrieve import _CITED, _CONTEXT, _FACTOR, _HISTORY, _RAW, _REWRITE, _index, _ranked, _rewrites, _rrf
from lectern.sources import infer, io
from lectern.sources.staging import shared_dir, stage_table, with_dense_id

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def _metric(k: int, hits: str = "hits_v", key: str = "qid", name: str = "pm") -> str:
    on = "config, qid" if key != "qid" else "qid"
    asked = "(select qid, count(*) n_gold from gold_v group by 1)"
    asked = f"(select * from {asked} g cross join (select distinct config from {hits}))" if key != "qid" else asked
    return f"""top{k} as (select {on}, rank, doc, page, g.qid is not null rel, row_number() over (partition by {on}, doc, page order by rank) again
  from (select * from {hits} where rank <= {k}) h left join gold_v g using (qid, doc, page)),
sum{k} as (select {on}, count(*) filter (rel) n_rel, count(*) filter (rel and again = 1) found, min(rank) filter (rel) best, sum(1 / log2(rank + 1.0)) filter (rel and again = 1) dcg from top{k} group by {on}),
{name}{k} as (select {on}, coalesce(n_rel / {k}, 0) as precision, coalesce(found / n_gold, 0) as recall, coalesce(1.0 / best, 0) as mrr,
  coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(n_gold, {k})), lambda i: 1 / log2(i + 1.0))) as ndcg from {asked} a left join sum{k} using ({on}))"""


_ROUND = "round(precision, 6) as precision, round(recall, 6) as recall, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg"


def _six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


@query(f"with {_metric(5).replace('g.qid is not null', 'g.page is not null')} select qid, {_ROUND} from pm5".replace("left join gold_v g using (qid, doc, page)", "left join (select qid, doc, page, true as r from gold_v) g using (qid, doc, page)").replace("g.page is not null", "coalesce(g.r, false)"))
def q6_1_page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.page_metrics(view(spark, sf_dir, "hits_v"), view(spark, sf_dir, "gold_v"), 5))


_COVER = """base as (select distinct source as doc, cast(floor(doc_id/20) as int)+1 as page from documents where doc_id % 3 <> 0 and length(text) >= 50),
cover as (select qid, case when count(b.r) = 0 then 'none' when count(b.r) < count(*) then 'some' else 'all' end as coverage
  from gold_v left join (select *, true as r from base) b using (doc, page) group by 1)"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages_v").where("doc_id % 3 <> 0").select("doc", "page", F.col("block_text").alias("text"))
    return metrics.coverage_groups(view(spark, sf_dir, "gold_v"), ck.chunk_fixed(pages).select("doc", "page"))


@query(f"with {_COVER} select * from cover")
def q6_2_coverage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


_CONFIG_HITS = """hits_c as (select 'a' as config, * from hits_v where rank <= 10 union all select 'b', * from (select qid, 11 - rank as rank, chunk_id, doc, page, score, text, date from hits_v))"""


def _config_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = view(spark, sf_dir, "hits_v").select("qid", "rank", "doc", "page")
    other = hits.withColumn("rank", 11 - F.col("rank"))
    return hits.withColumn("config", F.lit("a")).unionByName(other.withColumn("config", F.lit("b")))


def _rel(sql: str) -> str:
    sql = sql.replace("left join gold_v g using (qid, doc, page)", "left join (select qid, doc, page, true as r from gold_v) g using (qid, doc, page)")
    return sql.replace("g.qid is not null rel", "coalesce(g.r, false) rel")


_REPORT = _rel(f"with {_CONFIG_HITS}, {_COVER}, {_metric(5, 'hits_c', 'config')}, {_metric(10, 'hits_c', 'config')}")
_MEANS = ", ".join(f"round(avg(p{k}.{m}), 6) as {m}_{k}" for k in (5, 10) for m in metrics.NAMES)


@query(f"""{_REPORT} select config, coverage, count(*) as n, {_MEANS} from pm5 p5 join pm10 p10 using (config, qid) join cover using (qid)
group by grouping sets ((config), (config, coverage))""")
def q6_3_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.retrieval_report(_config_hits(spark, sf_dir), view(spark, sf_dir, "gold_v"), _coverage(spark, sf_dir)))


_SEARCHED = f"""{_rrf(_FACTOR)}, plain as {_ranked('dense', 10)},
hits_s as (select 'base' as config, qid, rank, doc, page from plain join index_v using (chunk_id)
  union all select 'best', qid, rank, doc, page from best join index_v using (chunk_id) where rank <= 10)"""
_REPORT_S = _rel(f"with {_SEARCHED}, {_COVER}, {_metric(5, 'hits_s', 'config')}, {_metric(10, 'hits_s', 'config')}")


@query(f"""{_REPORT_S} select config, coverage, count(*) as n, {_MEANS} from pm5 p5 join pm10 p10 using (config, qid) join cover using (qid)
group by grouping sets ((config), (config, coverage))""")
def q6_3_report_of_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations searched, cut at 5 and 10, and reported: from questions to means."""
    asked, chunks, index = _index(spark, sf_dir)
    configs = [ask.Config("base", "all", k=10), ask.Config("best", "all", hybrid=True, meta=True, k=10)]
    hits = ask.search_configs(asked, configs, {"all": ask.Index(chunks, index)})
    return _six(metrics.retrieval_report(hits.select("config", "qid", "rank", "doc", "page"), view(spark, sf_dir, "gold_v"), _coverage(spark, sf_dir)))


LETTERS = "etaoinsrldu"


def _letters(text):
    """A stand-in for a model's vector: the share of some letters, of unit length."""
    counts = F.array(*(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) + F.lit(0.25) for c in LETTERS))
    return F.transform(F.array(counts), tx.l2_normalize)[0]


def _sql_letters(text: str) -> str:
    counts = ", ".join(f"(length({text}) - length(replace({text}, '{c}', '')) + 0.25)::double" for c in LETTERS)
    return f"list_transform([[{counts}]], lambda c: list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))))[1]"


def _sql_size(sql: str, old: int, new: int) -> str:
    """The chunking's common table expressions for another size."""
    return sql.replace(f"> {old}", f"> {new}").replace(f", {old})", f", {new})").replace(f", {old - old // 5}))", f", {new - new // 5}))")


def _sized(size: int) -> str:
    """chunks of both builds at one size, as `four_{size}`."""
    base = f"n{size} as (select doc, page, {norm('raw_text')} as text from pg), {_sql_fixed(f'n{size}', 'text', 'doc, page', size, 50)}".replace("win ", f"bwin{size} ").replace("from win", f"from bwin{size}").replace("fixed as", f"bfixed{size} as")
    plain = _sql_fixed("plain", "text", "doc, page", size, 40).replace("win ", f"pwin{size} ").replace("from win", f"from pwin{size}").replace("fixed as", f"pfixed{size} as")
    read = _sql_blocks("read", "text", "doc, page", size)
    for name in ("bl", "fold", "kept", "cut"):
        read = read.replace(f"{name} as", f"{name}{size} as").replace(f"from {name})", f"from {name}{size})").replace(f"from {name}),", f"from {name}{size}),")
    return f"""{base}, {plain}, {read},
top{size} as (select doc, page, piece, case when heading is not null and not contains({squash('text')}, {squash('heading')}) then concat('## ', heading, {NL}, text) else text end as text
  from cut{size} left join hd using (doc, page) where not (heading is not null and not contains(text, {NL}) and contains({squash('text')}, {squash('heading')}))),
four{size} as (select 'baseline_{size}' as config, doc, page, piece, text as st from bfixed{size}
  union all select 'improved_{size}', doc, page, piece, concat(doc, ' ', page, '쪽', {NL}, text) from (select doc, page, piece, text from pfixed{size} union all select doc, page, piece, text from top{size}))"""


_FOUR = f"""{_RESOLVED}, plain as (select doc, page, text from resolved where how in ('text', 'fallback')), read as (select doc, page, text from resolved where how in ('vlm', 'cache')),
hd as (select doc, page, concat('Part ', page) heading from resolved where page % 3 = 0), {_sized(500)}, {_sized(1000)},
four as (select config, doc, page, row_number() over (partition by config order by doc, page, piece) as chunk_id, {_sql_letters('st')} v from (select * from four500 union all select * from four1000)),
ask4 as (select qid, {_sql_letters('question')} q from questions_v),
best4 as (select config, qid, doc, page, row_number() over (partition by config, qid order by round(list_inner_product(q, v), 9) desc, chunk_id) as rank from ask4, four qualify rank <= 10)"""
_REPORT_4 = _rel(f"{_FOUR.strip()}, {_COVER}, {_metric(5, 'best4', 'config')}, {_metric(10, 'best4', 'config')}")


@query(f"""{_REPORT_4} select config, coverage, count(*) as n, {_MEANS} from pm5 p5 join pm10 p10 using (config, qid) join cover using (qid)
group by grouping sets ((config), (config, coverage))""")
def q6_3_four_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and improved indexes at two sizes, built from pages, saved under their names in one place, searched at
    once, and reported."""
    place = _folder(spark, "four")
    pages, cached, new = _reads(spark, sf_dir)
    resolved = stage_table(pg.resolve_pages(pages, cached, new), "resolved")
    titles = _headings(pages).withColumnRenamed("heading", "title")
    for size in (500, 1000):
        built = {f"baseline_{size}": ck.build_baseline(pages, size).withColumn("search_text", F.col("text")), f"improved_{size}": ck.index_of_resolved(resolved, titles, size=size)}
        for name, chunks in built.items():
            io.write_index(chunks.select("chunk_id", "doc", "page", _letters(F.col("search_text")).alias("embedding")), place, name)
    asked = view(spark, sf_dir, "questions_v").select("qid", _letters(F.col("question")).alias("embedding"))
    hits = ask.search_indexes(asked, io.read_index(spark, place), k=10).withColumnRenamed("index_name", "config")
    return _six(metrics.retrieval_report(hits, view(spark, sf_dir, "gold_v"), _coverage(spark, sf_dir)))


@query(f"with {_CONFIG_HITS} select config, qid, string_agg(concat(doc, '#', page), ',' order by rank) as pages from hits_c where rank <= 10 group by 1, 2")
def q6_3_top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_pages(_config_hits(spark, sf_dir)).withColumn("pages", F.array_join("pages", ","))


@query(f"with {_COVER} select coverage, count(*) as n from cover group by 1")
def q6_4_coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage_counts(_coverage(spark, sf_dir))


_JUDGED = """jk as (select id, config, no from judge_v), sc as (select id, correctness, faithfulness from judge_v where right(id, 1) <> '7'),
rows_ as (select jk.config, jk.no, correctness, faithfulness, category, gold_answer, answer, coverage
  from jk join sc using (id) join judged_questions_v q using (no) left join judged_answers_v a on a.config = jk.config and a.no = jk.no)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    judge, questions = view(spark, sf_dir, "judge_v"), view(spark, sf_dir, "judged_questions_v")
    coverage = questions.where("coverage is not null").select("no", "coverage")
    return judging.judged_rows(judge.select("id", "config", "no"), judge.where("right(id, 1) <> '7'"), questions, view(spark, sf_dir, "judged_answers_v"), coverage)


@query(f"""with {_JUDGED} select config, count(*) as n, round(sum(correctness) / (2 * count(correctness)), 3) as correctness,
round(sum(faithfulness) / (2 * nullif(count(faithfulness), 0)), 3) as faithfulness, count(faithfulness) as faith_n,
count(*) filter (not contains(gold_answer, '찾을 수 없') and contains(coalesce(answer, ''), '찾을 수 없')) as wrong_refusals,
count(*) filter (not contains(gold_answer, '찾을 수 없')) as answerable_n from rows_ group by 1""")
def q6_5_judge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.judge_report(_judged(spark, sf_dir))


@query(f"""with {_JUDGED} select config, category, null::varchar as coverage, round(sum(correctness) / (2 * count(correctness)), 3) as correctness from rows_ group by 1, 2
union all select config, null, coverage, round(sum(correctness) / (2 * count(correctness)), 3) from rows_ where coverage is not null group by 1, 3""")
def q6_5_judge_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.judge_breakdown(_judged(spark, sf_dir))


@query("""with gone as (select id from judge_v where right(id, 1) = '7')
select (select count(*) from gone) as n_missing, (select string_agg(id, ',' order by id) from (select id from gone order by id limit 10)) as first_ids""")
def q6_6_missing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    judge = view(spark, sf_dir, "judge_v")
    return judging.missing_scores(judge, judge.where("right(id, 1) <> '7'")).withColumn("first_ids", F.array_join("first_ids", ","))


_CONFIGS = """configs as (select * from (values ('norag', null, null, 0), ('base5', 'small', false, 5), ('base10', 'small', false, 10), ('best5', 'large', true, 5), ('best10', 'large', true, 10)) c(config, index_name, meta, k))"""


def _configs(spark: SparkSession) -> DataFrame:
    rows = [("norag", None, None, 0), ("base5", "small", False, 5), ("base10", "small", False, 10), ("best5", "large", True, 5), ("best10", "large", True, 10)]
    return spark.createDataFrame(rows, "config string, index_name string, meta boolean, k int")


@query(f"with {_CONFIGS} select no, category, config, coalesce(index_name, '') as index_name, coalesce(meta, false) as meta, k from judged_questions_v cross join configs")
def q6_8_config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.config_grid(view(spark, sf_dir, "judged_questions_v").select("no", "category"), _configs(spark)).na.fill("", ["index_name"]).na.fill(False, ["meta"])


_RECORDS = f"""{_CONFIGS}, grid as (select q.no, q.category, c.* from judged_questions_v q cross join configs c),
gen as (select config, no, concat('answer ', config, ' ', no) answer from grid where (no + k) % 3 <> 0),
ret as (select g.config, g.no, h.rank, h.doc, h.page, h.score, h.date, h.text from grid g join hits_v h on h.qid = g.no and h.rank <= g.k),
cit as (select config, no, rank as ord, doc, page from ret where rank % 2 = 1)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = judging.config_grid(view(spark, sf_dir, "judged_questions_v").select("no", "category"), _configs(spark))
    answers = grid.where((F.col("no") + F.col("k")) % 3 != 0).select("config", "no", F.concat(F.lit("answer "), "config", F.lit(" "), F.col("no").cast("string")).alias("answer"))
    hits = view(spark, sf_dir, "hits_v").withColumn("no", F.col("qid").cast("int")).join(grid.select("config", "no", "k"), "no").where("rank <= k")
    cites = hits.where("rank % 2 = 1").select("config", "no", F.col("rank").alias("ord"), "doc", "page")
    return judging.generation_records(grid, hits, answers, cites)


@query(f"""with {_RECORDS}, r as (select config, no, string_agg(concat(rank, ':', doc, ':', page, ':', round(score, 4)), ',' order by rank) retrieved from ret group by 1, 2),
c as (select config, no, string_agg(concat(doc, ':', page), ',' order by ord) cited from cit group by 1, 2)
select config, no, category, answer, retrieved, cited from gen join grid using (config, no) left join r using (config, no) left join c using (config, no)""")
def q6_9_generation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda *parts: F.concat_ws(":", *(p.cast("string") for p in parts))
    rows = _records(spark, sf_dir)
    retrieved = F.array_join(F.transform("retrieved", lambda h: said(h["rank"], h["doc"], h["page"], h["score"])), ",")
    return rows.select("config", "no", "category", "answer", retrieved.alias("retrieved"), F.array_join(F.transform("cited", lambda c: said(c["doc"], c["page"])), ",").alias("cited"))


_PACKED = f"""{_RECORDS}, placed as (select g.config, g.no, answer, meta, row_number() over (order by md5(concat('0|', g.config, '|', g.no)), g.config, g.no) - 1 as n from gen join grid g using (config, no)),
ctx as (select r.config, r.no, string_agg(concat('[', rank, '] ', doc, ' p.', page, case when meta then concat(' (작성일 ', date, ')') else '' end, {NL}, text), '|' order by rank) context
  from ret r join grid g using (config, no) group by 1, 2),
packed as (select concat('A', lpad(n::varchar, greatest(3, length(n::varchar))::int, '0')) as id, (n // 40 + 1)::int as batch, config, no, answer, md5(context) as context from placed left join ctx using (config, no))"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.pack_blind(_records(spark, sf_dir))


@query(f"with {_PACKED} select * from packed")
def q6_10_pack_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("id", "batch", "config", "no", "answer", F.md5(F.array_join("context", "|")).alias("context"))


@query(f"with {_PACKED} select id, config, no from packed union all select concat('B', id), config, no from packed where no % 2 = 0")
def q6_10_merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = judging.judge_key(_packed(spark, sf_dir))
    later = key.where("no % 2 = 0").withColumn("id", F.concat(F.lit("B"), "id"))
    return judging.merge_keys(key, later)


@query(f"""with {_RECORDS}, two as (select config, no, case when starts_with(config, 'best') then 'B' else 'A' end pack from gen),
n as (select *, row_number() over (partition by pack order by md5(concat('0|', config, '|', no)), config, no) - 1 n from two)
select concat(pack, lpad(n::varchar, greatest(3, length(n::varchar))::int, '0')) as id, config, no from n""")
def q6_10_second_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later configurations packed by themselves, under their own prefix; one key for both packs."""
    records, later = _records(spark, sf_dir), F.startswith("config", F.lit("best"))
    packs = [judging.pack_blind(records.where(which), prefix) for which, prefix in ((~later, "A"), (later, "B"))]
    return judging.merge_keys(*(judging.judge_key(p) for p in packs))


_ASKED_T = f"""{_HISTORY}, r as (select *, {_RAW} raw from hist),
rw as (select concat(conv_id, ':', turn) as qid, conv_id, r.question as said, history, {_REWRITE} as query, embedding
  from r join embeddings on vec_id = (conv_id * 7 + turn) % (select max(vec_id) + 1 from embeddings)),
asked_t as (select qid, query as question, embedding from rw)"""
_ANSWERED = f"""{_ASKED_T}, {_rrf(_FACTOR).replace('asked_v', 'asked_t')},
found as (select qid, rank, doc, page, least(score / (2.0 / 61.0), 1.0) as score, text, date from best join index_v using (chunk_id) where rank <= 5),
{_CONTEXT.replace('hits_v', 'found')}, con as (select qid, count(distinct case when date <> '미상' then date end) >= 2 as conflict from found group by 1),
told as (select qid, case when history <> '(없음)' then concat('H:', history, {NL}) else '' end h, said, case when conflict then 'newest first' else '' end rules, coalesce(context, '') context
  from rw left join ctx using (qid) left join con using (qid)),
said_ as (select concat('best|', qid) as aid, concat('best|', qid) as qid, concat('See [1] and [3, 2]. ', md5(concat(h, 'R:', rules, {NL}, context, {NL}, 'Q:', said))) as answer from told
  union all select concat('norag|', qid), concat('norag|', qid), concat('See [1] and [3, 2]. ', md5(concat('H:', case when h = '' then '' else h[3:-2] end, {NL}, 'Q:', said))) from told),
found_ as (select * replace (concat('best|', qid) as qid) from found), {_CITED.replace('answers_v', 'said_').replace('hits_v', 'found_')}"""


@query(f"""with {_ANSWERED}, ret as (select qid, string_agg(concat(rank, ':', doc, ':', page, ':', date), ',' order by rank) retrieved from found_ group by 1),
ct as (select aid, string_agg(concat(doc, ':', page), ',' order by ord) cited from cites group by 1)
select string_split(s.aid, '|')[1] as config, rw.qid as no, conv_id, said as question, case when history <> '(없음)' then history end as history, query, answer, retrieved, cited
from said_ s join rw on rw.qid = string_split(s.aid, '|')[2] left join ret on ret.qid = s.aid left join ct using (aid)""")
def q7_6_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn from its history to the record of its answer: rewrite, search, context, prompt, answer, citations. The
    model answers with three citations and the digest of its prompt."""
    turns = view(spark, sf_dir, "turns_v")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    size = F.broadcast(vectors.agg((F.max("vec_id") + 1).alias("n")))  # one row
    asked = dialog.multi_turn_queries(turns, _rewrites(turns)).join(size, how="cross").withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % F.col("n"))
    asked = asked.join(vectors, "vec_id").select(
        "conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("category"), "question",
        F.when(F.col("history") != dialog.NO_HISTORY, F.col("history")).alias("history"), "query", "embedding",
    )
    asked = stage_table(with_dense_id(asked, ["conv_id", "turn"], "qid"), "asked")
    _, chunks, index = _index(spark, sf_dir)
    configs = [ask.Config("best", "all", hybrid=True, meta=True, k=5), ask.Config("norag")]
    hits = ask.search_configs(asked.select("qid", F.col("query").alias("question"), "embedding"), configs, {"all": ask.Index(chunks, index)})
    plain = "R:{rules}\n{context}\nQ:{question}"
    templates = ask.Templates(plain, "H:{history}\n" + plain, "H:{history}\nQ:{question}", "newest first")
    records, _ = ask.answer(asked, hits, configs, templates, _cite_and_digest, batch=64)
    said = lambda *parts: F.concat_ws(":", *(p.cast("string") for p in parts))
    retrieved = F.array_join(F.transform("retrieved", lambda h: said(h["rank"], h["doc"], h["page"], h["date"])), ",")
    cited = F.array_join(F.transform("cited", lambda c: said(c["doc"], c["page"])), ",")
    conv = F.split("category", ":")[0].cast("long").alias("conv_id")
    return records.select("config", F.col("category").alias("no"), conv, "question", "history", "query", "answer", retrieved.alias("retrieved"), cited.alias("cited"))


def _cite_and_digest(rows):
    return [f"See [1] and [3, 2]. {hashlib.md5(p.encode()).hexdigest()}" for p in rows["prompt"]]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("with x as (select 1) select source as folder, md5(coalesce(text, '')) as digest, length(coalesce(text, '')) as chars from documents")
def q1_1_read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, a folder for each source, and listed again."""
    path = _folder(spark, "files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = F.coalesce(F.concat(F.lit("source="), F.url_encode("source")), F.lit("none"))
    io.write_files(docs.select(folder.alias("folder"), "text"), path, "txt")
    text = F.expr("substring(content, 1, length(content) - 1)")  # without the line end
    files = io.read_documents(spark, path, "txt", text=F.md5(text), chars=F.length(text.cast("string")).cast("long"))
    name = "/source=([^/]*)/[^/]+$"
    return files.select(F.when(F.col("path").rlike(name), F.url_decode(F.regexp_extract("path", name, 1))).alias("folder"), F.col("text").alias("digest"), "chars")


@query("""with x as (select 1) select 'a' as index_name, doc_id, md5(text) as digest from documents where doc_id % 2 = 0
union all select 'b', doc_id, md5(text) from documents where doc_id % 2 = 1""")
def q1_2_named_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes in one place; the second is written twice and replaces itself only."""
    path, docs = _folder(spark, "index"), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5("text").alias("digest"))
    io.write_index(docs.where("doc_id % 2 = 0"), path, "a")
    io.write_index(docs, path, "b")
    io.write_index(docs.where("doc_id % 2 = 1"), path, "b")
    return io.read_index(spark, path).select("index_name", "doc_id", "digest")


@query("""select no, category, gold_answer, coalesce(refs, '') as refs from judged_questions_v left join
(select qid::int as no, string_agg(concat(doc, ':', page), ',' order by doc, page) refs from gold_v group by 1) using (no)""")
def q1_3_read_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, questions = _folder(spark, "questions"), view(spark, sf_dir, "judged_questions_v")
    refs = view(spark, sf_dir, "gold_v").groupBy(F.col("qid").cast("int").alias("no")).agg(F.array_sort(F.collect_list(F.struct("doc", "page"))).alias("gold_refs"))
    rows = questions.join(refs, "no", "left").select("no", F.col("gold_answer").alias("question"), "category", "gold_answer", "gold_refs")
    io.write_arrays(rows, path, "no")
    back = io.read_questions(spark, path)
    text = F.array_join(F.transform("gold_refs", lambda r: F.concat(r["doc"], F.lit(":"), r["page"].cast("string"))), ",")
    return back.select("no", "category", "gold_answer", F.coalesce(text, F.lit("")).alias("refs"))


@query("select id, case when no % 2 = 0 then 2 - correctness else correctness end as correctness, coalesce(faithfulness, -1) as faithfulness from judge_v where no is not null")
def q1_4_read_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score files of which the second corrects half of the first; the later record of an id counts."""
    path, judge = _folder(spark, "scores"), view(spark, sf_dir, "judge_v").where("no is not null").select("id", "no", "correctness", "faithfulness", F.lit("r").alias("reason"))
    later = judge.where("no % 2 = 0").withColumn("correctness", 2 - F.col("correctness"))
    for n, part in enumerate((judge, later)):
        io.write_arrays(part.select("id", "correctness", "faithfulness", "reason"), f"{path}/run={n}", "id")
    return io.read_scores(spark, path).select("id", "correctness", "faithfulness").na.fill(-1, ["faithfulness"])


@query(f"with {_PACKED} select id, config, no, answer from packed")
def q1_5_write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _folder(spark, "results"), _packed(spark, sf_dir).select("id", "config", "no", "answer")
    io.write_results(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(f"""with {_PACKED}, w as (select *, max(batch) over () most from packed)
select concat('part_', lpad(batch::varchar, greatest(2, length(most::varchar))::int, '0'), '.json') as file, count(*) as n, string_agg(id, ',' order by id) as ids, min(answer) as first_answer from w group by batch, most""")
def q1_6_write_judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as files of one array each, read back with their names."""
    path = _folder(spark, "batches")
    packed = _packed(spark, sf_dir).select("id", "batch", "config", "no", "answer")
    io.write_judge_batches(packed.withColumn("answer", F.lit("of an earlier run")).withColumn("batch", F.col("batch") + 1), path, "part")
    io.write_judge_batches(packed, path, "part")
    rows = spark.read.schema("id string, config string, no int, answer string").option("multiLine", True).json(f"{path}/part_*.json")
    rows = rows.select("*", F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("file"))
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.min("answer").alias("first_answer"))


@query("with x as (select 1) select doc_id, case when doc_id % 10 <> 3 then length(text) else -1 end as n_chars from documents")
def q1_8_infer_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails for a tenth of the rows, called one row at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def model(rows):
        if (rows["doc_id"] % 10 == 3).any():
            raise ValueError("no answer")
        return rows["text"].str.len()

    return infer.infer_batches(docs, model, ["doc_id", "text"], "n_chars", "long", batch=1, retries=2).select("doc_id", "n_chars").na.fill(-1)
