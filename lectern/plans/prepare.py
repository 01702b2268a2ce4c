"""Queries over page preparation, chunking and document metadata, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.html import html_table_shapes
from lectern.operators import chunks as ck
from lectern.operators import docmeta
from lectern.operators import pages as pg
from lectern.plans.fixtures import view, with_views
from lectern.sources import cache
from lectern.sources.io import read_documents  # noqa: F401
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


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{tx.WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{tx.WS}+|{tx.WS}+$', '', 'g')"


def squash(x: str) -> str:
    return f"regexp_replace({x}, '{tx.WS}', '', 'g')"


NL = "chr(10)"


@query(f"select doc_id, {norm('raw_text')} as text from pages_v")
def q2_01_normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages_v").select("doc_id", tx.normalize_ws(F.col("raw_text")).alias("text"))


@query(f"select doc_id, length({squash('raw_text')}) as n, md5({squash('raw_text')}) as digest from pages_v")
def q2_02_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tx.squash(F.col("raw_text"))
    return view(spark, sf_dir, "pages_v").select("doc_id", F.length(s).cast("long").alias("n"), F.md5(s).alias("digest"))


_SHAPES = f"""
with l as (select doc_id, unnest(string_split(block_text, {NL})) line, generate_subscripts(string_split(block_text, {NL}), 1) i from pages_v),
p as (select *, i - row_number() over (partition by doc_id, contains(line, '|') order by i) g from l where true),
t as (select doc_id, g, count(*) as n_rows, max(len(string_split(trim(line, ' |'), '|'))) as n_cols from p where contains(line, '|') group by 1, 2)"""


@query(f"""{_SHAPES},
s as (select doc_id, count(*) filter (n_rows >= 4 and n_cols >= 3) big from t group by 1),
b as (select doc_id, {strip('raw_text')} body from pages_v),
m as (select doc_id, body, coalesce(list_max(list_transform(list_filter(string_split(body, {NL}), lambda x: {strip('x')} <> ''), lambda x: length(x))), 0) longest from b)
select m.doc_id, length(body) < 200 or longest < 20 or coalesce(big, 0) > 0 as reread from m left join s using (doc_id)""")
def q2_03_needs_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "pages_v")
    return rows.select("doc_id", tx.needs_reread(F.col("raw_text"), tx.table_shapes(F.col("block_text"))).alias("reread"))


@query(f"""{_SHAPES}
select pages_v.doc_id, count(t.g) as n_tables, coalesce(string_agg(n_rows || 'x' || n_cols, ',' order by t.g), '') as shapes
from pages_v left join t using (doc_id) group by 1""")
def q2_04_table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "pages_v").withColumn("t", tx.table_shapes(F.col("block_text")))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["rows"].cast("string"), F.lit("x"), x["cols"].cast("string"))), ",")
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tables"), text.alias("shapes"))


_TABLED = """replace(replace(replace(replace(html, '<ul>', '<table>'), '</ul>', '</TABLE >'), '</li>', case page_id % 3 when 0 then '' else '</td></tr>' end), '<li>',
  case page_id % 2 when 0 then '<tr class="a>b"><td rowspan="2">n<td colspan=3>' else '<tr><th>n</th><td colspan=3>' end)"""
_NESTED = f"case when page_id % 5 = 0 then replace({_TABLED}, '<td colspan=3>', '<td colspan=3><table><tr><td>x<td>y</table>') else {_TABLED} end"


@query("""with n as (select page_id, len(regexp_extract_all(coalesce(html, ''), '<li>')) as lis, len(regexp_extract_all(coalesce(html, ''), '<ul>')) as uls from pages)
select page_id, case when uls = 0 then 0 when page_id % 5 = 0 then uls + lis else uls end as n_tables, case when uls = 0 then '' else
  concat(lis, 'x', case when page_id % 2 = 0 and lis > 1 then 5 else 4 end, case when page_id % 5 = 0 then repeat(',1x2', lis::int) else '' end) end as shapes from n""")
def q2_04_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's menu as a table, with cells over three columns, over two rows, with open rows and cells, and with a
    table in each row's cell."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("t", html_table_shapes(F.expr(_NESTED)))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["rows"].cast("string"), F.lit("x"), x["cols"].cast("string"))), ",")
    return rows.select("page_id", F.size("t").cast("long").alias("n_tables"), text.alias("shapes"))


def _degenerate(x: str) -> str:
    ls = f"list_filter(list_transform(string_split({x}, {NL}), lambda l: {strip('l')}), lambda l: length(l) > 10)"
    return f"""case when length({x}) > 6000 then true when len({ls}) = 0 then false
      when list_max(list_transform({ls}, lambda l: length(l))) > 1500 then true
      else len(list_distinct({ls})) / len({ls}) < 0.5 end"""


@query(f"select doc_id, {_degenerate('block_text')} as degenerate from pages_v")
def q2_05_is_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages_v").select("doc_id", tx.is_degenerate(F.col("block_text")).alias("degenerate"))


def _reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, every second one torn into short lines, readings that are cached, and new ones, some of which run away."""
    pages = view(spark, sf_dir, "pages_v").withColumn("tables", tx.table_shapes(F.col("block_text")))
    pages = pages.withColumn("raw_text", F.when(F.col("doc_id") % 2 == 1, F.replace(F.col("raw_text"), F.lit(" "), F.lit("\n"))).otherwise(F.col("raw_text")))
    cached = pages.where("doc_id % 4 = 0").select("doc", "page", F.col("block_text").alias("text"))
    again = F.when(F.col("doc_id") % 8 == 1, F.repeat(F.concat("block_text", F.lit("\n")), F.lit(3))).otherwise(F.col("block_text"))
    new = pages.where("doc_id % 4 in (1, 2)").select("doc", "page", again.alias("text"))
    return pages, cached, new


_RESOLVED = f"""{_SHAPES},
s as (select doc_id, count(*) filter (n_rows >= 4 and n_cols >= 3) big from t group by 1),
pg as (select doc_id, doc, page, case when doc_id % 2 = 1 then replace(raw_text, ' ', {NL}) else raw_text end raw_text, block_text,
  case when doc_id % 8 = 1 then repeat(concat(block_text, {NL}), 3) else block_text end new_text from pages_v),
b as (select *, {strip('raw_text')} body from pg),
m as (select *, coalesce(list_max(list_transform(list_filter(string_split(body, {NL}), lambda x: {strip('x')} <> ''), lambda x: length(x))), 0) longest from b),
h as (select m.*, case when doc_id % 4 = 0 then 'cache' when not (length(body) < 200 or longest < 20 or coalesce(big, 0) > 0) then 'text'
  when doc_id % 4 in (1, 2) and new_text <> '' and not ({_degenerate('new_text')}) then 'vlm' else 'fallback' end how
  from m left join s using (doc_id)),
resolved as (select doc_id, doc, page, how, case how when 'cache' then block_text when 'vlm' then new_text else {norm('raw_text')} end text from h)"""


@query(f"{_RESOLVED} select doc, page, how, md5(text) as digest from resolved")
def q2_06_resolve_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.resolve_pages(*_reads(spark, sf_dir)).select("doc", "page", "how", F.md5("text").alias("digest"))


@query(f"{_RESOLVED} select doc, page from resolved where how <> 'text' and doc_id % 4 <> 0")
def q1_07_pending_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, cached, _ = _reads(spark, sf_dir)
    return pg.pending_reads(pages, cached)


_SECOND = _RESOLVED.replace("doc_id % 4 in (1, 2)", "doc_id % 5 <> 1")


@query(f"{_SECOND} select doc, page, case how when 'vlm' then 'cached' else 'asked again' end as state from resolved where how in ('vlm', 'fallback')")
def q1_07_resumed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose model fails for a fifth of the pages; its readings are appended to the cache, and a second run asks
    for the others only."""
    pages, cached, _ = _reads(spark, sf_dir)
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    cached.write.parquet(path)

    def model(rows):
        if (rows["doc_id"] % 5 == 1).any():
            raise ValueError("no answer")
        return [f"{t}\n" * 3 if n % 8 == 1 else t for n, t in zip(rows["doc_id"], rows["block_text"], strict=True)]

    found = pg.read_run(pages, cached, pages, model, ["doc_id", "block_text"], batch=1, retries=2)[1]
    found.write.mode("append").parquet(path)
    again = pg.pending_reads(pages, spark.read.parquet(path)).withColumn("state", F.lit("asked again"))
    return spark.read.parquet(path).join(cached.select("doc", "page"), ["doc", "page"], "left_anti").select("doc", "page", F.lit("cached").alias("state")).unionByName(again)


@query("""select doc, page from pages_v where doc_id % 4 = 0 and doc_id % 3 <> 0 and doc <> 'src1'""")
def q1_07_pending_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages_v")
    titles = pages.where("doc_id % 3 = 0").select("doc", "page", F.when(F.col("doc_id") % 2 == 0, "").otherwise("t").alias("title"))
    documents = pages.where("doc <> 'src1'").select("doc").distinct()
    return pg.pending_titles(pages.where("doc_id % 4 = 0"), documents, titles)


@query("""select doc, page, case when doc_id % 5 = 1 then null when doc_id % 3 = 0 then '' else concat('Part ', page) end as title,
case when doc_id % 5 = 1 then 'asked again' else 'added' end as state from pages_v where doc_id % 4 = 0 and doc <> 'src1'""")
def q1_07_title_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title run whose model fails for a fifth of the pages, written a second time under its name, as after a lost
    answer to its commit; then a run that finds only the failed pages left, and fails for them again."""
    pages = view(spark, sf_dir, "pages_v")
    reads, documents = pages.where("doc_id % 4 = 0"), pages.where("doc <> 'src1'").select("doc").distinct()
    path = f"{shared_dir(spark)}/titles-{uuid.uuid4().hex}"

    def model(rows):
        (doc_id,) = rows["doc_id"]
        if doc_id % 5 == 1:
            raise ValueError("no answer")
        return ["없음" if doc_id % 3 == 0 else f"## Part {rows['number'].iloc[0]} \nmore"]

    sources = pages.withColumn("number", F.col("page"))
    for run in ("first", "first", "second"):
        pg.title_job(reads, documents, sources, path, run, model, ["doc_id", "number"], batch=1, retries=1).collect()
    titles = cache.read_cache(spark, path, pg.TITLES, pg.PAGE)
    left = pg.pending_titles(reads, documents, titles).select("doc", "page", F.lit(None).cast("string").alias("title"), F.lit("asked again").alias("state"))
    raw = spark.read.parquet(path).select("doc", "page", "title", F.lit("added").alias("state"))  # as it lies there, repeats and all
    return raw.unionByName(left)


_RAW_TITLE = """case page_id % 6 when 0 then concat('## "', title, '" ', chr(10), 'x') when 1 then title when 2 then '없음' when 3 then repeat(title, 9)
  when 4 then concat('** ', title, ' `') else concat(' ', chr(9)) end"""


def _sql_clean(x: str) -> str:
    line = strip(f"trim({strip(f'split_part({x}, {NL}, 1)')}, '#*\"''` ')")
    return f"case when {line} = '' or contains({line}, '없음') or length({line}) > 80 then '' else {line} end"


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = view(spark, sf_dir, "web_v")
    raw = (
        F.when(F.col("page_id") % 6 == 0, F.concat(F.lit('## "'), "title", F.lit('" \nx'))).when(F.col("page_id") % 6 == 1, F.col("title"))
        .when(F.col("page_id") % 6 == 2, "없음").when(F.col("page_id") % 6 == 3, F.repeat("title", F.lit(9)))
        .when(F.col("page_id") % 6 == 4, F.concat(F.lit("** "), "title", F.lit(" `"))).otherwise(" \t")
    )
    return web.withColumn("raw", raw)


@query(f"with w as (select page_id, {_RAW_TITLE} as raw from web_v) select page_id, {_sql_clean('raw')} as title from w")
def q2_07_clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir).select("page_id", tx.clean_title(F.col("raw")).alias("title"))


_LINE = strip(f"trim({strip(f'''coalesce(list_filter(string_split_regex(text, '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]'), lambda l: {strip('l')} <> '')[1], '')''')}, '#* ')")
_HEADING = f"""w as (select page_id, doc, page, text, {strip('title')} as own, {_LINE} as line from (select page_id, doc, page, text, case when page_id % 7 = 3 then '' else title end title from web_v where page_id % 5 <> 4)),
heads as (select doc, page, case when own = '' or contains({squash('doc')}, {squash('own')}) then ''
  when length(line) <= 120 and not starts_with(line, '|') and contains({squash('line')}, {squash('own')}) then line else own end heading from w)"""


def _headed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Web pages, and the headings (doc, page, heading) of those that have a title. An address may repeat: each of its pages
    has a heading of its own title and text, told apart by page_id."""
    web = view(spark, sf_dir, "web_v")
    titled = web.where("page_id % 5 <> 4")
    titles = titled.select("doc", "page", "page_id", F.when(F.col("page_id") % 7 == 3, "").otherwise(F.col("title")).alias("title"))
    return web, pg.page_headings(titled, titles, on=("doc", "page", "page_id")).select("doc", "page", "heading")


@query(f"with {_HEADING} select web_v.doc, coalesce(heading, '') as heading from web_v left join heads using (doc, page)")
def q2_08_page_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    web, heads = _headed(spark, sf_dir)
    return web.select("doc", "page").join(heads, ["doc", "page"], "left").select("doc", F.coalesce("heading", F.lit("")).alias("heading"))


def _sql_blocks(source: str, text: str, key: str, size: int = 500, min_len: int = 40) -> str:
    """Common table expressions ending in `cut` (key, piece, text)."""
    last = strip("string_split(acc.buf, chr(10))[-1]")
    return f"""bl as (select {key}, list_filter(list_transform(string_split({text}, concat({NL}, {NL})), lambda x: {strip('x')}), lambda x: x <> '') blocks from {source}),
fold as (select {key}, list_reduce(blocks, lambda acc, x: case when acc.buf <> '' and length(acc.buf) + length(x) > {size}
    then {{'out': list_append(acc.out, acc.buf), 'buf': case when contains(x, '|') and contains(x, {NL}) and substring({last}, 1, 100) <> '' then concat(substring({last}, 1, 100), {NL}, x) else x end}}
    else {{'out': acc.out, 'buf': case when acc.buf = '' then x else concat(acc.buf, {NL}, {NL}, x) end}} end, {{'out': []::varchar[], 'buf': ''}}) f from bl),
kept as (select {key}, list_filter(list_append(f.out, f.buf), lambda x: length(x) >= {min_len}) ps from fold),
cut as (select {key}, unnest(ps) as text, generate_subscripts(ps, 1) - 1 as piece from kept)"""


@query(f"""with {_HEADING}, {_sql_blocks('web_v', 'text', 'doc, page')}
select doc, piece, case when coalesce(heading, '') <> '' and not contains({squash('text')}, {squash('heading')}) then concat('## ', heading, {NL}, text) else text end as text
from cut left join heads using (doc, page)
where not (coalesce(heading, '') <> '' and not contains(text, {NL}) and contains({squash('text')}, {squash('heading')}))""")
def q2_09_with_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    web, heads = _headed(spark, sf_dir)
    chunks = ck.chunk_blocks(web.select("doc", "page", "text"))
    return pg.with_heading(chunks, heads).select("doc", F.col("piece").cast("long").alias("piece"), "text")


@query(f"select doc_id, concat(doc, ' ', page, '쪽', {NL}, raw_text) as search_text from pages_v")
def q2_10_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages_v").select("doc_id", pg.search_text(F.col("doc"), F.col("page"), F.col("raw_text")).alias("search_text"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("digest"))


@query("""select arg_min(concat(source, '/', doc_id), string_split(concat(source, '/', doc_id), '/')) as path, md5(text) as digest
from documents group by md5(text)""".replace("select arg_min", "with x as (select 1) select arg_min"))
def q2_11_dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.dedup_documents(_files(spark, sf_dir))


@query("with x as (select 1) select count(distinct md5(text)) as kept, count(*) - count(distinct md5(text)) as dup from documents")
def q2_11_count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.count_documents(_files(spark, sf_dir))


def _sql_fixed(source: str, text: str, key: str, size: int = 500, min_len: int = 50) -> str:
    return f"""win as (select {key}, {text} t, unnest(generate_series(0, length({text}) - 1, {size - size // 5})) i from {source}),
fixed as (select {key}, row_number() over (partition by {key} order by i) - 1 as piece, substring(t, i + 1, {size}) as text
  from win where length(substring(t, i + 1, {size})) >= {min_len})"""


@query(f"""with n as (select doc_id, {norm('raw_text')} text from pages_v), {_sql_fixed('n', 'text', 'doc_id')} select * from fixed""")
def q3_1_chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "pages_v").select("doc_id", tx.normalize_ws(F.col("raw_text")).alias("text"))
    return ck.chunk_fixed(rows).withColumn("piece", F.col("piece").cast("long"))


@query(f"with {_sql_blocks('pages_v', 'block_text', 'doc_id')} select doc_id, piece, text from cut")
def q3_2_chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "pages_v").select("doc_id", F.col("block_text").alias("text"))
    return ck.chunk_blocks(rows).withColumn("piece", F.col("piece").cast("long"))


def _headings(resolved: DataFrame) -> DataFrame:
    """A heading for a third of the pages."""
    return resolved.where("page % 3 = 0").select("doc", "page", F.concat(F.lit("Part "), F.col("page").cast("string")).alias("heading"))


_CHUNKED = f"""{_RESOLVED},
plain as (select doc, page, text from resolved where how in ('text', 'fallback')), {_sql_fixed('plain', 'text', 'doc, page', 500, 40)},
read as (select doc, page, text from resolved where how in ('vlm', 'cache')), {_sql_blocks('read', 'text', 'doc, page')},
hd as (select doc, page, concat('Part ', page) heading from resolved where page % 3 = 0),
topped as (select doc, page, piece, case when heading is not null and not contains({squash('text')}, {squash('heading')}) then concat('## ', heading, {NL}, text) else text end as text
  from cut left join hd using (doc, page) where not (heading is not null and not contains(text, {NL}) and contains({squash('text')}, {squash('heading')}))),
chunked as (select doc, page, piece, text from fixed union all select doc, page, piece, text from topped)"""


@query(f"{_CHUNKED} select * from chunked")
def q3_3_chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = pg.resolve_pages(*_reads(spark, sf_dir))
    return ck.chunk_pages(resolved, _headings(resolved)).select("doc", "page", F.col("piece").cast("long").alias("piece"), "text")


@query(f"""with n as (select doc, page, {norm('raw_text')} text from pages_v), {_sql_fixed('n', 'text', 'doc, page')}
select row_number() over (order by doc, page, piece) - 1 as chunk_id, doc, page, piece, text from fixed""")
def q3_4_build_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.build_baseline(view(spark, sf_dir, "pages_v")).select("chunk_id", "doc", "page", F.col("piece").cast("long").alias("piece"), "text")


def _sql_lang(source: str, text: str) -> str:
    return f"""cnt as (select doc, sum(len(regexp_extract_all({text}, '[가-힣]'))) ko, sum(len(regexp_extract_all({text}, '[A-Za-z]'))) en from {source} where page <= 6 group by 1),
langs as (select doc, case when ko + en < 50 then 'mixed' when ko / (ko + en) > 0.5 then 'ko' when ko / (ko + en) < 0.12 then 'en' else 'mixed' end lang from cnt)"""


@query(f"""{_CHUNKED}, {_sql_lang('resolved', 'text')}
select row_number() over (order by doc, page, piece) - 1 as chunk_id, doc, page, piece, md5(text) as digest, '미상' as date, coalesce(lang, 'mixed') as lang,
  md5(concat(doc, ' ', page, '쪽', {NL}, text)) as search_digest from chunked left join langs using (doc)""")
def q3_4_build_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, cached, new = _reads(spark, sf_dir)
    titles = _headings(pages).withColumnRenamed("heading", "title")
    built = ck.build_improved(pages, cached, new, titles)
    return built.select("chunk_id", "doc", "page", F.col("piece").cast("long").alias("piece"), F.md5("text").alias("digest"), "date", "lang", F.md5("search_text").alias("search_digest"))


def _ymd(x: str, pattern: str, out: str) -> str:
    return f"case when regexp_matches({x}, '{pattern}') then {out} end"


_P8 = r"(?:^|[^0-9])(20\d{2})(\d{2})(\d{2})(?:[^0-9]|$)"
_P6 = tx.NAME_6
_PD = r"(?:^|[^0-9])(\d{2})\.(\d{2})\.(\d{2})(?:[^0-9]|$)"
_PY = tx.NAME_YEAR


def _g(x: str, p: str, k: int) -> str:
    return f"nullif(regexp_extract({x}, '{p}', {k}), '')"


def _range(x: str, p: str) -> str:
    return f"{_g(x, p, 2)}::int between 1 and 12 and {_g(x, p, 3)}::int between 1 and 31"


_NAME = f"""coalesce({_g('doc', _P8, 1)} || '-' || {_g('doc', _P8, 2)} || '-' || {_g('doc', _P8, 3)},
  case when {_range('doc', _P6)} then (case when {_g('doc', _P6, 1)}::int < 70 then '20' else '19' end) || {_g('doc', _P6, 1)} || '-' || {_g('doc', _P6, 2)} || '-' || {_g('doc', _P6, 3)} end,
  case when {_range('doc', _PD)} then '20' || {_g('doc', _PD, 1)} || '-' || {_g('doc', _PD, 2)} || '-' || {_g('doc', _PD, 3)} end,
  {_g('doc', _PY, 1)})"""
_T3 = tx.TEXT_DAY
_T2 = tx.TEXT_MONTH
_TEXT = f"""coalesce({_g('first_page', _T3, 1)} || '-' || lpad({_g('first_page', _T3, 2)}::int::varchar, 2, '0') || '-' || lpad({_g('first_page', _T3, 3)}::int::varchar, 2, '0'),
  {_g('first_page', _T2, 1)} || '-' || lpad({_g('first_page', _T2, 2)}::int::varchar, 2, '0'))"""
_PC = tx.FILE_DAY
_PDF = f"{_g('created', _PC, 1)} || '-' || {_g('created', _PC, 2)} || '-' || {_g('created', _PC, 3)}"


@query(f"select o_orderkey, {_NAME} as date from names_v")
def q4_1_date_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "names_v").select("o_orderkey", tx.date_from_name(F.col("doc")).alias("date"))


@query(f"select o_orderkey, {_TEXT} as date from names_v")
def q4_2_date_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "names_v").select("o_orderkey", tx.date_from_text(F.col("first_page")).alias("date"))


@query(f"select o_orderkey, {_PDF} as date from names_v")
def q4_3_date_from_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "names_v").select("o_orderkey", tx.date_from_pdf(F.create_map(F.lit("modDate"), "created")).alias("date"))


@query(f"select o_orderkey, coalesce({_NAME}, {_TEXT}, {_PDF}, '미상') as date from names_v")
def q4_4_doc_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(F.lit("creationDate"), "created")
    return view(spark, sf_dir, "names_v").select("o_orderkey", tx.doc_date(F.col("doc"), F.col("first_page"), meta).alias("date"))


@query(f"with {_sql_lang('pages_v', 'raw_text')} select doc, lang from langs")
def q4_5_doc_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docmeta.doc_langs(view(spark, sf_dir, "pages_v").withColumnRenamed("raw_text", "text"))


@query("select qid, case when regexp_matches(question, '[가-힣]') then 'ko' else 'en' end as lang from questions_v")
def q4_6_query_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "questions_v").select("qid", tx.query_lang(F.col("question")).alias("lang"))


@query(f"""with n as (select doc, page, {norm('raw_text')} text from pages_v), {_sql_fixed('n', 'text', 'doc, page')}, {_sql_lang('n', 'text')}
select doc, page, piece, '미상' as date, lang from fixed join langs using (doc)""")
def q4_7_attach_doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages_v").select("doc", "page", tx.normalize_ws(F.col("raw_text")).alias("text"))
    rows = docmeta.attach_doc_meta(ck.chunk_fixed(pages), docmeta.doc_meta(pages))
    return rows.select("doc", "page", F.col("piece").cast("long").alias("piece"), "date", "lang")


@query(f"""{_CHUNKED} select concat('pages_', how) as kind, count(*)::double as value from resolved group by 1
union all select 'chunks', count(*)::double from chunked union all select 'median_chars', quantile_cont(length(text), 0.5)::double from chunked""")
def q6_7_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.metrics import index_stats

    resolved = pg.resolve_pages(*_reads(spark, sf_dir))
    return index_stats(resolved, ck.chunk_pages(resolved, _headings(resolved)))
