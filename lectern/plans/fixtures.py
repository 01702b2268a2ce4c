"""Views over the given tables that stand in for pages, questions, hits and so on; one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "pages_v": """
        select doc_id, source as doc, cast(floor(doc_id/20) as int)+1 as page,
          case (doc_id%20)%3 when 0 then translate(text,'etaoinsrlu','에타아오이나사라루우')
                             when 1 then replace(text,'e','에') else text end as raw_text,
          replace(text, concat('.',chr(10)), concat('.',chr(10),chr(10))) as block_text
        from {documents}""",
    "questions_v": """
        select item_id as qid, concat('c',cast(item_id%4 as varchar(10))) as category,
          case when item_id%3=0 then replace(text,'e','에') else text end as question from {benchmark}""",
    "chunks_v": """
        select doc_id as chunk_id, text from {documents}""",
    "index_v": """
        select e.vec_id as chunk_id, d.source as doc, cast(floor(d.doc_id/20) as int)+1 as page, e.embedding, d.text,
          case e.vec_id%4 when 0 then 'ko' when 1 then 'en' when 2 then 'mixed' end as lang,
          case e.vec_id%3 when 0 then '미상' when 1 then '2024-01-02' else '2023' end as date
        from {embeddings} e join {documents} d on d.doc_id = e.vec_id""",
    "asked_v": """
        select q.item_id as qid, case when q.item_id%3=0 then replace(q.text,'e','에') else q.text end as question, e.embedding
        from {benchmark} q join {embeddings} e on e.vec_id = q.item_id""",
    "hits_v": """
        select q.item_id as qid, r.rank, d.doc_id as chunk_id, d.source as doc,
          cast(floor(d.doc_id/20) as int)+1 as page, cast(1.0 as double)/(60+r.rank) as score, d.text,
          case when q.item_id%3=0 or r.rank%4=0 then '미상' when q.item_id%3=1 then '2023' else concat('202',cast(r.rank%3 as varchar(3))) end as date
        from {benchmark} q cross join (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) r(rank)
        cross join (select max(doc_id)+1 as n from {documents}) s
        join {documents} d on d.doc_id = (q.item_id*7919+(r.rank%7)*104729)%s.n""",
    "gold_v": """
        select distinct q.item_id as qid, d.source as doc, cast(floor(d.doc_id/20) as int)+1 as page
        from {benchmark} q cross join (values (2),(5),(9)) g(j)
        cross join (select max(doc_id)+1 as n from {documents}) s
        join {documents} d on d.doc_id = (q.item_id*7919+g.j*104729)%s.n""",
    "answers_v": """
        select concat(cast(conv_id as varchar(20)),':',cast(turn as varchar(20))) as aid, (conv_id*7+turn)%s.n as qid,
          concat(text,' [',cast((conv_id+turn)%14 as varchar(10)),', 2] x [3] [2,1] [x]') as answer
        from {conversations} cross join (select max(item_id)+1 as n from {benchmark}) s where role='assistant'""",
    "turns_v": """
        select conv_id, turn, question, answer from (
          select conv_id, turn, role, text as question,
            lead(role) over (partition by conv_id order by turn) as nr,
            concat(lead(text) over (partition by conv_id order by turn), ' [1, 2] end [3]') as answer from {conversations}) t
        where role='user' and nr='assistant'""",
    "judge_v": """
        select concat('A',cast(doc_id as varchar(20))) as id, cast(doc_id%9 as varchar(5)) as config, cast(doc_id%40 as int) as no,
          cast(quality+1-toxic as int) as correctness, cast(case when doc_id%5=0 then null else quality*2 end as int) as faithfulness
        from {labels}""",
    "judged_questions_v": """
        select cast(item_id as int) as no, concat('c',cast(item_id%4 as varchar(10))) as category,
          case when item_id%5=0 then '답을 찾을 수 없음' else text end as gold_answer,
          case item_id%4 when 0 then 'all' when 1 then 'some' when 2 then 'none' end as coverage from {benchmark}""",
    "judged_answers_v": """
        select cast(c.n as varchar(5)) as config, cast(q.item_id as int) as no,
          case when (q.item_id+c.n)%3=0 then '찾을 수 없습니다' else 'found' end as answer
        from {benchmark} q cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8)) c(n)""",
    "names_v": """
        select o_orderkey, case o_orderkey%7
           when 0 then concat('manual_', y, m, d)
           when 1 then concat(substring(y,3,2), m, d, '_manual')
           when 2 then concat('manual(', substring(y,3,2), '.', m, '.', d, ')')
           when 3 then concat(y, '년도 manual')
           when 4 then concat('UDD', m, d, '0')
           when 5 then concat('991399_manual ', y, ' 년')
           else concat('manual ', m) end as doc,
         case o_orderkey%3
           when 0 then concat('head ', y, '. ', cast(cast(m as int) as varchar(4)), '. ', cast(cast(d as int) as varchar(4)), '. team')
           when 1 then concat('head ', y, '년 ', cast(cast(m as int) as varchar(4)), '월')
           else 'no date' end as first_page,
         case when o_orderkey%4=0 then concat('D:', y, m, d) end as created
        from (select o_orderkey, substring(cast(o_orderdate as varchar(30)),1,4) y,
                substring(cast(o_orderdate as varchar(30)),6,2) m,
                substring(cast(o_orderdate as varchar(30)),9,2) d from {orders}) o""",
    "web_v": """
        select page_id, url as doc, 1 as page, regexp_extract(html,'<title>(.*?)</title>',1) as title,
          concat(case when page_id%2=0 then concat('# ', regexp_extract(html,'<h1>(.*?)</h1>',1), chr(10), chr(10)) else '' end,
            regexp_replace(regexp_replace(regexp_extract(html,'</h1>([^^]*)',1), '<[^>]*>', '', 'g'), '[.] ', concat('.',chr(10),chr(10)), 'g')) as text
        from {pages}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    if name == "web_v":  # Spark replaces all matches without a flag
        sql = sql.replace(", 'g')", ")")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """The query with the views that it names, and those that they need, as common table expressions."""
    ctes = [f"{n} as ({v.format(**{t: t for t in TABLES})})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    sql = sql.strip()
    if sql.startswith("with "):
        return "with " + ",\n".join([*ctes, sql[5:]])
    return "with " + ",\n".join(ctes) + "\n" + sql
