"""The opN_ queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_pairs, chat, lsh_forest, packing, prefix_trie, quality, sentence_spans, sp_codec, structure_repair, suffix_dedup, token_counts, topk, toxicity
from lectern.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sp_codec.codec_digest(sp_codec.decode_documents(sp_codec.encode_documents(docs)))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, F.col("vec_id") % 100 == 0)


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.digest(sentence_spans.span_dedup(table(spark, sf_dir, "documents")))


def op5_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), size=3, num=85, den=100)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), own.alias("text"))
    back = chat.read_back(chat.format_paths(chat.linear_tree(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_byte_pair_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_pairs.codec_digest(byte_pairs.decode_documents(byte_pairs.encode_documents(docs)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.rebuilt_conversations(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(rebuilt).drop("turn_id")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return structure_repair.repair_report(structure_repair.damaged(rows), rows)


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, max(list_inner_product(q.v, c.v))::bigint score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0 group by q.vec_id, c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 10
"""

_SAFE = r"replace(replace(replace(replace(replace({}, '\', '\\'), '<|', '<\|'), 'INST]', '\INST]'), 's>', '\s>'), 'SYS>>', '\SYS>>')"
OP10_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations where conv_id is not null
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g as (select conv_id, count(*) n_turns,
  string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text) said,
  coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') lost,
  sum(12 + length({_SAFE.format("role")}) + 1 + length({_SAFE.format("text")}) + 11)::bigint formatted_chars
  from rows group by conv_id)
select conv_id, n_turns, sha256(said) turns_sha256, length(lost) loss_chars, sha256(lost) loss_sha256, formatted_chars from g
"""


_NL, _DOCS = "chr(10)", "docs as (select doc_id, coalesce(text, '') t from documents where doc_id is not null)"
_CUT, _BREAK = "t", "chr(57344)"  # a private character, which the tables do not hold
for _end in [_NL, *(f"'{mark} '" for mark in sentence_spans.MARKS), *(f"'{mark}'" for mark in sentence_spans.WIDE_MARKS)]:
    _CUT = f"replace({_CUT}, {_end}, concat({_end}, {_BREAK}))"
OP4_SQL = f"""
with {_DOCS},
split as (select doc_id, string_split({_CUT}, {_BREAK}) ps from docs),
parts as (select doc_id, unnest(ps) part, generate_subscripts(ps, 1) k from split),
placed as (select *, trim(part, concat(' ', chr(9), chr(10), chr(13))) sent from parts),
sents as (select doc_id, k, sent, row_number() over w pos, lead(sent) over w is null or not regexp_matches(sent, '[,;:，；：、]$') is_end,
  length(sent) - length(replace(sent, ' ', '')) + 1 + length(regexp_replace(sent, '[^぀-ヿ㐀-鿿]', '', 'g')) // 2 n from placed where sent <> '' window w as (partition by doc_id order by k)),
runs as (select doc_id, pos, concat(sent, {_NL}, lead(sent) over w, {_NL}, lead(sent, 2) over w) run, n + lead(n) over w + lead(n, 2) over w n from sents window w as (partition by doc_id order by pos)),
later as (select doc_id, pos from (select *, row_number() over (partition by run order by doc_id, pos) rn from runs where n >= 8) where rn > 1),
gone as (select distinct doc_id, pos + j as pos from later, (values (0), (1), (2)) v(j)),
marked as (select p.doc_id, p.k, part, s.pos is not null is_unit, is_end, g.pos is not null cut
  from placed p left join sents s using (doc_id, k) left join gone g on g.doc_id = p.doc_id and g.pos = s.pos)
select doc_id, count(*) filter (is_end) as n_sentences, count(*) filter (is_unit) as n_clauses, count(*) filter (cut) as n_removed,
  sha256(coalesce(string_agg(part, '' order by k) filter (not cut), '')) as kept_sha256
from marked group by doc_id
"""
_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
OP5_SQL = f"""
with recursive docs as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents where doc_id is not null),
words as (select doc_id, {_WORDS} w from docs),
sh as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) i from words where len(w) > 0)),
sizes as (select doc_id, count(*) n from sh group by 1), sized as (select * from sh join sizes using (doc_id)),
links as (select a.doc_id a, b.doc_id b from sized a join sized b on a.s = b.s and a.doc_id < b.doc_id and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways as (select a, b from links union select b, a from links),
reach as (select doc_id v, doc_id c from docs union select ways.b, reach.c from reach join ways on ways.a = reach.v)
select doc_id, coalesce(n, 0) as n_shingles, min(c) as component_id, min(c) = doc_id as kept from docs left join sizes using (doc_id) join reach on v = doc_id group by doc_id, n
"""
OP6_SQL = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) x from documents where doc_id is not null),
w as (select doc_id, i, substring(x, 2 * i - 1, 100) s from (select doc_id, x, unnest(generate_series(1, length(x) // 2 - 49)) i from h)),
f as (select s, min(doc_id) d from w group by s having count(*) > 1),
c as (select w.doc_id, i from w join f using (s) where f.d < w.doc_id),
m as (select *, case when i > 50 + lag(i) over o then 1 else 0 end fresh from c window o as (partition by doc_id order by i)),
g as (select *, sum(fresh) over (partition by doc_id order by i) grp from m),
spans as (select doc_id, min(i) lo, max(i) + 49 hi from g group by doc_id, grp),
kept as (select doc_id, string_agg(seg, '' order by lo) k from (
  select s.doc_id, lo, substring(x, 2 * coalesce(lag(hi) over (partition by s.doc_id order by lo), 0) + 1, 2 * (lo - 1 - coalesce(lag(hi) over (partition by s.doc_id order by lo), 0))) seg from spans s join h using (doc_id)
  union all select doc_id, 1000000000000, substring(x, 2 * last + 1) from (select doc_id, max(hi) last from spans group by 1) join h using (doc_id)) group by doc_id)
select h.doc_id, length(x) // 2 as n_bytes, coalesce(r, 0)::bigint as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(coalesce(k, x))) as kept_sha256
from h left join (select doc_id, sum(hi - lo + 1) r, count(*) n from spans group by 1) using (doc_id) left join kept using (doc_id)
"""
OP8_SQL = f"""
with {_DOCS}, words as (select doc_id, {_WORDS} w from docs),
eight as (select doc_id, w, unnest(generate_series(1, len(w) - 7)) i from words),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + 7], ' ')) c from eight) where c > 1),
cover as (select doc_id, count(distinct i + j) n from again, (select unnest(generate_series(0, 7)) j) group by 1),
long as (select doc_id, max(c) c from (select doc_id, count(*) c from (select doc_id, w, unnest(generate_series(1, len(w) - 100)) i from words) group by doc_id, array_to_string(w[i:i + 100], ' ')) group by 1),
lines as (select doc_id, count(*) - count(distinct l) n from (select doc_id, unnest(string_split(t, {_NL})) l from docs) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by 1),
b as (select d.doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
  coalesce(lines.n, 0) n_dup_lines, coalesce(cover.n, 0) n_repeat_words, coalesce(long.c, 0) > 1 too_long
  from docs d join words using (doc_id) left join lines using (doc_id) left join cover using (doc_id) left join long using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 20 * n_words or too_long) as kept from b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_sentencepiece_codec": op2_sentencepiece_codec,
        "op3_exact_top_k": op3_exact_top_k,
        "op4_sentence_spans": op4_sentence_spans,
        "op5_minhash_lsh_forest": op5_minhash_lsh_forest,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_quality_rules": op8_quality_rules,
        "op9_toxicity": op9_toxicity,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_byte_pair_codec": op11_byte_pair_codec,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_structure_repair": op13_structure_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_top_k": OP3_SQL,
        "op4_sentence_spans": OP4_SQL,
        "op5_minhash_lsh_forest": OP5_SQL,
        "op6_suffix_array_dedup": OP6_SQL,
        "op8_quality_rules": OP8_SQL,
        "op10_chat_formatting": OP10_SQL,
    }
