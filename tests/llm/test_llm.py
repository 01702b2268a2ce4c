"""The training-data operators on small fixtures, against brute force, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, components, lsh_forest, packing, quality, queries, sentence_spans, sp_codec, suffix_dedup, token_counts, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and in reading river stone moves slowly under a bright morning sky while people watch boats drift past old bridges".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


def corpus(seed=1, n=40):
    """Texts with exact and near copies, repeats, odd characters, an empty and a null text, and a long one."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 160)) for _ in range(n)]
    passage = prose(random.Random(9), 60)
    texts = [*base, base[0], base[1], base[1]]
    for k in range(8):
        words = base[2 + k % 3].split(" ")
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [base[5] + "\n" + passage + "\n" + base[6], base[7] + "\n" + passage, "", None, "one", "two words", "é😀 ß　x  y\t\n z", "same same " * 40, prose(rng, 6000)]
    return list(enumerate(texts))


def table(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOC)
    for name in ("h", "bucket", "component_id", "kept", "score", "length", "rank", "file", "_m", "quality", "batch") if clash else ():
        df = df.withColumn(name, F.lit("clash"))  # further columns, with names that the operators use inside
    return df.repartition(3)


EMPTY: list = []


def ids_of(text):
    return np.frombuffer(bpe.byte_bpe(special=True).encode_bytes(text or ""), "<u4").tolist()


def test_bpe_is_that_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t in corpus()] + ["a  b", "a \n b", "  lead", "trail  ", "x \n", "it's we'll", "a  b", "1 22 333", " ", "\n"]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(bpe.byte_bpe().encode_bytes(t), "<u4").tolist() == want
    for t in [*texts, "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "x<|endoftext", "a<|endoftext|>  b \n"]:
        assert np.frombuffer(bpe.byte_bpe(special=True).encode_bytes(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("special", [False, True])
def test_bpe_of_new_words_costs_what_the_library_does(special):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdeinorst", k=rng.randint(4, 12))) for _ in range(200_000))
    plain, own = [], []
    for _ in range(3):
        codec = bpe.ByteBPE(special=special)  # to which each word is new
        start = time.process_time()
        want = codec.encoding.encode_ordinary(text)
        middle = time.process_time()
        got = codec.encode_bytes(text)
        plain.append(middle - start)
        own.append(time.process_time() - middle)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert min(own) < 2 * min(plain)


def test_bpe_of_long_runs_of_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run = " \n\t\u3000" * 300_000
    for t in (run, run + "x", "it's" + run + " x", "a " + run + "<|endoftext|>" + run + "é", " " * 1_200_000 + "\x1c b"):
        assert np.frombuffer(bpe.byte_bpe(special=True).encode_bytes(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    t = "it's" + run + " x"
    assert np.frombuffer(bpe.byte_bpe(width=2).encode_bytes(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_token_counts(spark, block):
    rows = corpus()
    got = token_counts.token_counts(table(spark, rows), block_tokens=block).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(ids_of(t)) for i, t in rows} and len(got) == len(rows)
    assert token_counts.token_counts(table(spark, EMPTY)).count() == 0


def test_separator_scan_of_binary_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 5, n).astype("<u2") for n in (0, 1, 50, 400)]
    for k, x in enumerate(streams):
        (tmp_path / f"{k}.bin").write_bytes(x.tobytes())
    blocks = token_counts.read_token_files(spark, str(tmp_path), 2, 16)
    names = {r["file"]: r["path"] for r in blocks.select("file", "path").distinct().collect()}
    got = sorted((int(names[r["file"]][-5]), r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in token_counts.separator_scan(blocks, 4).collect())
    want = []
    for k, x in enumerate(streams):
        start, n = 0, 0
        for p, v in enumerate(x.tolist()):
            if v == 4:
                want.append((k, n, start, p - start, True))
                start, n = p + 1, n + 1
        if start < len(x):
            want.append((k, n, start, len(x) - start, False))
    assert got == sorted(want)


def test_sentencepiece_codec(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus()
    got = {r["doc_id"]: r for r in sp_codec.decode_documents(sp_codec.encode_documents(table(spark, rows))).collect()}
    for i, t in rows:
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == sp.encode(t or "") and got[i]["text"] == (t or "")
    assert sp_codec.encode_documents(table(spark, EMPTY)).count() == 0


def test_long_words_are_encoded_as_the_library_does():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeinorst", k=n)) for n in (49, 300, 5000)] + ["".join(rng.choices("的一是不了人我在有他é😀", k=3000)), "a" * 3000, "".join(rng.choices(["ing", "the", "ation", "Q", "9"], k=900))]
    codec = sp_codec.encoder("piece_bpe_32k.model")
    for w in words:
        assert np.frombuffer(codec.encode([w])[0], "<u4").tolist() == sp.encode(w)
    start = time.time()
    long = "".join(rng.choices("abcdeinorst的一", k=1_000_000))
    assert codec.model.decode(np.frombuffer(codec.encode([long])[0], "<u4")) == long and time.time() - start < 120


@pytest.mark.parametrize("unigram", [False, True])
def test_words_together_and_few_words_get_the_same_ids(unigram):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model, rng = sp_codec.PieceModel(unigram=unigram), random.Random(5)
    alphabets = ["abcdeinorst", "▁thein", "的一是不了人我在有他é😀\ud7ff", ["ing", "the", "ation", "Q", "9", "한"]]
    words = ["".join(rng.choices(rng.choice(alphabets), k=n)) for n in [*range(1, 140), 400, 999] for _ in range(3)]
    by_class = collections.defaultdict(list)
    for w in words:
        by_class[sp_codec.length_class(len(w))].append(w)
    assert all(size == len(w) for size, ws in by_class.items() if size < 32 for w in ws)
    assert all(len(w) <= size <= len(w) * 17 / 16 for size, ws in by_class.items() for w in ws)
    together = {w: ids for ws in by_class.values() for w, ids in zip(ws, model.encode_words(ws), strict=True)}
    assert model.encode_few(words) == [together[w] for w in words] == [model.encode_few([w])[0] for w in words]
    if not unigram:
        texts = [w.replace("▁", " ").strip() for w in words]
        assert [np.frombuffer(x, "<u4").tolist() for x in sp_codec.Encoder().encode(texts)] == sp.encode(texts)


def test_many_words_of_sixty_letters_advance_together():
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdeinorst", k=rng.randint(55, 65))) for _ in range(4000))
    codec = sp_codec.Encoder()
    start = time.time()
    ids = codec.encode([text])[0]
    assert time.time() - start < 1e-5 * len(text) and codec.model.decode(np.frombuffer(ids, "<u4")) == text


def test_a_long_text_of_one_word_is_judged_in_bounded_memory():
    got = quality.measure(["same " * 1_000_000])[0]
    assert got[0] == got[4] == 1_000_000 and got[5] == 999_999


def test_unigram_viterbi_finds_the_best_sum():
    model = sp_codec.PieceModel(unigram=True)
    score = {p: model.score[k] for _, ks, _ in model.keys.values() for k in ks.tolist() for p in [model.table[k].decode().replace(" ", "▁")]}
    for word in ("▁there", "▁abcdefgh", "▁internation"):
        best = [0.0] + [-math.inf] * len(word)
        for e in range(1, len(word) + 1):
            best[e] = max(best[s] + score.get(word[s:e], -math.inf) for s in range(e))
        assert abs(sum(model.score[k] for k in np.frombuffer(model.encode_words([word])[0], "<u4").tolist()) - best[-1]) < 1e-6


def test_exact_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [round(rng.uniform(-1, 1), 3) for _ in range(6)]) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (200, rows[5][1]), (70, None), (71, [float("nan")] * 6), (72, [None] * 6), (73, [float("inf")] * 6), (74, [0.5]), (74, [0.5]), (75, [])]
    rows += [(20, rows[7][1]), (33, rows[9][1]), (200, [2.0])]  # other vectors under ids that queries and candidates have
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("v", F.lit("clash"))
    vectors = topk.integer_vectors(df)
    for groups, per in ((24, 4096), (3, 1)):
        got = topk.exact_top_k(vectors, F.col("vec_id") % 20 == 0, 10, 10, per, groups).collect()
        usable = collections.defaultdict(list)
        for i, v in rows:
            if v is not None and all(x is not None and math.isfinite(x) for x in v):
                usable[i].append([math.floor(1024 * x) for x in v])
        want = {}
        for q in (i for i in usable if i % 20 == 0):
            scored = sorted((-max(sum(a * b for a, b in zip(u, v)) for u in usable[q] for v in vs), i) for i, vs in usable.items() if i != q)[:10]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scored)}
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
        assert topk.exact_top_k(vectors, F.col("vec_id") % 20 == 0, 10, min_groups=1, cell_bytes=8 * 6 * 9).orderBy("query_id", "rank").collect() == sorted(got)
    assert topk.exact_top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_cells_of_wide_vectors_are_bounded_in_bytes(spark):
    """At a width of 1,024, cells hold 8,192 rows: their memory is a small multiple of cell_bytes."""
    rng, n = np.random.default_rng(7), (1 << 26) // (8 * 1024)
    pdf = pd.DataFrame({"vec_id": np.arange(n + 50), "v": list(rng.integers(-1024, 1024, (n + 50, 1024))), "is_query": np.arange(n + 50) >= n})
    tracemalloc.start()
    got = topk._cell(pdf, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 500 and peak < 4 << 26
    wide = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda d: F.pmod(F.xxhash64("id", d), F.lit(64)) / 64.0).alias("embedding"))
    narrow = topk.exact_top_k(topk.integer_vectors(wide), F.col("vec_id") % 100 == 0, cell_bytes=1 << 20)
    assert sorted(narrow.collect()) == sorted(topk.exact_top_k(topk.integer_vectors(wide), F.col("vec_id") % 100 == 0, min_groups=2).collect())


def span_brute_force(rows, span=3, min_words=8):
    """Spans over units found by a regular expression, in plain dictionaries."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        parts = re.findall(r"(?s).*?(?:\n|[.!?,;:] |[。！？，；：、])|.+\Z", text or "")
        at = [k for k, p in enumerate(parts) if p.strip(" \t\r\n")]
        found = [parts[k].strip(" \t\r\n") for k in at]
        words = [s.count(" ") + 1 + sum("\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" for c in s) // 2 for s in found]
        gone = set()
        for k in range(len(found) - span + 1):
            run = tuple(found[k : k + span])
            if sum(words[k : k + span]) >= min_words:
                gone |= set(at[k : k + span]) if run in seen else set()
                seen.add(run)
        kept = "".join(p for k, p in enumerate(parts) if k not in gone)
        ends = sum(s[-1] not in ",;:，；：、" for s in found[:-1]) + (len(found) > 0)
        out[doc_id] = (ends, len(found), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_sentence_spans(spark):
    rows = corpus()
    wide = "今日は天気がいいですね。明日も晴れるでしょう、たぶん。散歩に行きませんか？"
    rows += [(9001, wide), (9002, "別の文。" + wide + "終わり、"), (9003, "a, b; c: d. e! f? g"), (9004, ("One two three. Four five, six seven. " * 20000))]
    got = {r["doc_id"]: tuple(r)[1:] for r in sentence_spans.digest(sentence_spans.span_dedup(table(spark, rows))).collect()}
    assert got == span_brute_force(rows) and any(v[2] for v in got.values())
    assert got[9001][:3] == (3, 4, 0) and got[9002][:3] == (5, 6, 4) and got[9003][:3] == (4, 7, 0)
    assert got[0][2] == 0 and sentence_spans.span_dedup(table(spark, EMPTY)).count() == 0
    twice = sentence_spans.digest(sentence_spans.span_dedup(table(spark, rows[:3] * 2))).collect()
    assert len(twice) == 6 and len(set(map(tuple, twice))) == 3


def components_plain(rows, size, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, num):
    rows = corpus()
    got = {r["doc_id"]: tuple(r)[1:] for r in lsh_forest.near_duplicates(table(spark, rows), size, num, 100).collect()}
    assert got == components_plain(rows, size, num, 100)


def test_near_duplicates_in_a_crowd(spark):
    """Many near copies in one region, each with edits of its own: links to the original must be found."""
    rng = random.Random(8)
    base = prose(rng, 300).split(" ")
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(table(spark, rows), 3, 85, 100).collect()}
    want = {i: v[1] for i, v in components_plain(rows, 3, 85, 100).items()}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def edited(rng, words, at):
    words = list(words)
    for k in at:
        words[k] = f"w{rng.randrange(10**9)}"
    return words


def test_near_duplicates_in_a_crowd_of_different_texts(spark):
    """3,000 texts of one template, most alike to none; of the pairs over the threshold, all must be found."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    texts = [edited(rng, base, rng.sample(range(5, 295, 6), 7)) for _ in range(2500)]
    texts += [edited(rng, t, rng.sample(range(5, 295, 6), 6)) for t in texts[:500]]
    rng.shuffle(texts)
    sets = [{tuple(t[k : k + 5]) for k in range(296)} for t in texts]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = [h for h in holders.values() if len(h) > 20]
    held = np.zeros((len(texts), len(common)), np.float32)
    for k, h in enumerate(common):
        held[h, k] = 1
    both = held @ held.T
    for h in holders.values():
        if 1 < len(h) <= 20:
            both[np.ix_(h, h)] += 1
    size = np.array([len(s) for s in sets])
    links = np.argwhere(np.triu(100 * both >= 80 * (size[:, None] + size - both), 1)).tolist()
    root = list(range(len(texts)))
    for a, b in links:  # each component is a base and its copies: few rounds
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert 300 < len(links) < 1000
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(table(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_near_duplicates_joins_groups_in_a_crowd(spark):
    """Groups of near copies in one crowd, of which two at a time are joined by one pair alone."""
    rng = random.Random(7)
    base, texts, places = [f"b{k}" for k in range(300)], [], range(5, 295, 6)
    for _ in range(3):
        first = edited(rng, base, rng.sample(places, 7))
        one = [edited(rng, first, rng.sample(places, 3)) for _ in range(90)]
        second = edited(rng, one[0], rng.sample(places, 6))
        texts += [first, *one, second, *(edited(rng, second, rng.sample(places, 3)) for _ in range(90))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r)[1:] for r in lsh_forest.near_duplicates(table(spark, rows)).collect()}
    want = components_plain(rows, 5, 80, 100)
    assert len({v[1] for v in want.values()}) == 3
    assert got == want


@pytest.mark.parametrize("block", [9, 2048])
def test_near_duplicates_block_against_block(spark, monkeypatch, block):
    """A crowd under the threshold with some pairs over it, and a large joined group: any number of blocks joins the same."""
    monkeypatch.setattr(lsh_forest, "BLOCK_SETS", block)
    rng = random.Random(13)
    base = [f"b{k}" for k in range(60)]
    texts = [[w if rng.random() > 0.06 else f"x{rng.randrange(4)}" for w in base] for _ in range(90)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: set(lsh_forest.shingle_hashes(t, 5).tolist()) for i, t in rows}
    component = {i: 0 if i < 30 else i for i in sets}
    of = lambda links: [min(c[0] for c in components_of(links, component) if i in c[1]) for i in sets]

    def components_of(links, component):
        root = dict(component)
        for a, b in links:
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
        return [(r, {i for i in root if root[i] == r}) for r in set(root.values())]

    alike = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert any(component[a] != component[b] for a, b in alike)
    keys = [7] + list(range(lsh_forest.TREES - 1))
    left = spark.createDataFrame([(7, 0, i, component[i]) for i in sets], "key long, tree int, doc_id long, component long")
    some = spark.createDataFrame([(i, len(x), [k if t == 0 else 100 * t + i for t, k in enumerate(keys)]) for i, x in sets.items()], "doc_id long, n_shingles long, keys array<long>")
    links = [tuple(r) for r in lsh_forest.block_links(left, some, table(spark, rows), 5, 80, 100).collect()]
    assert set(links) <= set(alike)
    assert of(links) == of(alike)


@pytest.mark.parametrize("partitions", [4, 67])
def test_near_duplicates_at_any_number_of_partitions(spark, partitions):
    """Lone pairs and a crowd of copies, by regions and by the prefix filter alone."""
    rng = random.Random(11)
    texts = [[f"a{rng.randrange(10**9)}" for _ in range(60)] for _ in range(120)]
    texts += [edited(rng, t, rng.sample(range(60), 1)) for t in texts[:60]] + [edited(rng, texts[0], rng.sample(range(60), 1)) for _ in range(200)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = components_plain(rows, 5, 80, 100)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for exact in (False, True) if partitions == 4 else (False,):
            assert {r["doc_id"]: tuple(r)[1:] for r in lsh_forest.near_duplicates(table(spark, rows), exact=exact).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_near_duplicates_of_odd_tables(spark):
    assert lsh_forest.near_duplicates(table(spark, EMPTY)).count() == 0
    got = lsh_forest.near_duplicates(table(spark, [(1, None), (2, ""), (3, "a"), (4, "A"), (4, "A")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False)]
    got = lsh_forest.near_duplicates(table(spark, [(1, "a b c"), (2, "d e f"), (2, "a b c"), (3, None), (4, "d e f")])).collect()
    assert len(got) == 5 and len({r["component_id"] for r in got if r["doc_id"] == 2}) == 1  # one text of 2 is compared


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), *((k, k + 1) for k in range(100, 140))]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{k: 100 for k in range(100, 141)}}


def suffix_plain(rows, length=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted(raw):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2, 0])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 5000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(6)
    odd = [(100 + k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for k in range(30)] + [(200, "a" * 500), (201, "a" * 120), (202, "é" * 80), (203, "é" * 80), (203, "é" * 80)]
    rows = corpus() + odd
    got = sorted((r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in suffix_dedup.suffix_dedup(table(spark, rows)).collect())
    assert got == suffix_plain(rows)
    assert suffix_dedup.suffix_dedup(table(spark, EMPTY)).count() == 0


@pytest.mark.parametrize(("n", "letters"), [(1, 1), (2, 2), (60, 1), (3000, 2), (3000, 26), (5000, 250)])
def test_two_stage_order(n, letters):
    data = np.random.default_rng(n).integers(3, 3 + letters, n).astype(np.uint8)
    order, raw = suffix_dedup.two_stage_order(data, 50), data.tobytes()
    keys = [raw[p : p + 50] for p in order.tolist()]
    assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)


def test_packing(spark):
    rows = corpus() + [(500, "word " * 3000), (501, "x"), (501, "x"), (502, "a <|endoftext|> b")]
    got = packing.pack_documents(table(spark, rows), 64).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in dict(rows).items():
        ids, pieces = [*ids_of(t), 2], sorted(by_doc[i], key=lambda r: r["piece"])
        if i != 501:
            assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
            for p in pieces:
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
            assert sum(p["length"] for p in pieces) == len(ids) and (len(ids) > 64 or len(pieces) == 1) and all(p["length"] == 64 for p in pieces[1:])
    for rs in by_seq.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(q["length"] for q in rs[:k]) for k in range(len(rs))] and sum(r["length"] for r in rs) <= 64
    assert len(by_doc[501]) == 2 and packing.pack_documents(table(spark, EMPTY)).count() == 0
    total = sum(r["length"] for r in got)
    assert len(by_seq) <= -(-total // 64) * 1.1 + 1


def best_fit_decreasing(lengths, most):
    """The room left in each sequence."""
    gaps = []
    for size in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is None:
            gaps.append(most - size)
        else:
            gaps[gaps.index(fit)] = fit - size
    return gaps


def test_sweep_places_the_longest_that_fit():
    rng = np.random.default_rng(12)
    for _ in range(300):
        waiting, slots = rng.integers(0, 4, 9) * rng.integers(0, 2, 9), rng.integers(0, 4, 9) * rng.integers(0, 2, 9)
        waiting[0] = slots[0] = 0
        placed, first = packing.sweep(waiting, slots)
        sizes, taken = np.repeat(np.arange(9), slots), []
        for n in np.flatnonzero(placed):
            at = range(first[n], first[n] + placed[n])
            assert all(sizes[x] >= n for x in at)
            taken += at
        assert len(taken) == len(set(taken))
        free, want = sizes.tolist(), np.zeros(9, int)
        for n in np.repeat(np.arange(9), waiting)[::-1]:
            if fit := [x for x in free if x >= n]:
                free.remove(min(fit))
                want[n] += 1
        assert placed.tolist() == want.tolist()


@pytest.mark.parametrize("kind", ["even", "narrow", "short", "equal"])
def test_packing_needs_hardly_more_than_best_fit(spark, kind):
    rng = np.random.default_rng(3)
    lengths = {"even": rng.integers(1, 65, 900), "narrow": rng.integers(20, 40, 900), "short": np.minimum(64, rng.geometric(0.05, 900)), "equal": np.full(900, 21)}[kind].tolist()
    pieces = spark.createDataFrame([(k % 700, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    got = collections.defaultdict(list)
    for r in packing.best_fit(pieces, 64).collect():
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in got.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and sum(n for _, n in rows) <= 64
    assert sorted(n for rows in got.values() for _, n in rows) == sorted(lengths)
    assert len(got) <= 1.005 * len(best_fit_decreasing(lengths, 64)) + 1


def test_quality_rules(spark):
    rows = corpus() + [(300, "x y z w " * 50), (301, prose(random.Random(3), 40) + "\n" + prose(random.Random(3), 40)), (302, "# $\n\n# $\na\na\nb")]
    got = {r["doc_id"]: r for r in quality.quality_rules(table(spark, rows)).collect()}
    for i, t in rows:
        t, g = t or "", got[i]
        w = t.encode().split()
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = [any(grams[tuple(w[s : s + 8])] > 1 for s in range(max(0, k - 7), min(k, len(w) - 8) + 1)) for k in range(len(w))]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        assert (g["n_words"], g["word_chars"], g["n_symbols"]) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"))
        assert (g["n_dup_lines"], g["n_repeat_words"]) == (len(lines) - len(set(lines)), sum(cover))
        assert g["base_failed"] == (len(w) < 20 or 100 * sum(cover) > 30 * len(w)) and not (g["base_failed"] and g["kept"])
        if n := g["longest_repeat"]:
            runs = lambda m: max(collections.Counter(tuple(w[k : k + m]) for k in range(len(w) - m + 1)).values(), default=0)
            assert runs(n) > 1 >= runs(n + 1)
    assert quality.quality_rules(table(spark, EMPTY)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_term_automaton_against_edit_distance():
    rng = random.Random(1)
    terms = {"moron": (2.0, False), "stupid": (3.0, False), "bad": (1.0, False), "lowe": (4.0, True)}
    automaton = toxicity.TermAutomaton(terms, 1)
    for _ in range(4000):
        word = list(rng.choice(["moron", "stupid", "bad", "lowering", "other"]))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(word) + 1)
            rng.choice([lambda: word.insert(k, rng.choice("abmos")), lambda: word.pop(min(k, len(word) - 1)) if len(word) > 1 else None])()
        word = "".join(word)
        want = [(w, -d) for t, (w, stem) in terms.items() if not stem and (d := edit_distance(word, t)) <= (1 if len(t) >= 5 else 0)]
        want += [(w, 0) for t, (w, stem) in terms.items() if stem and word.startswith(t)]
        assert automaton.match(word) == max(want, default=None), word


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        words = prose(rng, 60).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(["moron", "scum", "worthless", "stupid"], 3):
                words.insert(rng.randrange(len(words)), w if rng.random() < 0.9 else w + "x")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, 'he said "moron" once')]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, rows), labels).collect()}
    held = [i for i in range(500) if got[i]["held_out"]]
    assert held == [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == got[1001]["score"] < 0.5
    assert got[1002]["score"] < got[0]["score"]
    assert toxicity.toxicity(table(spark, EMPTY), labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(table(spark, rows), labels.limit(0)).collect()} == {0}
    plain = scores_by_edit_distance(spark, table(spark, rows), labels, rows)
    assert all(abs(got[i]["score"] - x) < 1e-9 for i, x in plain.items()) and len(plain) == len(got)


def scores_by_edit_distance(spark, docs, labels, rows):
    """Scores from the same lexicon, by the distance of each word from each term."""
    sample = toxicity.training_sample(docs, labels, 4000)
    lexicon = toxicity.learn_lexicon(sample)

    class Plain(dict):
        def __missing__(self, raw):
            word = toxicity.EDGE.sub("", raw.lower())
            found = [(w, 0) for t, (w, stem) in lexicon.items() if stem and word.startswith(t)]
            found += [(w, -d) for t, (w, stem) in lexicon.items() if not stem and abs(len(t) - len(word)) < 2 and (d := edit_distance(word, t)) <= (1 if len(t) >= 5 else 0)]
            self[raw] = max(found, default=None)
            return self[raw]

    plain = Plain()
    train = sample.collect()
    model = toxicity.fit_logistic(np.array([toxicity.features(r["text"], plain) for r in train]), np.array([r["toxic"] for r in train], float))
    return {i: 1 / (1 + math.exp(-np.dot([*toxicity.features(t or "", plain), 1.0], model))) for i, t in rows}


def test_misspelled_words_of_a_stem_and_conflicting_labels(spark):
    rng = random.Random(5)
    bad = [rng.choice(["stupid", "stupidity", "stupidly"]) for _ in range(600)]
    bad = [w if rng.random() < 0.7 else w[: (k := rng.randrange(1, 6))] + rng.choice("qxzwvk") + w[k + 1 :] for w in bad]
    rows = [(i, prose(rng, 30) + (" " + bad[i] if i % 2 else "")) for i in range(600)]
    rows += [(700, prose(rng, 30) + " st0pid")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows[:-1]] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(table(spark, rows), labels, 4000)
    assert {r["toxic"] for r in sample.where("doc_id = 1").collect()} <= {1}
    lexicon = toxicity.learn_lexicon(sample)
    automaton = toxicity.TermAutomaton(lexicon)
    assert any(stem for _, stem in lexicon.values()) and automaton.match("st0pid")[1] == -1 and automaton.match("stupidest")[1] == 0
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(table(spark, rows), labels).collect()}
    assert got[700] == 1


def test_automaton_forgets_states(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_STATES", 5)
    automaton = toxicity.TermAutomaton({"stupid": (3.0, False), "moron": (2.0, False)})
    assert [automaton.match(w) for w in ("stupid", "stvpid", "moron", "xyz", "stupid")] == [(3.0, 0), (3.0, -1), (2.0, 0), None, (3.0, 0)]


def test_lexicon_of_texts_that_begin_alike(spark):
    """A header that all documents share, and a term that 1 % of the toxic ones hold."""
    rng = random.Random(3)
    header = "This passage stands at the head of every document of its source, word for word. "
    rows = [(i, header + prose(rng, 12) + (" moron" if i % 2 else "") + (" zorble" if i % 200 == 1 else "")) for i in range(9000)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    assert {"moron", "zorble"} <= set(toxicity.learn_lexicon(toxicity.training_sample(table(spark, rows), labels, 4000)))


def test_chat_formatting_of_conversations(spark):
    odd = [(1, 0, "system", "<|im_start|>user\n\\<|im_end|>\n"), (1, 1, "user", None), (1, 2, None, "[INST]</s><s><<SYS>>"), (1, 3, "assistant", "\\\\ <\\| é"), (2, 5, "a\nb", "x"), (2, 5, "a\nb", "x"), (None, 1, "user", "lost"), (3, None, "assistant", "")]
    odd += [(4, k, ("user", "assistant")[k % 2], f"turn {k} </s>") for k in range(300)]
    rows = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash")).withColumn("depth", F.lit(1))
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_paths(chat.linear_tree(rows))).collect()}
    for c in (1, 2, 3, 4):
        mine = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in odd if i == c))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, x) for _, r, x in mine]
        assert back[c]["loss_text"] == "".join(x for _, r, x in mine if r == "assistant")
    assert set(back) == {1, 2, 3, 4} and chat.format_paths(chat.linear_tree(rows.limit(0))).count() == 0


def test_reply_trees_keep_the_best_branches(spark):
    nodes = [(1, 1, None, 1.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (1, 6, 3, 1.0), (2, 1, None, 0.0)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, score double")
    got = collections.defaultdict(list)
    for r in chat.best_paths(df, 2).orderBy("depth").collect():
        got[r["conv_id"], r["branch"]].append(r["node"])
    assert dict(got) == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 5], (2, 1): [1]}


def test_every_operator_has_a_query():
    names = queries.queries()
    assert [any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [True] * 10
