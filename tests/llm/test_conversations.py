"""Byte pairs, prefix tries and structure repair, against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import byte_pairs, prefix_trie, structure_repair

CONV = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, CONV)
    for name in ("grp", "unit", "box", "path", "key", "part", "n", "fault", "_kind", "audit", "edit"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


# byte pairs


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "<|endof", "text|>", "é", "ß", "한", "글", "日本", "😀", " ", "\x1c", "\x85", "1", "½", "aaaaa", "the", "!!", "́", "𔐀", "՘", "Ᲊ", "\U0003fc3b"]


def test_byte_pairs_are_those_of_the_library(library):
    rng = random.Random(3)
    texts = ["", " ", "\n", "a" * 31] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x600), rng.randrange(0xE000, 0x110000)])) for _ in range(12)) for _ in range(1000)]
    codec = byte_pairs.Encoder()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # words anew, and remembered
        got = [np.frombuffer(x, "<u4") for x in codec.encode(texts)]
        assert [x.tolist() for x in got] == want
    assert [codec.model.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]
    loose = [[rng.randrange(50257) for _ in range(9)] for _ in range(500)]
    assert [codec.model.decode(np.array(x, "<u4")) for x in loose] == [library.decode(x, skip_special_tokens=False) for x in loose]
    assert codec.model.decode(np.array([70000, 64], "<u4")) == library.decode([64])


def test_long_words_take_time_in_proportion(library):
    rng = random.Random(4)
    for word in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "ab" * 50_000, "日本語한글" * 20_000):
        codec = byte_pairs.Encoder()
        got = np.frombuffer(codec.encode([word])[0], "<u4").tolist()
        assert got == library.encode(word, add_special_tokens=False).ids
        assert word not in codec.known  # only short words are remembered


def test_a_vocabulary_whose_ranks_are_out_of_order_is_refused(tmp_path, monkeypatch):
    import json

    import public_tokenizers

    letters = {c: k for k, c in enumerate(byte_pairs.byte_letters())}
    about = {"added_tokens": [], "model": {"vocab": letters | {"ab": 256, "abc": 257}, "merges": [["ab", "c"], ["a", "b"]]}}
    (tmp_path / "v.json").write_text(json.dumps(about))
    monkeypatch.setattr(public_tokenizers, "path", lambda name: str(tmp_path / name))
    with pytest.raises(ValueError, match="before"):
        byte_pairs.PairModel("v.json")
    about["model"]["merges"].reverse()
    (tmp_path / "v.json").write_text(json.dumps(about))
    assert np.frombuffer(byte_pairs.PairModel("v.json").encode_words([b"abcab"])[0], "<u4").tolist() == [257, 256]


def test_documents_through_the_codec(spark, library):
    texts = ["plain words", None, "", "<|endoftext|> x", "plain words", "né " * 30_000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in byte_pairs.codec_digest(byte_pairs.decode_documents(byte_pairs.encode_documents(docs))).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), sha(t or ""))
    none = docs.where("false")
    assert byte_pairs.codec_digest(byte_pairs.decode_documents(byte_pairs.encode_documents(none))).count() == 0


# tries


def in_order(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(rows):
    convs = in_order(rows)
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for prefix, who in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        parents = {p[:-1] for p in below if len(p) > len(prefix)}
        saved = sum((len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(prefix))
        kids = sum(len(p) == len(prefix) + 1 for p in below)
        up = min(members[prefix[:-1]]) if prefix else None
        out.add((min(who), len(prefix), up, len(who), kids, sum(p not in parents for p in below), saved, sha(ends)))
    return out


def random_conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        deep = rng.choice([0, 2, 5, 9])
        for t in range(rng.randint(1, 7) + deep):
            text = "same opening words" if t < deep else rng.choice(["yes no", "a b c", "", "\t", "one"])
            rows.append((c, t, rng.choice(["user", "user", "assistant"]) if t >= deep else "user", text))
    rows += [(5000 + k, 0, "user", "copy of one") for k in range(50)]
    rows += [(77777, None, None, "null turn"), (77777, 0, "user", None), (77778, None, "user", None), (None, 1, "user", "no id"), (77779, 1, "user", "x"), (77779, 1, "user", "x")]
    return rows


@pytest.mark.parametrize("limit", [1, 6, 40, 100_000])
def test_trie_is_that_of_brute_force(spark, limit):
    rows = random_conversations(limit)
    nodes = prefix_trie.prefix_trie(prefix_trie.rebuilt_conversations(rows_of(spark, rows)), limit)
    got = [tuple(r) for r in nodes.drop("turn_id").collect()]
    want = brute_trie(rebuilt(rows))
    assert len(got) == len(set(got)) and set(got) == want


def test_trie_of_plain_conversations_names_its_texts(spark):
    rows = [(c, t, "user", f"turn {t} of a long shared start") for c in range(30) for t in range(12)] + [(c, 12, "user", f"own {c}") for c in range(0, 30, 2)]
    df = rows_of(spark, rows)
    nodes = prefix_trie.with_texts(prefix_trie.prefix_trie(prefix_trie.conversation_turns(df), 20), df)
    by_depth = {}
    for r in nodes.collect():
        by_depth.setdefault(r.depth, []).append(r)
    assert {d: len(v) for d, v in by_depth.items()} == {d: 1 for d in range(13)} | {13: 15}
    assert by_depth[12][0].text == "turn 11 of a long shared start" and by_depth[0][0].text is None
    assert sorted(r.text for r in by_depth[13]) == sorted(f"own {c}" for c in range(0, 30, 2))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt_conversations(rows_of(spark, []))).count() == 0


# repair


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        if c is None:
            continue
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def kinds_of(turns):
    seen, kinds, count = set(), "", {"b": 0, "d": 0, "t": 0}
    for r, x in turns:
        body = WORD.findall(x)
        initial = r[:1] if r[:1] in ("s", "u", "a") else "o"
        fault = "b" if not body else "d" if (r, x) in seen else "t" if body[-1][-1] not in ".!?" else ""
        seen.add((r, x))
        if fault:
            count[fault] += 1
        kinds += "x" if fault in ("b", "d") else initial.upper() if fault else initial
    return kinds, count


def brute_parse(kinds):
    """Least (cost, audit) over all edits of a conversation, by trying them."""
    best = None
    n = len(kinds)

    def options(kind):
        yield 4, "D", None
        if kind != "x":
            more = 3 if kind.isupper() else 0
            yield more, "K", kind.lower()
            yield 3 + more, "R", "u"
            yield 3 + more, "R", "a"

    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*(list(options(k)) for k in kinds)):
        for ins in itertools.product(gaps, repeat=n + 1):
            cost = sum(e[0] for e in edits) + 3 * sum(map(len, ins))
            roles = ins[0] + "".join((e[2] or "") + i for e, i in zip(edits, ins[1:], strict=True))
            if (best is None or cost <= best[0]) and re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(ins[0]) + "".join(e[1] + "I" * len(i) for e, i in zip(edits, ins[1:], strict=True))
                best = min(best or (99, ""), (cost, audit))
    return best


def all_splits(kinds):
    """Textbook CYK: every span, every split."""
    cells = {(k, k + 1): structure_repair.row_cell(c) for k, c in enumerate(kinds)}
    for size in range(2, len(kinds) + 1):
        for i in range(len(kinds) - size + 1):
            found = {}
            for m in range(i + 1, i + size):
                for pq, v in structure_repair.combine(cells[i, m], cells[m, i + size]).items():
                    found[pq] = min(v, found.get(pq, v))
            cells[i, i + size] = found
    return cells[0, len(kinds)]


def test_parse_is_that_of_trying_all_edits():
    rng = random.Random(1)
    for n in range(4):
        for kinds in itertools.product("xsuaoUA", repeat=n) if n < 3 else [rng.choices("xsuaoSUAO", k=3) for _ in range(25)]:
            assert structure_repair.parse("".join(kinds)) == brute_parse("".join(kinds)), kinds


def test_one_split_of_a_span_is_as_good_as_all():
    rng = random.Random(2)
    for _ in range(60):
        kinds = "".join(rng.choices("xsuaoSUAO", k=rng.randint(1, 24)))
        assert structure_repair.span_cell(kinds) == all_splits(kinds), kinds


def expected_report(rows):
    convs = {c: [] for c, *_ in rows if c is not None}
    for c, t, r, x in damaged(rows):
        convs[c].append((t is not None, t or 0, r, hashlib.md5(x.encode()).hexdigest(), x))
    out = {}
    for c, got in convs.items():
        got.sort()
        turns = [(g[2], g[4]) for g in got]
        numbers = {g[1] for g in got if g[0]}
        kinds, count = kinds_of(turns)
        cost, audit = structure_repair.parse(kinds)
        initials = [r[:1] for r, _ in turns]
        lines, at, state = [], 0, "start"
        for edit in audit:
            need = "assistant" if state == "user" else "user"
            if edit == "I":
                lines.append((need, ""))
            else:
                r, x = turns[at]
                at += 1
                if edit == "D":
                    continue
                lines.append((r if edit == "K" else need, x))
            state = {"u": "user", "a": "assistant", "s": "start"}[lines[-1][0][0]]
        assert at == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines))
        out[c] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count["b"], count["d"], count["t"],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, sha("\n".join(f"{r}:{x}" for r, x in lines)),
        )
    return out


def test_repair_of_damaged_conversations(spark):
    rng = random.Random(6)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t if rng.random() < 0.95 else t + 3, rng.choice(["user", "assistant", "system", "tool", "", "user"]), rng.choice(["Yes.", "no", "what?", " \t", "é!", "Yes. \n"])))
    rows += [(500, None, "user", "a."), (500, None, None, "b."), (500, 4, "assistant", None), (501, 10**15, "user", "x."), (501, -5, "system", "y.")]
    rows += [(c, 1, "user", "dropped.") for c in range(800, 900) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    rows += [(None, 1, "user", "x."), (502, 2**62, "user", "x."), (502, 2**62 + 3, "assistant", "y."), (700, 3, "user", "long. " * 40_000)] + [(600, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(600)]
    df = rows_of(spark, rows)
    bad = structure_repair.damaged(df)
    got = {r.conv_id: tuple(r)[1:] for r in structure_repair.repair_report(bad, df).collect()}
    assert got == expected_report(rows)
    dropped = [c for c, v in got.items() if v[-2:] == ("", sha(""))]
    assert dropped  # conversations without a row after damage are there
    turns = structure_repair.repaired_turns(bad, structure_repair.audits(bad, df)).collect()
    for c in got:
        mine = sorted((r for r in turns if r.conv_id == c), key=lambda r: r.pos)
        assert [r.pos for r in mine] == [*range(len(mine))] and sha("\n".join(f"{r.role}:{r.text}" for r in mine)) == got[c][-1]
        assert "".join(r.edit for r in mine) == got[c][-2].replace("D", "")


def test_repair_of_nothing(spark):
    none = rows_of(spark, [])
    assert structure_repair.repair_report(none, none).count() == 0
    ids = spark.createDataFrame([(3,), (3,), (None,)], "conv_id long")
    assert [tuple(r) for r in structure_repair.repair_report(none, ids).collect()] == [(3, 0, 0, 0, 0, 0, 0, "", sha(""))]
