"""MinHash near-dedup by an LSH forest.

Every distinct shingle set gets VALUES minhashes. TREES trees order the sets by their signatures, each reading the
values in another (rotated) order. A region is a tree's sets with one prefix of PREFIX values. In a tree's order the
neighbours of a set are those with the longest common prefixes, and each set offers the longer-prefix one, so that the
depth at which it is compared follows its region: deep among copies, PREFIX values in sparse places. The smallest id
of a region of more than two sets, mostly the original, is offered to the others, too.

Candidates are sifted by their signatures and confirmed on full shingle sets: first the best partner of each
document, then every candidate pair whose ends those links have not joined. Links give connected components. Then
regions are contracted: of each component in a region one set stays, and these have new neighbours, at smaller depths.
That goes on until a round finds no link (ROUNDS at most). A region whose sets are all in one component is settled;
what is left apart in others is compared without a cap, block against block (block_links): the shingle sets of a region
are dealt to blocks of bounded size, each set is sent once for each pair of blocks that it is in, and no pair is ever a
row. Inside a pair of blocks a filter over each set's rarest shingles names the pairs that can reach the threshold, and
what leaves it are links enough to join what belongs together, at most one for each set. So a pair that shares a region
in any tree is found, however large the region is. exact=True compares all sets, whatever their regions, by a join on
their rarest shingles (crowd_pairs).

A pair shares no region with a chance of (1 - s^3)^16: 3e-7 at similarity s = 0.85, 1e-5 at 0.8; the sift turns a pair
at the threshold away once in 300,000. Orders are range-sorted over (region, further values, id), which splits a region
that holds a third of all rows; the rows at both sides of a partition's border are compared as well.

Equal sets are one class from the start, so that copies cost one row each. Joins that can meet a hot key are of two
plain exchanges, which Spark splits where they are skewed; joins with texts are never broadcast, as nothing
bounds either side.

Cases: null texts and texts without words have an empty set and are linked with nothing; texts with fewer words than
a shingle count as one shingle; rows that repeat a doc_id get the same component, and of its different texts the one with the
smallest hash is compared; long texts are taken whole, one at a time, in memory of some 50 bytes a word; ties go to smaller
ids; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import mix64, stage_table, texts
from lectern.llm.components import connected_components

VALUES, TREES = 96, 16
PREFIX = 3
ORDER_BYTES = 24  # of the values after the prefix that the order reads
ROUNDS = 3  # contractions at most, before what is left goes through the prefix filter
SLOTS = 1 << 18  # counters that tell rare shingles from common ones
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20  # of one side of a pair of blocks, in the mean
AT_ONCE = 1 << 20  # shingles that one set is compared with in one step
SIGNED = "doc_id long, of_text long, n_shingles long, d1 long, d2 long, low binary, keys array<long>"

_odd = mix64(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 40:
            self[word] = h
        return h


_words = _WordHashes()


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    span = min(size, len(h))
    x = np.full(len(h) - span + 1, np.uint64(span))
    for k in range(span):
        x = mix64(x + h[k : k + len(x)])
    return np.unique(x)


def signature(x: np.ndarray) -> np.ndarray:
    """VALUES minhashes of 32 bits."""
    low = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for s in range(0, len(x), 1024):
        np.minimum(low, (x[s : s + 1024, None] * _odd).min(axis=0), out=low)
    return low >> np.uint64(32)


def signed(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        rotated = (6 * np.arange(TREES)[:, None] + np.arange(PREFIX)) % VALUES
        for pdf in batches:
            rows = []
            for doc_id, text, of_text in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["of_text"].tolist(), strict=True):
                x = shingle_hashes(text, size)
                if not len(x):
                    rows.append((doc_id, of_text, 0, None, None, None, None))
                    continue
                sig = signature(x)
                digest = xxhash.xxh3_128_digest(x.tobytes())
                keys = np.arange(1, TREES + 1, dtype=np.uint64)
                for k in range(PREFIX):
                    keys = mix64(keys + sig[rotated[:, k]] * np.uint64(0x9E3779B97F4A7C15))
                d1, d2 = np.frombuffer(digest, np.int64).tolist()
                rows.append((doc_id, of_text, len(x), d1, d2, mix64(sig).astype(np.uint8).tobytes(), keys.view(np.int64)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNED.split(", ")]).astype({"n_shingles": "int64", "d1": "Int64", "d2": "Int64"})
        _words.clear()

    return docs.mapInPandas(run, SIGNED)


def sift_at(share: float) -> int:
    """Equal signature bytes that a pair at this similarity has but once in 300,000: 4.5 deviations below the mean."""
    return int(VALUES * share - 4.5 * (VALUES * share * (1 - share)) ** 0.5)


def neighbours(rows: DataFrame, at_least: int) -> DataFrame:
    """(a, b, same), a < b: neighbours in a tree's order that share a region, if no other neighbour of either has a
    longer common prefix, and if at_least signature bytes are equal. rows: (tree, key, doc_id, low); keys tell trees
    apart."""

    def pairs_of(ids, keys, low, common, at):
        """The pairs (k - 1, k) for k in at that are offered. common[k]: values that k - 1 and k share, from 1 on."""
        wider = np.append(common, 0)
        at = at[(common[at] > 0) & ((common[at] >= common[at - 1]) | (common[at] >= wider[at + 1]))]
        same = (low[at] == low[at - 1]).sum(axis=1)
        at, same = at[same >= at_least], same[same >= at_least]
        return pd.DataFrame({"a": np.minimum(ids[at], ids[at - 1]), "b": np.maximum(ids[at], ids[at - 1]), "same": same})

    def run(batches):
        part, first, decided = TaskContext.get().partitionId(), None, 0
        ids, keys, low, turned = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, VALUES), np.uint8), np.empty((0, ORDER_BYTES), np.uint8)
        common = np.empty(0, np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            raw = np.frombuffer(b"".join(pdf["low"]), np.uint8).reshape(-1, VALUES)
            then = np.frombuffer(b"".join(pdf["turned"]), np.uint8).reshape(-1, ORDER_BYTES)
            if first is None:
                first = (pdf["key"].iloc[0], pdf["doc_id"].iloc[0], pdf["low"].iloc[0])
            ids, keys = np.concatenate([ids, pdf["doc_id"].to_numpy()]), np.concatenate([keys, pdf["key"].to_numpy()])
            low, turned = np.concatenate([low, raw]), np.concatenate([turned, then])
            differ = np.ones((len(ids), ORDER_BYTES + 1), bool)
            differ[1:, :-1] = turned[1:] != turned[:-1]
            common = PREFIX + differ.argmax(axis=1)
            common[0] = 0
            common[1:][keys[1:] != keys[:-1]] = 0
            yield pairs_of(ids, keys, low, common, np.arange(decided + 1, len(ids) - 1))  # the last waits for its next one
            ids, keys, low, turned, common = ids[-3:], keys[-3:], low[-3:], turned[-3:], common[-3:]
            decided = len(ids) - 2
        if first is not None:
            yield pairs_of(ids, keys, low, common, np.arange(max(1, len(ids) - 1), len(ids)))
            ends = [(part, 0, *first), (part, 1, keys[-1], ids[-1], low[-1].tobytes())]
            yield pd.DataFrame(ends, columns=["part", "side", "key", "doc_id", "low"])

    order = ["key", "turned", "doc_id"]
    rows = rows.withColumn("turned", F.expr(f"substring(concat(low, low), tree * 6 + {PREFIX + 1}, {ORDER_BYTES})"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "a long, b long, same int, part int, side int, key long, doc_id long, low binary"
    fill = lambda frames: (x.reindex(columns=[k.split()[0] for k in kinds.split(", ")]).astype({"a": "Int64", "b": "Int64", "same": "Int32", "part": "Int32", "side": "Int32", "key": "Int64", "doc_id": "Int64"}) for x in frames)
    found = stage_table(placed.select("key", "turned", "low", "doc_id").mapInPandas(lambda batches: fill(run(batches)), kinds), "neighbours")
    line = Window.orderBy("part", "side")  # two rows for each partition
    edges = found.where("part is not null").select("side", "doc_id", "key", *(F.lag(c).over(line).alias(f"{c}_before") for c in ("doc_id", "key")))
    edges = edges.where("side = 0 and key = key_before and doc_id <> doc_id_before")
    across = edges.select(F.least("doc_id", "doc_id_before").alias("a"), F.greatest("doc_id", "doc_id_before").alias("b"), F.lit(None).cast("int").alias("same"))
    return found.where("part is null").select("a", "b", "same").union(across).groupBy("a", "b").agg(F.max("same").alias("same"))


def in_trees(sets: DataFrame) -> DataFrame:
    return sets.select(F.posexplode("keys").alias("tree", "key"), "low", "doc_id")


def crowds(sets: DataFrame) -> DataFrame:
    """(tree, key, first, low, doc_id): the sets of regions with more than two, and the smallest id of each region."""
    sizes = in_trees(sets).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    sizes = stage_table(sizes.where("n > 2").select("key", "first"), "sizes")  # read plainly, so that Spark can split a hot key
    return stage_table(in_trees(sets).join(sizes.hint("merge"), "key"), "crowds")


def originals(crowded: DataFrame) -> DataFrame:
    """(a, b), a < b: the smallest set of each crowded region and each other one."""
    return crowded.where("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()


def unsettled(crowded: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of crowded regions that hold more than one component, with `component`."""
    of = joined.select(F.col("node").alias("doc_id"), "component")
    rows = stage_table(crowded.join(of.hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "regions")
    mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    mixed = stage_table(mixed, "mixed")
    return stage_table(rows.join(mixed.hint("merge"), "key", "left_semi"), "unsettled")


def contracted(open_rows: DataFrame) -> DataFrame:
    """Of each component in a region, the set with the smallest id."""
    one = open_rows.groupBy("key", "component").agg(F.min_by(F.struct("tree", "low", "doc_id"), "doc_id").alias("x"))
    return one.select("key", "x.*")


def sifted(pairs: DataFrame, sets: DataFrame, at_least: int) -> DataFrame:
    """(a, b, same): the pairs whose signatures have enough equal bytes."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, VALUES) for c in ("x", "y"))
                same = (x == y).sum(axis=1)
                yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "same": same})[same >= at_least]

    x, y = (sets.select(F.col("doc_id").alias(c), F.col("low").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long, same int")


def confirmed(pairs: DataFrame, some: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union of their full shingle sets. some: (doc_id, text) of all
    documents in pairs."""

    def run(batches):
        last: dict[str, tuple] = {"a": (None, None), "b": (None, None)}
        for pdf in batches:
            ok = []
            for a, b, ta, tb in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["ta"], pdf["tb"], strict=True):
                for side, i, t in (("a", a, ta), ("b", b, tb)):
                    if last[side][0] != i:
                        last[side] = (i, shingle_hashes(t, size))
                x, y = last["a"][1], last["b"][1]
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pdf.loc[ok, ["a", "b"]]
        _words.clear()

    ta, tb = (some.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return stage_table(pairs.select("a", "b").join(ta.hint("merge"), "a").join(tb.hint("merge"), "b").mapInPandas(run, "a long, b long"), "confirmed")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The one exchange of all texts: what it keeps is staged for all rounds. ids: (doc_id, of_text), each doc_id once."""
    return stage_table(docs.join(ids.hint("merge"), ["doc_id", "of_text"]).dropDuplicates(["doc_id"]).select("doc_id", "text"), "texts")


def rare_prefixes(some: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(h, doc_id, n, at, leads): the rarest shingles of each set of some, rarest first. Two sets of a similarity of
    num / den share one of them: of n shingles, the n - ceil(n * num / den) + 1 rarest, and in the set with fewer (or
    the smaller id) even one of the n - ceil(n * 2 num / (num + den)) + 1 rarest, which lead. Counters need not tell
    shingles apart, as any one order of all shingles will do."""

    def count(batches):
        n = np.zeros(SLOTS, np.int64)
        for pdf in batches:
            x = [shingle_hashes(text, size) % np.uint64(SLOTS) for text in pdf["text"]]
            if x:
                n += np.bincount(np.concatenate(x).astype(np.int64), minlength=SLOTS)
        _words.clear()
        slot = np.flatnonzero(n)
        yield pd.DataFrame({"slot": slot, "n": n[slot]})

    seen = some.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    often = np.zeros(SLOTS, np.int64)
    often[seen["slot"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)

    def run(batches):
        for pdf in batches:
            parts = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                x = shingle_hashes(text, size)
                n = len(x)
                if not n:
                    continue
                at = np.arange(n - -(-n * num // den) + 1)
                rare = x[np.lexsort((x, often[(x % np.uint64(SLOTS)).astype(np.int64)]))[: len(at)]]
                parts.append((rare.view(np.int64), np.full(len(at), doc_id), np.full(len(at), n), at, at <= n - -(-2 * n * num // (num + den))))
            if parts:
                yield pd.DataFrame(dict(zip(("h", "doc_id", "n", "at", "leads"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))
        _words.clear()

    return some.select("doc_id", "text").mapInPandas(run, "h long, doc_id long, n long, at long, leads boolean")


def shared_prefixes(some: DataFrame, joined: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The rows of rare_prefixes, with component, for shingles that sets of several components hold; main is the one
    that holds the shingle most often, and rest is true outside it."""
    of = joined.select(F.col("node").alias("doc_id"), "component")
    rows = rare_prefixes(some, size, num, den).join(of.hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = stage_table(rows, "prefixes")
    parts = rows.groupBy("h", "component").agg(F.count("*").alias("n"))
    most = parts.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return stage_table(rows.join(most.select("h", "main").hint("merge"), "h").withColumn("rest", F.col("component") != F.col("main")), "mixed")


def crowd_pairs(some: DataFrame, joined: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(a, b), a < b: all pairs of sets of some in different components that can have a similarity of num / den.
    The largest component of a shingle's holders is not compared with itself, so that near copies that are joined
    already cost one row each for a shingle that all of them hold."""
    rows = shared_prefixes(some, joined, size, num, den)
    few, many = (rows.select("h", *(F.col(c).alias(f"{c}{k}") for c in ("doc_id", "n", "at", "leads", "component", "rest"))) for k in (1, 2))
    both = few.where("rest1").join(many.hint("merge"), "h").where("component1 <> component2 and (not rest2 or doc_id1 < doc_id2)")
    first = F.expr("n1 < n2 or n1 = n2 and doc_id1 < doc_id2")
    able = F.when(first, F.col("leads1")).otherwise(F.col("leads2")) & (F.least(F.expr("n1 - at1"), F.expr("n2 - at2")) * (num + den) >= (F.col("n1") + F.col("n2")) * num)
    return both.where(able).select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b")).distinct()


def hash_sets(some: DataFrame, size: int) -> DataFrame:
    """(doc_id, x): each shingle set as sorted 64-bit hashes."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [shingle_hashes(t, size).tobytes() for t in pdf["text"]]})
        _words.clear()

    return some.select("doc_id", "text").mapInPandas(run, "doc_id long, x binary")


def block_pairs(rows: DataFrame) -> DataFrame:
    """(key, tree, p, q, second, doc_id, component): rows (key, tree, doc_id, component, n_shingles) of regions, once for
    each pair of blocks (p, q) that they take part in; second tells the sides of a pair apart. The largest component of
    a region is not compared with itself: its blocks stand on the second side only."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    main = F.max_by("component", F.struct("n", "component"))
    rest = lambda c: F.sum(c) - F.max_by(c, F.struct("n", "component"))
    blocks = lambda n, m: F.ceil(F.greatest(n / BLOCK_SETS, m / BLOCK_SHINGLES)).cast("int")
    most = lambda c: F.max_by(c, F.struct("n", "component"))
    dealt = parts.groupBy("key").agg(main.alias("main"), blocks(rest("n"), rest("m")).alias("r"), blocks(most("n"), most("m")).alias("of_main"))
    rows = rows.join(stage_table(dealt.where("r > 0"), "dealt").hint("merge"), "key").withColumn("in_main", F.expr("component = main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("in_main"), F.col("of_main")).otherwise(F.col("r"))).cast("int"))
    at = F.expr("""case when in_main then transform(sequence(0, r - 1), k -> struct(k as p, r + own as q, true as second))
        else concat(transform(sequence(0, r - 1), k -> struct(least(own, k) as p, greatest(own, k) as q, own > k as second)),
                    transform(sequence(0, of_main - 1), k -> struct(own as p, r + k as q, false as second))) end""")
    return rows.select("key", "tree", "doc_id", "component", F.explode(at).alias("at")).select("key", "tree", "at.*", "doc_id", "component")


def links_of_blocks(ids, component, second, keys, sets, tree: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links (a, b), a < b, of at least num / den that join whatever the links between sets of different components
    join: of the two sides, or of the one. Pairs that share a region in an earlier tree are left to that tree. The rarest
    shingles are those of rare_prefixes, with the blocks' own counts for an order."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    of, start = np.repeat(np.arange(len(sets)), n), np.cumsum(n) - n
    _, shingle, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((shingle, often[shingle], of))  # each set's shingles, rarest first
    at = np.arange(len(of)) - start[of]
    leads = at <= (n - -(-2 * n * num // (num + den)))[of]
    front = (at <= (n - -(-n * num // den))[of]) & (often[shingle[order]] > 1)
    first_side = np.append(0, np.cumsum(front))  # where each set's entries start
    first_side = first_side[np.append(start, len(of))]
    code, owner, at, leads = shingle[order][front], of[front], at[front], leads[front]
    by_code = np.argsort(code, kind="stable")
    lo, hi = (np.searchsorted(code[by_code], code, side) for side in ("left", "right"))
    label = np.unique(component, return_inverse=True)[1]
    alone, has, links = not second.any(), np.zeros(len(often), bool), []
    for a in np.flatnonzero(~second):
        e = np.arange(first_side[a], first_side[a + 1])
        e = e[hi[e] - lo[e] > 1]
        if not len(e):
            continue
        count = hi[e] - lo[e]
        mine = np.repeat(e, count)
        its = by_code[np.repeat(lo[e] - np.cumsum(count) + count, count) + np.arange(len(mine))]
        c = owner[its]
        able = (c > a if alone else second[c]) & (label[c] != label[a])
        mine, its, c = mine[able], its[able], c[able]
        able = np.where((n[a] < n[c]) | ((n[a] == n[c]) & (a < c)), leads[mine], leads[its])
        able &= np.minimum(n[a] - at[mine], n[c] - at[its]) * (num + den) >= (n[a] + n[c]) * num
        near = np.unique(c[able])
        near = near[(keys[near] == keys[a]).argmax(axis=1) == tree]
        has[shingle[start[a] : start[a] + n[a]]] = True
        ends = np.cumsum(n[near])
        for part in np.split(near, np.flatnonzero(np.diff(ends // AT_ONCE)) + 1) if len(near) else ():
            held = has[np.concatenate([shingle[start[c] : start[c] + n[c]] for c in part])]
            both = np.add.reduceat(held, np.cumsum(n[part]) - n[part], dtype=np.int64)
            for c in part[den * both >= num * (n[a] + n[part] - both)]:
                if label[c] != label[a]:
                    links.append((min(ids[a], ids[c]), max(ids[a], ids[c])))
                    label[label == label[c]] = label[a]
        has[shingle[start[a] : start[a] + n[a]]] = False
    return links


def block_links(left: DataFrame, sets: DataFrame, some: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(a, b): links that join whatever is alike and still apart in the regions of left."""

    def of_group(g):
        cols = {c: np.concatenate([x[c].to_numpy() for x in g]) for c in ("doc_id", "component", "second")}
        keys = np.stack([k for x in g for k in x["keys"]])
        hashes = [np.frombuffer(s, np.uint64) for x in g for s in x["x"]]
        return links_of_blocks(cols["doc_id"], cols["component"], cols["second"].astype(bool), keys, hashes, int(g[0]["tree"].iloc[0]), num, den)

    def run(batches):
        group, last = [], None
        for pdf in batches:
            if not len(pdf):
                continue
            at = pdf[["key", "p", "q"]].to_numpy(np.int64)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                if group and tuple(at[lo]) != last:
                    yield pd.DataFrame(of_group(group), columns=["a", "b"], dtype="int64")
                    group = []
                group, last = [*group, pdf.iloc[lo:hi]], tuple(at[lo])
        if group:
            yield pd.DataFrame(of_group(group), columns=["a", "b"], dtype="int64")

    pairs = block_pairs(left.join(sets.select("doc_id", "n_shingles").hint("merge"), "doc_id"))
    full = stage_table(hash_sets(some, size).join(sets.select("doc_id", "keys").hint("merge"), "doc_id"), "hashed")
    rows = stage_table(pairs, "block_pairs").join(full.hint("merge"), "doc_id").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return stage_table(rows.select("key", "p", "q", "tree", "second", "doc_id", "component", "keys", "x").mapInPandas(run, "a long, b long"), "block_links")


def _extend(links: DataFrame, pairs: DataFrame, some: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Components of links and of those further pairs that hold between different components; and all links."""
    joined = connected_components(links)
    ca, cb = (joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    apart = pairs.select("a", "b").join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    apart = stage_table(apart.select("a", "b"), "apart")
    if apart.isEmpty():
        return joined, links
    links = links.union(confirmed(apart, some, size, num, den))
    return connected_components(links), links


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents whose shingle sets have a Jaccard similarity
    of at least num / den. exact: leave nothing to the chance that two alike sets share no region."""
    docs = texts(docs).withColumn("of_text", F.xxhash64("text"))
    every = stage_table(signed(docs, size), "signed")
    filled = every.where("n_shingles > 0")
    several = every.groupBy("doc_id").agg(F.min("of_text").alias("chosen"), F.max("of_text").alias("last")).where("chosen < last")
    several = stage_table(several.select("doc_id", "chosen"), "several")
    if not several.isEmpty():  # different texts of one doc_id
        filled = filled.join(several.hint("merge"), "doc_id", "left").where("chosen is null or chosen = of_text").drop("chosen")
    classes = stage_table(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    of = stage_table(filled.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "rep").distinct(), "of")
    reps = of.where("doc_id = rep").select("doc_id")
    sets = stage_table(filled.join(reps, "doc_id", "left_semi").select("doc_id", "of_text", "n_shingles", "low", "keys").dropDuplicates(["doc_id"]), "sets")
    least = sift_at(num / den)
    crowded = crowds(sets)
    found = neighbours(in_trees(sets), least).union(sifted(originals(crowded), sets, least))
    pairs = stage_table(found.groupBy("a", "b").agg(F.max("same").alias("same")), "pairs")
    best = pairs.groupBy("b").agg(F.max(F.struct("same", (-F.col("a")).alias("m"))).alias("x"))  # most alike, then smallest
    best = stage_table(best.select((-F.col("x.m")).alias("a"), "b"), "best")
    members = (sets if exact else crowded).select("doc_id").distinct()
    some = texts_of(docs, sets.select("doc_id", "of_text").join(ends(pairs).union(members).distinct(), "doc_id", "left_semi"))
    links = confirmed(best, some, size, num, den)
    joined, links = _extend(links, pairs.join(best, ["a", "b"], "left_anti"), some, size, num, den)
    left = unsettled(crowded, joined)
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        again = sifted(neighbours(contracted(left), 0).join(pairs, ["a", "b"], "left_anti"), sets, least)
        again = stage_table(again, "again")
        new = confirmed(again, some, size, num, den)
        if new.isEmpty():
            break
        pairs, links = pairs.union(again), links.union(new)
        joined = connected_components(links)
        left = unsettled(left.drop("component"), joined)
    if exact:
        wide = stage_table(crowd_pairs(some, joined, size, num, den).join(pairs, ["a", "b"], "left_anti"), "wide")
        if not wide.isEmpty():
            joined = connected_components(links.union(confirmed(wide, some, size, num, den)))
    elif not left.isEmpty():  # whatever the offers left apart
        rest = some.join(left.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        able = stage_table(shared_prefixes(rest, joined, size, num, den).select("doc_id").distinct(), "able")
        if not able.isEmpty():
            left = stage_table(left.select("key", "tree", "doc_id", "component").join(able.hint("merge"), "doc_id", "left_semi"), "left")
            new = block_links(left, sets, some.join(able.hint("merge"), "doc_id", "left_semi"), size, num, den)
            joined = connected_components(links.union(new))
    found = of.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = found.select("doc_id", F.coalesce("component", "rep").alias("component"))
    result = every.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    result = result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.col("doc_id") == F.col("component_id"))
