"""Suffix-array dedup: removes bytes that a long string of an earlier document covers, exactly.

All strings of `length` bytes are dealt out by their minimizer, the smallest hash among the ANCHOR-byte grams inside:
equal strings have equal minimizers, and neighbouring strings mostly share one, so a text falls into short pieces
(runs of strings with one minimizer). Three passes over packed batches of texts:

1. minimizers: a batch sends each of its distinct minimizers once (5 bytes) to a bucket, which answers with a bit for
   each that another document holds, too. Most of the corpus leaves the game here.
2. pieces: a batch sends each distinct piece with such a minimizer once, with its smallest document. A bucket matches
   equal pieces at once; pieces that share a minimizer but differ are concatenated and suffix-sorted in two stages:
   only suffixes smaller than their successors are sorted directly, the rest is induced from them by bucket scans.
   Common prefixes of neighbours give the classes of equal strings and the smallest document of each class.
3. removal: a batch gets a mask for each piece and cuts the covered bytes out of its documents.

A minimizer with more than HOT different pieces (a short phrase in ever new surroundings) would make a bucket grow with
the corpus. Its strings are dealt out one by one by a 128-bit hash of all their bytes, each once for each batch with its
smallest document, and the answer is the smallest document of all.

What a batch sends is distinct within it, so a passage that a third of all documents hold is one entry for each
batch; batches and buckets have a fixed size, and their number follows the input.

Cases: null texts are empty; documents shorter than `length` bytes keep everything; rows that repeat a doc_id are
no earlier documents for each other; an empty table gives an empty result; further columns are ignored. What is left
of a text may end within a character: `kept` is binary. A document is never cut, so a task holds some 60 bytes for each
byte of a batch: of BATCH_BYTES, or of the longest document, if that is longer.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import mix64, stage_table, texts

ANCHOR = 24
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
MOST = 64  # strings in a piece: one mask
HOT = 20_000  # different pieces of one minimizer, above which its strings are dealt out by themselves
TASKS = 20_000  # buckets share tasks beyond this number
BATCHES = "batch long, size long, ids binary, lens binary, data binary, more binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def packed(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Batches of whole documents, compressed; more: the carried columns of each document."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        first = TaskContext.get().partitionId() << 32
        ids, raw, more, size, n = [], [], [], 0, 0

        def row():
            data = b"".join(raw)
            return (first + n, len(data), np.array(ids, "<i8").tobytes(), np.array([len(x) for x in raw], "<i8").tobytes(), squeeze(data), squeeze(json.dumps(more).encode()))

        for pdf in batches:
            out = []
            others = pdf[list(carried)].astype(object).where(pdf[list(carried)].notna(), None).values.tolist()
            for doc_id, text, other in zip(pdf["doc_id"].tolist(), pdf["text"], others, strict=True):
                ids.append(doc_id)
                more.append(other)
                raw.append(text.encode("utf-8", "surrogatepass"))
                size += len(raw[-1])
                if size >= BATCH_BYTES:
                    out.append(row())
                    ids, raw, more, size, n = [], [], [], 0, n + 1
            yield pd.DataFrame(out, columns=["batch", "size", "ids", "lens", "data", "more"])
        if ids:
            yield pd.DataFrame([row()], columns=["batch", "size", "ids", "lens", "data", "more"])

    return stage_table(docs.mapInPandas(run, BATCHES), "batches")


def words_at(data: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Eight bytes from each place as a big-endian number; data has at least 8 bytes after the last place."""
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    return view[at].astype(np.uint64)


class Batch:
    """A batch's documents and pieces: start, strings and minimizer of each piece."""

    def __init__(self, ids: bytes, lens: bytes, data: bytes, length: int):
        self.length = length
        self.ids, self.lens = np.frombuffer(ids, "<i8"), np.frombuffer(lens, "<i8")
        self.data = zstandard.ZstdDecompressor().decompress(data)
        self.ends = np.cumsum(self.lens)
        n = len(self.data) - length + 1
        if n < 1:
            self.start = self.strings = np.empty(0, np.int64)
            self.key, self.doc = np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        x = np.frombuffer(self.data + b"\0" * 8, np.uint8)
        eight = words_at(x, slice(None))
        m = len(self.data) - ANCHOR + 1
        h = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, ANCHOR, 8):
            h ^= h >> np.uint64(29)
            h += eight[k : k + m]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        del eight
        w, have = length - ANCHOR + 1, 1
        while 2 * have <= w:
            h = np.minimum(h[:-have], h[have:])
            have *= 2
        if have < w:
            h = np.minimum(h[: n], h[w - have : w - have + n])
        h = h[:n]
        new = np.ones(n, bool)
        new[1:] = h[1:] != h[:-1]
        inner = self.ends[:-1]
        new[inner[inner < n]] = True
        bad = np.zeros(n + 1, np.int32)  # strings that cross the end of a document
        np.add.at(bad, np.minimum(np.maximum(self.ends - length + 1, self.ends - self.lens), n), 1)
        np.add.at(bad, np.minimum(self.ends, n), -1)
        valid = np.cumsum(bad)[:n] == 0
        new[1:] |= valid[1:] != valid[:-1]
        start = np.flatnonzero(new)
        strings = np.diff(np.append(start, n))
        ok = valid[start]
        start, strings = start[ok], strings[ok]
        if len(strings) and strings.max() > MOST:  # long runs of one minimizer
            parts = -(-strings // MOST)
            at = np.repeat(np.arange(len(start)), parts)
            k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            start, strings = start[at] + k * MOST, np.minimum(strings[at] - k * MOST, MOST)
        self.start, self.strings, self.key = start, strings, h[start]
        self.doc = np.searchsorted(self.ends, start, "right")

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers in order, whether two documents here hold each, each piece's place among them, and about
        how many different pieces here have each."""
        x = np.frombuffer(self.data + b"\0" * 8, np.uint8)
        kind = mix64(words_at(x, self.start) + np.uint64(31) * words_at(x, self.start + self.strings + self.length - 9)) + self.strings.astype(np.uint64)
        order = np.lexsort((kind, self.key))
        k, kind = self.key[order], kind[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(new)
        doc = self.ids[self.doc[order]]
        twice = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at) if len(at) else np.empty(0, bool)
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(new) - 1
        other = new.copy()
        other[1:] |= kind[1:] != kind[:-1]
        kinds = np.add.reduceat(other, at, dtype=np.int64) if len(at) else at
        return k[at], twice, place, kinds

    def strings_at(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all strings of some pieces, their documents, and two 64-bit hashes of each."""
        n = self.strings[pieces]
        at = np.repeat(self.start[pieces], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = np.frombuffer(self.data + b"\0" * 8, np.uint8)
        h = np.full((len(at), 2), np.uint64(self.length))
        for k in [*range(0, self.length - 8, 8), self.length - 8]:
            w = words_at(x, at + k)
            h[:, 0] = mix64(h[:, 0] + w)
            h[:, 1] = mix64((h[:, 1] ^ w) + np.uint64(0x9E3779B97F4A7C15))
        return at, self.ids[np.repeat(self.doc[pieces], n)], h


def by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its keys) for each bucket that has any; the same each time."""
    b = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    return [(int(b[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different pair of hashes, in their order, and for each row the place among them."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]).any(axis=1)
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def least_of(at: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """The smallest document of each of n classes."""
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, at, docs)
    return least


def five(keys: np.ndarray, buckets: int) -> bytes:
    """40 bits of each key besides its bucket."""
    x = (mix64(keys) // np.uint64(buckets)) & np.uint64((1 << 40) - 1)
    return (x >> np.uint64(8)).astype("<u4").tobytes() + x.astype(np.uint8).tobytes()


def unfive(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return (np.frombuffer(raw[: 4 * n], "<u4").astype(np.uint64) << np.uint64(8)) | np.frombuffer(raw[4 * n :], np.uint8)


def two_stage_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes of data, in the order of their first `depth` bytes (or more). Suffixes smaller than
    their successors are sorted directly, by eight bytes at a time where they tie; the others are induced."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    after = np.append(data[1:], 0).astype(np.int16) - data  # > 0: smaller than its successor; 0: as the next one
    after[-1] = -1
    known = np.flatnonzero(after)
    small = np.repeat(after[known] > 0, np.diff(np.concatenate([[-1], known])))
    direct = np.flatnonzero(small)
    first = words_at(padded, direct)
    order = np.argsort(first, kind="stable")
    direct, first = direct[order], first[order]
    new = np.ones(len(direct), bool)
    new[1:] = first[1:] != first[:-1]
    for k in range(8, depth, 8):
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        more = words_at(padded, direct[tied] + k)
        by = np.lexsort((more, group))
        direct[tied] = direct[tied][by]
        group, more = group[by], more[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (more[1:] != more[:-1])
        new[tied] |= fresh
    smalls = np.searchsorted(data[direct], np.arange(257))
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[data[-1]].append(np.array([n - 1]))  # the end of data comes before all

    def scan(places: np.ndarray, c: int) -> np.ndarray:
        """Larger predecessors go to the buckets of their first bytes; those of bucket c are returned."""
        p = places[places > 0] - 1
        p = p[~small[p]]
        head = data[p]
        order = np.argsort(head, kind="stable")
        p, head = p[order], head[order]
        here = p[:0]
        for part in np.split(p, np.flatnonzero(np.diff(head)) + 1):
            if len(part):
                if data[part[0]] == c:
                    here = part
                else:
                    large[data[part[0]]].append(part)
        return here

    out = []
    for c in range(256):
        waves = np.concatenate(large[c]) if large[c] else direct[:0]
        while len(waves):
            out.append(waves)
            waves = scan(waves, c)
        block = direct[smalls[c] : smalls[c + 1]]
        if len(block):
            out.append(block)
            scan(block, c)
    return np.concatenate(out) if out else direct


def masks(pieces: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """For each piece, the strings in it that a piece with a smaller document holds, as bits."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)
    order = two_stage_order(data, length)
    order = order[order + length <= (starts + sizes)[owner[order]]]  # whole strings only
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    same = np.ones(len(order) - 1, bool)  # whether neighbours share a prefix of `length` bytes
    for k in [*range(0, length - 8, 8), length - 8]:
        at = np.flatnonzero(same)
        same[at] = words_at(padded, order[at] + k) == words_at(padded, order[at + 1] + k)
    first = np.flatnonzero(np.append(True, ~same))
    least = np.repeat(np.minimum.reduceat(docs[owner[order]], first), np.diff(np.append(first, len(order))))
    hit = order[docs[owner[order]] > least]
    out = np.zeros(len(pieces), np.uint64)
    np.bitwise_or.at(out, owner[hit], np.uint64(1) << (hit - starts[owner[hit]]).astype(np.uint64))
    return out


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def judged(pieces: list[bytes], tags: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """A mask for each entry of a bucket; entries may repeat a piece. tags: equal for pieces with one minimizer."""
    slot: dict[bytes, int] = {}
    at = np.fromiter((slot.setdefault(p, len(slot)) for p in pieces), np.int64, len(pieces))
    least = np.full(len(slot), np.iinfo(np.int64).max)
    np.minimum.at(least, at, docs)
    tag = np.zeros(len(slot), tags.dtype)
    tag[at] = tags
    own = np.zeros(len(slot), np.uint64)
    _, group, count = np.unique(tag, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[group] > 1)
    if len(mixed):
        distinct = list(slot)
        own[mixed] = masks([distinct[k] for k in mixed], least[mixed], length)
    return np.where(docs > least[at], ALL, own[at])


def suffix_dedup(docs: DataFrame, length: int = 50, as_text: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document. as_text: kept is a string, without the rests of
    characters that were cut. carried: string columns that each row takes along."""
    batches = packed(texts(docs, *carried), carried)
    total = batches.agg(F.sum("size")).first()[0] or 0
    buckets = max(24, -(-total // BUCKET_BYTES))
    tasks = -(-buckets // -(-buckets // TASKS))
    squeeze, level, most_kinds = zstandard.ZstdCompressor, 3, HOT

    def dealt_out(rows):
        """Rows by bucket; each task takes equally many buckets, where a hash of their numbers would leave it to chance."""
        rows = rows.withColumn("task", (F.col("bucket") % tasks).cast("int"))
        return rows.repartitionById(tasks, F.col("task")).groupBy("task", "bucket")

    def send_keys(parts):
        for pdf in parts:
            for r in pdf.itertuples():
                keys, twice, _, kinds = Batch(r.ids, r.lens, r.data, length).keys()
                kinds = np.minimum(kinds, 65535).astype("<u2")
                yield pd.DataFrame(
                    [(b, r.batch, five(keys[p], buckets), np.packbits(twice[p]).tobytes(), kinds[p].tobytes()) for b, p in by_bucket(keys, buckets)],
                    columns=["bucket", "batch", "keys", "twice", "kinds"],
                )

    def answer_keys(pdf):
        each = [unfive(x) for x in pdf["keys"]]
        sizes = np.array([len(x) for x in each])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(pdf["twice"], sizes, strict=True)])
        every = np.concatenate(each)
        order = np.argsort(every, kind="stable")
        k = every[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(k)))
        hit = np.zeros(len(k), bool)
        hit[order] = np.repeat((size > 1) | (np.maximum.reduceat(twice[order], start) > 0), size)
        kinds = np.frombuffer(b"".join(pdf["kinds"]), "<u2").astype(np.int64)
        hot = np.zeros(len(k), bool)
        hot[order] = np.repeat(np.add.reduceat(kinds[order], start) > most_kinds, size)
        bits, hots = ([np.packbits(x).tobytes() if x.any() or not few else b"" for x in np.split(y, np.cumsum(sizes)[:-1])] for y, few in ((hit, False), (hot, True)))
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "bits": bits, "hot": hots})

    sent = batches.select("batch", "ids", "lens", "data").mapInPandas(send_keys, "bucket long, batch long, keys binary, twice binary, kinds binary")
    answers = dealt_out(sent).applyInPandas(answer_keys, "batch long, bucket long, bits binary, hot binary")
    shared = stage_table(answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("bits")), "shared")
    known = batches.join(shared, "batch", "left").select("batch", "ids", "lens", "data", "more", "bits")

    def wanted(r):
        """A batch, its pieces whose minimizer is shared, and for each of them its slot; slots by bucket. And the
        strings of hot minimizers: places, documents, slots, hashes of slots; slots by bucket."""
        batch = Batch(r.ids, r.lens, r.data, length)
        keys, _, place, _ = batch.keys()
        bits = {x["bucket"]: x for x in r.bits} if r.bits is not None else {}
        hit, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for b, p in by_bucket(keys, buckets):
            hit[p] = np.unpackbits(np.frombuffer(bits[b]["bits"], np.uint8), count=len(p)).astype(bool)
            if bits[b]["hot"]:
                hot[p] = np.unpackbits(np.frombuffer(bits[b]["hot"], np.uint8), count=len(p)).astype(bool)
        places, docs, h = batch.strings_at(np.flatnonzero((hit & hot)[place]) if len(keys) else place)
        one, string = distinct(h)
        lone = places, docs, string, h[one], by_bucket(h[one, 0], buckets)
        use = np.flatnonzero((hit & ~hot)[place]) if len(keys) else place
        start, end = batch.start[use], batch.start[use] + batch.strings[use] + length - 1
        slot: dict[bytes, int] = {}
        data = batch.data
        at = np.fromiter((slot.setdefault(data[s:e], len(slot)) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(use))
        key = np.zeros(len(slot), np.uint64)
        key[at] = batch.key[use]
        least = least_of(at, batch.ids[batch.doc[use]], len(slot))
        return batch, use, at, list(slot), key, least, by_bucket(key, buckets), lone

    def send_pieces(parts):
        small = squeeze(level=level)
        for pdf in parts:
            for r in pdf.itertuples():
                _, _, _, pieces, key, least, dealt, (_, docs, string, h, alone) = wanted(r)
                first = least_of(string, docs, len(h))
                rows = [(buckets + b, r.batch, h[p].astype("<u8").tobytes(), b"", b"", first[p].astype("<i8").tobytes()) for b, p in alone]
                for b, p in dealt:
                    some = [pieces[k] for k in p]
                    rows.append((b, r.batch, small.compress(b"".join(some)), np.array([len(x) for x in some], np.uint8).tobytes(), mix64(key[p]).astype("<u4").tobytes(), least[p].astype("<i8").tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "batch", "data", "lens", "tags", "docs"])

    def answer_strings(pdf):
        h = np.frombuffer(b"".join(pdf["data"]), "<u8").reshape(-1, 2)
        one, at = distinct(h)
        least = least_of(at, np.frombuffer(b"".join(pdf["docs"]), "<i8"), len(one))[at]
        cuts = np.cumsum(pdf["docs"].map(len).to_numpy() // 8)[:-1]
        small = squeeze(level=level)
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "masks": [small.compress(x.astype("<i8").tobytes()) for x in np.split(least, cuts)]})

    def answer_pieces(pdf):
        if pdf["bucket"].iloc[0] >= buckets:
            return answer_strings(pdf)
        small, pieces, sizes = zstandard.ZstdDecompressor(), [], []
        for data, lens in zip(pdf["data"], pdf["lens"], strict=True):
            data, at = small.decompress(data), 0
            for n in lens:
                pieces.append(data[at : at + n])
                at += n
            sizes.append(len(lens))
        tags = np.frombuffer(b"".join(pdf["tags"]), "<u4")
        docs = np.frombuffer(b"".join(pdf["docs"]), "<i8").astype(np.int64)
        out = judged(pieces, tags, docs, length)
        small = squeeze(level=level)
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "masks": [small.compress(x.tobytes()) for x in np.split(out, np.cumsum(sizes)[:-1])]})

    pieces = known.mapInPandas(send_pieces, "bucket long, batch long, data binary, lens binary, tags binary, docs binary")
    answers = dealt_out(pieces).applyInPandas(answer_pieces, "batch long, bucket long, masks binary")
    answers = stage_table(answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks")), "masks")

    def cut(parts):
        small = zstandard.ZstdDecompressor()
        for pdf in parts:
            for r in pdf.itertuples():
                batch, use, at, pieces, _, least, dealt, (places, docs, string, h, alone) = wanted(r)
                own = np.zeros(len(pieces), np.uint64)
                found = {x["bucket"]: x["masks"] for x in r.masks} if r.masks is not None else {}
                for b, p in dealt:
                    own[p] = np.frombuffer(small.decompress(found[b]), np.uint64)
                mask = np.where(batch.ids[batch.doc[use]] > least[at], ALL, own[at]) if len(use) else own
                n = len(batch.data)
                step = np.zeros(n + 1, np.int32)
                first = np.zeros(len(h), np.int64)
                for b, p in alone:
                    first[p] = np.frombuffer(small.decompress(found[buckets + b]), "<i8")
                later = places[docs > first[string]]
                np.add.at(step, later, 1)
                np.add.at(step, later + length, -1)
                full = np.flatnonzero(mask == ALL)  # at most `strings` of them count
                np.add.at(step, batch.start[use[full]], 1)
                np.add.at(step, batch.start[use[full]] + batch.strings[use[full]] + length - 1, -1)
                some = np.flatnonzero((mask != 0) & (mask != ALL))
                for k in range(MOST):
                    here = some[(mask[some] >> np.uint64(k)) & np.uint64(1) == 1]
                    s = batch.start[use[here]] + k
                    np.add.at(step, s, 1)
                    np.add.at(step, s + length, -1)
                gone = np.cumsum(step)[:n] > 0
                data, rows, at_byte = np.frombuffer(batch.data, np.uint8), [], 0
                more = json.loads(small.decompress(r.more))
                for doc_id, size, other in zip(batch.ids.tolist(), batch.lens.tolist(), more, strict=True):
                    g = gone[at_byte : at_byte + size]
                    removed = int(np.count_nonzero(g))
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if removed else 0
                    kept = batch.data[at_byte : at_byte + size] if not removed else data[at_byte : at_byte + size][~g].tobytes()
                    rows.append((doc_id, size, removed, spans, kept.decode("utf-8", "ignore") if as_text else kept, *other))
                    at_byte += size
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carried])

    result = ", ".join([RESULT.replace("kept binary", "kept string") if as_text else RESULT, *(f"{c} string" for c in carried)])
    return known.join(answers, "batch", "left").select("batch", "ids", "lens", "data", "more", "bits", "masks").mapInPandas(cut, result)
