"""SentencePiece encoding and decoding of whole tables by a batched Viterbi search in numpy.

No piece spans the place before a word's blank mark, so a text is encoded word by word, and each distinct word of a
batch once. Words of one length class (equal up to 31 characters, within a sixteenth beyond, and then filled up with a
code that no piece holds) form a matrix of code points and advance together: at each end place, hashes of the substrings
that end there probe the sorted keys of the pieces, and maxima over the piece lengths store backpointers. A unigram model
maximises the sum of scores. A BPE model (such as the public one used here) is no sum of scores: a segmentation is the one
that merging gives exactly if each two neighbours stay apart when merged by themselves, so a step is allowed only from a
prefix whose last piece is compatible, and one path remains. Characters without a piece become byte pieces. Classes of
fewer than TOGETHER words (such as a whole text without blanks) share one row: their substrings are probed for a slice of
places at once, and the same maxima are taken place by place, which gives the same ids (tested at both sides).

Cases: null and empty texts have no pieces; a text that holds the blank mark U+2581 itself decodes to blanks;
repeated rows are encoded one by one; a text of any length is encoded whole, also as a single word, in memory of some
100 bytes and time of some 5 microseconds a character; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import texts

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
LETTER, STOPS = r"[^\W\d_²]", ".,!?|"
#: words that also end before a stop, where no piece of the model goes from a letter to a stop
SHORT_WORDS = re.compile(f"{MARK}*(?:[^{MARK}\n{STOPS}]*{LETTER}(?=[{STOPS}])|[^{MARK}\n]+)|{MARK}+|\n")
CACHE_WORDS = 300_000
CHUNK_CHARS = 1 << 20
TOGETHER, SLICE, FILL = 64, 1 << 16, 0x110000
TABLE_BITS = 18
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def length_class(n: int) -> int:
    """The greatest length that shares n's class: n itself up to 31, at most a sixteenth more beyond."""
    spare = max(0, n.bit_length() - 5)
    return -(-n >> spare) << spare


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _merge(word: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Symbols that merging leaves of a word, and the last merge."""
    parts, last = list(word), None
    while len(parts) > 1:
        r, k = min((rank.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
        if r == 1 << 60:
            break
        last = (parts[k], parts[k + 1])
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts, last


class PieceModel:
    """The tables of a model file. Ranks of a BPE model: 0 for the first merge."""

    def __init__(self, name: str = "piece_bpe_32k.model", unigram: bool = False):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = sp.get_piece_size()
        self.unigram, self.bytes, self.table = unigram, np.zeros(256, np.int64), []
        pieces: dict[str, int] = {}
        for k in range(n):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k):
                self.table.append(b"")
            else:
                pieces[piece] = k
                self.table.append(piece.replace(MARK, " ").encode())
        self.score = np.array([sp.get_score(k) for k in range(n)])
        order = sorted(pieces, key=lambda p: (-self.score[pieces[p]], pieces[p]))
        rank = {p: r for r, p in enumerate(order) if len(p) > 1}
        self.rank = np.full(n, -1, np.int64)  # single characters come before all merges
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        usable = {}
        for p, k in pieces.items():
            if len(p) == 1 or unigram:
                usable[p] = k
                continue
            parts, last = _merge(p, rank)
            if len(parts) == 1:  # else merging never makes this piece
                usable[p] = k
                self.rank[k], self.left[k], self.right[k] = rank[p], pieces[last[0]], pieces[last[1]]
        joins = [(pieces[p[:c]] * n + pieces[p[c:]], rank[p]) for p in rank for c in range(1, len(p)) if p[:c] in pieces and p[c:] in pieces]
        joins = np.array(sorted(joins), np.int64).reshape(-1, 2)
        self.join_key, self.join_rank = joins[:, 0], joins[:, 1]
        self.one_by_one: tuple | None = None
        self.n, self.longest = n, max(map(len, usable))
        self.words = WORDS if any(re.search(f"{LETTER}[{STOPS}]", p) for p in pieces) else SHORT_WORDS
        # sorted piece keys of each size, and a table of bits that turns most substrings away before the search
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.uint64]] = {}
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        for size in sorted({len(p) for p in usable}):
            found = [(p, k) for p, k in usable.items() if len(p) == size]
            codes = np.array([[ord(c) for c in p] for p, _ in found], np.uint64).reshape(-1, size)
            h = np.zeros(len(found), np.uint64)
            for c in range(size):
                h = h * _BASE + codes[:, c] + np.uint64(1)
            salt = np.uint64(size * int(_BASE) & ((1 << 64) - 1))
            by = np.argsort(h)
            self.keys[size] = h[by], np.array([k for _, k in found], np.int64)[by], salt
            self.maybe[self.place(h, salt)] = True

    @staticmethod
    def place(h: np.ndarray, salt: np.uint64) -> np.ndarray:
        return ((h + salt) * _MIX) >> np.uint64(64 - TABLE_BITS)

    def find(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which substring hashes are those of pieces of this size, and the pieces."""
        keys, ids, salt = self.keys[size]
        rows = np.flatnonzero(self.maybe[self.place(h, salt)])
        p = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
        same = keys[p] == h[rows]
        return rows[same], ids[p[same]]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of pieces a and b gives just a and b: both are taken apart, the newest merge
        first, and no symbols that meet at the border may have joined before that merge."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        r, l, limit = a.copy(), b.copy(), np.full(len(a), 1 << 60)
        while len(at):
            key = r * self.n + l
            p = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            joined = (self.join_key[p] == key) & (self.join_rank[p] < limit)
            ok[at[joined]] = False
            undo_a = self.rank[r] > self.rank[l]
            go = ~joined & (np.maximum(self.rank[r], self.rank[l]) >= 0)
            limit = np.where(undo_a, self.rank[r], self.rank[l] + 1)[go]
            r, l = np.where(undo_a, self.right[r], r)[go], np.where(undo_a, l, self.left[l])[go]
            at = at[go]
        return ok

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of many words of one length class, by Viterbi."""
        lengths = np.array([len(w) for w in words])
        size, m = int(lengths.max()), len(words)
        codes = np.full((m, size), FILL, np.uint64)
        codes[np.arange(size) < lengths[:, None]] = code_points(words)
        prefix = np.zeros((size + 1, m), np.uint64)
        for k in range(size):
            prefix[k + 1] = prefix[k] * _BASE + codes[:, k] + np.uint64(1)
        power = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _BASE, np.uint64)))
        best = np.full((size + 1, m), -np.inf)
        best[0] = 0
        piece = np.full((size + 1, m), -2, np.int64)  # -1: a character without a piece
        step = np.zeros((size + 1, m), np.int64)
        for end in range(1, size + 1):
            rows, ids, sizes = [], [], []
            for k in self.keys:
                if k > end:
                    break
                hit, found = self.find(prefix[end] - prefix[end - k] * power[k], k)
                if k == 1:
                    lone = np.ones(m, bool)
                    lone[hit] = False
                    lone = np.flatnonzero(lone)
                    piece[end, lone], step[end, lone] = -1, 1
                    best[end, lone] = best[end - 1, lone] - (1e4 if self.unigram else 0)
                ok = best[end - k, hit] > -np.inf
                rows.append(hit[ok])
                ids.append(found[ok])
                sizes.append(np.full(len(rows[-1]), k))
            rows, ids, sizes = (np.concatenate(x) for x in (rows, ids, sizes))
            before = best[end - sizes, rows]
            if self.unigram:
                value = before + self.score[ids]
            else:
                last = piece[end - sizes, rows]
                free = (sizes == end) | (last < 0)
                pair = np.where(free, 0, last * self.n + ids)
                kinds, at = np.unique(pair, return_inverse=True)
                fine = self.compatible(kinds // self.n, kinds % self.n)[at] | free
                value = np.where(fine, before, -np.inf)
            top = best[end].copy()
            np.maximum.at(top, rows, value)
            won = np.flatnonzero((value == top[rows]) & (value > -np.inf))
            best[end], piece[end, rows[won]], step[end, rows[won]] = top, ids[won], sizes[won]
        at, trail = lengths.copy(), []
        while (live := np.flatnonzero(at > 0)).size:
            trail.append((live, piece[at[live], live], at[live]))
            at[live] -= step[at[live], live]
        word, ids, ends = (np.concatenate(x) for x in zip(*reversed(trail), strict=True))
        order = np.argsort(word, kind="stable")  # the trail was walked from the end
        word, ids, ends = word[order], ids[order], ends[order]
        cuts = np.cumsum(np.bincount(word, minlength=m))[:-1]
        lone = set(word[ids < 0].tolist())
        raw, stops = ids.astype("<u4").tobytes(), [0, *cuts.tolist(), len(ids)]
        out = [raw[4 * a : 4 * b] for a, b in zip(stops, stops[1:])]
        for w in lone:
            part = []
            for k, e in zip(ids[stops[w] : stops[w + 1]].tolist(), ends[stops[w] : stops[w + 1]].tolist(), strict=True):
                part += [k] if k >= 0 else self.bytes[list(words[w][e - 1].encode("utf-8", "surrogatepass"))].tolist()
            out[w] = np.array(part, "<u4").tobytes()
        return out

    def _joins(self):
        """Whether merging keeps pieces a and b apart, for one pair; from plain dictionaries, made when first needed."""
        if self.one_by_one is None:
            self.one_by_one = dict(zip(self.join_key.tolist(), self.join_rank.tolist(), strict=True)), self.rank.tolist(), self.left.tolist(), self.right.tolist(), {}
        joins, rank, left, right, known = self.one_by_one
        n = self.n

        def apart(a: int, b: int) -> bool:
            key = a * n + b
            if (got := known.get(key)) is not None:
                return got
            r, l, limit, ok = a, b, 1 << 60, True
            while True:
                if joins.get(r * n + l, limit) < limit:
                    ok = False
                    break
                if rank[r] < 0 and rank[l] < 0:
                    break
                if rank[r] > rank[l]:
                    r, limit = right[r], rank[r]
                else:
                    l, limit = left[l], rank[l] + 1
            if len(known) > CACHE_WORDS:
                known.clear()
            known[key] = ok
            return ok

        return apart

    def encode_few(self, words: list[str]) -> list[bytes]:
        """The same for few words, of any lengths: one row of all their characters, with FILL after each word."""
        ends_of = np.cumsum([len(w) for w in words])
        codes = np.insert(code_points(words), ends_of, np.uint64(FILL)) + np.uint64(1)
        n = len(codes)
        fills = set((ends_of + np.arange(1, len(words) + 1)).tolist())
        piece, step, best = [-2] * (n + 1), [0] * (n + 1), [0.0] * (n + 1 if self.unigram else 0)
        apart, score = self._joins(), self.score.tolist() if self.unigram else []
        for low in range(0, n, SLICE):
            high, begin = min(n, low + SLICE), max(0, low - self.longest)
            ends, found, sizes = [], [], []
            h = np.zeros(high - begin, np.uint64)
            for k in range(1, min(self.longest, high - begin) + 1):
                h = h[: high - begin - k + 1] * _BASE + codes[begin + k - 1 : high]
                if k in self.keys:
                    rows, ids = self.find(h, k)
                    inside = begin + rows + k > low
                    ends.append(begin + rows[inside] + k)
                    found.append(ids[inside])
                    sizes.append(np.full(int(inside.sum()), k))
            ends, found, sizes = (np.concatenate(x) for x in (ends, found, sizes))
            order = np.lexsort((sizes, ends))
            cuts = np.searchsorted(ends[order], np.arange(low + 1, high + 2)).tolist()
            found, sizes = found[order].tolist(), sizes[order].tolist()
            for end in range(low + 1, high + 1):
                here = range(cuts[end - low - 1], cuts[end - low])
                if not here or sizes[here[0]] > 1:  # the character has no piece
                    piece[end], step[end] = -1, 1
                    if self.unigram:
                        best[end] = 0.0 if end in fills else best[end - 1] - 1e4
                elif self.unigram:
                    best[end] = float("-inf")
                for e in here:
                    size, one = sizes[e], found[e]
                    if self.unigram:
                        if (value := best[end - size] + score[one]) >= best[end]:
                            best[end], piece[end], step[end] = value, one, size
                        continue
                    before = piece[end - size]
                    if size == end or before == -1 or before >= 0 and apart(before, one):
                        piece[end], step[end] = one, size
        out, start = [], 0
        for word in words:
            ids, at = [], start + len(word)
            while at > start:
                if piece[at] >= 0:
                    ids.append(piece[at])
                else:
                    ids += self.bytes[list(word[at - start - 1].encode("utf-8", "surrogatepass"))].tolist()[::-1]
                at -= step[at]
            out.append(np.array(ids[::-1], "<u4").tobytes())
            start += len(word) + 1
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


class Encoder:
    """encode(texts) -> ids of each as little-endian 32-bit bytes; remembers a bounded number of words."""

    def __init__(self, name: str = "piece_bpe_32k.model", unigram: bool = False):
        self.model = PieceModel(name, unigram)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, rows: list[str]) -> list[bytes]:
        find = self.model.words.findall
        split = [find(MARK + t.replace(" ", MARK)) if t else [] for t in rows]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        new = set().union(*split) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        by_size: dict[int, list[str]] = {}
        for w in new - again:
            by_size.setdefault(length_class(len(w)), []).append(w)
        few = []
        for size, words in by_size.items():
            if len(words) < TOGETHER:
                few += words
                continue
            most = max(TOGETHER, 400_000 // size)
            for s in range(0, len(words), most):
                part = words[s : s + most]
                self.known.update(zip(part, self.model.encode_words(part), strict=True))
        if few:
            self.known.update(zip(few, self.model.encode_few(few), strict=True))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in split]


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str, unigram: bool = False) -> Encoder:
    if (name, unigram) not in _encoders:
        _encoders[name, unigram] = Encoder(name, unigram)
    return _encoders[name, unigram]


def _chunks(rows: list[str]):
    start, size = 0, 0
    for k, t in enumerate(rows):
        size += len(t)
        if size >= CHUNK_CHARS or k + 1 == len(rows):
            yield start, rows[start : k + 1]
            start, size = k + 1, 0


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", unigram: bool = False) -> DataFrame:
    """(doc_id, ids binary): the ids of each text as little-endian unsigned 32-bit numbers."""

    def run(batches):
        codec = encoder(model, unigram)
        for pdf in batches:
            rows, ids = pdf["text"].tolist(), pdf["doc_id"]
            for start, part in _chunks(rows):
                yield pd.DataFrame({"doc_id": ids[start : start + len(part)], "ids": codec.encode(part)})

    return texts(docs).mapInPandas(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids)."""

    def run(batches):
        codec = encoder(model).model
        for pdf in batches:
            yield pdf.assign(text=[codec.decode(np.frombuffer(x, "<u4")) for x in pdf["ids"]])

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids binary, text string")


def codec_digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text_sha256) of encoded and decoded documents."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
