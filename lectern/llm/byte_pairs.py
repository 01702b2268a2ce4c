"""Byte-pair encoding and decoding of whole tables by batched merge rounds in numpy.

A text is cut at its special tokens and then into words by the vocabulary's pattern; each distinct word of a batch is
encoded once. The symbols of all these words lie in one flat array, linked to their neighbours; the ranks of all pairs
come from a binary search over the sorted pair keys. A round merges every place of the lowest rank that is left, in all
words at once (of overlapping places, the first), and looks the pairs up that it made. Words do not touch, and a pair
that holds a merged symbol ranks after the merge that made it, so these rounds give each word what merging its own
lowest pair first gives. A vocabulary without that order of ranks is refused. A round costs what it merges, so a word
of any length takes time in proportion to its bytes.

Cases: null and empty texts have no tokens; special tokens that a text spells out become their ids, as in the
vocabulary's own library; decoding leaves out ids that the vocabulary lacks and puts U+FFFD for bytes that are no UTF-8;
repeated rows are encoded one by one; a text of any length is encoded whole, in some 60 bytes of memory for each byte of
its distinct words; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import texts

CACHE_WORDS = 300_000
CACHE_CHARS = 64  # longer words are encoded each time
CHUNK_BYTES = 1 << 21  # words of so many bytes are merged at once


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's strings: visible Latin-1 characters for themselves,
    the other bytes in order from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(other)}


def newer_letters() -> str:
    """Letters and digits of a newer Unicode than Python's own. The pattern's library here may know them earlier than the
    vocabulary's library does, so a text that holds one of them is cut by the latter."""
    import regex

    new = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    codes = np.array([*map(ord, regex.findall(r"[\p{L}\p{N}]", new)), 0x110000])
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)[:-1]
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) or "\0"


class PairModel:
    """The tables of a vocabulary file."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            about = json.load(f)
        vocab: dict[str, int] = about["model"]["vocab"]
        letters = byte_letters()
        self.pattern = regex.compile(public_tokenizers.PATTERN).findall
        newer = newer_letters()
        self.later, self.newer = re.compile(f"[{newer[0]}-\U0010ffff]").search, re.compile(f"[{newer}]").search
        self.special = {t["content"]: t["id"] for t in about["added_tokens"]}
        either = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.split = re.compile(f"({either})").split if either else lambda text: [text]
        self.n = 1 + max([*vocab.values(), *self.special.values()])
        self.table = [b""] * self.n
        for token, k in vocab.items():
            self.table[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            self.table[k] = token.encode()
        self.first = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in about["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.whole = np.array([vocab[a + b] for a, b in pairs], np.int32)
        made = np.full(self.n, -1, np.int64)
        made[self.whole] = np.arange(len(pairs))
        if len(pairs) and (np.maximum(made[self.left], made[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge of this vocabulary comes before the merges that make its parts")
        keys = self.left.astype(np.int64) * self.n + self.right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def words(self, text: str) -> list[str]:
        if text.isascii() or not self.later(text) or not self.newer(text):
            return self.pattern(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by binary search; -1 for pairs that do not merge."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(-1))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of words without empty ones."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        sym = np.append(self.first[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))  # the last one is nobody's
        after = np.arange(1, n + 1, dtype=np.int32)  # n: no neighbour
        after[ends - 1] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[0] = before[ends[:-1]] = n
        place = np.flatnonzero(after < n).astype(np.int32)
        rank = self.rank(sym[place], sym[after[place]])
        place, rank = place[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        place, rank = place[order], rank[order]
        todo, starts = np.unique(rank, return_index=True)
        given = dict(zip(todo.tolist(), np.split(place, starts[1:]), strict=True)) if len(todo) else {}
        queue, later = todo.tolist(), {}
        while queue:
            r = heapq.heappop(queue)
            at = given.pop(r, None)
            if (more := later.pop(r, None)) is not None:
                more = np.array(more, np.int32)
                at = np.unique(more if at is None else np.concatenate([at, more]))
            a, b, whole = self.left[r], self.right[r], self.whole[r]
            mate = after[at]
            fine = (sym[at] == a) & (sym[mate] == b)  # not merged otherwise meanwhile
            at, mate = at[fine], mate[fine]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of overlapping places, every second one
                fresh = np.append(True, mate[:-1] != at[1:])
                k = np.arange(len(at))
                even = (k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0
                at, mate = at[even], mate[even]
            follow = after[mate]
            sym[at], sym[mate] = whole, -1
            after[at] = follow
            inner = follow < n
            before[follow[inner]] = at[inner]
            prior = before[at]
            prior = prior[prior < n]
            place = np.concatenate([prior, at[inner]])
            rank = self.rank(sym[place], sym[after[place]])
            hit = np.flatnonzero(rank >= 0)
            for k, p in zip(rank[hit].tolist(), place[hit].tolist(), strict=True):
                if (found := later.get(k)) is not None:
                    found.append(p)
                else:
                    later[k] = [p]
                    if k not in given:
                        heapq.heappush(queue, k)
        kept = sym[:n] >= 0
        raw = sym[:n][kept].astype("<u4").tobytes()
        stops = [0, *(4 * np.cumsum(kept)[ends - 1]).tolist()]
        return [raw[s:e] for s, e in zip(stops, stops[1:])]

    def decode(self, ids: np.ndarray) -> str:
        known = ids[ids < self.n] if len(ids) and ids.max() >= self.n else ids
        return b"".join(map(self.table.__getitem__, known.tolist())).decode("utf-8", "replace")


class Encoder:
    """encode(texts) -> ids of each as little-endian 32-bit bytes; remembers a bounded number of words."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.model = PairModel(name)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if not any(t in text for t in self.model.special):
            return self.model.words(text)
        out = []
        for k, part in enumerate(self.model.split(text)):  # every second one is a special token
            out += [part] if k % 2 else self.model.words(part)
        return out

    def encode(self, rows: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in rows]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        for t, k in self.model.special.items():
            self.known[t] = np.array([k], "<u4").tobytes()
        new = set().union(*split) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        part, size, long = [], 0, []
        for w in new - again:
            part.append(w)
            size += len(w)
            if len(w) > CACHE_CHARS:
                long.append(w)
            if size >= CHUNK_BYTES:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in split]
        for w in long:
            del self.known[w]
        return out

    def _learn(self, words: list[str]) -> None:
        self.known.update(zip(words, self.model.encode_words([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, ids binary): the ids of each text as little-endian unsigned 32-bit numbers."""

    def run(batches):
        codec = encoder(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": codec.encode(pdf["text"].tolist())})

    return texts(docs).mapInPandas(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids)."""

    def run(batches):
        model = encoder(vocabulary).model
        for pdf in batches:
            yield pdf.assign(text=[model.decode(np.frombuffer(x, "<u4")) for x in pdf["ids"]])

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids binary, text string")


def codec_digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded documents."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
