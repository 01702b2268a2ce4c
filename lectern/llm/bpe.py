"""Byte-level BPE ids of whole texts.

The vocabulary's library cuts a text into words and merges them outside of Python, and hands the ids over in one buffer.
So a new word costs no more than a known one, and nothing is kept from one text to the next.

Cases: on request, special tokens of the vocabulary that a text spells out are taken as their ids, as the vocabulary's own
library does; a run of white space that is too long for the library's pattern (a million characters) is cut out, and
merged as the one word that it is; an empty text has no ids.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space of the library's pattern
LONG_RUN = re.compile(f"(?<![{SPACE}])([{SPACE}]{{1000,}})(?![^{SPACE}])")  # the last blank goes with a word after it


class ByteBPE:
    """encode_bytes(text): the ids as little-endian unsigned integers of the given width. special: with the special
    tokens of the JSON file beside the rank file."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken", width: int = 4, special: bool = False):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special: dict[str, int] = {}
        about = public_tokenizers.path(os.path.splitext(name)[0] + ".json")
        if special and os.path.exists(about):
            with open(about, encoding="utf-8") as f:
                self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        # without any special token the library stops at each character to look for one: this one is never allowed
        named = self.special or {"<|none|>": max(ranks.values()) + 1}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=named)
        self.allowed = frozenset(self.special)
        self.dtype = np.dtype(f"<u{width}")
        either = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.split = re.compile(f"({either})").split if either else lambda text: [text]

    def encode_bytes(self, text: str) -> bytes:
        try:
            ids = self.encoding.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:  # the pattern cannot go back over a long run
            ids = np.array(self.in_parts(text), np.uint32)
        return ids.astype(self.dtype, copy=False).tobytes()

    def in_parts(self, text: str) -> list[int]:
        out = []
        for k, part in enumerate(self.split(text)):  # every second one is a special token
            if k % 2:
                out.append(self.special[part])
                continue
            for j, x in enumerate(LONG_RUN.split(part)):  # every second one is a run
                out += self.encoding._encode_single_piece(x) if j % 2 else self.encoding.encode_ordinary(x)
        return out


_loaded: dict[tuple, ByteBPE] = {}


def byte_bpe(name: str = "byte_bpe_50k.tiktoken", width: int = 4, special: bool = False) -> ByteBPE:
    """One encoder for each Python worker."""
    if (name, width, special) not in _loaded:
        _loaded[name, width, special] = ByteBPE(name, width, special)
    return _loaded[name, width, special]
