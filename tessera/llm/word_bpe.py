"""Ids of a word-level BPE vocabulary file (lower case, NFC, white space dropped, word ends marked).

The ``tokenizers`` file is read and its merges are run by ``tiktoken``: a marker byte stands for the word end, so that
the suffix joins the last byte first, as there. Texts with special strings or with characters that Python's Unicode
tables do not know (the library's may be newer), and units with the marker, go through ``tokenizers`` itself. Tests
compare ids with that library, over all code points too.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from .token_counts import byte_alphabet
from .units import UnitEncoder, text_blocks

_MARK = "\x01"
#: Contractions of the pre-tokenizer (fixed values of the vocabulary file).
_SHORT, _LONG = "stmd", ("re", "ve", "ll")
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, of each code point."""
    if not _kinds:
        import regex

        table, every = np.full(0x110000, 3, np.uint8), "".join(map(chr, range(0x110000)))
        for kind, pattern in ((0, r"\p{White_Space}+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _kinds.append(table)
    return _kinds[0]


#: Finds a character from U+0378 on, the first that is not assigned.
_BEYOND = re.compile("[^\x00-\u0377]")


@functools.lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Which code points Python's Unicode tables do not know."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


def strange(text: str) -> bool:
    """Whether a text holds a character that Python's Unicode tables do not know."""
    if text.isascii() or not _BEYOND.search(text):
        return False
    return bool(unassigned()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def cut(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds()[points]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    opens = np.zeros(n + 1, bool)
    opens[offsets[:-1]] = True
    start |= opens[:n]
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        first = opens[quotes] | (kind[np.maximum(quotes - 1, 0)] != 3) | (quotes == 0)
        quotes = quotes[first]
        ends = offsets[np.searchsorted(offsets, quotes, "right")]  # of their texts
        one = np.where(quotes + 1 < ends, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 < ends, points[np.minimum(quotes + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in _SHORT]), 2, 0)
        for a, b in _LONG:
            size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
        hit = size > 0
        quotes, after, ends = quotes[hit], (quotes + size)[hit], ends[hit]
        start[quotes + 1] = False
        after = after[after < ends]
        start[after[kind[after] == 1]] = True
    edge = start.copy()
    edge[1:] |= (kind[1:] == 0) & (kind[:-1] != 0)
    begin = np.flatnonzero(edge)
    finish = np.r_[begin[1:], n]
    word = kind[begin] != 0
    return begin[word], finish[word]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> WordBpe:
    """One encoder, and so one cache, for all tasks of a worker."""
    return WordBpe(path)


class WordBpe:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix, alphabet = model["end_of_word_suffix"], byte_alphabet()
        if model["type"] != "BPE" or not suffix or model["continuing_subword_prefix"]:
            raise ValueError("a word-level BPE file is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]

        def raw(piece: str) -> bytes:
            tail = piece.endswith(suffix)
            return bytes(alphabet[c] for c in (piece[: -len(suffix)] if tail else piece)) + (_MARK.encode() if tail else b"")

        order = [bytes([b]) for b in range(256)] + [bytes([b]) + _MARK.encode() for b in range(256)]
        seen = set(order)
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            piece = raw(a + b)
            if piece not in seen:
                seen.add(piece)
                order.append(piece)
        vocab = {raw(p): i for p, i in model["vocab"].items() if p not in self.special}
        self.id_of = np.array([vocab.get(p, -1) for p in order], np.int32)
        self.ends = np.array([p.endswith(_MARK.encode()) and len(p) > 1 for p in order])
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks={p: i for i, p in enumerate(order)}, special_tokens={})
        self.units = UnitEncoder(cut, self._encode)

    @functools.cached_property
    def slow(self) -> Tokenizer:
        """The library's tokenizer, loaded where a text needs it."""
        return Tokenizer.from_file(self.path)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, w in enumerate(words) if _MARK in w]
        plain = [w for w in words if _MARK not in w] if odd else words
        ranks = np.array(self.fast.encode_ordinary(_MARK.join([*plain, ""])), np.int64)
        ids, last = self.id_of[ranks], np.flatnonzero(self.ends[ranks])
        count = np.diff(np.r_[-1, last])
        if odd:  # words that hold the marker itself
            parts, at, k = [], np.r_[0, np.cumsum(count)], 0
            for i, w in enumerate(words):
                if _MARK in w:
                    parts.append(np.array(self.slow.encode(w, add_special_tokens=False).ids, np.int32))
                else:
                    parts.append(ids[at[k] : at[k + 1]])
                    k += 1
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, count

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens added."""
        out: list[np.ndarray] = []
        for a, b in text_blocks(texts):
            part = texts[a:b]
            slow = {i for i, t in enumerate(part) if any(s in t for s in self.special) or strange(t)}
            plain = ["" if i in slow else (t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).replace("Σ", "σ").lower() for i, t in enumerate(part)]
            ids, bounds = self.units.ids(plain)
            out += [np.array(self.slow.encode(part[i], add_special_tokens=False).ids, np.int32) if i in slow else ids[bounds[i] : bounds[i + 1]] for i in range(len(part))]
        return out
