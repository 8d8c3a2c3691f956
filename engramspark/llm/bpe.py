"""Byte-level BPE over whole texts: cut into pieces with numpy, each distinct piece encoded once per worker.

The ids are those of the tokenizers library for the vocabulary file (tests compare them): added tokens such as <|endoftext|> are cut out
first, wherever they stand; a piece is what the pre-tokenizer (contractions, letters, digits, other, white space, each with one
space before) makes of what is between them."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import words as W

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
#: Distinct pieces that a worker remembers in a table of 2 ** TABLE_BITS places; beyond that it starts anew.
REMEMBERED, TABLE_BITS = 1_500_000, 22


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(None)
def _classes() -> np.ndarray:
    """The class of each code point, from the Unicode categories; white space as regular expressions have it."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = DIGIT
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


@lru_cache(None)
def _ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token; the vocabulary writes bytes as printable characters."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    written = {c: c for c in plain} | {256 + i: c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = {x["content"] for x in model.get("added_tokens", [])}
    return {bytes(written[ord(c)] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}


@lru_cache(None)
def _added(path: str) -> dict[bytes, int]:
    """The added tokens, which are found in a text before it is cut into pieces."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    if any(x.get(flag) for x in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what is beside them are not supported")
    return {x["content"].encode(): x["id"] for x in tokens}


@lru_cache(None)
def _code_point_class_of_ascii() -> np.ndarray:
    return _classes()[:128].copy()


def pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pieces, and each text's n + 1 offsets into them; texts share no piece."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # the byte each code point starts at
    if len(at) == n:
        code = raw
        kind = _code_point_class_of_ascii()[raw]
    else:
        code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = _classes()[code]
    first = np.zeros(len(at) + 1, bool)
    bounds = np.searchsorted(at, offs)
    first[bounds] = True
    text_start, text_end = first[:-1], first[1:]
    change = np.empty(len(at), bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= text_start
    begin = change.copy()
    # the last of white space before something else stands alone, and goes with what follows if it is U+0020
    space = kind == SPACE
    follows = np.zeros(len(at), bool)
    follows[:-1] = ~space[1:] & ~text_end[:-1]
    tail = np.flatnonzero(space & follows)
    begin[tail] = True
    joined = tail[code[tail] == 0x20]
    begin[joined + 1] = False
    # contractions: an apostrophe that begins a piece of its own
    quote = np.flatnonzero(code == 0x27)
    if len(quote):
        quote = quote[begin[quote]]
        for q in quote:
            room = int(bounds[np.searchsorted(bounds, q, side="right")]) - q - 1
            after = "".join(map(chr, code[q + 1 : q + 1 + min(2, room)].tolist()))
            size = 1 if after[:1] in ("s", "t", "m", "d") and after else 2 if after in ("re", "ve", "ll") else 0
            if size:
                begin[q + 1] = False
                if size == 2:
                    begin[q + 2] = False
                if size < room:
                    nxt = q + 1 + size
                    if kind[nxt] == LETTER:
                        begin[nxt] = True
    starts = np.flatnonzero(begin)
    return at[starts], np.searchsorted(starts, bounds)


class Encoder:
    """Encodes blocks of texts; keeps the ids of pieces it has met."""

    def __init__(self, path: str):
        import tiktoken

        ranks, self._added = _ranks(path), _added(path)
        # what it gets is one piece already, so its expression takes all
        self._bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._whole = ranks | self._added
        self._find_added = re.compile(b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if self._added else None
        self.sizes = np.zeros(max(self._whole.values()) + 1, np.int64)
        for token, i in self._whole.items():
            self.sizes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self._table, self._where = np.zeros(1 << TABLE_BITS, W.U64), np.zeros(1 << TABLE_BITS, np.int32)
        self._n, self._used = 0, 0
        self._starts, self._counts, self._ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 17, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Which remembered piece each key is, or -1."""
        last = W.U64((1 << TABLE_BITS) - 1)
        at = keys & last
        found = np.where(self._table[at] == keys, self._where[at], -1)
        left = np.flatnonzero((found < 0) & (self._table[at] != 0))
        while len(left):
            at = (at[left] + W.U64(1)) & last if len(at) == len(keys) else (at + W.U64(1)) & last
            here = self._table[at]
            hit = here == keys[left]
            found[left[hit]] = self._where[at[hit]]
            go = ~hit & (here != 0)
            left, at = left[go], at[go]
        return found

    def _remember(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        counts = np.fromiter(map(len, lists), np.int32, len(lists))
        fresh = np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum()))
        while self._n + len(keys) > len(self._starts):
            self._starts, self._counts = np.concatenate([self._starts, self._starts]), np.concatenate([self._counts, self._counts])
        while self._used + len(fresh) > len(self._ids):
            self._ids = np.concatenate([self._ids, self._ids])
        self._starts[self._n : self._n + len(keys)] = self._used + np.cumsum(counts) - counts
        self._counts[self._n : self._n + len(keys)] = counts
        self._ids[self._used : self._used + len(fresh)] = fresh
        last = W.U64((1 << TABLE_BITS) - 1)
        left, at = np.arange(len(keys)), keys & last
        while len(left):  # of those that want one free place, the last written gets it
            free = self._table[at] == 0
            self._table[at[free]] = keys[left[free]]
            got = self._table[at] == keys[left]
            self._where[at[got]] = self._n + left[got]
            left, at = left[~got], (at[~got] + W.U64(1)) & last
        self._n, self._used = self._n + len(keys), self._used + len(fresh)

    def _one(self, piece: bytes) -> list[int]:
        found = self._whole.get(piece)
        return [found] if found is not None else self._bpe.encode_ordinary(piece.decode())

    def _pieces(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pieces(), with each added token that lies in one text as a piece, and what is before and after it as texts of their own."""
        found = []
        if self._find_added:
            # a match across two texts must not hide one that begins inside it, so each search goes on behind the border
            data, at = raw.tobytes(), 0
            while m := self._find_added.search(data, at):
                border = int(offs[np.searchsorted(offs, m.start(), side="right")])
                if m.end() <= border:
                    found.append(m.span())
                at = m.end() if m.end() <= border else m.start() + 1
        if not found:
            return pieces(raw, offs)
        spans = np.array(found, np.int64)
        starts, _ = pieces(raw, np.unique(np.concatenate([offs, spans.ravel()])))
        inside = np.searchsorted(spans[:, 0], starts, side="left") - 1
        starts = starts[(inside < 0) | (starts >= spans[np.maximum(inside, 0), 1])]
        return starts, np.searchsorted(starts, offs)

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's n + 1 offsets into them."""
        starts, piece_offs = self._pieces(raw, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(raw))
        keys = W.span_hashes(raw, starts, ends)
        slots = self._find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            unique, where = np.unique(keys[new], return_index=True)
            if self._n + len(unique) > REMEMBERED:
                self._forget()
                new = np.arange(len(keys))
                unique, where = np.unique(keys, return_index=True)
            data, of = raw.tobytes(), new[where]
            self._remember(unique, [self._one(data[i:j]) for i, j in zip(starts[of].tolist(), ends[of].tolist())])
            slots[new] = self._find(keys[new])
        counts = self._counts[slots].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self._ids[np.repeat(self._starts[slots] - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[piece_offs]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_column(column: pa.Array, path: str, limit: int = 1 << 19):
    """(first row, row after the last, bytes, offsets, ids, id offsets) of blocks of whole texts."""
    raw, offs = W.utf8(column)
    known = encoder(path)
    for lo, hi, part, own in W.blocks(raw, offs, limit):
        yield lo, hi, part, own, *known.encode(part, own)
