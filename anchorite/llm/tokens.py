"""Token ids of whole texts, by the tokenizers library, with a cache of chunks.

Texts are cut where both pre-tokenizers always cut: before a single space or
around a single line feed between other characters, and between a Latin letter
and ASCII punctuation. Such chunks are encoded on their own with the same result,
so a chunk met before costs a lookup; new ones go through the library.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .textvec import SPACE, Block

#: Chunks held by a worker's cache; a fuller one is emptied.
CACHE = 1_000_000
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
#: Lead bytes of characters among which some are white space.
_DOUBT = np.zeros(256, bool)
_DOUBT[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]*")
#: Pre-token patterns of the two files for plain chunks: fixed values of those formats.
_BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+")
#: The byte-level alphabet of both files: printable bytes are themselves, others follow from U+0100 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SEEN)}
_TABLE = {b: c for b, c in _ALPHABET.items()}


class Encoder:
    """Ids of the rows of blocks, for the file ``name`` of the public tokenizers (or a path)."""

    _own: dict[str, "Encoder"] = {}

    def __init__(self, name: str):
        path = name if "/" in name else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(str(path))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.lower = "word" in name
        self.pattern = _WORDS if self.lower else _BYTE
        self.clear()

    @classmethod
    def of(cls, name: str) -> "Encoder":
        if name not in cls._own:
            cls._own[name] = cls(name)
        return cls._own[name]

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.words: dict[str, list[int]] = {}

    def plain(self, text: str) -> list[int]:
        """Ids of a chunk of plain characters: its pre-tokens go to the library's model one by one."""
        out: list[int] = []
        for piece in self.pattern.findall(text.lower() if self.lower else text):
            ids = self.words.get(piece)
            if ids is None:
                ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_TABLE))]
                if len(piece) < 5:
                    self.words[piece] = ids
            out += ids
        return out

    def learn(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [self.plain(c) if _PLAIN.fullmatch(c) else None for c in chunks]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True) if rest else ():
            out[i] = e.ids
        return out

    def cuts(self, b: Block) -> np.ndarray:
        """Starts of the chunks of a block, rows' starts included."""
        buf, n = b.buf, len(b.buf)
        if not n:
            return np.zeros(0, np.int64)
        space = SPACE[buf]
        doubt = _DOUBT[buf]
        doubt[1:] |= _DOUBT[buf[:-1]]
        doubt[2:] |= _DOUBT[buf[:-2]]
        # Control characters are no white space for numpy's table but may be for a pattern.
        odd = doubt | ((buf < 32) & ~space)
        clear = ~space & ~odd
        single = np.zeros(n, bool)
        single[1:-1] = clear[:-2] & clear[2:]
        at = single & (buf == 32)
        feed = single & (buf == 10)
        at |= feed
        at[1:] |= feed[:-1]
        letter = _ASCII[buf]
        latin = np.zeros(n, bool)
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        at[1:] |= (letter | latin)[:-1] & _PUNCT[buf[1:]]
        at[b.off[:-1][b.off[:-1] < n]] = True
        return np.flatnonzero(at)

    def encode(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and the bounds of each row's ids."""
        start = self.cuts(b)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(b.n + 1, np.int64)
        end = np.append(start[1:], len(b.buf))
        h = b.hashes(start, end)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHE:
            self.clear()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            raw = b.buf.tobytes()
            ids = self.learn([raw[s:e].decode("utf-8", "replace") for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.array([y for x in ids for y in x], np.int32)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used : self.used + len(flat)] = flat
            slot = len(self.start) + np.arange(len(size))
            self.start = np.concatenate((self.start, self.used + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.used += len(flat)
            self.known, self.slot = np.insert(self.known, at[new], unique[new]), np.insert(self.slot, at[new], slot)
            at = np.searchsorted(self.known, unique)
        slot = self.slot[at][inverse]
        size = self.size[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.start[slot] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, b.off)]
