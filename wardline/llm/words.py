"""Words of many texts at once as numpy arrays: byte ranges, 64-bit hashes, hashes of word runs."""

from __future__ import annotations

import hashlib

import numpy as np

_BYTES = np.arange(256)
# The two kinds of words, as bytes of UTF-8 that belong to one.
#: ``[^\x20\x09-\x0D]+``
PLAIN = ~np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased
FOLDED = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
)
#: Bytes hashed at a time, and the length from which a word is hashed on its own.
_BLOCK, _LONG = 1 << 20, 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of SplitMix64); one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64))


_LETTER = seeded(np.arange(256, dtype=np.uint64), 1)
_POWER = np.cumprod(np.full(_LONG, 0xD1342543DE82EF95, np.uint64)).astype(np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)


class Words:
    """Words of a list of texts (null counts as empty)."""

    def __init__(self, texts: list[str | None], inside: np.ndarray, fold: bool) -> None:
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join(coded)
        #: bytes that hold every word
        self.raw = raw.lower() if fold else raw
        letters = np.frombuffer(self.raw, np.uint8)
        flags = np.zeros(len(letters) + 2, np.int8)
        flags[1:-1] = inside[letters]
        edges = np.flatnonzero(np.diff(flags))
        #: first byte and the byte after the last, by word
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded))
        borders = np.concatenate(([0], np.cumsum(sizes)))
        #: number of the first word of each text; one more at the end
        self.first = np.searchsorted(self.starts, borders)
        self.counts = np.diff(self.first)
        self.hashes = self._hash(letters)

    def __len__(self) -> int:
        return len(self.starts)

    def _hash(self, letters: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        lengths = self.ends - self.starts
        usual = np.flatnonzero(lengths <= _LONG)
        for i in np.flatnonzero(lengths > _LONG):
            word = self.raw[self.starts[i] : self.ends[i]]
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        reach = np.cumsum(lengths[usual])
        at = 0
        while at < len(usual):
            done = reach[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(reach, done + _BLOCK, "right")))
            some = usual[at:upto]
            n = lengths[some]
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(begin, n)
            spots = place + np.repeat(self.starts[some], n)
            out[some] = np.add.reduceat(_LETTER[letters[spots]] * _POWER[place], begin)
            at = upto
        return mix(out)

    def text_of(self) -> np.ndarray:
        """By word, the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def runs(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; across texts where too few are left."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        out = self.hashes[:count].copy()
        for j in range(1, n):
            out *= _STEP
            out += self.hashes[j : j + count]
        return mix(out + np.uint64(n))

    def whole(self, n: int) -> np.ndarray:
        """For ``runs(n)``: whether the run lies within one text."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.empty(0, bool)
        of = self.text_of()
        return of[:count] == of[n - 1 :]

    def words(self, start: int, end: int) -> list[bytes]:
        raw = self.raw
        pairs = zip(self.starts[start:end].tolist(), self.ends[start:end].tolist())
        return [raw[a:b] for a, b in pairs]
