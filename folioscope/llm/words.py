"""Words of many texts at once, without an object for each: boundaries, bytes and 64-bit hashes as numpy arrays."""

from __future__ import annotations

import numpy as np

#: Odd numbers that spread bits.
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: A random number for each byte.
_DRAWN = np.random.default_rng(9).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
#: What undoes a multiplication by ODD[2] modulo 2^64.
_UNDOES = np.uint64(pow(int(ODD[2]), -1, 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * ODD[0]
    h = (h ^ (h >> np.uint64(29))) * ODD[1]
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a chunk of documents, as arrays: bytes (of all words, A-Z in lower case), sizes (bytes of each word), lengths (words of each document), types."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        inside = np.zeros(len(data) + 2, bool)  # neither ASCII white space nor beyond the ends
        np.logical_and(data - np.uint8(9) > 4, data != 32, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts = edges[::2].copy()
        self.sizes = edges[1::2] - starts
        self.first = np.cumsum(self.sizes) - self.sizes
        self.bytes = (data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)))[inside[1:-1]]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.lengths = np.diff(np.append(0, np.searchsorted(starts, ends)))
        if len(starts):
            # a word's polynomial of ODD[2]: its bytes take the powers in a row, from the chunk's first byte on, and its sum is divided by the power that it began with
            powers = np.full(len(self.bytes), ODD[2])
            powers[0] = 1
            powers = np.cumprod(powers, out=powers)
            powers *= _DRAWN[self.bytes]
            begins = np.cumprod(np.append(np.uint64(1), np.full(int(self.sizes.max()), _UNDOES)))[np.append(0, self.sizes[:-1])]
            sums = np.add.reduceat(powers, self.first) * np.cumprod(begins)
        else:
            sums = np.empty(0, np.uint64)
        self.types = mixed(sums + self.sizes.astype(np.uint64)).view(np.int64)

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b (their numbers, side by side) have the same bytes."""
        same = self.sizes[a] == self.sizes[b]
        n = np.where(same, self.sizes[a], 0)
        ends = np.cumsum(n)
        offset = np.arange(int(n.sum())) - np.repeat(ends - n, n)
        differs = self.bytes[np.repeat(self.first[a], n) + offset] != self.bytes[np.repeat(self.first[b], n) + offset]
        same[np.searchsorted(ends, np.flatnonzero(differs), "right")] = False
        return same

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, inverse): the number of a word of each kind, and each word's kind. Kinds are told by bytes: equal hashes only propose them."""
        order = np.argsort(self.types, kind="stable")
        types = self.types[order]
        new = np.append(True, types[1:] != types[:-1])[: len(types)]
        first, inverse = order[new], np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        others = np.flatnonzero(first[inverse] != np.arange(len(order)))
        wrong = others[~self.alike(others, first[inverse[others]])]
        if len(wrong):  # other words with the hash of a first one: told apart one by one
            data, kinds, more = self.bytes.tobytes(), {}, []
            for i in wrong.tolist():
                word = data[self.first[i] : self.first[i] + self.sizes[i]]
                if word not in kinds:
                    kinds[word] = len(first) + len(more)
                    more.append(i)
                inverse[i] = kinds[word]
            first = np.append(first, more)
        return first, inverse

    def pairs(self) -> np.ndarray:
        """Number of each pair of neighbouring symbols: 0 before a word and behind it, a byte and one inside. A word has its bytes' pairs, then its last one."""
        symbols = self.bytes.astype(np.int32) + 1
        before = np.append(np.int32(0), symbols[:-1])[: len(symbols)]
        before[self.first] = 0
        return before * 257 + symbols, symbols[self.first + self.sizes - 1] * 257 if len(self.first) else symbols
