"""Words and shingles of texts as 64-bit numbers."""

from __future__ import annotations

import numpy as np

#: Words whose hashes one task remembers.
MOST_WORDS = 250_000

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)

#: Bytes of a text whose words are hashed together.
BLOCK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


class WordHashes(dict):
    """Word hashes of a text: A-Z in lower case, words between ASCII white space."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes, both know ASCII only
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class BlockHashes:
    """Word hashes of a text as ``WordHashes`` has them (other numbers), a block of bytes at a time: running sums of the
    bytes' numbers times powers of an odd number, and its inverse's powers where a word begins."""

    def __init__(self):
        values = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
        self.values, self.white = values, np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
        self.powers = self.back = np.zeros(0, np.uint64)

    def block(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words, and where they begin and end."""
        n = len(raw)
        if n > len(self.powers):
            self.powers = np.multiply.accumulate(np.full(max(n, 1 << 14), _STEP, np.uint64))
            self.back = np.multiply.accumulate(np.full(max(n, 1 << 14), pow(int(_STEP), -1, 1 << 64), np.uint64))
        border = np.ones(n + 2, bool)
        border[1:-1] = self.white[raw]
        at = np.flatnonzero(border[1:] != border[:-1])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[:n], out=sums[1:])
        begin, end = at[::2], at[1::2]
        return mixed((sums[end] - sums[begin]) * self.back[begin]), begin, end

    def of(self, text: str | None) -> np.ndarray:
        return self.placed((text or "").encode())[0]

    def placed(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(text, np.uint8)
        if len(raw) <= BLOCK:
            return self.block(raw)
        # blocks end behind white space
        ends = 1 + np.flatnonzero(self.white[raw])
        cuts = [0]
        while cuts[-1] < len(raw):
            k = np.searchsorted(ends, cuts[-1] + BLOCK)
            cuts.append(int(ends[k]) if k < len(ends) else len(raw))
        blocks = [(names, begin + a, end + a) for a, b in zip(cuts, cuts[1:]) for names, begin, end in [self.block(raw[a:b])]]
        return tuple(map(np.concatenate, zip(*blocks)))


class SliceHashes:
    """Word hashes of several texts, the numbers of ``WordHashes``; each different word is looked up once."""

    def __init__(self):
        self.blocks, self.known = BlockHashes(), {}

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and where each text begins among them, with the end behind."""
        import xxhash

        encoded = [(t or "").encode() for t in texts]
        joined = b"\n".join(encoded)
        names, begin, end = self.blocks.placed(joined)
        different, first, each = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        different, known = different.tolist(), self.known
        for name, a, b in zip(different, begin[first].tolist(), end[first].tolist()):
            if name not in known:
                known[name] = xxhash.xxh3_64_intdigest(joined[a:b].lower())
        hashes = np.fromiter(map(known.__getitem__, different), np.uint64, len(different))[each]
        starts = np.cumsum([0, *(len(t) + 1 for t in encoded)])
        return hashes, np.searchsorted(begin, starts)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words in text order; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    joined = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        joined = joined * _STEP + words[k : k + n]
    return mixed(joined)


def signed(x: np.ndarray) -> list[int]:
    """Unsigned 64-bit numbers as the signed longs that Spark has."""
    return x.astype(np.uint64).view(np.int64).tolist()
