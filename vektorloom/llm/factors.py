"""Basic factors of word sequences: equal stretches of a power-of-two length, named level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The name that ends a text; no factor runs over it.
BREAK = -1


class WordNames(dict):
    """Numbers of distinct words in order of first use. Exact: no hash stands for a word."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def joined(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts, each text followed by ``BREAK``, and where each text starts.

    A word has another name in each text, so that only repeats inside a text count.
    """
    names = WordNames()
    lengths = np.array([len(words) for words in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int(lengths.sum()) + len(texts), BREAK, np.int64)
    for words, start in zip(texts, starts.tolist(), strict=True):
        out[start : start + len(words)] = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    return np.where(out == BREAK, BREAK, out * len(texts) + text), starts


def repeated_factors(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, places, names`` for lengths 1, 2, 4, ... up to ``longest``, sorted by name and place.

    Only factors that stand in two places or more are given, and only they are joined to factors of twice the length:
    a factor with a lone half stands in one place only.
    """
    places = np.flatnonzero(words != BREAK)
    names, length = words[places], 1
    while len(places) and length <= longest:
        order = np.argsort(names, kind="stable")
        places, names = places[order], names[order]
        first = np.append(True, names[1:] != names[:-1])
        lone = first & np.append(first[1:], True)
        names = np.cumsum(first)[~lone]
        places = places[~lone]
        if not len(places):
            return
        yield length, places, names
        named = np.zeros(len(words) + length, np.int64)
        named[places] = names
        places = np.sort(places)
        places = places[named[places + length] > 0]
        names = named[places] * (int(names[-1]) + 1) + named[places + length]
        length *= 2
