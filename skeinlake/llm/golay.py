"""The perfect binary Golay code [23, 12, 7] and the fuzzy keys that it gives.

Every 23-bit word lies within distance 3 of exactly one codeword. The keys of a word are the
indices of the codewords that the word and its 23 neighbours decode to: one index where the word
is within distance 2 of its codeword, else six. Words at distance 2 or less share a key, because
a word between them is a neighbour of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, INFO = 23, 12
CHECK = BITS - INFO
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
MAX_KEYS = 6


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


def _tables() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    unit = [_remainder(1 << i) for i in range(BITS)]
    error = np.zeros(1 << CHECK, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(BITS), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            error[s] = sum(1 << b for b in bits)
    # by syndrome: what to XOR to the information bits for each key, and how many keys there are
    delta, count = np.zeros((1 << CHECK, MAX_KEYS), np.int64), np.zeros(1 << CHECK, np.int64)
    for s in range(1 << CHECK):
        found = dict.fromkeys([error[s] >> CHECK])
        for b in range(BITS):
            found[(error[s ^ unit[b]] ^ (1 << b)) >> CHECK] = None
        delta[s, : len(found)] = list(found)
        count[s] = len(found)
    # syndromes byte by byte
    parts = []
    for byte in range(3):
        t = np.zeros(256, np.int64)
        for v in range(256):
            for b in range(8):
                if v >> b & 1 and byte * 8 + b < BITS:
                    t[v] ^= unit[byte * 8 + b]
        parts.append(t)
    return parts, delta, count


_PARTS, _DELTA, _COUNT = _tables()


def syndrome(words: np.ndarray) -> np.ndarray:
    return _PARTS[0][words & 255] ^ _PARTS[1][words >> 8 & 255] ^ _PARTS[2][words >> 16 & 255]


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of shape words.shape + (6,), number of valid ones) of 23-bit words."""
    s = syndrome(words)
    return (words >> CHECK)[..., None] ^ _DELTA[s], _COUNT[s]
