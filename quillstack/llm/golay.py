"""The binary Golay code of length 23: every 23-bit vector is within three bits of exactly one of its 4,096 codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
LENGTH, DIMENSION = 23, 12
_FLIPS = np.array([0, *(1 << i for i in range(LENGTH))], dtype=np.uint32)


@cache
def codewords() -> np.ndarray:
    found = np.zeros(1 << DIMENSION, dtype=np.uint32)
    index = np.arange(1 << DIMENSION, dtype=np.uint32)
    for i in range(DIMENSION):
        found ^= np.where(index >> i & 1, np.uint32(GENERATOR << i), np.uint32(0))
    return found


@cache
def table() -> np.ndarray:
    """The index of the nearest codeword of each vector; 16 MB, built once in a worker."""
    errors = [sum(1 << i for i in c) for n in range(4) for c in combinations(range(LENGTH), n)]
    out = np.empty(1 << LENGTH, dtype=np.uint16)
    index = np.arange(1 << DIMENSION, dtype=np.uint16)
    for e in errors:
        out[codewords() ^ np.uint32(e)] = index
    return out


def decode(vectors: np.ndarray) -> np.ndarray:
    return table()[vectors]


def near(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid), both of shape (n, 6): the codewords that a vector or a neighbour of it at one bit decodes to.

    There is one, or there are six. Two vectors at two bits or less share a key, as what lies between them decodes to
    one codeword; of two at one bit or less, each has what the other decodes to.
    """
    found = np.sort(table()[vectors[:, None] ^ _FLIPS[None, :]], axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    order = np.argsort(~first, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(found, order, axis=1).astype(np.int64), np.take_along_axis(first, order, axis=1)
