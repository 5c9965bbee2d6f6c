"""Shingle sets of texts, by numpy over a group of texts at once.

Words are the runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A word's hash is a
polynomial over its bytes; a shingle's hash mixes the hashes of its words.  Hashes have 64
bits and stand for the shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: One random-looking value per byte, and the multiplier of the polynomial.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
_STEP = _U(0xD6E8FEB86659FD93)
#: Bytes of a group for which the powers are kept.
_KEPT = 4_000_000
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 ** 64, at least so many; kept for most groups."""
    if len(_POWERS[0]) < size:
        made = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size + size // 4, x, np.uint64)))) for x in (int(_STEP), pow(int(_STEP), -1, 1 << 64))]
        if size > _KEPT:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    edges = np.cumsum([0, *(len(c) + 1 for c in coded)])
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    power, inverse = _powers(len(data))
    values = _BYTE[data]  # white space is 0
    values *= power[: len(data)]
    # a word's polynomial times the power of its place, which is divided out
    hashes = _mix(np.add.reduceat(values, starts) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, edges))


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending; a text of fewer words is one shingle, one without words none."""
    hashes, counts = word_hashes(texts)
    mixed = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        mixed = _mix(mixed * _STEP + hashes[k : k + len(mixed)] + _U(k + 1))
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(mixed[at : at + n - words + 1]))
        elif n:
            whole = hashlib.blake2b(hashes[at : at + n].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(hashes[:0])
        at += n
    return out


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set (of its sorted shingles)."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
