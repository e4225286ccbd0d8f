"""Vectorised word hashing over Arrow text slices.

Words are maximal runs of word bytes in UTF-8, A-Z lower-cased.  A word's
digest has two 64-bit lanes with constants of their own.  Each lane chains a
bijective mix over the word's eight-byte blocks, its length first; words over
64 bytes are digested by BLAKE2b instead.  Lane ``hash`` names words in joins
and filters; wherever equality decides a result, lane ``check`` (so 128 bits)
or the words themselves are compared too.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

from loamstat.llm.common import mix64

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[ord("A") : ord("Z") + 1] = True
ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Longer words (in bytes) are digested one by one.
_LONG = 64
#: Keeps the first 0 to 8 bytes of a little-endian block.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _mix_check(x: np.ndarray) -> np.ndarray:
    """The second lane's bijective mix (other shifts and multipliers than ``mix64``)."""
    x = x * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(35)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(28)
    return x


class Words(NamedTuple):
    """Word spans of a slice: byte start and end, row, both lanes of the digest (``check`` only if asked for)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    check: np.ndarray | None = None


def _digests(low: np.ndarray, start: np.ndarray, length: np.ndarray, checked: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Both lanes of the words at ``start`` in lower-cased bytes that eight spare bytes follow."""
    at_byte = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))  # the eight bytes at every place
    size = length.astype(np.uint64)
    h = mix64(size + np.uint64(0x632BE59BD9B4E019))
    c = _mix_check(size + np.uint64(0xE7037ED1A0B428DB)) if checked else None
    block = at_byte[start] & _KEEP[np.minimum(length, 8)]
    h = mix64(h ^ block)
    c = _mix_check(c ^ block) if checked else None
    live = np.flatnonzero(length > 8)
    for k in range(8, _LONG, 8):
        block = at_byte[start[live] + k] & _KEEP[np.minimum(length[live] - k, 8)]
        h[live] = mix64(h[live] ^ block)
        if checked:
            c[live] = _mix_check(c[live] ^ block)
        live = live[length[live] > k + 8]
    for i in live:
        d = hashlib.blake2b(low[start[i] : start[i] + length[i]].tobytes(), digest_size=16).digest()
        h[i] = int.from_bytes(d[:8], "little")
        if checked:
            c[i] = int.from_bytes(d[8:], "little")
    return h, c


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = SPACED, checked: bool = False) -> Words:
    none, empty = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    if len(start) == 0:
        return Words(none, none, none, empty, empty if checked else None)
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[data]
    h, c = _digests(low, start, end - start, checked)
    doc = np.searchsorted(offs, start, "right") - 1
    return Words(start, end, doc, h, c)


def lowered(data: np.ndarray) -> bytes:
    return _LOWER[data].tobytes()


def phrases(low: bytes, w: Words, at: np.ndarray, n: np.ndarray) -> list[str]:
    """The words of ``lowered`` bytes from word ``at[i]`` on, ``n[i]`` of them, joined by one space."""
    return [b" ".join([low[w.start[j] : w.end[j]] for j in range(a, a + k)]).decode() for a, k in zip(at.tolist(), n.tolist(), strict=True)]


_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _combined(lane: np.ndarray, at: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k, s in enumerate(steps):
        h += lane[at + s] * _MULTIPLIERS[k]
    h += mix64(np.array([len(steps) * 1_000_003 + steps[-1]], np.uint64))[0]
    return h


def ngrams(w: Words, n: int, steps: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams and the word index each starts at.

    ``steps`` gives the word distances from the first word (default
    0..n-1), so skip-grams are n-grams with gaps.  N-grams never cross
    rows.
    """
    steps = tuple(range(n)) if steps is None else steps
    reach = steps[-1]
    if len(w.hash) <= reach:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w.hash) - reach
    at = np.flatnonzero(w.doc[:m] == w.doc[reach:])
    return mix64(_combined(w.hash, at, steps)), at


def ngram_checks(w: Words, at: np.ndarray, n: int) -> np.ndarray:
    """The second lane of the n-grams that start at ``at``."""
    return _mix_check(_combined(w.check, at, tuple(range(n))))


def phrase_words(text: str, kind: np.ndarray = ALNUM) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)], np.int64), kind).hash


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
