"""Counting quotient filters over packed keys: lossless, sorted, mergeable counters.

A key of up to 128 bits is permuted by an invertible mix.  The permuted key's
high bits name a block, the next ones are the quotient, and all the others the
remainder, which is stored in full: a filter can be read back into its keys and
exact counts.  A sealed filter is one byte string: a header, the bit per
quotient that says whether it has a run, the bit per entry that ends a run, the
remainders, one byte a counter, and the counts of 255 and more.  Entries are in
the order of the permuted keys, so filters of one block merge as sorted lists.

Keys are pairs of arrays of unsigned 64-bit numbers (high, low).
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from loamstat.llm.common import mix64

_HEAD = struct.Struct("<BBBBQQ")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROUNDS = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03))
#: A counter of so much is followed by its whole count.
_FULL = 255


class Keys(NamedTuple):
    high: np.ndarray
    low: np.ndarray

    def take(self, at: np.ndarray) -> Keys:
        return Keys(self.high[at], self.low[at])


def _low_bits(n: int) -> np.uint64:
    return _ALL >> np.uint64(64 - n) if n else np.uint64(0)


def _right(k: Keys, n: int) -> Keys:
    if n == 0:
        return k
    if n >= 64:
        return Keys(np.zeros_like(k.high), k.high >> np.uint64(n - 64) if n < 128 else np.zeros_like(k.high))
    s = np.uint64(n)
    return Keys(k.high >> s, (k.low >> s) | (k.high << np.uint64(64 - n)))


def _left(k: Keys, n: int) -> Keys:
    if n == 0:
        return k
    if n >= 64:
        return Keys(k.low << np.uint64(n - 64) if n < 128 else np.zeros_like(k.low), np.zeros_like(k.low))
    s = np.uint64(n)
    return Keys((k.high << s) | (k.low >> np.uint64(64 - n)), k.low << s)


def _masked(k: Keys, n: int) -> Keys:
    """The lowest ``n`` bits."""
    return Keys(k.high & _low_bits(max(n - 64, 0)), k.low & _low_bits(min(n, 64)))


def pack(ids: list[np.ndarray], bits: int) -> Keys:
    """Keys of n-grams from the ids of their words, each of ``bits`` (1 to 32) bits."""
    high = low = np.zeros(len(ids[0]), np.uint64)
    out = Keys(high, low)
    for i in ids:
        out = _left(out, bits)
        out = Keys(out.high, out.low | i.astype(np.uint64))
    return out


def unpack(k: Keys, n: int, bits: int) -> list[np.ndarray]:
    out = []
    for _ in range(n):
        out.append((k.low & _low_bits(bits)).astype(np.int64))
        k = _right(k, bits)
    return out[::-1]


def permute(k: Keys, bits: int) -> Keys:
    """An invertible mix of the ``bits``-bit keys onto themselves (a Feistel network)."""
    right = bits - bits // 2
    a, b = _right(k, right).low, _masked(k, right).low
    for i, c in enumerate(_ROUNDS):
        if i % 2:
            b = b ^ (mix64(a ^ c) & _low_bits(right))
        else:
            a = a ^ (mix64(b ^ c) & _low_bits(bits // 2))
    out = _left(Keys(np.zeros_like(a), a), right)
    return Keys(out.high, out.low | b)


def restore(k: Keys, bits: int) -> Keys:
    """The inverse of ``permute``."""
    right = bits - bits // 2
    a, b = _right(k, right).low, _masked(k, right).low
    for i, c in reversed(list(enumerate(_ROUNDS))):
        if i % 2:
            b = b ^ (mix64(a ^ c) & _low_bits(right))
        else:
            a = a ^ (mix64(b ^ c) & _low_bits(bits // 2))
    out = _left(Keys(np.zeros_like(a), a), right)
    return Keys(out.high, out.low | b)


def counted(k: Keys, counts: np.ndarray | None = None) -> tuple[Keys, np.ndarray]:
    """Distinct keys in order, with the sum of their counts (each 1 by default)."""
    if not len(k.low):
        return k, np.zeros(0, np.int64)
    if not k.high.any():
        order = np.argsort(k.low, kind="stable")
    else:
        order = np.lexsort((k.low, k.high))
    k = k.take(order)
    new = np.concatenate([[True], (k.low[1:] != k.low[:-1]) | (k.high[1:] != k.high[:-1])])
    first = np.flatnonzero(new)
    if counts is None:
        return k.take(first), np.diff(np.append(first, len(new)))
    return k.take(first), np.add.reduceat(counts[order], first)


def blocks_of(k: Keys, bits: int, block_bits: int) -> np.ndarray:
    return _right(k, bits - block_bits).low.astype(np.int64)


def seal(k: Keys, counts: np.ndarray, bits: int, block_bits: int) -> bytes:
    """The filter of distinct permuted keys of one block, in order, with their counts."""
    n = len(counts)
    q = min(max(n - 1, 1).bit_length(), bits - block_bits)
    rest = bits - block_bits - q
    quotient = _masked(_right(k, rest), q).low.astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
    size = -(-rest // 8)
    left = _masked(k, rest)
    remainder = np.stack([left.low, left.high], axis=1).astype("<u8").view(np.uint8).reshape(n, 16)[:, :size]
    small = np.minimum(counts, _FULL)
    large = counts[small == _FULL].astype("<u8")
    block = int(blocks_of(k.take(np.array([0])), bits, block_bits)[0]) if n else 0
    parts = [_HEAD.pack(bits, block_bits, q, size, n, block), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainder.tobytes(), small.astype(np.uint8).tobytes(), large.tobytes()]
    return b"".join(parts)


def unseal(raw: bytes) -> tuple[Keys, np.ndarray]:
    """The permuted keys of a filter and their counts, in order."""
    bits, block_bits, q, size, n, block = _HEAD.unpack_from(raw)
    data = np.frombuffer(raw, np.uint8, offset=_HEAD.size)
    cut = np.cumsum([0, -(-(1 << q) // 8), -(-n // 8), n * size, n])
    occupied, ends, remainder, small = (data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
    with_run = np.flatnonzero(np.unpackbits(occupied, count=1 << q))
    run_end = np.unpackbits(ends, count=n).astype(np.int64)
    quotient = with_run[np.cumsum(run_end) - run_end].astype(np.uint64)
    wide = np.zeros((n, 16), np.uint8)
    wide[:, :size] = remainder.reshape(n, size)
    lanes = wide.view("<u8")
    rest = bits - block_bits - q
    top = _left(Keys(np.zeros(n, np.uint64), quotient), rest)
    place = _left(Keys(np.zeros(n, np.uint64), np.full(n, block, np.uint64)), rest + q)
    counts = small.astype(np.int64)
    counts[counts == _FULL] = np.frombuffer(data[cut[-1] :].tobytes(), "<u8").astype(np.int64)
    return Keys(lanes[:, 1] | top.high | place.high, lanes[:, 0] | top.low | place.low), counts


def merged(filters: list[bytes]) -> tuple[Keys, np.ndarray]:
    """The distinct permuted keys of several filters of a block, with summed counts."""
    read = [unseal(f) for f in filters]
    k = Keys(np.concatenate([k.high for k, _ in read]), np.concatenate([k.low for k, _ in read]))
    return counted(k, np.concatenate([c for _, c in read]))


def merge(filters: list[bytes]) -> bytes:
    """One filter with the summed counts of several filters of a block."""
    k, counts = merged(filters)
    return seal(k, counts, filters[0][0], filters[0][1])


def count_in(raw: bytes, key: Keys) -> int:
    """The count of one permuted key: its quotient's run is found by the two bit rows, then its remainder."""
    bits, block_bits, q, size, n, block = _HEAD.unpack_from(raw)
    rest = bits - block_bits - q
    if int(blocks_of(key, bits, block_bits)[0]) != block:
        return 0
    quotient = int(_masked(_right(key, rest), q).low[0])
    data = np.frombuffer(raw, np.uint8, offset=_HEAD.size)
    cut = np.cumsum([0, -(-(1 << q) // 8), -(-n // 8), n * size, n])
    occupied = np.unpackbits(data[: cut[1]], count=1 << q)
    if not occupied[quotient]:
        return 0
    run = int(occupied[:quotient].sum())
    ends = np.flatnonzero(np.unpackbits(data[cut[1] : cut[2]], count=n))
    lo, hi = (int(ends[run - 1]) + 1 if run else 0), int(ends[run]) + 1
    left = _masked(key, rest)
    wanted = np.stack([left.low, left.high], axis=1).astype("<u8").view(np.uint8).reshape(16)[:size]
    found = np.flatnonzero((data[cut[2] : cut[3]].reshape(n, size)[lo:hi] == wanted).all(axis=1))
    if not len(found):
        return 0
    at = lo + int(found[0])
    small = data[cut[3] : cut[4]]
    if small[at] < _FULL:
        return int(small[at])
    return int(np.frombuffer(data[cut[4] :].tobytes(), "<u8")[int((small[:at] == _FULL).sum())])
