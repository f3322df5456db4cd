"""Reversible block transforms as numpy kernels: suffix sorting, Burrows-Wheeler, move-to-front with zero runs, E8/E9."""

from __future__ import annotations

import numpy as np

#: Start positions whose ranks are kept for each block.
LANES = 8
#: Bytes that suffixes are sorted by at first: as many as one number holds.
HEAD = 7
#: Runs that are moved to the front one after another; pieces of so many are taken side by side. Shorter blocks are taken
#: byte by byte.
PIECE, LONG = 128, 1 << 15


class CorruptBlock(ValueError):
    """A block whose bytes can't be what an encoder wrote."""


def suffix_array(data: bytes) -> np.ndarray:
    """Suffix starts in byte order, a prefix before what it begins: sorted by their first bytes, then by doubling, in
    which only suffixes that aren't told apart yet are sorted again."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    x = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 1, np.zeros(HEAD, np.int64)])
    key = x[:n].copy()
    for j in range(1, HEAD):
        key = key * 257 + x[j : n + j]
    order = np.argsort(key)
    key = key[order]
    starts = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # beyond the end
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank[order] = group
    step, left = HEAD, np.flatnonzero(~(starts & np.concatenate([starts[1:], [True]])))
    while len(left):
        own, group = order[left], group[left] if len(group) == n else group
        key = group * (n + 1) + rank[np.minimum(own + step, n)] + 1
        by = np.argsort(key)
        key, own = key[by], own[by]
        order[left] = own
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(fresh, left, 0))
        rank[own] = group
        stay = ~(fresh & np.concatenate([fresh[1:], [True]]))
        left, group = left[stay], group[stay]
        step *= 2
    return order


def lane_starts(n: int) -> np.ndarray:
    """Where each lane's segment ends, counted from the back: lane 0 at 0, which stands for the end."""
    lengths = n // LANES + (n % LANES > np.arange(LANES))
    return np.where(np.arange(LANES) == 0, 0, n - (np.cumsum(lengths) - lengths))


def bwt(data: bytes) -> tuple[bytes, np.ndarray]:
    """The byte before each suffix in sorted order (the last one before the whole), and the lanes' ranks."""
    n = len(data)
    if not n:
        return b"", np.zeros(LANES, np.int64)
    order = suffix_array(data)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return np.frombuffer(data, np.uint8)[order - 1].tobytes(), rank[lane_starts(n) % n]


def lf_mapping(symbols: bytes, primary: int) -> np.ndarray:
    """For each row, the row of the suffix that is one byte longer; the primary row comes first in its class."""
    x = np.frombuffer(symbols, np.uint8)
    order = np.lexsort((np.arange(len(x)) != primary, x))
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x))
    return out


def unbwt(symbols: bytes, primary: int) -> bytes:
    """The block, by pointer doubling along the LF mapping."""
    n = len(symbols)
    if not n:
        return b""
    if not 0 <= primary < n:
        raise CorruptBlock("primary index beyond the block")
    rows, jump = np.array([primary]), lf_mapping(symbols, primary)
    while len(rows) < n:
        rows = np.concatenate([rows, jump[rows]])
        jump = jump[jump]
    return np.frombuffer(symbols, np.uint8)[rows[:n]][::-1].tobytes()


def mtf_ranks(symbols: bytes) -> list[int]:
    """Places in the move-to-front list, which begins in byte order."""
    table, out = list(range(256)), []
    for s in symbols:
        i = table.index(s)
        out.append(i)
        if i:
            del table[i]
            table.insert(0, s)
    return out


def zero_runs(ranks: list[int]) -> list[int]:
    """Tokens: runs of zeros as digits 0 and 1 in bijective base 2, lowest first; any other rank is itself plus one."""
    out, run = [], 0
    for r in [*ranks, -1]:
        if r == 0:
            run += 1
            continue
        run += 1
        while run > 1:
            out.append(run & 1)
            run >>= 1
        run = 0
        out.append(r + 1)
    return out[:-1]


def from_tokens(tokens, size: int) -> bytes:
    """The symbols of a token stream; ``size`` is what they must come to."""
    table, out, run, digit = list(range(256)), bytearray(), 0, 0
    for t in tokens:
        if t < 2:
            run += (t + 1) << digit
            digit += 1
            if len(out) + run > size:
                raise CorruptBlock("run beyond the block")
            continue
        if t > 256:
            raise CorruptBlock("token above 256")
        if run:
            out += bytes([table[0]]) * run
            run = digit = 0
        digit = 0
        s = table.pop(t - 1)
        table.insert(0, s)
        out.append(s)
    out += bytes([table[0]]) * run
    if len(out) != size:
        raise CorruptBlock("tokens don't come to the block's size")
    return bytes(out)


def _tokens_of_long(symbols: bytes) -> np.ndarray:
    """``zero_runs(mtf_ranks(symbols))``, by runs of equal bytes and in pieces that are taken side by side.

    A byte's rank is the number of bytes that were seen after it was. When each was last seen before a piece begins is
    known beforehand; those that weren't yet come after, in byte order.
    """
    x = np.frombuffer(symbols, np.uint8)
    head = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    byte, zeros, n = x[head], np.diff(head, append=len(x)) - 1, len(head)
    used, first, own = np.unique(byte, return_index=True, return_inverse=True)
    k, pieces = len(used), -(-n // PIECE)
    own = np.concatenate([own, np.full(pieces * PIECE - n, own[-1])])
    place, time = own.reshape(pieces, PIECE).T, np.arange(pieces * PIECE, dtype=np.int32).reshape(pieces, PIECE).T
    seen = np.full((k, pieces + 1), -1, np.int32)
    seen[:, 0] = -1 - used.astype(np.int32)
    np.maximum.at(seen, (own, np.arange(len(own)) // PIECE + 1), np.arange(len(own), dtype=np.int32))
    seen[:, 1:][seen[:, 1:] < 0] = -257
    seen = np.ascontiguousarray(np.maximum.accumulate(seen, axis=1)[:, :-1])
    rank, lane = np.empty((PIECE, pieces), np.uint8), np.arange(pieces)
    for s, t, out in zip(place, time, rank, strict=True):
        np.add.reduce((seen > seen[s, lane]).view(np.uint8), axis=0, dtype=np.uint8, out=out)
        seen[s, lane] = t
    rank = rank.T.reshape(-1)[:n].astype(np.int32)
    rank[first] += used - np.arange(k)  # bytes that never occur are before those that are seen for the first time, too
    extra = int(rank[0] == 0)  # only the first run's own byte can be at the front already
    zeros[0] += extra
    digits = np.frexp((zeros + 1).astype(np.float64))[1] - 1
    count = digits + 1
    count[0] -= extra
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    out[at[extra:]] = rank[extra:] + 1
    at += 1
    at[0] -= extra
    for j in range(int(digits.max())):
        some = np.flatnonzero(digits > j)
        out[at[some] + j] = (zeros[some] + 1) >> j & 1
    return out


def token_array(data: bytes) -> tuple[list[int] | np.ndarray, np.ndarray]:
    """``tokens_of``, an array for a long block."""
    symbols, lanes = bwt(data)
    return (zero_runs(mtf_ranks(symbols)) if len(data) < LONG else _tokens_of_long(symbols)), lanes


def tokens_of(data: bytes) -> tuple[list[int], np.ndarray]:
    """Tokens of a block and its lanes' ranks."""
    tokens, lanes = token_array(data)
    return (tokens if isinstance(tokens, list) else tokens.tolist()), lanes


def data_of(tokens, primary: int, size: int) -> bytes:
    """The block of a token stream."""
    return unbwt(from_tokens(tokens, size), primary)


def e8e9(data: bytes, encode: bool) -> bytes:
    """Make relative call and jump targets absolute within the block, or back; candidates come from a vectorised search."""
    n = len(data)
    if n < 5:
        return data
    out, x, free, sign = bytearray(data), np.frombuffer(data, np.uint8), 0, 1 if encode else -1
    for i in np.flatnonzero((x[: n - 4] & 0xFE) == 0xE8).tolist():
        if i >= free:
            value = int.from_bytes(out[i + 1 : i + 5], "little")
            out[i + 1 : i + 5] = ((value + sign * i) & 0xFFFFFFFF).to_bytes(4, "little")
            free = i + 5
    return bytes(out)
