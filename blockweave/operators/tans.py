"""Table-based asymmetric numeral coding with order-1 contexts."""

from __future__ import annotations

import numpy as np

from .transforms import CorruptBlock

#: States in a table and its logarithm, the spread step, symbols, and the context before any token up to 255.
STATES, LOG, STEP, SYMBOLS, NO_CONTEXT = 2048, 11, 1283, 257, 256
#: Streams from so many tokens on are coded in pieces of so many side by side.
LONG, PIECE = 1 << 14, 512


def histograms(tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by token, counts by (context, token), and each token's context: the last token up to 255 before it."""
    t = np.asarray(tokens, np.int64)
    at = np.maximum.accumulate(np.where(t <= 255, np.arange(len(t)), -1)) if len(t) else t
    before = np.concatenate([[-1], at[:-1]]) if len(t) else at
    context = np.where(before >= 0, t[before], NO_CONTEXT) if len(t) else t
    order1 = np.bincount(context * SYMBOLS + t, minlength=SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS) if len(t) else np.zeros((SYMBOLS, SYMBOLS), np.int64)
    return np.bincount(t, minlength=SYMBOLS) if len(t) else np.zeros(SYMBOLS, np.int64), order1[:NO_CONTEXT], context


def normalise(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to add up to STATES, none that occurs below 1; without counts the first symbol takes all."""
    total = int(counts.sum())
    out = np.where(counts > 0, np.maximum(1, counts * STATES // max(total, 1)), 0)
    if not total:
        out[0] = STATES
        return out
    missing = STATES - int(out.sum())
    if missing > 0:  # the largest stays the largest as it grows
        out[int(out.argmax())] += missing
    for _ in range(-missing):
        out[int(out.argmax())] -= 1
    return out


_PLACES = np.arange(STATES) * STEP % STATES
_LOG2 = np.floor(np.log2(np.maximum(np.arange(2 * STATES), 1))).astype(np.int64)


class Tables:
    """Coding tables of a block's contexts, all built at once; row k of each flat view belongs to the k-th context that occurs."""

    def __init__(self, order0: np.ndarray, order1: np.ndarray):
        used = np.flatnonzero(order1.any(axis=1))
        counts = np.vstack([order1[used], order0]).astype(np.int64)
        n = len(counts)
        self.row = dict(zip([*used.tolist(), NO_CONTEXT], range(n), strict=True))
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        norm = np.where(counts > 0, np.maximum(1, counts * STATES // total), 0)
        missing = STATES - norm.sum(axis=1)
        norm[np.arange(n), norm.argmax(axis=1)] += np.maximum(missing, 0)  # no counts at all: the first symbol takes all
        for k in np.flatnonzero(missing < 0):
            norm[k] = normalise(counts[k])
        symbols = np.repeat(np.tile(np.arange(SYMBOLS), n), norm.ravel()).reshape(n, STATES)
        spread = np.empty_like(symbols)
        spread[:, _PLACES] = symbols
        # The k-th place of a symbol, in ascending order of places, is reached from sub-state norm + k.
        order = np.argsort(spread.astype(np.int16), axis=1, kind="stable")
        first = np.cumsum(norm, axis=1) - norm
        sub = np.empty_like(symbols)
        np.put_along_axis(sub, order, np.arange(STATES) + np.take_along_axis(norm - first, symbols, 1), 1)
        bits, most = LOG - _LOG2[sub], LOG - _LOG2[norm]
        view = lambda x: memoryview(np.ascontiguousarray(x, np.int64).ravel())
        self.symbol, self.bits, self.base, self.place = view(spread), view(bits), view(sub << bits), view(order + STATES)
        self.shift, self.most, self.limit = view(first - norm), view(most), view(norm << most)


def encode(tokens, order0: np.ndarray, order1: np.ndarray, contexts) -> bytes:
    """The bit stream of a token list: tokens from last to first, then the state, then a marker bit."""
    t, state, acc, held, out = Tables(order0, order1), STATES, 0, 0, bytearray()
    if len(tokens) >= LONG:
        return _side_by_side(t, tokens, contexts)
    row, most, limit, place, shift = t.row, t.most, t.limit, t.place, t.shift
    tokens, contexts = (x.tolist() if isinstance(x, np.ndarray) else list(x) for x in (tokens, contexts))
    for s, c in zip(reversed(tokens), reversed(contexts), strict=True):
        k = row[c]
        at = k * SYMBOLS + s
        n = most[at] - (state < limit[at])
        acc |= (state & ((1 << n) - 1)) << held
        held += n
        while held >= 8:
            out.append(acc & 255)
            acc >>= 8
            held -= 8
        state = place[k * STATES + shift[at] + (state >> n)]
    acc |= (state | 1 << 12) << held
    return bytes(out) + acc.to_bytes((held + 13 + 7) // 8, "little")


def _side_by_side(t: Tables, tokens, contexts) -> bytes:
    """What ``encode`` gives: pieces are coded side by side, from any state at first.

    Seldom tokens have few states, so after some of them it hardly matters where a piece began. Pieces that the one before
    doesn't leave in the state they began with are coded again from there, at last one by one, until they meet what they
    were.
    """
    s, c, n = np.asarray(tokens, np.int64)[::-1], np.asarray(contexts, np.int64)[::-1], len(tokens)
    rows = np.zeros(NO_CONTEXT + 1, np.int64)
    rows[list(t.row)] = list(t.row.values())
    place, most, limit, shift = (np.asarray(x) for x in (t.place, t.most, t.limit, t.shift))
    row = rows[c]
    at, pieces = row * SYMBOLS + s, -(-n // PIECE)

    def dealt(x, beyond):
        return np.ascontiguousarray(np.concatenate([x, np.full(pieces * PIECE - n, beyond)]).reshape(pieces, PIECE).T)

    # Beyond the end no bits are written, and the state that is read there is of no use.
    most, limit, base = dealt(most[at], 0), dealt(limit[at], 0), dealt(row * STATES + shift[at], -STATES)
    states, began = np.empty((PIECE + 1, pieces), np.int64), np.full(pieces, STATES)
    for _ in range(2):
        states[0] = began
        for before, most_, limit_, base_, after in zip(states, most, limit, base, states[1:], strict=False):
            bits = most_ - (before < limit_)
            np.right_shift(before, bits, bits)
            bits += base_
            place.take(bits, None, after, "clip")
        began[1:] = states[-1, :-1]
    for k in range(1, pieces):
        if states[0, k] != states[-1, k - 1]:
            _met(states, k, t.place, most, limit, base)
    before = states[:-1]
    bits = (most - (before < limit)).T.reshape(-1)[:n]
    value = before.T.reshape(-1)[:n] & ((1 << bits) - 1)
    end = states.T[-1, n - (pieces - 1) * PIECE]
    value, ends = np.append(value, end | 1 << 12), np.cumsum(bits)
    first = np.concatenate([[0], ends])
    value <<= first & 7
    byte, size = first >> 3, (int(ends[-1]) + 13 + 7) // 8
    out = sum(np.bincount(byte + j, value >> 8 * j & 255, size + 3) for j in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _met(states: np.ndarray, k: int, place, most: np.ndarray, limit: np.ndarray, base: np.ndarray) -> None:
    """Piece k's states from where the piece before ends, until they meet what they were."""
    state, new, old = int(states[-1, k - 1]), [], states[:, k].tolist()
    for was, m, li, b in zip(old, most[:, k].tolist(), limit[:, k].tolist(), base[:, k].tolist(), strict=False):
        if state == was:
            break
        new.append(state)
        state = place[b + (state >> m - (state < li))]
    else:
        new.append(state)
    states[: len(new), k] = new


def decode(data: bytes, n: int, order0: np.ndarray, order1: np.ndarray) -> list[int]:
    """The first ``n`` tokens of a bit stream, read from its end."""
    if not data or not data[-1]:
        raise CorruptBlock("no marker at the end of the stream")
    at = 8 * (len(data) - 1) + data[-1].bit_length() - 1 - 12
    if at < 0:
        raise CorruptBlock("stream too short")
    padded, out, t = data + b"\0\0\0", [], Tables(order0, order1)
    row, symbol, bits, base, k = t.row, t.symbol, t.bits, t.base, t.row[NO_CONTEXT]
    state = (int.from_bytes(padded[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & 4095
    for _ in range(n):
        if not STATES <= state < 2 * STATES or k is None:
            raise CorruptBlock("state outside the table")
        x = k * STATES + state - STATES
        s, b = symbol[x], bits[x]
        at -= b
        if at < 0:
            raise CorruptBlock("stream ended early")
        i = at >> 3
        state = base[x] | (padded[i] | padded[i + 1] << 8 | padded[i + 2] << 16) >> (at & 7) & ((1 << b) - 1)
        out.append(s)
        if s <= 255:
            k = row.get(s)
    return out
