"""Binary range coding of tokens under an adaptive mix of orders 0, 1 and 2.

``encode`` and ``decode`` take one stream bit by bit. ``encode_many`` and ``decode_many`` give the same bytes and tokens
for many: short streams are taken together, one bit of every stream at a time. Where there are too few for that, an
encoder, which knows all tokens, still follows its probabilities side by side, since each depends on its own bits alone,
and then takes the streams' ranges a bit at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from .transforms import CorruptBlock

#: Probability bits, least range, symbols' bits, hash mask, weights (1, 3, 4) over 8, rates by order.
BITS, TOP, WIDTH, MASK = 12, 1 << 24, 9, 0x1FFF
ONE, LOW, HIGH, HALF = 1 << BITS, 1, (1 << BITS) - 1, 1 << (BITS - 1)


def adapt(p: int, bit: int, rate: int) -> int:
    """A probability of 0 after a bit."""
    return min(max(p + (((0 if bit else ONE) - p) >> rate), LOW), HIGH)


class Encoder:
    """Carry-propagating range encoder; p is the probability of 0 in 4,096ths."""

    def __init__(self):
        self.low, self.range, self.cache, self.pending, self.out = 0, 0xFFFFFFFF, 0xFF, 1, bytearray()

    def bit(self, bit: int, p: int) -> None:
        """One bit."""
        bound = (self.range >> BITS) * p
        if bit:
            self.low += bound
            self.range -= bound
        else:
            self.range = bound
        while self.range < TOP:
            self.range = (self.range << 8) & 0xFFFFFFFF
            self._shift()

    def _shift(self) -> None:
        if self.low < 0xFF000000 or self.low > 0xFFFFFFFF:
            carry = self.low >> 32
            self.out.append((self.cache + carry) & 255)
            self.out += bytes([(0xFF + carry) & 255]) * (self.pending - 1)
            self.pending, self.cache = 0, (self.low >> 24) & 255
        self.pending += 1
        self.low = (self.low << 8) & 0xFFFFFFFF

    def finish(self) -> bytes:
        """Flush and return everything."""
        for _ in range(5):
            self._shift()
        return bytes(self.out)


class Decoder:
    """The inverse; past the end it reads zeros. The first byte carries nothing."""

    def __init__(self, data: bytes):
        if not data:
            raise CorruptBlock("empty stream")
        self.data, self.at, self.range = data + bytes(8), 5, 0xFFFFFFFF
        self.code = int.from_bytes(self.data[1:5], "big")

    def bit(self, p: int) -> int:
        """One bit."""
        bound = (self.range >> BITS) * p
        if self.code < bound:
            self.range, bit = bound, 0
        else:
            self.code -= bound
            self.range -= bound
            bit = 1
        while self.range < TOP:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.code, self.range, self.at = (self.code << 8 | byte) & 0xFFFFFFFF, (self.range << 8) & 0xFFFFFFFF, self.at + 1
        return bit


def encode(tokens) -> bytes:
    """The range-coded stream of a token list. The bit loop is written out: nothing in it calls back into Python code."""
    e, o0, o1, o2, before, earlier = Encoder(), [HALF] * 512, {}, {}, 0, 0
    span, low, shift = e.range, e.low, e._shift
    for token in tokens:
        a, b, node = before << WIDTH, (((earlier * 257) ^ before) & MASK) << WIDTH, 1
        for i in (8, 7, 6, 5, 4, 3, 2, 1, 0):
            ka, kb = a + node, b + node
            p0, p1, p2 = o0[node], o1.get(ka, HALF), o2.get(kb, HALF)
            bound = (span >> BITS) * ((p0 + 3 * p1 + 4 * p2) >> 3)
            if token >> i & 1:
                low += bound
                span -= bound
                o0[node] = max(p0 + (-p0 >> 5), LOW)
                o1[ka] = max(p1 + (-p1 >> 5), LOW)
                o2[kb] = max(p2 + (-p2 >> 4), LOW)
                node = node << 1 | 1
            else:
                span = bound
                o0[node] = min(p0 + ((ONE - p0) >> 5), HIGH)
                o1[ka] = min(p1 + ((ONE - p1) >> 5), HIGH)
                o2[kb] = min(p2 + ((ONE - p2) >> 4), HIGH)
                node <<= 1
            while span < TOP:
                span = (span << 8) & 0xFFFFFFFF
                e.low = low
                shift()
                low = e.low
        earlier, before = before, token
    e.low = low
    return e.finish()


def decode(data: bytes, n: int) -> list[int]:
    """``n`` tokens of a stream."""
    d, out, o0, o1, o2, before, earlier = Decoder(data), [], [HALF] * 512, {}, {}, 0, 0
    span, code, at, data, end = d.range, d.code, d.at, d.data, len(d.data)
    for _ in range(n):
        a, b, node = before << WIDTH, (((earlier * 257) ^ before) & MASK) << WIDTH, 1
        while node < 512:
            ka, kb = a + node, b + node
            p0, p1, p2 = o0[node], o1.get(ka, HALF), o2.get(kb, HALF)
            bound = (span >> BITS) * ((p0 + 3 * p1 + 4 * p2) >> 3)
            if code < bound:
                span = bound
                o0[node] = min(p0 + ((ONE - p0) >> 5), HIGH)
                o1[ka] = min(p1 + ((ONE - p1) >> 5), HIGH)
                o2[kb] = min(p2 + ((ONE - p2) >> 4), HIGH)
                node <<= 1
            else:
                code -= bound
                span -= bound
                o0[node] = max(p0 + (-p0 >> 5), LOW)
                o1[ka] = max(p1 + (-p1 >> 5), LOW)
                o2[kb] = max(p2 + (-p2 >> 4), LOW)
                node = node << 1 | 1
            while span < TOP:
                code = (code << 8 | (data[at] if at < end else 0)) & 0xFFFFFFFF
                span, at = (span << 8) & 0xFFFFFFFF, at + 1
        token = node - 512
        if token > 256:
            raise CorruptBlock("token above 256")
        earlier, before = before, token
        out.append(token)
    return out


#: Tokens and streams that are taken together, at most, and tokens whose probabilities are followed at once, unless one
#: stream has more.
TOKENS, STREAMS, FOLLOWED = 1 << 22, 1024, 1 << 17
#: Fewer streams than this are followed first and then coded side by side; fewer than LANES one by one: an array
#: operation costs as much as so many steps. Tokens that wait to be coded side by side, and tokens of a stream in a step.
FEW_STREAMS, LANES, WAITING, STEP = 64, 32, 20 << 20, 128
#: Bits of a long run that are followed beside its others, after how many it is seen whether they have met, and pieces at once.
PIECE, MEET, WHOLE = 512, 64, 4096
_LOW = np.int16(LOW)
LEVELS = WIDTH
_WEIGHTS = (1, 3, 4)


@cache
def _next() -> np.ndarray:
    """What follows a probability: by bit for rate 5, then by bit for rate 4."""
    return np.array([adapt(min(max(p, LOW), HIGH), bit, rate) for rate in (5, 4) for bit in (0, 1) for p in range(ONE)], np.int16)


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Indexes of streams, longest first, in groups of few tokens; none has less than half of its group's longest."""
    group, total = [], 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if group and (total + sizes[i] > TOKENS or len(group) == STREAMS or 2 * sizes[i] < sizes[group[0]]):
            yield group
            group, total = [], 0
        group.append(i)
        total += sizes[i]
    if group:
        yield group


def encode_many(streams: list) -> list[bytes]:
    """``encode`` of each token list."""
    out, waiting, held = [b""] * len(streams), [], 0

    def code():
        for i, x in zip([i for i, _ in waiting], _side_by_side([x for _, x in waiting]), strict=True):
            out[i] = x
        waiting.clear()

    for group in _groups([len(x) for x in streams]):
        if len(group) >= FEW_STREAMS:
            coded = _together([len(streams[i]) for i in group], streams=[streams[i] for i in group])
            for i, x in zip(group, coded, strict=True):
                out[i] = x
            continue
        sizes = np.array([len(streams[i]) for i in group])
        for some in np.split(np.arange(len(group)), np.flatnonzero(np.diff(np.cumsum(sizes) // FOLLOWED)) + 1):
            tokens = np.concatenate([np.asarray(streams[group[k]], np.int32) for k in some])
            bits, at = _bits(tokens, sizes[some]), 0
            for k, n in zip(some.tolist(), sizes[some].tolist(), strict=True):
                waiting.append((group[k], bits[at : at + n].reshape(-1)))
                at += n
            held += len(tokens)
            if held >= WAITING:
                code()
                held = 0
    code()
    return out


def decode_many(datas: list[bytes], sizes: list[int]) -> list:
    """``decode`` of each stream into its number of tokens, or the CorruptBlock that says why it can't be."""
    out = [CorruptBlock("empty stream")] * len(datas)
    whole = [i for i, x in enumerate(datas) if x]
    for group in _groups([sizes[i] for i in whole]):
        group = [whole[k] for k in group]
        if len(group) >= FEW_STREAMS:
            for i, x in zip(group, _together([sizes[i] for i in group], datas=[datas[i] for i in group]), strict=True):
                out[i] = x
            continue
        for i in group:
            try:
                out[i] = decode(datas[i], sizes[i])
            except CorruptBlock as e:
                out[i] = e
    return out


def _together(sizes: list[int], streams: list | None = None, datas: list[bytes] | None = None) -> list:
    """Token lists coded, or streams decoded, a bit of each at a time; longest first. Probabilities are kept less HALF.

    Those of order 2 are kept for contexts that occur only: in slots of three bits' nodes, found through the slot before.
    """
    lanes, total = len(sizes), int(sum(sizes))
    after = (_next() - HALF).astype(np.int16)
    after5, after4 = after[: 2 * ONE], after[2 * ONE :]
    lengths = np.array(sizes)
    span, number = np.full(lanes, 0xFFFFFFFF, np.int64), np.zeros(lanes, np.int64)  # number: low, or code
    all0, all1 = np.zeros(lanes * 512, np.int16), np.zeros(lanes * 257 * 512, np.int16)
    root, slots, kids, free = np.zeros(lanes * (MASK + 1), np.int32), np.zeros((3 * total + 1) * 8, np.int16), np.zeros((3 * total + 1) * 8, np.int32), 1
    before, earlier, lane = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.arange(lanes, dtype=np.int64)
    tokens, bad = np.zeros((int(lengths[0]), lanes), np.int32), np.zeros(lanes, bool)
    if streams is not None:
        for i, x in enumerate(streams):
            tokens[: len(x), i] = x
        room = 14 * lengths + 8  # a bit adds 12 bits at most
        at = np.cumsum(room) - room
        bytes_, begin = np.zeros(int(room.sum()), np.uint16), at.copy()
        bytes_[at] = 0xFF
        at = at + 1
    else:
        room = np.array([len(x) + 8 for x in datas])
        begin = np.cumsum(room) - room
        bytes_ = np.frombuffer(b"".join(x + bytes(8) for x in datas), np.uint8)
        end, at = begin + room - 1, begin + 5
        for k in range(1, 5):
            number = number << 8 | bytes_[begin + k]
    for t, k in enumerate(np.searchsorted(-lengths, -np.arange(len(tokens)), side="left").tolist()):  # lanes longer than t
        if k < len(lane):
            lane, before, earlier = lane[:k], before[:k], earlier[:k]
        base0, base1 = lane * 512, (lane * 257 + before) * 512
        table, where = root, lane * (MASK + 1) + (((earlier * 257) ^ before) & MASK)
        sp, nb, node, own = span[:k], number[:k], np.ones(k, np.int64), tokens[t, :k]
        for i in range(LEVELS):
            if i % 3 == 0:
                slot = table[where]
                new = np.flatnonzero(slot == 0)
                if len(new):
                    ids = np.arange(free, free + len(new), dtype=np.int32)
                    slot[new] = table[where[new]] = ids
                    free += len(new)
                base2, inner, table = slot.astype(np.int64) * 8, np.ones(k, np.int64), kids
            k0, k1, k2 = base0 + node, base1 + node, base2 + inner
            p0, p1, p2 = all0[k0], all1[k1], slots[k2]
            bound = (sp >> BITS) * (((p0 + 3 * p1 + 4 * p2) >> 3) + HALF)
            one = nb >= bound if streams is None else (own >> (LEVELS - 1 - i) & 1).astype(bool)
            offset = one * ONE + HALF
            all0[k0], all1[k1], slots[k2] = after5[p0 + offset], after5[p1 + offset], after4[p2 + offset]
            if streams is None:
                nb -= bound * one
            else:
                nb += bound * one
            sp[:] = np.where(one, sp - bound, bound)
            node, inner = 2 * node + one, 2 * inner + one
            if i % 3 == 2:
                where = base2 + inner - 8
            short = np.flatnonzero(sp < TOP)
            while len(short):
                x = nb[short]
                if streams is None:
                    nb[short] = (x << 8 | bytes_[np.minimum(at[short], end[short])]) & 0xFFFFFFFF
                else:
                    bytes_[at[short]] = x >> 24
                    nb[short] = (x & 0xFFFFFF) << 8
                at[short] += 1
                sp[short] <<= 8
                short = short[sp[short] < TOP]
        token = node - 512
        if streams is None:
            bad[:k] |= token > 256
            token = np.minimum(token, 256)
            tokens[t, :k] = token
        earlier, before = before, token
    if streams is None:
        return [CorruptBlock("token above 256") if b else x[:n].tolist() for x, n, b in zip(tokens.T, sizes, bad.tolist(), strict=True)]
    for _ in range(4):
        bytes_[at] = number >> 24
        number, at = (number & 0xFFFFFF) << 8, at + 1
    return [_carried(bytes_[a:b]) for a, b in zip(begin.tolist(), at.tolist(), strict=True)]


def _bits(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mixed probability before each bit of each token, highest bit first; negative where the bit is 1."""
    n = len(tokens)
    if not n:
        return np.empty((0, LEVELS), np.int16)
    stream = np.repeat(np.arange(len(sizes)), sizes)
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before, earlier = np.zeros((2, n), np.int64)
    before[1:], earlier[2:] = tokens[:-1], tokens[:-2]
    before[firsts] = earlier[firsts] = 0
    earlier[(firsts + 1)[firsts + 1 < n]] = 0  # of a stream of one token this is the next one's first
    contexts = (stream, stream * 512 + before, stream * (MASK + 1) + (((earlier * 257) ^ before) & MASK))
    mixed = np.zeros((LEVELS, n), np.uint16)
    for k, (c, weight) in enumerate(zip(contexts, _WEIGHTS, strict=True)):
        # Tokens by context, and by time within it. A level later zeros go before ones, as a whole and in order, which
        # keeps those of one context and of the same bits so far side by side.
        most = int(c.max())
        by = np.argsort(c.astype(np.uint16) if most < 1 << 16 else c, kind="stable")
        own = (c[by] << WIDTH | tokens[by]).astype(np.int32 if most < 1 << 31 - WIDTH else np.int64)
        ones, orders, starts = np.empty((LEVELS, n), bool), np.empty((LEVELS, n), np.int64), []
        for level in range(LEVELS):
            group = own >> (LEVELS - level)
            starts.append(np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1]) + level * n)
            one = (own >> (LEVELS - 1 - level) & 1).astype(bool)
            ones[level], orders[level] = one, by
            if level < LEVELS - 1 and one.any():
                to = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
                by, own = by[to], own[to]
        got = _followed(ones.reshape(-1), np.concatenate(starts), 4 if k == 2 else 5).view(np.uint16).reshape(LEVELS, n)
        got *= np.uint16(weight)
        for level in range(LEVELS):
            own = np.empty(n, np.uint16)
            own[orders[level]] = got[level]
            mixed[level] += own
    signs = 1 - 2 * ((tokens >> np.arange(LEVELS - 1, -1, -1)[:, None]) & 1).astype(np.int16)
    return np.ascontiguousarray(((mixed >> 3).astype(np.int16) * signs).T)


def _followed(ones: np.ndarray, starts: np.ndarray, rate: int) -> np.ndarray:
    """The probability before each bit of runs of bits, which begin at HALF.

    Long runs are cut into pieces that are followed side by side, each from HALF at first. Then those that the piece
    before doesn't leave at what they began with are followed again from there, until they meet what they were.
    """
    target, out = np.where(ones, np.int16(0), np.int16(ONE)), np.full(len(ones), HALF, np.int16)
    lengths = np.diff(starts, append=len(ones))
    starts, lengths = starts[lengths > 1], lengths[lengths > 1]
    if not len(starts):
        return out
    pieces = -(-lengths // PIECE)
    place = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # a piece's number in its run
    at = np.repeat(starts, pieces) + place * PIECE
    length = np.minimum(np.repeat(lengths, pieces) - place * PIECE, PIECE)
    last, inner = np.full(len(at), HALF, np.int16), np.flatnonzero(place > 0)

    def follow(which, p, again):
        """Follow pieces, longest first, from ``p``; those that didn't meet what they were before, if ``again``."""
        ends, left = -length[which], []
        for step in range(int(length[which[0]])):
            k = int(np.searchsorted(ends, -step, side="left"))
            if k < len(which):
                last[which[k:]] = p[k:]
                left.append(which[k:])
                which, p, ends = which[:k], p[:k], ends[:k]
            if not len(which):
                break
            here = at[which] + step if step % MEET == 0 else here[:k] + 1
            if again and step % MEET == 0:
                apart = out[here] != p
                which, p, ends, here = which[apart], p[apart], ends[apart], here[apart]
                if not len(which):
                    break
            out[here] = p
            move = target[here]
            move -= p
            move >>= rate
            p = np.maximum(p + move, _LOW)
        last[which] = p
        return np.concatenate([*left, which])

    whole = np.flatnonzero(length == PIECE)
    for some in np.array_split(whole, -(-len(whole) // WHOLE)) if len(whole) else []:
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(target, PIECE)[at[some]].T)
        p, move = np.full(len(some), HALF, np.int16), np.empty(len(some), np.int16)
        for row in rows:
            np.subtract(row, p, move)
            row[:] = p
            move >>= rate
            p += move
            np.maximum(p, _LOW, p)
        last[some] = p
        np.lib.stride_tricks.sliding_window_view(out, PIECE, writeable=True)[at[some]] = rows.T
    short = np.flatnonzero(length < PIECE)
    if len(short):
        follow(short[np.argsort(-length[short], kind="stable")], np.full(len(short), HALF, np.int16), False)
    began = np.full(len(at), HALF, np.int16)
    todo = inner
    while len(todo):
        todo = todo[last[todo - 1] != began[todo]]
        if not len(todo):
            break
        began[todo] = last[todo - 1]
        todo = todo[np.argsort(-length[todo], kind="stable")]
        ran = follow(todo, began[todo], True) + 1
        todo = ran[(ran < len(at))]
        todo = np.sort(todo[place[todo] > 0])
    return out


#: Bits that a range is moved up, by its upper half.
_UP = np.array([16, *[8] * 255, *[0] * (65536 - 256)], np.int64)


def _side_by_side(streams: list[np.ndarray]) -> list[bytes]:
    """The range-coded streams of bits as ``_bits`` gives them, a bit of each at a time.

    Only the range has to be known step by step. What each bit adds is added up afterwards, by where its digits begin.
    """
    order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
    sums, digits = [[] for _ in streams], [None] * len(streams)
    begin, span, done = np.zeros(len(order), np.int64), np.full(len(order), 0xFFFFFFFF, np.int64), 0
    while len(order) >= LANES:
        k, rows = len(order), min(STEP * LEVELS, len(streams[order[0]]) - done)
        p = np.zeros((rows, k), np.int16)
        for lane, i in enumerate(order):
            x = streams[i][done : done + rows]
            p[: len(x), lane] = x
        done += rows
        share, keep = p.astype(np.int64), ((p - 1) >> 15).astype(np.int64)  # beyond a stream's end nothing changes
        spans, cut, a, b = np.empty((rows + 1, k), np.int64), np.empty((rows, k), "<i8"), np.empty(k, np.int64), np.empty(k, np.int64)
        spans[0], twelve, upper = span, np.full(k, BITS), cut.view("<u2")[:, 1::4]  # spans have 32 bits
        for own, q, low, new, half, after in zip(spans, share, keep, cut, upper, spans[1:], strict=False):
            np.right_shift(own, twelve, a)
            np.multiply(a, q, a)
            np.bitwise_and(own, low, b)
            np.add(a, b, new)
            _UP.take(half, None, b, "clip")
            np.left_shift(new, b, after)
        span = spans[-1].copy()
        up = np.cumsum(_UP[upper] >> 3, axis=0)
        width = int(up[-1].max()) + 1
        at = np.concatenate([np.zeros((1, k), np.int64), up[:-1]]) + np.arange(k) * width
        one = p < 0
        added = np.bincount(at[one], (spans[:-1] - cut)[one], minlength=k * width).astype(np.int64).reshape(k, width)
        for lane, (i, x) in enumerate(zip(order, up[-1].tolist(), strict=True)):
            sums[i].append((int(begin[lane]), added[lane, : x + 1].copy()))
        begin += up[-1]
        k = sum(len(streams[i]) > done for i in order)
        for lane in range(k, len(order)):
            digits[order[lane]] = int(begin[lane]), [0] * 4
        order, begin, span = order[:k], begin[:k], span[:k]
    for lane, i in enumerate(order):
        digits[i] = int(begin[lane]), _coded(streams[i][done:].tolist(), int(span[lane]))
    out = []
    for parts, (at, rest) in zip(sums, digits, strict=True):
        whole, total = np.zeros(1 + at + len(rest), np.uint32), np.zeros(at + 1, np.int64)
        whole[0] = 0xFF
        whole[1 + at :] = rest
        for start, x in parts:
            total[start : start + len(x)] += x
        for j in range(4):
            whole[1 + j : 2 + j + at] += (total >> (24 - 8 * j) & (0xFFFF if j == 0 else 0xFF)).astype(np.uint32)
        out.append(_carried(whole))
    return out


def _coded(bits: list[int], span: int) -> list[int]:
    """What bits from a range on add to a stream's digits, four of which are left at the end."""
    low, digits = 0, []
    for p in bits:
        if p > 0:
            span = (span >> BITS) * p
        else:
            bound = (span >> BITS) * p
            low -= bound
            span += bound
        while span < TOP:
            span <<= 8
            digits.append(low >> 24)
            low = (low & 0xFFFFFF) << 8
    for _ in range(4):
        digits.append(low >> 24)
        low = (low & 0xFFFFFF) << 8
    return digits


def _carried(digits: np.ndarray) -> bytes:
    """The bytes of digits to base 256, in which a digit may be larger and is carried into the one before."""
    number = int.from_bytes((digits & 255).astype(np.uint8).tobytes(), "big") + (int.from_bytes((digits >> 8).astype(np.uint8).tobytes(), "big") << 8)
    return number.to_bytes(len(digits), "big")
