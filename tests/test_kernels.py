"""Byte kernels: roundtrips of the transforms and coders, and what damage does."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockweave.operators import codec, rangecoder, tans, transforms
from blockweave.operators.transforms import CorruptBlock

R = random.Random(5)
CASES = {
    "empty": b"", "one": b"A", "basic": b"hello world hello world hello world", "periodic": bytes(13 * i % 256 for i in range(1000)), "zeros": bytes(100), "ff": b"\xff" * 100,
    "up": bytes(range(256)), "down": bytes(range(255, -1, -1)), "run": b"A" * 10_000, "shuffled": bytes(R.sample(range(256), 256)), "random": R.randbytes(4096),
    "png": b"\x89PNG\r\n\x1a\n" + R.randbytes(1500), "program": b"MZ\0\0" + b"\xe8\x01\x02\x03\x04\xe9" * 40, "stored1": b"PK\x03\x04" + b"x" * 1028, "short zip": b"PK\x03\x04",
    "utf8": "Größe ñandú élève 日本".encode() * 9,
}


@pytest.mark.parametrize("mode", codec.MAGIC)
@pytest.mark.parametrize("name", CASES)
def test_blocks_come_back(mode, name):
    data = CASES[name]
    assert codec.decode_block(codec.encode_block(data, mode, 3), mode, len(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(sorted(codec.MAGIC)))
def test_any_block_comes_back(data, mode):
    assert codec.decode_block(codec.encode_block(data, mode, 1), mode, len(data)) == data


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 9, 64, 257])
def test_bwt_against_sorting(size):
    data = bytes(R.choices(b"abc", k=size))
    order = sorted(range(size), key=lambda i: data[i:])
    symbols, lanes = transforms.bwt(data)
    assert symbols == bytes(data[i - 1] for i in order)
    if size:
        assert [order[k] for k in lanes] == [int(x) % size for x in transforms.lane_starts(size)]
        assert transforms.unbwt(symbols, int(lanes[0])) == data


def test_runs_in_bijective_base_two():
    assert [transforms.zero_runs([0] * n) for n in range(1, 6)] == [[0], [1], [0, 0], [1, 0], [0, 1]]


def test_e8e9_is_reversible_near_the_end():
    for n in range(12):
        data = (b"\xe8\xe9" * 8)[:n]
        assert transforms.e8e9(transforms.e8e9(data, True), False) == data


@pytest.mark.parametrize("tokens", [[0, 1, 2, 0, 1, 2, 256, 128, 0, 1, 1, 1, 5, 10], [42] * 1000, []])
def test_token_coders(tokens):
    o0, o1, ctx = tans.histograms(tokens)
    assert tans.decode(tans.encode(tokens, o0, o1, ctx.tolist()), len(tokens), o0, o1) == tokens
    assert rangecoder.decode(rangecoder.encode(tokens), len(tokens)) == tokens


@pytest.mark.parametrize("few", [1, 64, 10**9])
def test_streams_coded_together(few, monkeypatch):
    """Side by side or one by one, streams are the same bytes; damage to one is its own."""
    monkeypatch.setattr(rangecoder, "FEW_STREAMS", few)
    monkeypatch.setattr(rangecoder, "FOLLOWED", 4000)
    r = random.Random(few)
    streams = [[], [5], [0, 1], [256] * 700, [0] * 3000, [], [r.randrange(257) for _ in range(900)]]
    streams += [[min(256, int(r.expovariate(0.3))) for _ in range(r.randrange(90))] for _ in range(150)]
    coded, sizes = rangecoder.encode_many(streams), [len(x) for x in streams]
    assert coded == [rangecoder.encode(x) for x in streams] and rangecoder.decode_many(coded, sizes) == streams
    assert rangecoder.encode_many([]) == [] == rangecoder.decode_many([], [])

    def alone(data, n):
        try:
            return rangecoder.decode(data, n)
        except CorruptBlock as e:
            return str(e)

    damaged = [bytes(r.randrange(256) if r.random() < 0.1 else v for v in x)[: len(x) - r.randrange(4)] for x in coded] + [b""]
    got = rangecoder.decode_many(damaged, [*sizes, 3])
    assert [str(x) if isinstance(x, CorruptBlock) else x for x in got] == [alone(x, n) for x, n in zip(damaged, [*sizes, 3], strict=True)]
    assert any(isinstance(x, CorruptBlock) for x in got)


def test_few_steps_for_many_streams(monkeypatch):
    """Blocks of a batch share their steps: none is coded or decoded by itself, and a block's payload stays the same."""
    datas = [R.choice([b"", b"PK\x03\x04", b"MZ\0\0\xe8\1\2\3\4\xe9"]) + bytes(R.choices(b"abcd ", k=R.randrange(300, 500))) for _ in range(300)]
    alone = [codec.encode_block(x, "ratio") for x in datas]
    assert all(x[36:] == rangecoder.encode(codec._transformed(d)[1]) for x, d in zip(alone, datas, strict=True) if not codec.is_stored(d))
    for name in ("encode", "decode", "_coded"):
        monkeypatch.setattr(rangecoder, name, lambda *_: pytest.fail("by itself"))
    assert codec.encode_many(datas, "ratio") == alone
    assert codec.decode_many(alone, ["ratio"] * 300, list(map(len, datas))) == datas


def test_few_long_streams_are_followed_together(monkeypatch):
    """Long blocks, too few to be taken a bit at a time: all their probabilities come from one pass, not from ``encode``."""
    r, passes, bits = random.Random(4), [], rangecoder._bits
    streams = [[min(256, int(r.expovariate(0.2))) for _ in range(n)] for n in (5000, 4000, 3999, 1)]
    want = [rangecoder.encode(x) for x in streams]
    monkeypatch.setattr(rangecoder, "_bits", lambda tokens, sizes: (passes.append(len(sizes)), bits(tokens, sizes))[1])
    monkeypatch.setattr(rangecoder, "encode", lambda *_: pytest.fail("by itself"))
    assert rangecoder.encode_many(streams) == want and passes == [3, 1]


def test_long_streams_side_by_side(monkeypatch):
    """Streams that are too few to be followed a bit at a time are still coded so, long runs of bits in pieces."""
    r, alone, coded = random.Random(6), [], rangecoder._coded
    streams = [[min(256, int(r.expovariate(0.2))) for _ in range(r.randrange(2000, 3500))] for _ in range(40)]
    streams += [[0] * 9000, [256] * 2500, [r.randrange(2) for _ in range(7000)], [r.choice([0, 0, 0, 255]) for _ in range(2600)]]
    monkeypatch.setattr(rangecoder, "_coded", lambda bits, span: (alone.append(len(bits)), coded(bits, span))[1])
    assert rangecoder.encode_many(streams) == [rangecoder.encode(x) for x in streams]
    assert sum(alone) < 9 * sum(map(len, streams)) // 2


@pytest.mark.parametrize("weights", [[1] * 257, [4000, 900, 300, *[1] * 254], [1, *[0] * 255, 1], [*[0] * 9, 1]])
def test_tables_side_by_side(weights, monkeypatch):
    """Pieces give the bytes of the loop, also where they never agree on their own."""
    tokens = R.choices(range(len(weights)), weights, k=5000)
    o0, o1, ctx = tans.histograms(tokens)
    for n in (1, 511, 512, 513, 5000):
        monkeypatch.setattr(tans, "LONG", 10**9)
        want = tans.encode(tokens[:n], o0, o1, ctx[:n])
        monkeypatch.setattr(tans, "LONG", 1)
        assert tans.encode(tokens[:n], o0, o1, ctx[:n]) == want
    assert tans.decode(want, 5000, o0, o1) == tokens


@pytest.mark.parametrize("alphabet", [bytes(1), b"\0\1", b"ab", b"\xff", bytes(range(256)), b"the quick brown fox \n"])
def test_tokens_of_long_blocks(alphabet):
    for n in (1, 2, 127, 128, 129, 3000):
        symbols = b"".join(bytes([c]) * R.choice([1, 1, 1, 2, 9, 300]) for c in R.choices(alphabet, k=n))
        assert transforms._tokens_of_long(symbols).tolist() == transforms.zero_runs(transforms.mtf_ranks(symbols))


def test_modes_share_a_blocks_tokens(monkeypatch):
    datas, sorts, sort = [bytes(R.choices(b"abcd ", k=n)) for n in (40_000, 500, 0)] + [CASES["png"], CASES["program"]], [], transforms.suffix_array
    want = [[codec.encode_block(x, mode, 3) for x in datas] for mode in codec.MAGIC]
    monkeypatch.setattr(transforms, "suffix_array", lambda x: (sorts.append(len(x)), sort(x))[1])
    assert codec.encode_each(datas, list(codec.MAGIC), 3) == want and len(sorts) == 3
    assert codec.decode_block(want[list(codec.MAGIC).index("balanced")][0], "balanced", 40_000) == datas[0]


def test_more_tokens_than_bytes_are_damage():
    data = b"some text " * 30
    payload = bytearray(codec.encode_block(data, "ratio"))
    payload[35] |= 0x3F  # would be decoded for hours
    with pytest.raises(CorruptBlock, match="more tokens"):
        codec.decode_block(bytes(payload), "ratio", len(data))
    assert "more tokens" in str(codec.decode_many([bytes(payload)], ["ratio"], [len(data)])[0])


def test_bits_of_the_range_coder():
    bits = [(i * 2_654_435_761 >> 7) & 1 for i in range(10_000)]
    e = rangecoder.Encoder()
    for i, b in enumerate(bits):
        e.bit(b, 1 + i % 4095)
    d = rangecoder.Decoder(e.finish())
    assert [d.bit(1 + i % 4095) for i in range(len(bits))] == bits


def test_normalised_counts():
    for counts in ([0] * 257, [1] * 257, [10**6, *[1] * 256], [5, 5, *[0] * 255]):
        n = tans.normalise(np.array(counts))
        assert n.sum() == tans.STATES and all(x >= 1 for x, c in zip(n, counts, strict=True) if c)


def test_normalised_counts_step_by_step():
    def by_steps(counts):
        total, out = sum(counts), [0] * len(counts)
        for i, c in enumerate(counts):
            out[i] = max(1, c * 2048 // total) if c else 0
        while (gap := 2048 - sum(out)) != 0:
            at = out.index(max(out))
            out[at] += 1 if gap > 0 else -1
        return out

    r = random.Random(1)
    for _ in range(60):
        counts = [r.choice([0, 0, 1, 1, 2, r.randrange(10**r.randrange(1, 7))]) for _ in range(257)]
        counts[r.randrange(257)] += 1
        assert tans.normalise(np.array(counts)).tolist() == by_steps(counts)


def test_e8e9_against_a_plain_loop():
    def plain(data, sign):
        out, i = bytearray(data), 0
        while i + 4 < len(out):
            if out[i] in (0xE8, 0xE9):
                out[i + 1 : i + 5] = ((int.from_bytes(out[i + 1 : i + 5], "little") + sign * i) % 2**32).to_bytes(4, "little")
                i += 5
            else:
                i += 1
        return bytes(out)

    for n in range(400):
        data = bytes(R.choices([0xE8, 0xE9, 0, 1, 255], k=n % 80))
        assert transforms.e8e9(data, True) == plain(data, 1) and transforms.e8e9(data, False) == plain(data, -1)


@pytest.mark.parametrize("data", [b"a" * 50, b"ab" * 40, b"mississippi" * 9, bytes(60), b"abcdefg" * 30 + b"abcdefh", bytes(R.choices(b"ab", k=500))])
def test_suffixes_in_order(data):
    assert transforms.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_block_beyond_two_to_the_24():
    """Rows that 24-bit pointers don't tell apart."""
    data = R.randbytes((1 << 24) + 777)
    symbols, lanes = transforms.bwt(data)
    assert transforms.unbwt(symbols, int(lanes[0])) == data


def test_contexts_skip_token_256():
    assert tans.histograms([7, 256, 3])[2].tolist() == [256, 7, 7]


@pytest.mark.parametrize("mode", codec.MAGIC)
def test_damage_is_an_error_or_other_bytes(mode):
    data = b"the quick brown fox jumps over the lazy dog " * 40
    good = codec.encode_block(data, mode, 3)
    for at in range(0, len(good), max(1, len(good) // 60)):
        bad = good[:at] + bytes([good[at] ^ 0x55]) + good[at + 1 :]
        for x in (bad, good[:at]):
            try:
                assert codec.decode_block(x, mode, len(data)) != data or x[32:] == good[32:] or mode != "fast"
            except (CorruptBlock, IndexError, KeyError, ValueError):
                pass


def test_stored_blocks_below_the_tables_size():
    for n in (1, 1031, 1032):
        data = b"PK\x03\x04" + bytes(n)
        payload = codec.encode_block(data, "balanced")
        assert len(payload) == 36 + len(data) and codec.decode_block(payload, "balanced", len(data)) == data
