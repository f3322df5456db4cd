"""Packing documents into sequences by non-negative least squares over window-filling length combinations.

One narrow Arrow pass encodes every document. Its ids are cut into whole windows, a body that is a multiple of UNIT, and
a tail shorter than UNIT, and each piece gets its checksum there, so texts and ids never move; only piece rows do.

Whole windows are sequences by themselves. Bodies come in WINDOW / UNIT - 1 lengths. All combinations of at most DEPTH
lengths that fill a window exactly are enumerated; non-negative least squares against the histogram of body lengths
says how often to repeat each. The solution is rounded down and dealt out in every bucket of documents on its own, in
proportion to what the bucket holds; what is left of bodies, and all tails, is packed greedily there, best fit first.
A bucket holds a bounded number of pieces, so a task's work doesn't grow with the input, and leaves a few
part-filled sequences at most.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, kept, spread_table, written

#: Tokens in a sequence; the grain bodies are cut to; lengths in a combination, at most; the id after each document.
WINDOW, UNIT, DEPTH, END = 2048, 64, 4, 1
#: Pieces that one bucket packs, about.
BUCKET = 40_000
#: Encoded words a worker remembers in each of two generations.
REMEMBERED = 150_000


#: The vocabulary's pre-token pattern; the last letter that is cut by it here.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LATIN = "ɏ"


@cache
def tokenizer(path: str):
    """The library's tokenizer of a vocabulary file, once in a process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def merger(path: str):
    """A function from a lower-case pre-token's bytes to its ids, by merge ranks; None for a vocabulary of another make.

    The vocabulary marks a word's last symbol. Here a byte that UTF-8 never has stands for the mark and is merged into
    the last symbol before anything else; from then on ranks are those of the vocabulary.
    """
    import tiktoken

    model = json.loads(tokenizer(path).to_str())["model"]
    if model.get("end_of_word_suffix") != "</w>":
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in the vocabulary's alphabet
    others = [x for x in range(256) if x not in set(shown)]
    byte = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(others)}
    letter = {x: c for c, x in byte.items()}
    spelled = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + (b"\xff" if t.endswith("</w>") and t != "</w>" else b"")
    tokens = [letter[x] for x in range(256)] + [letter[x] + "</w>" for x in range(255)]
    tokens += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks = {spelled(t): k for k, t in enumerate(tokens)}
    if len(ranks) != len(tokens):
        return None
    ids = [model["vocab"].get(t, -1) for t in tokens]
    encoding = tiktoken.Encoding("ranks", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    return lambda part: array("I", [ids[r] for r in encoding._encode_single_piece(part + b"\xff")]).tobytes()


class Words(dict):
    """A run of bytes without ASCII white space, to its ids as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space and lets no token cross it, so a text's ids are those of its runs in order. A run
    is cut into lower-case pre-tokens, which are runs themselves; what has letters beyond Latin, or looks like a
    special token, is left to the library. Two generations are remembered, so that frequent runs stay.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path, self.old, self.merge = path, {}, merger(path)

    def __missing__(self, run: bytes) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = self.encode(run)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[run] = ids
        return ids

    def encode(self, run: bytes) -> bytes:
        """Ids of a run that isn't remembered."""
        if self.merge and run.isalpha():
            low = run.lower()
            return self.merge(low) if low == run else self[low]
        text = run.decode()
        if self.merge is None or b"<|" in run or max(text) > LATIN:
            return np.array(tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = [p.encode() for p in PATTERN.findall(unicodedata.normalize("NFC", text).lower())]
        return self.merge(run) if parts == [run] else b"".join([self[p] for p in parts])

    def ids(self, text: str) -> bytes:
        """Ids of a whole text."""
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


def cut(n: int, window: int = WINDOW, unit: int = UNIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    whole, rest = divmod(n, window)
    pieces = [(k * window, window) for k in range(whole)]
    if body := rest // unit * unit:
        pieces.append((whole * window, body))
    if rest % unit:
        pieces.append((n - rest % unit, rest % unit))
    return pieces


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: a row for each piece of each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names, end = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"], np.array([END], "<u4").tobytes()

    def run(batches):
        words = kept("words", path, lambda: Words(path))
        for b in bounded(batches, 1):
            at, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = words.ids(text) + end
                n = len(ids) // 4
                for start, length in cut(n):
                    at.append(i)
                    out.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *map(pa.array, columns)], names=names)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long")


def combos(units: int = WINDOW // UNIT, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every multiset of 2 to ``depth`` lengths, in units, that fills a window of ``units`` exactly, largest length first."""
    return [c[::-1] for k in range(2, depth + 1) for c in combinations_with_replacement(range(1, units), k) if sum(c) == units]


def nnls(a: np.ndarray, b: np.ndarray, most: int = 500) -> np.ndarray:
    """The x >= 0 with the least |ax - b|, by active sets: free the variable with the steepest gain, solve, step back to the border."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(b).max(initial=0))) * len(b)
    for _ in range(most):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        if not (gain > slack).any():
            break
        free[int(gain.argmax())] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (s[free] > 0).all():
                x = s
                break
            out = free & (s <= 0)
            step = np.min(x[out] / np.maximum(x[out] - s[out], 1e-300))
            x = np.maximum(x + step * (s - x), 0)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(histogram: dict[int, int]) -> list[tuple[tuple[int, ...], float]]:
    """(combination, share): how many sequences of each combination to make for each body, from the lengths' histogram in units."""
    total = sum(histogram.values())
    if not total:
        return []
    made = combos()
    a = np.zeros((WINDOW // UNIT - 1, len(made)))
    for j, c in enumerate(made):
        for u in c:
            a[u - 1, j] += 1
    x = nnls(a, np.array([histogram.get(u, 0) / total for u in range(1, WINDOW // UNIT)]))
    return [(made[j], float(x[j])) for j in np.argsort(-x, kind="stable") if x[j] > 1e-9]


def pack_bucket(lengths: np.ndarray, shares: list[tuple[tuple[int, ...], float]]) -> tuple[np.ndarray, np.ndarray, int]:
    """For the pieces of one bucket: each one's sequence and its offset there, and the number of sequences."""
    sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    body = (lengths % UNIT == 0) & (lengths < WINDOW)
    stacks = {u: np.flatnonzero(lengths == u * UNIT)[::-1].tolist() for u in range(1, WINDOW // UNIT)}
    bodies, made = int(body.sum()), 0

    def put(i: int, seq: int, at: int) -> int:
        sequence[i], offset[i] = seq, at
        return at + int(lengths[i])

    for i in np.flatnonzero(lengths == WINDOW):
        put(i, made, 0)
        made += 1
    for combo, share in shares:
        need = {u: combo.count(u) for u in combo}
        for _ in range(min(int(share * bodies), *(len(stacks[u]) // k for u, k in need.items()))):
            at = 0
            for u in combo:
                at = put(stacks[u].pop(), made, at)
            made += 1
    rest = sorted((i for s in stacks.values() for i in s), key=lambda i: (-lengths[i], i))
    tails = sorted(np.flatnonzero(lengths % UNIT).tolist(), key=lambda i: (-lengths[i], i))
    room: list[tuple[int, int]] = []  # (free tokens, sequence), ascending
    for i in [*rest, *tails]:
        n = int(lengths[i])
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, seq = room.pop(k)
        else:
            free, seq, made = WINDOW, made, made + 1
        put(i, seq, WINDOW - free)
        if free > n:
            insort(room, (free - n, seq))
    return sequence, offset, made


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    - A null text counts as empty: its one token is the end id. Every row is packed, so repeated rows give repeated
      pieces, each at its own place; null ids are packed like others.
    - Ties go to the piece that comes first by (doc_id, start, checksum). An empty table gives no rows.
    Sequences have at most WINDOW tokens. Their ids hold the bucket in the upper bits, so they don't collide.
    """
    cuts = written(pieces(docs, path, id_col, text_col))
    body = cuts.filter((F.col("length") % UNIT == 0) & (F.col("length") < WINDOW))
    shares = plan({int(r["u"]): int(r["n"]) for r in body.groupBy((F.col("length") / UNIT).cast("int").alias("u")).agg(F.count(F.lit(1)).alias("n")).collect()})
    buckets = max(1, -(-cuts.count() // bucket))
    names = [*cuts.columns, "sequence_id", "offset"]
    kind = dict(cuts.dtypes)["doc_id"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        sequence, offset, _ = pack_bucket(pdf["length"].to_numpy(), shares)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)[names]

    # A row's bucket also hangs on its checksum, so that many rows of one document don't meet in one bucket.
    dealt = cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInPandas(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents``, packed under the word vocabulary."""
    import public_tokenizers

    return pack(spread_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
