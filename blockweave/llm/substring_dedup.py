"""Substring dedup: every run of WINDOW words that also starts earlier in the corpus is removed.

The reference that texts are matched against is the corpus itself, which no automaton on one machine can hold. It is
cut into shards whose suffix automata do fit, by content: a window of words goes to the shard of its minimizer, the
least hash among the GRAM-word runs inside it, so equal windows always meet in one shard and a window that has no
equal never needs to travel far. Consecutive windows with one minimizer form a piece, and only pieces move:

1. One scan cuts all texts into pieces, without their words. Minimizers are counted; those that occur once prove that
   no window around them repeats.
2. Places of pieces with equal content hashes share one decision, so a hot passage travels once. A second scan gives
   the words of each piece's first place.
3. In its shard, in the order of first places, each piece is streamed through the suffix automaton of those before it
   that share its minimizer. The matching statistics say which of its windows are there already; its further places
   repeat all of them. A minimizer with more than SPLIT different pieces would outgrow a shard; its windows are
   grouped by their own words instead, which is exact as well.
4. Each text gets the places of its repeated windows and drops the words they cover.

The second scan leaves out what a bit table of a fixed size rules out. The table is a filter only: what it lets
through by chance is told apart by exact joins, so it costs time and never results.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, sortable, spread_table, written

#: Words in a window, and in the runs that minimizers are chosen from.
WINDOW, GRAM = 20, 6
#: Different pieces of one minimizer above which it is split into windows; pieces in a shard, about.
SPLIT, SHARD = 1_000, 4_000
#: Rows of one key from which it isn't dealt to one task; keys with as many there may be at most, which bounds their broadcast.
HOT, HOT_KEYS = 1_000, 100_000
#: Binary logarithm of the bits in a filter: 8 MB, whatever the input.
BITS = 26
#: Grams that are compared at once, and the low bits of a hash that give way to a gram's place among them.
CHUNK, PLACE = 1 << 16, np.uint64((1 << 17) - 1)
#: Bytes of words that are hashed at once; longer words than LONG, which may be built to collide, are hashed by themselves.
AT_ONCE, LONG = 1 << 18, 256
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTES = np.random.default_rng(7).integers(1, 1 << 64, 256, np.uint64)
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, r, np.uint64))]) for r in (_R, _R_INVERSE)]
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of what isn't ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Texts:
    """The words of several texts: data (bytes), starts and ends of words in it, lengths (words of each text)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        self.data = texts.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
        at, x = at - at[0], np.frombuffer(self.data, np.uint8)
        inside = ~_IS_SPACE[x]
        bounds = np.zeros(len(x) + 1, bool)
        bounds[at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | bounds[1:-1]
        last[:-1] &= ~inside[1:] | bounds[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.lengths = np.diff(np.searchsorted(self.starts, at))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, whichever text it is in."""
        x, starts, ends = np.frombuffer(self.data, np.uint8), self.starts, self.ends
        up, down = _power_tables(AT_ONCE + 1)
        out, i = np.zeros(len(starts), np.uint64), 0
        while i < len(starts):
            j = int(np.searchsorted(ends, starts[i] + AT_ONCE, side="right"))
            if j > i:
                v = _BYTES[x[starts[i] : ends[j - 1]]]
                sums = np.concatenate([[np.uint64(0)], np.cumsum(v * up[: len(v)], dtype=np.uint64)])
                a = starts[i:j] - starts[i]
                out[i:j] = (sums[ends[i:j] - starts[i]] - sums[a]) * down[a]
            i = max(j, i + 1)
        out = _mixed(out)
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            from xxhash import xxh64_intdigest

            out[long] = [xxh64_intdigest(self.data[a:b], 7) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        return out

    def runs(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[bytes]:
        """n words of text doc from its word start, joined by single spaces."""
        first = (np.cumsum(self.lengths) - self.lengths)[doc] + start
        return [b" ".join(self.data[a:b].split()) for a, b in zip(self.starts[first].tolist(), self.ends[first + n - 1].tolist(), strict=True)]


def leftmost_least(keys: np.ndarray, span: int) -> np.ndarray:
    """Where the least of every ``span`` neighbours stands, the leftmost of equal ones; low bits of keys don't count."""
    out = np.empty(len(keys) - span + 1, np.int64)
    for b in range(0, len(out), CHUNK):
        x = keys[b : b + CHUNK + span - 1]
        x = (x & ~PLACE) | np.arange(len(x), dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            x = np.minimum(x[:-step], x[step:])
            width += step
        out[b : b + len(x)] = (x & PLACE).astype(np.int64) + b
    return out


def cut_pieces(texts: Texts, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Pieces of several documents: doc (index), start (first word), n (windows), anchor, piece (hashes)."""
    lengths = texts.lengths
    total = int(lengths.sum())
    none = np.empty(0, np.int64)
    if total < window or not (lengths >= window).any():
        return {"doc": none, "start": none, "n": none, "anchor": none, "piece": none}
    h = texts.hashes()
    up, down = _power_tables(total + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:total], dtype=np.uint64)])
    grams = _mixed((sums[gram:] - sums[:-gram]) * down[: total - gram + 1])
    at = leftmost_least(grams, window - gram + 1)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    p = np.flatnonzero(np.arange(len(at)) + window <= ends[doc])  # windows that lie within one document
    m = at[p]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(p)]]))
    begin = p[first]
    content = (sums[begin + n - 1 + window] - sums[begin]) * down[begin]
    own = doc[begin]
    return {
        "doc": own,
        "start": begin - (ends - lengths)[own],
        "n": n,
        "anchor": grams[m[first]].view(np.int64),
        "piece": _mixed(content ^ n.astype(np.uint64)).view(np.int64),
    }


def filter_bits(keys: DataFrame, key: Column) -> np.ndarray:
    """A bit table of 2 ** BITS bits with those set that the keys' low bits name; combined by executors."""
    low = key.bitwiseAND(F.lit((1 << BITS) - 1))
    got = keys.select(F.shiftright(low, 6).cast("int").alias("i"), F.expr("1L").alias("one"), low.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    words = got.groupBy("i").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("bits"))

    def pack(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            i, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([i.astype("<i4").tobytes()]), pa.array([bits.astype("<i8").tobytes()])], names=["i", "bits"])

    out = np.zeros(1 << (BITS - 6), np.uint64)
    for row in words.mapInArrow(pack, "i binary, bits binary").toLocalIterator():  # one partition's words at a time
        out[np.frombuffer(row["i"], "<i4")] = np.frombuffer(row["bits"], "<u8")
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the table lets through."""
    low = keys.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


class Automaton:
    """A suffix automaton of several word sequences, grown one sequence at a time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        """Take in one sequence."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w, q: int) -> int:
        """A copy of state ``q`` that is as long as its way through ``p`` makes it."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def matches(self, words: list) -> list[int]:
        """Matching statistics: for each position, the length of the longest run ending there that some sequence holds."""
        nxt, link, length = self.next, self.link, self.length
        state = got = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                got = length[state]
            if w in nxt[state]:
                state, got = nxt[state][w], got + 1
            out.append(got)
        return out


def _met(many: DataFrame, few: DataFrame, keys: list[str], how: str, hot: int) -> DataFrame:
    """Written ``many`` joined to written ``few``, which holds each key once and in ``times`` its rows in ``many``.

    Keys with more rows than both ``hot`` and a HOT_KEYS-th of all rows stay where they are and meet a broadcast: there
    can't be more than HOT_KEYS of them, whatever the input. The others are dealt out and are small groups each.
    """
    limit = max(hot, many.count() // HOT_KEYS)
    large, small = few.filter(F.col("times") > limit).drop("times"), few.filter(F.col("times") <= limit).drop("times")
    if large.isEmpty():
        return many.join(small, keys, how)
    rest = many.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return many.join(F.broadcast(large), keys, how).unionByName(rest.join(small, keys, how))


def _scan(rows: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(batch, texts, pieces)`` over batches of (no_id, doc, row, text)."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for b in bounded(batches, 3):
            texts = Texts(b.column(3))
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in emit(b, texts, cut_pieces(texts))], names=names)

    return rows.mapInArrow(run, schema)


def _decided(shard: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """For the different pieces of one shard, each with its words: mask, the windows that start earlier in the shard, and
    again, those that an equal piece further on repeats.

    The first are matching statistics of the piece in the automaton of the pieces before it. The automaton that has taken
    a piece in matches it throughout, so the second are all its windows. Windows of different minimizers are never equal:
    each minimizer has an automaton of its own, into which a piece goes only if another one follows.
    """
    shard = shard.sort_values(["anchor", "no_id", "doc", "row", "start"], kind="stable", ignore_index=True)
    anchors, masks, again = shard["anchor"].tolist(), np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
    automaton, before = None, None
    for i, (anchor, words) in enumerate(zip(anchors, shard["words"], strict=True)):
        own = words.split(b" ")
        again[i] = (1 << len(own) - window + 1) - 1
        if anchor == before:
            masks[i] = sum(1 << j for j, got in enumerate(automaton.matches(own)[window - 1 :]) if got >= window)
        else:
            automaton, before = Automaton(), anchor
        if i + 1 < len(anchors) and anchors[i + 1] == anchor:
            automaton.add(own)
    return shard.assign(mask=masks, again=again)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, shard: int = SHARD, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text (null without ``with_text``).

    - A null text has no words. Texts shorter than a window lose nothing.
    - A document is an id with a text. Earlier means a smaller id, null ids last; of one id with several texts a smaller
      hash of the text; in one text an earlier start. Rows that repeat id and text, null ids included, are one document
      and don't repeat each other; rows that share an id only are documents of their own.
    - An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.select(id_col).dtypes)[id_col]
    own = F.xxhash64(F.lit("row"), F.col(id_col), F.col(text_col))
    rows = docs.select(*sortable(docs, id_col), own.alias("row"), F.col(text_col).alias("text"))
    place = f"no_id boolean, doc {dict(rows.dtypes)['doc']}, row long, start int"

    def cut(b, texts, c):
        at = pa.array(c["doc"])
        return [c["anchor"], c["piece"], c["n"].astype(np.int8), *(b.column(k).take(at) for k in range(3)), c["start"].astype(np.int32)]

    pieces = written(_scan(rows, cut, f"anchor long, piece long, n tinyint, {place}"))
    twice = written(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    places = written(_met(pieces, twice, ["anchor"], "left_semi", hot))
    discard(pieces, twice)
    first = places.groupBy("anchor", "piece", "n").agg(F.min(F.struct("no_id", "doc", "row", "start")).alias("first"), F.count(F.lit(1)).alias("times"))
    first = written(first.select("anchor", "piece", "n", "times", "first.*"))
    crowded = written(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > split).select("anchor"))

    spot = F.col("piece").bitwiseXOR(F.col("row")).bitwiseXOR(F.shiftleft(F.col("start").cast("long"), 9))
    wanted = spark.sparkContext.broadcast(filter_bits(first, spot))

    def contents(b, texts, c):
        row = b.column(2).to_numpy()[c["doc"]]
        ok = np.flatnonzero(passes(wanted.value, c["piece"] ^ row ^ (c["start"] << 9)))
        text = texts.runs(c["doc"][ok], c["start"][ok], c["n"][ok] + WINDOW - 1)
        return [c["anchor"][ok], c["piece"][ok], row[ok], c["start"][ok].astype(np.int32), pa.array(text, pa.binary())]

    read = written(_scan(rows, contents, "anchor long, piece long, row long, start int, words binary"))
    shards = max(1, -(-first.count() // shard))
    deal = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")

    def decide(pdf: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.drop_duplicates(["anchor", "piece", "row", "start"])  # rows repeated with their text
        return _decided(pdf.merge(texts, on=["anchor", "piece", "row", "start"]))[["anchor", "piece", "mask", "again"]]

    usual = first.join(crowded, "anchor", "left_anti").withColumn("shard", deal)
    met = usual.groupBy("shard").cogroup(read.select("*", deal).groupBy("shard"))
    masks = met.applyInPandas(decide, "anchor long, piece long, mask long, again long")
    if not crowded.isEmpty():
        masks = masks.union(_by_window(first.join(crowded, "anchor"), read))
    masks = written(masks)
    discard(read)

    verdicts = first.join(masks, ["anchor", "piece"]).select("anchor", "piece", "times", F.col("row").alias("first_row"), F.col("start").alias("first_start"), "mask", "again")
    verdicts = written(verdicts.filter("mask > 0 OR (again > 0 AND times > 1)"))
    is_first = (F.col("row") == F.col("first_row")) & (F.col("start") == F.col("first_start"))
    marks = _met(places, verdicts, ["anchor", "piece"], "inner", hot).select("no_id", "doc", "row", "start", F.when(is_first, F.col("mask")).otherwise(F.col("again")).alias("mask")).filter("mask > 0")
    by_row = marks.select("no_id", "doc", "row", F.shiftleft(F.col("start").cast("long"), 16).bitwiseOR(F.col("mask")).alias("mark")).groupBy("no_id", "doc", "row").agg(F.collect_set("mark").alias("marks"))

    def finish(batches):
        for b in bounded(batches, 1):
            n, gone, digest, kept = [], [], [], []
            for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                size = len(words)
                if marks:
                    m, j = np.array(marks, np.int64)[:, None], np.arange(WINDOW - GRAM + 1)
                    own = ((m >> 16) + j)[(m >> j) & 1 == 1]
                    cover = np.bincount(own, minlength=size + 1) - np.bincount(own + WINDOW, minlength=size + 1)
                    words = list(compress(words, (np.cumsum(cover[:-1]) == 0).tolist()))
                left = b" ".join(words)
                n.append(size)
                gone.append(size - len(words))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    texts = docs.select(F.col(id_col).alias("doc_id"), *sortable(docs, id_col), own.alias("row"), F.col(text_col).alias("text"))
    joined = texts.join(by_row, ["no_id", "doc", "row"], "left").select("doc_id", "text", "marks")
    return written(joined.mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"))


def _by_window(hot: DataFrame, read: DataFrame) -> DataFrame:
    """anchor, piece, mask, again for pieces of crowded minimizers, window by window: windows are grouped by their words
    themselves, and all but the first place of each repeat it. Groups combine on the map side."""
    known = hot.join(read, ["anchor", "piece", "row", "start"]).dropDuplicates(["anchor", "piece"])
    parts = F.split(F.decode("words", "ISO-8859-1"), " ")
    windows = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.encode(F.array_join(F.slice(parts, i, WINDOW), " "), "ISO-8859-1"))
    each = known.select("anchor", "piece", "no_id", "doc", "row", "start", F.posexplode(windows).alias("j", "window"))
    heads = each.groupBy("window").agg(F.min(F.struct("no_id", "doc", "row", F.expr("start + j"), "anchor", "piece", "j")).alias("f"))
    fresh = heads.groupBy("f.anchor", "f.piece").agg(F.bit_or(F.expr("shiftleft(1L, f.j)")).alias("bits"))
    full = F.expr("shiftleft(1L, cast(n as int)) - 1")
    return hot.join(fresh, ["anchor", "piece"], "left").select("anchor", "piece", full.bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0)))).alias("mask"), full.alias("again"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows in the whole of ``documents``."""
    return substring_dedup(spread_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


SQL = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM l),
k AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS key FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM k WHERE i + 19 <= n),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE r > 1),
m AS (SELECT w.doc_id, count(c.i) AS n_removed, coalesce(string_agg(CASE WHEN c.i IS NULL THEN w.word END, ' ' ORDER BY w.i), '') AS kept
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.i = c.i GROUP BY w.doc_id)
SELECT l.doc_id, CAST(len(l.ws) AS BIGINT) AS n_words, CAST(coalesce(m.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256
FROM l LEFT JOIN m ON l.doc_id = m.doc_id
"""
