"""Language identification by word-first backoff.

A word the model knows is scored by its log frequency in each language; a word it doesn't know is scored by its
character n-grams, the longest ones first, and shorter ones only where none of the longer is known. Every language of
the labelled rows that aren't held out is learned. Word and n-gram counts come from a bounded sample of those rows,
drawn by language, and are cut to the most frequent of each language, so the model has a bounded size and is broadcast.
Prediction is one narrow Arrow pass over every whole text.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, kept, sortable, spread_table, without, written

#: Labelled documents the model is fitted on, about; those of a language that are taken even beyond that, if it has them.
SAMPLE, LEAST = 20_000, 32
#: Words and n-grams of each order kept for each language, at most; with more than FULL languages each keeps fewer in proportion.
WORDS, GRAMS, FULL = 30_000, 8_000, 64
#: n-gram orders, longest first.
ORDERS = (5, 4, 3, 2, 1)
#: Words that a document's evidence counts as, at most: longer texts are not surer without end.
EVIDENCE = 20
#: Words a worker remembers beside the model's; scores it remembers, and scores up to which a model has a full table.
REMEMBERED, SCORES = 200_000, 12_800_000
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def bounded_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` of the rows, chosen by a hash of their ids; all rows if there are no more."""
    n = rows.count()
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1)))
    return rows.filter(share) if n > most else rows


def quota(sizes: list[int], most: int) -> int:
    """Rows to take of each language, so that about ``most`` are taken of all: small languages are taken whole."""
    left, sizes = most, sorted(sizes)
    for i, n in enumerate(sizes):
        share = left // (len(sizes) - i)
        if n > share:
            return max(LEAST, share)
        left -= n
    return max([LEAST, *sizes])


def stratified_sample(rows: DataFrame, sizes: dict[str, int], most: int) -> DataFrame:
    """About ``most`` of the rows (id, text, lang), LEAST of each language at least; all rows if there are no more.

    ``sizes``: the rows of each language. Rows are chosen by a hash of id and text, so rows without ids are spread too.
    """
    if sum(sizes.values()) <= most:
        return rows
    q = quota(list(sizes.values()), most)
    share = rows.sparkSession.createDataFrame([(x, int((1 << 30) * min(1.0, q / n))) for x, n in sizes.items()], "lang string, share long")
    return rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64(F.lit("sample"), F.col("id"), F.col("text")), F.lit(1 << 30)) < F.col("share")).drop("share")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its boundary marks."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def model_counts(labelled: DataFrame, words: int = WORDS, most_grams: int = GRAMS) -> DataFrame:
    """From (lang, text): lang, kind (0 words, else the order), token, n, cut to the most frequent of each language and kind.

    Tokens that occur equally often stay or go together, so no more than asked for stay.
    """
    def run(batches):
        counts: dict[str, Counter] = {}
        for b in bounded(batches, 1):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
        for lang, own_words in counts.items():
            found: Counter = Counter()
            for w, c in own_words.items():
                found[0, w] += c
                for n in ORDERS:
                    for g in grams(w, n):
                        found[n, g] += c
            keys = list(found)
            for at in range(0, len(keys), 50_000):
                own = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([k for k, _ in own], pa.int32()), pa.array([t for _, t in own]), pa.array([found[k] for k in own], pa.int64())], names=["lang", "kind", "token", "n"])

    summed = labelled.select("lang", "text").mapInArrow(run, "lang string, kind int, token string, n long").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    summed = written(summed)
    # Tokens are cut by how often they occur: a row for each such number, so no window sees the tokens themselves.
    steps = summed.groupBy("lang", "kind", "n").agg(F.count(F.lit(1)).alias("tokens"))
    above = F.sum("tokens").over(Window.partitionBy("lang", "kind").orderBy(F.desc("n")))
    fits = steps.withColumn("above", above).filter(F.col("above") <= F.when(F.col("kind") == 0, words).otherwise(most_grams))
    least = fits.groupBy("lang", "kind").agg(F.min("n").alias("least"))  # as many rows as languages and orders
    return summed.join(F.broadcast(least), ["lang", "kind"]).filter("n >= least").select("lang", "kind", "token", "n")


class Model:
    """Log frequencies of words and n-grams by language; only those of languages that have a token are stored."""

    def __init__(self, langs: list[str], counts):
        """counts: rows (lang, kind, token, n) with lang one of ``langs``."""
        self.langs, self.rows = langs, {}
        at = {x: i for i, x in enumerate(langs)}
        of = np.fromiter((self.rows.setdefault(x, len(self.rows)) for x in zip(counts["kind"], counts["token"], strict=True)), np.int64)
        lang, n = np.fromiter((at[x] for x in counts["lang"]), np.int64), np.fromiter(counts["n"], np.float64)
        kind = np.fromiter(counts["kind"], np.int64)
        self.base, gain = {}, np.zeros(len(n))
        for k in set(kind.tolist()):
            own = kind == k
            total = np.bincount(lang[own], n[own], len(langs)) + 0.5 * len(np.unique(of[own]))
            self.base[k] = np.log(0.5 / total).astype(np.float32)
            gain[own] = np.log((n[own] + 0.5) / 0.5)
        order = np.lexsort((lang, of))
        self.lang, self.gain = lang[order].astype(np.int32), gain[order].astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.rows)))])
        self.table = None
        if len(self.rows) * len(langs) <= SCORES:  # quicker to read, same scores
            kinds = np.fromiter((k for k, _ in self.rows), np.int64, len(self.rows))
            self.table = np.zeros((len(self.rows), len(langs)), np.float32)
            for k, base in self.base.items():
                self.table[kinds == k] = base
            self.table[of[order], self.lang] += self.gain

    def mean(self, kind: int, rows: list[int]) -> np.ndarray:
        """The mean of rows of one kind."""
        if self.table is not None:
            return self.table[rows].mean(axis=0) if len(rows) > 1 else self.table[rows[0]]
        out = self.base[kind].copy()
        for r in rows:
            own = slice(self.starts[r], self.starts[r + 1])
            out[self.lang[own]] += self.gain[own] / np.float32(len(rows))
        return out

    def backoff(self, word: str) -> np.ndarray | None:
        """Scores of a word the model doesn't know; None if it has no letter."""
        if not any(map(str.isalpha, word)):
            return None
        for n in ORDERS:
            if known := [self.rows[n, g] for g in grams(word, n) if (n, g) in self.rows]:
                return self.mean(n, known)
        return np.zeros(len(self.langs), np.float32)


class Predictor:
    """A model with the words it has met, in a worker process."""

    def __init__(self, model: Model):
        self.model, self.most = model, min(REMEMBERED + len(model.rows), SCORES // max(1, len(model.langs)))
        self.forget()

    def forget(self) -> None:
        self.at, self.own, self.n = {}, np.zeros((1024, len(self.model.langs)), np.float32), 0

    def learn(self, word: str) -> int:
        """The row of a word's scores, -1 without a letter."""
        m = self.model
        v = m.mean(0, [own]) if (own := m.rows.get((0, word))) is not None else m.backoff(word)
        if v is None:
            self.at[word] = -1
            return -1
        if self.n == len(self.own):
            self.own = np.concatenate([self.own, np.zeros_like(self.own)])
        self.own[self.n] = v
        self.at[word] = self.n
        self.n += 1
        return self.n - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of belief."""
        words = Counter(LETTERS.findall(text.lower())) if text else None
        if not words or not self.model.langs:
            return "und", 0.0
        if len(self.at) > self.most:
            self.forget()
        get, learn = self.at.get, self.learn
        rows = [i if (i := get(w)) is not None else learn(w) for w in words]
        n = np.fromiter(words.values(), np.float64, len(rows))
        rows = np.array(rows)
        if (rows < 0).any():
            n, rows = n[rows >= 0], rows[rows >= 0]
            if not len(rows):
                return "und", 0.0
        total = n @ self.own[rows]
        total = (total - total.max()) * min(1.0, EVIDENCE / n.sum())
        best = int(total.argmax())
        return self.model.langs[best], 1.0 / math.fsum(np.exp(total).tolist())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of all languages of the labelled rows that aren't held out, from about ``sample`` documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as the model has languages
    langs = sorted(sizes)
    if not langs:
        return Model([], {k: [] for k in ("lang", "kind", "token", "n")})
    part = min(1.0, FULL / len(langs))
    counts = model_counts(stratified_sample(rows, sizes, sample), math.ceil(WORDS * part), math.ceil(GRAMS * part)).toPandas()
    return Model(langs, counts)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    - A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing can be learned.
    - A null label trains nothing. A null id is not held out. Equal scores go to the first language by code point.
    - Repeated rows count as often as they stand there; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, sample))
    token = uuid.uuid4().hex

    def run(batches):
        p = kept("language", token, lambda: Predictor(model.value))
        for b in bounded(batches, 2):
            got = [p.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double"))


def drop_unidentified(docs: DataFrame, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without rows whose language isn't identified: ``und``, or a score under ``least``. All columns stay.

    Rows are judged by their text, so rows that share an id only are told apart. Where no row has a label nothing can
    be learned, and all rows stay.
    """
    learned = fit(docs, id_col, text_col, lang_col)
    if not learned.langs:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(learned)
    token = uuid.uuid4().hex
    key = [*sortable(docs, id_col), F.xxhash64(F.lit("row"), F.col(id_col), F.col(text_col)).alias("row")]
    rows = docs.select(*key, F.col(text_col).alias("text"))

    def run(batches):
        p = kept("language", token, lambda: Predictor(model.value))
        for b in bounded(batches, 3):
            got = [p.predict(t) for t in b.column(3).to_pylist()]
            yield b.select(["no_id", "doc", "row"]).filter(pa.array([lang == "und" or score < least for lang, score in got], pa.bool_()))

    gone = written(rows.mapInArrow(run, f"no_id boolean, doc {dict(rows.dtypes)['doc']}, row long")).distinct()
    return without(docs, key, gone, gone.limit(0))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of the whole of ``documents``."""
    return language_id(spread_table(spark, sf_dir, "documents"))
