"""Toxicity by noisy-channel deobfuscation: restore what was disguised, then score the restored text.

A character language model is counted over every document: 4-grams of letters and word bounds, summed by executors.
Tokens that hold leetspeak, stretched letters or marks between letters, and runs of single characters, become lattices:
every observed character may stand for some letters, for itself, or for nothing. Viterbi decoding finds the likeliest
reading under the language model and the channel's costs; it is exact, as its states are the three classes that the
model's next probability hangs on. A linear model over the words of the restored text, learned from a bounded sample of
the labelled rows that aren't held out, gives the score; texts are restored alike for learning and for scoring.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, kept, spread_table, table, written
from .lang_id import bounded_sample, held_out

#: Labelled documents the scorer is fitted on, about; words it weighs, at most; scores from which a text is toxic.
SAMPLE, FEATURES, THRESHOLD = 12_000, 600, 0.3
#: Letters of a word's beginnings that are features beside the word itself.
STEMS = (4, 5, 6)
#: Decoded tokens that a worker remembers, and the length up to which it does.
REMEMBERED, SHORT = 200_000, 120
#: What the characters of leetspeak may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c"}
#: Costs, in nats: reading a disguise, dropping one of several equal letters, dropping a mark or a digit, a bound inside a spaced run.
READ, SQUEEZE, DROP, BREAK = 0.4, 0.2, 1.5, 0.3
#: Characters a token may be stripped of at its ends.
EDGES = ".,;:!?\"'()[]{}<>*_~-|&%#"
#: Classes of the language model: 0 bound, 1 to 26 letters, 27 any other letter.
CLASSES, ORDER = 28, 4
CONTEXTS = CLASSES ** (ORDER - 1)
#: Runs of single characters, at least three, with a space or a mark between them.
SPACED = re.compile(r"(?<![^\s])[\w@$!|+](?:[ .\-_*]{1,2}[\w@$!|+](?=[ .\-_*]|\s|[,;:?!]|$)){2,}")
STRETCHED = re.compile(r"(.)\1\1")
#: More than three equal characters, which a lattice reads like three.
SURPLUS = re.compile(r"(.)\1{3,}")
ZERO_WIDTH = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])


def _class_table() -> np.ndarray:
    """UTF-8 byte to class."""
    t = np.zeros(256, np.int64)
    t[ord("a") : ord("z") + 1] = t[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    t[0x80:] = 27
    return t


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """code, n: how often each 4-gram of classes stands in all texts. A code is the 4-gram read as a number to base CLASSES."""

    def run(batches):
        classes, total = _class_table(), np.zeros(CLASSES**ORDER, np.int64)
        for b in bounded(batches, 0):
            joined = " ".join(t for t in b.column(0).to_pylist() if t)
            x = classes[np.frombuffer(f" {joined} ".encode("utf-8", "replace"), np.uint8)]
            x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]  # one bound between words, and between texts
            x = np.concatenate([[0, 0], x])
            code = x[:-3]
            for k in (1, 2, 3):
                code = code * CLASSES + x[k : len(x) - 3 + k]
            total += np.bincount(code, minlength=len(total))
        full = np.flatnonzero(total)
        for at in range(0, len(full), 100_000):
            own = full[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["code", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated character log probabilities of order ORDER."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        counts = np.zeros(CLASSES**ORDER)
        counts[codes] = n
        p = np.full(CLASSES, 1.0 / CLASSES)
        for order in range(1, ORDER + 1):
            c = counts.reshape(CLASSES ** (ORDER - order), -1).sum(axis=0).reshape(-1, CLASSES)
            kinds = (c > 0).sum(axis=1, keepdims=True)
            lower = np.tile(p.reshape(-1, CLASSES), (len(c) // max(1, p.size // CLASSES), 1)) if order > 1 else p[None]
            p = (c + (kinds + 0.5) * lower) / (c.sum(axis=1, keepdims=True) + kinds + 0.5)  # Witten-Bell
        self.log = np.log(p).astype(np.float32).reshape(-1)
        self.cost = (-self.log.astype(np.float64)).tolist()


def class_of(ch: str) -> int:
    """The class of a character of restored text."""
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def lattice(token: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """For each place of a token, (what it may stand for, cost)."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        ch, run = token[i], 1
        while i + run < len(token) and token[i + run] == ch:
            run += 1
        if ch.isalpha():
            if run == 1:
                out.append([(ch, 0.0)])
            elif run == 2:
                out.append([(ch + ch, 0.0), (ch, READ)])
            else:
                out.append([(ch, SQUEEZE), (ch + ch, READ)])
        elif ch in LEET:
            reads = [(x, READ) for x in LEET[ch]]
            out.append([*reads, *((x + x, 2 * READ) for x in LEET[ch] if run > 1), ("", DROP)])
        elif spaced and ch in " .-_*":
            out.append([("", 0.0), (" ", BREAK)])
        else:
            out.append([("", 0.0 if ch in ".-_*~'" else DROP)])
        i += run
    return out


def decode(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest reading of a token that isn't empty, by Viterbi decoding; empty if there is none.

    A state is the context of the next class, as a number; -1 is the start, where nothing has been read yet.
    """
    cost, paths = model.cost, {-1: (0.0, None)}
    for place in lattice(token, spaced):
        reads = [(tuple(map(class_of, r)), extra, r) for r, extra in place]
        grown: dict[int, tuple] = {}
        for state, (so_far, back) in paths.items():
            for classes, extra, reading in reads:
                c, x = so_far + extra, state
                if classes:
                    x = max(x, 0)
                    for k in classes:
                        at = x * CLASSES + k
                        c += cost[at]
                        x = at % CONTEXTS
                if (old := grown.get(x)) is None or c < old[0]:
                    grown[x] = (c, (back, reading))
        paths = grown
    ends = [(c + cost[x * CLASSES], x) for x, (c, _) in paths.items() if x >= 0]
    out, back = [], paths[min(ends)[1]][1] if ends else None
    while back:
        back, reading = back
        out.append(reading)
    return "".join(reversed(out))


def features(words) -> set[str]:
    """Words and, with a mark before them, their beginnings."""
    return {*words, *(f"^{w[:k]}" for w in words for k in STEMS if len(w) > k)}


def pieces(token: str) -> list[str]:
    """The parts of a token between its punctuation and symbols, and between those alone that aren't leetspeak; without single ASCII characters."""
    inner = token.strip(EDGES)
    if inner.isalnum():
        return []
    cut = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in inner)
    loose = "".join(" " if d == " " and c not in LEET else c for c, d in zip(inner, cut, strict=True))
    return [p for p in dict.fromkeys([*loose.split(), *cut.split()]) if p != token and (len(p) > 1 or not p.isascii())]


class Restorer:
    """A worker's decoded tokens. ``only``: the features to report; all if None."""

    def __init__(self, model: CharModel, only=None):
        self.model, self.only, self.seen = model, only, {}

    def best(self, token: str, spaced: bool = False) -> tuple[str, ...]:
        """The words that a disguised token or a spaced run is read as."""
        return tuple(decode(SURPLUS.sub(r"\1\1\1", token), self.model, spaced).split())

    def read(self, token: str) -> tuple[str, ...]:
        """The words that a lower-case token without white space stands for."""
        if token.isalpha() and not STRETCHED.search(token):
            return (token,)
        core = token.strip(EDGES)
        if core.isalpha() and not STRETCHED.search(core):
            plain = (core,)
            odd = token.lstrip(".,;:?\"'[]{}*_~-&%#").rstrip(".,;:?\"'()[]{}*_~-&%#!|")
            return plain if odd == core or not any(c in LEET for c in odd) else plain + self.best(odd)
        if not any(c.isalpha() or c in LEET for c in token):
            return ()
        return self.best(token.strip(".,;:?\"'[]{}*_~-&%#"))

    def report(self, words) -> tuple[str, ...]:
        """The features of words that are asked for."""
        f = features(words)
        return tuple(f if self.only is None else f & self.only)

    def words(self, text: str | None) -> set[str]:
        """The features of a text, restored."""
        if not text:
            return set()
        text = text.translate(ZERO_WIDTH).lower() if not text.isascii() else text.lower()
        out: set[str] = set()
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        for token in set(text.split()):
            got = seen.get(token)
            if got is None:
                got = self.report([*self.read(token), *(w for p in pieces(token) for w in self.read(p))])
                if len(token) <= SHORT:
                    seen[token] = got
            if got:
                out.update(got)
        for m in SPACED.finditer(text):
            out.update(self.report(self.best(m.group(), True)))
        return out


def restore(text: str | None, restorer: Restorer) -> str:
    """A text with its disguised stretches replaced by what they stand for; white space is kept."""
    text = (text or "").translate(ZERO_WIDTH)
    text = SPACED.sub(lambda m: " ".join(restorer.best(m.group().lower(), True)), text)
    return re.sub(r"\S+", lambda m: m.group() if m.group().strip(EDGES).isalpha() and not STRETCHED.search(m.group()) else " ".join(restorer.read(m.group().lower())) or m.group(), text)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of penalised logistic regression, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


class Scorer:
    """Word weights over restored words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, words: set[str]) -> float:
        """The likelihood of label 1."""
        get = self.weights.get
        z = self.bias + math.fsum(sorted(x for w in words if (x := get(w)) is not None))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """A scorer of the labelled rows that aren't held out; ``sample`` bounds the rows, ``FEATURES`` the words."""
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    some = F.broadcast(bounded_sample(usable, "id", sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(some, "id")

    def run(batches):
        r = Restorer(model.value)
        for b in bounded(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(r.words(t)) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["y", "words"])

    read = written(rows.select("y", "text").mapInArrow(run, "y int, words array<string>"))
    n = Counter({r["y"]: r["n"] for r in read.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()})
    if not n[0] or not n[1]:
        return Scorer({}, math.log((n[1] + 0.5) / (n[0] + 0.5)) if n else -3.0)
    w = read.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    p, q = F.col("pos") / n[1], F.col("neg") / n[0]
    all_ = (F.col("pos") + F.col("neg")) / (n[0] + n[1])
    z = (p - q) / F.sqrt(all_ * (1 - all_) * (1 / n[1] + 1 / n[0]) + 1e-12)
    top = w.filter(F.col("pos") + F.col("neg") >= max(3, 0.003 * (n[0] + n[1]))).withColumn("z", z).filter("abs(z) >= 4").orderBy(F.desc(F.abs("z")), "w").limit(FEATURES).collect()
    words = [r["w"] for r in top]
    if not words:
        return Scorer({}, math.log((n[1] + 0.5) / (n[0] + 0.5)))
    kept = read.select("y", F.array_intersect("words", F.array(*map(F.lit, words))).alias("words")).groupBy("y", "words").agg(F.count(F.lit(1)).alias("n")).toPandas()
    at = {x: i for i, x in enumerate(words)}
    x = np.zeros((len(kept), len(words)))
    for i, own in enumerate(kept["words"]):
        x[i, [at[t] for t in own]] = 1
    repeat = np.repeat(np.arange(len(kept)), kept["n"])
    weights, bias = logistic(x[repeat], kept["y"].to_numpy(float)[repeat])
    return Scorer(dict(zip(words, weights.tolist(), strict=True)), bias)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score, predicted, restored (words it recognised in disguise or plain).

    - A null or empty text has the score of a text without known words. A null id is not held out and never trained on.
    - Labels other than 0 and 1 train nothing; of several labels of one id, 1 counts. Without labels of both kinds the
      score is the share of what there is, or low with none.
    - Repeated rows are scored alike; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    counts = written(char_counts(docs, text_col)).toPandas()  # at most CLASSES ** ORDER rows
    char_model = CharModel(counts["code"].to_numpy(np.int64), counts["n"].to_numpy(float))
    model = spark.sparkContext.broadcast(char_model)
    scorer = spark.sparkContext.broadcast(fit(docs, labels, model, id_col, text_col, label_col, sample))
    token = uuid.uuid4().hex

    def run(batches):
        s = scorer.value
        known = frozenset(w for w, x in s.weights.items() if x > 0)
        r = kept("restorer", token, lambda: Restorer(model.value, frozenset(s.weights)))
        for b in bounded(batches, 2):
            words = [r.words(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.score(w) for w in words], pa.float64()), pa.array([sorted(w & known) for w in words], pa.list_(pa.string()))], names=["doc_id", "held_out", "score", "restored"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = written(rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, restored array<string>"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "restored")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of the whole of ``documents``."""
    return toxicity(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("restored")
