"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The tagger is trained here, in numpy, from labelled spans: those that the patterns find in a bounded sample of the
texts, copies of them in other spellings (no plus sign, other separators, spelled-out at and dot) under the same label, random
ones of each kind put into texts without any, and dates, counts and codes under no label. Texts are cut into overlapping
windows wherever a digit, an at sign or a spelled-out one stands, since nothing it looks for is without one; each window
is decoded by Viterbi, and where windows overlap a character takes its tag from the window it lies deepest in, over the
whole text.
Spans so found are kept if they have the digits or marks that their kind can't be without and touch no span of the
patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, spread_table, written

KINDS = ("email", "ip", "card", "phone")
#: Characters in a window and from one to the next; characters around a trigger that windows cover.
WIDTH, STEP, MARGIN = 64, 32, 32
#: Windows the tagger is trained on, at most, half of them with spans; steps, windows in a step, sizes of the embedding and of each direction's state; seed.
TRAIN, STEPS, BATCH, EMBED, HIDDEN, SEED = 3_000, 420, 64, 12, 20, 11
#: Windows tagged at once.
AT_ONCE = 2_048
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]|(?<=\w) at (?=[\w-]+ dot \w)", re.IGNORECASE)
AT_MARK, DOT_MARK = re.compile(r"@|\bat\b", re.IGNORECASE), re.compile(r"\.|\bdot\b", re.IGNORECASE)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether a card number's check digit fits."""
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then by start."""
    out: list[Span] = []
    last = 0
    for m in AT.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            last = m.end()
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if _ip_ok(m.group())]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def joined(spans: Iterable[Span]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def encode(s: str) -> np.ndarray:
    """Character classes: printable ASCII by itself, other letters, white space, the rest."""
    x = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((x >= 32) & (x < 127), x - 31, np.where((x == 10) | (x == 9) | (x == 13), 97, np.where(x > 127, 96, 98)))


CODES = 99  # 0 pads


def windows_of(text: str) -> list[int]:
    """Starts of the windows that cover a text's triggers."""
    out: list[int] = []
    for m in TRIGGER.finditer(text):
        low, high = max(0, m.start() - MARGIN) // STEP * STEP, m.end() + MARGIN
        start = max(low, out[-1] + STEP) if out else low
        while start < high and start < len(text):
            out.append(start)
            start += STEP
    return out


class Tagger:
    """A bidirectional LSTM over characters with a linear-chain CRF on top."""

    def __init__(self, seed: int = SEED, dtype=np.float32):
        r = np.random.default_rng(seed)
        init = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"embed": r.normal(0, 0.3, (CODES, EMBED)), "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"wx{d}": init(EMBED, 4 * HIDDEN), f"wh{d}": init(HIDDEN, 4 * HIDDEN), f"b{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.p = {k: x.astype(dtype) for k, x in self.p.items()}

    def _run(self, e: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction over (batch, time, embedding)."""
        n, t, _ = e.shape
        x, h, c, out = e @ self.p[f"wx{d}"] + self.p[f"b{d}"], np.zeros((n, HIDDEN), e.dtype), np.zeros((n, HIDDEN), e.dtype), np.empty((n, t, HIDDEN), e.dtype)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = x[:, k] + h @ self.p[f"wh{d}"]
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o, z = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            before, old = h, c
            c = f * c + i * z
            tc = np.tanh(c)
            h = o * tc
            out[:, k] = h
            if keep is not None:
                keep.append((k, i, f, o, z, tc, before, old))
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores (batch, time, tag)."""
        e, both = self.p["embed"][codes], []
        for d in "fb":
            tape = None if keep is None else keep.setdefault(d, [])
            both.append(self._run(e, d, tape))
        h = np.concatenate(both, 2)
        if keep is not None:
            keep |= {"e": e, "h": h}
        return h @ self.p["out"] + self.p["bias"]

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """The best tags (batch, time)."""
        em, trans = self.emissions(codes), self.p["trans"]
        score, back = em[:, 0] + self.p["start"], np.zeros((*codes.shape, 1), np.int64).repeat(TAGS, 2)
        for k in range(1, codes.shape[1]):
            s = score[:, :, None] + trans
            back[:, k] = s.argmax(1)
            score = s.max(1) + em[:, k]
        tags = np.empty(codes.shape, np.int8)
        tags[:, -1] = score.argmax(1)
        for k in range(codes.shape[1] - 1, 0, -1):
            tags[:, k - 1] = np.take_along_axis(back[:, k], tags[:, k, None].astype(np.int64), 1)[:, 0]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tags for each window, and its gradients."""
        tape: dict = {}
        em = self.emissions(codes, tape)
        n, t, _ = em.shape
        trans, start = self.p["trans"], self.p["start"]
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0] + start
        for k in range(1, t):
            alpha[:, k] = lse(alpha[:, k - 1, :, None] + trans, 1) + em[:, k]
        for k in range(t - 2, -1, -1):
            beta[:, k] = lse(trans + (em[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        at = np.arange(n)[:, None], np.arange(t)[None], tags
        gold = em[at].sum(1) + start[tags[:, 0]] + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        d_em = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + trans + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1.0)
        d_start = d_em[:, 0].sum(0)
        np.subtract.at(d_start, tags[:, 0], 1.0)
        d_em[at] -= 1.0
        d_em /= n
        g = {"trans": pair / n, "start": d_start / n, "bias": d_em.sum((0, 1)), "out": np.tensordot(tape["h"], d_em, ((0, 1), (0, 1)))}
        d_h = d_em @ self.p["out"].T
        d_e = np.zeros_like(tape["e"])
        for j, d in enumerate("fb"):
            dx, dwh = np.zeros((n, t, 4 * HIDDEN), em.dtype), np.zeros((HIDDEN, 4 * HIDDEN), em.dtype)
            dh, dc = np.zeros((n, HIDDEN), em.dtype), np.zeros((n, HIDDEN), em.dtype)
            for k, i, f, o, zz, tc, before, old in reversed(tape[d]):
                dh = dh + d_h[:, k, j * HIDDEN : (j + 1) * HIDDEN]
                dc = dc + dh * o * (1 - tc * tc)
                dg = np.concatenate([dc * zz * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - zz * zz)], 1)
                dx[:, k] = dg
                dwh += before.T @ dg
                dh, dc = dg @ self.p[f"wh{d}"].T, dc * f
            g |= {f"wh{d}": dwh, f"b{d}": dx.sum((0, 1)), f"wx{d}": np.tensordot(tape["e"], dx, ((0, 1), (0, 1)))}
            d_e += dx @ self.p[f"wx{d}"].T
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], codes, d_e)
        return float((z - gold).mean()), g

    def train(self, codes: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02) -> float:
        """Adam over random batches; the last batches' mean loss."""
        r, m, v, losses = np.random.default_rng(SEED), {}, {}, []
        for s in range(1, steps + 1):
            own = r.integers(0, len(codes), min(batch, len(codes)))
            loss, g = self.gradients(codes[own], tags[own])
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                v[k] = 0.999 * v.get(k, 0) + 0.001 * x * x
                self.p[k] = self.p[k] - rate * (1 - 0.7 * s / steps) * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.999**s)) + 1e-8)
        return float(np.mean(losses[-10:]))


def tags_of(spans: Iterable[Span], start: int, width: int = WIDTH) -> np.ndarray:
    """Tags of a window from the spans of its text."""
    out = np.zeros(width, np.int64)
    for kind, a, b in spans:
        tag = 1 + 2 * KINDS.index(kind)
        low, high = max(a - start, 0), min(b - start, width)
        if low < high:
            out[low:high] = tag + 1
            if a >= start:
                out[low] = tag
    return out


def padded(text: str, start: int) -> np.ndarray:
    """Codes of a window, padded with 0."""
    x = encode(text[start : start + WIDTH])
    return np.concatenate([x, np.zeros(WIDTH - len(x), np.int64)])


def respelled(kind: str, s: str, r: np.random.Generator) -> str:
    """A span in another spelling."""
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    if kind == "email":
        local, _, domain = s.partition("@")
        at, dot = pick((" @ ", "."), (" @ ", " . "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" AT ", " DOT "), (" at ", " dot "), (" [AT] ", "."))
        return local + at + domain.replace(".", dot)
    d = _digits(s)
    if kind == "phone":
        last = f"{d[-10:-7]}", f"{d[-7:-4]}", f"{d[-4:]}"
        return pick("", "", f"{d[:-10] or '1'}-", f"00{d[:-10] or '1'} ", f"{d[:-10] or '1'}.") + pick(".".join(last), f"({last[0]}) {last[1]}-{last[2]}", "-".join(last), "/".join(last), " ".join(last))
    if kind == "card":
        return pick(".", "/", "  ", "_", " - ").join(d[i : i + 4] for i in range(0, len(d), 4))
    return s.replace(".", pick(" . ", "[.]", "(.)", "[dot]", " dot "))


def made(kind: str, r: np.random.Generator) -> str:
    """A random span of a kind as the patterns know it."""
    n = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda k: "".join(map(chr, r.integers(97, 123, k)))
    if kind == "email":
        local = word(int(r.integers(2, 10))) + ("", "." + word(5), "_" + word(3), n(2))[int(r.integers(4))]
        return f"{local}@{word(int(r.integers(3, 10)))}.{('com', 'org', 'net', 'co.uk', 'de', 'io')[int(r.integers(6))]}"
    if kind == "phone":
        return f"+{int(r.integers(1, 99))} ({n(3)}) {n(3)}-{n(4)}"
    if kind == "ip":
        return ".".join(map(str, r.integers(0, 256, 4)))
    digits = n(15)
    return next(x for x in (digits + str(k) for k in range(10)) if luhn(x))


def decoy(r: np.random.Generator) -> str:
    """Something with digits or signs that is no personal data: a date, a time, a count, a version, a code."""
    n = lambda low, high: int(r.integers(low, high))
    code = "".join("0123456789abcdef"[n(0, 16)] for _ in range(n(8, 40)))
    made = (
        f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29):02d}.{n(1, 13):02d}.{n(1900, 2100)}", f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2100)}", f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}",
        f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 29):02d} {n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}", str(n(0, 10 ** n(1, 9))), f"{n(0, 10**6)}.{n(0, 100):02d}", f"{n(0, 20)}.{n(0, 30)}.{n(0, 99)}", code,
        f"{n(1, 999)},{n(0, 1000):03d},{n(0, 1000):03d}", f"978-{n(0, 10)}-{n(100, 999)}-{n(10000, 99999)}-{n(0, 10)}", f"#{n(1, 10**5)}", f"{n(1900, 2100)}-{n(1900, 2100)}", f"at {n(1, 13)} dot", f"{n(1, 99)}%",
    )
    return made[n(0, len(made))]


def valid(kind: str, s: str) -> bool:
    """Whether a span the tagger proposes has what its kind can't be without."""
    d = _digits(s)
    if kind == "email":
        at = AT_MARK.search(s, 1)
        return bool(at and DOT_MARK.search(s, at.end()) and s[0].isalnum() and s[-1].isalnum())
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and _ip_ok(".".join(parts))
    if any(c.isalpha() for c in s):
        return False
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15 and len(re.findall(r"[0-9]+", s)) > 1


def reconciled(text: str, starts: list[int], tags: np.ndarray) -> list[Span]:
    """Spans of a whole text from its windows' tags: a character's tag is that of the window it lies deepest in."""
    best: dict[int, tuple[int, int]] = {}
    for start, own in zip(starts, tags, strict=True):
        for k in np.flatnonzero(own).tolist():
            best.setdefault(start + k, (-1, 0))
        n = min(WIDTH, len(text) - start)
        for at in [x for x in range(start, start + n) if x in best]:
            depth = min(at - start if start else WIDTH, start + n - 1 - at if start + n < len(text) else WIDTH)
            if depth > best[at][0]:
                best[at] = (depth, int(own[at - start]))
    out: list[list] = []
    for at in sorted(best):
        tag = best[at][1]
        if not tag:
            continue
        kind = KINDS[(tag - 1) // 2]
        if out and tag % 2 == 0 and out[-1][0] == kind and out[-1][2] == at:
            out[-1][2] = at + 1
        else:
            out.append([kind, at, at + 1])
    trimmed = []
    for kind, a, b in out:
        while a < b and text[a] in " \t\n\r,;:":
            a += 1
        while b > a and text[b - 1] in " \t\n\r,;:.":
            b -= 1
        if a < b:
            trimmed.append((kind, a, b))
    return trimmed


def found(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; all spans are sorted by kind as listed, then start."""
    base = [base_spans(t) for t in texts]
    starts = [windows_of(t) if tagger else [] for t in texts]
    jobs = [(i, s) for i, own in enumerate(starts) for s in own]
    tags: list[np.ndarray] = []
    for at in range(0, len(jobs), AT_ONCE):
        part = jobs[at : at + AT_ONCE]
        tags.extend(tagger.viterbi(np.stack([padded(texts[i], s) for i, s in part])))
    out, at = [], 0
    for text, own, spans in zip(texts, starts, base, strict=True):
        more = list(spans)
        if own:
            taken = sorted((a, b) for _, a, b in spans)
            for kind, a, b in reconciled(text, own, np.stack(tags[at : at + len(own)])):
                if valid(kind, text[a:b]) and all(b <= x or a >= y for x, y in taken):
                    more.append((kind, a, b))
            at += len(own)
        out.append((spans, sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def training_windows(docs: DataFrame, text_col: str = "text", most: int = TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags to learn from: windows with labelled spans, copies of each with a span respelled and with a decoy
    in its place, and windows without spans, as they are and with a random span or a decoy put in. Up to ``most`` windows of texts are taken, those of the least hashes, half
    of them with spans if there are so many."""
    half = most // 2

    def run(batches):
        best: dict[bool, dict[str, tuple[str, str]]] = {True: {}, False: {}}
        for b in bounded(batches, 0):
            for text in b.column(0).to_pylist():
                spans = base_spans(text)
                for start in windows_of(text):
                    part = text[start : start + WIDTH]
                    own = [(k, a - start, e - start) for k, a, e in spans if a < start + WIDTH and e > start]
                    best[bool(own)][hashlib.sha256(part.encode("utf-8", "replace")).hexdigest()] = (part, joined(own))
            for k, own in best.items():
                if len(own) > 2 * half:
                    best[k] = {x: own[x] for x in sorted(own)[:half]}
        for own in best.values():
            first = sorted(own)[:half]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), *(pa.array([own[x][i] for x in first], pa.string()) for i in (0, 1))], names=["key", "text", "label"])

    rows = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike(f"(?i){TRIGGER.pattern}"))
    cut = written(rows.mapInArrow(run, "key string, text string, label string"))  # at most ``most`` rows from a task
    part = [row for test in ("label <> ''", "label = ''") for row in cut.filter(test).dropDuplicates(["key"]).orderBy("key").limit(half).collect()]
    r = np.random.default_rng(SEED)
    codes, tags = [], []

    def add(text: str, spans: list[Span]) -> None:
        codes.append(padded(text, 0))
        tags.append(tags_of(spans, 0))

    def put(text: str, a: int, b: int, kind: str, span: str) -> None:
        at = max(0, a - int(r.integers(0, 45)))
        add(text[at:a] + span + text[b:], [(kind, a - at, a - at + len(span))])

    for k, row in enumerate(part):
        text = row["text"]
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in row["label"].split(",") if x)]
        add(text, spans)
        whole = [s for s in spans if s[1] >= 0 and s[2] <= len(text)]
        for kind, a, b in whole[:1]:
            put(text, a, b, kind, respelled(kind, text[a:b], r))
            add(text[:a] + decoy(r) + text[b:], [s for s in spans if s[2] <= a])
        gaps = [m.end() for m in re.finditer(r"\s", text)] if not spans else []
        for kind in (KINDS[k % 4], KINDS[(k + 1) % 4]) if gaps else ():  # kinds that a corpus has few of are learned as well
            a, span = gaps[int(r.integers(len(gaps)))], made(kind, r)
            put(text, a, a, kind, (respelled(kind, span, r) if r.random() < 0.8 else span) + " ")
            tags[-1][tags[-1].nonzero()[0][-1:]] = 0  # the space
            add(text[:a] + decoy(r) + " " + text[a:], [])
    return (np.stack(codes), np.stack(tags)) if codes else (np.empty((0, WIDTH), np.int64), np.empty((0, WIDTH), np.int64))


def fit(docs: DataFrame, text_col: str = "text") -> Tagger | None:
    """A trained tagger; None if the patterns find nothing to learn from, which leaves their spans alone."""
    codes, tags = training_windows(docs, text_col)
    if not len(codes) or not tags.any():
        return None
    tagger = Tagger()
    tagger.train(codes, tags)
    return tagger


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are those of the fixed patterns; spans holds theirs and the tagger's.

    - A null text counts as empty and has no spans; base_sha256 is then that of the empty string.
    - Spans of one kind never overlap; of different kinds they may, as the patterns say. Offsets are code points.
    - Repeated rows get the same spans; null ids pass through; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    tagger = spark.sparkContext.broadcast(fit(docs, text_col))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for b in bounded(batches, 1):
            got = found(b.column(1).to_pylist(), tagger.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([joined(spans) for _, spans in got], pa.string())], names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the whole of ``documents``."""
    return personal_data(spread_table(spark, sf_dir, "documents"))
