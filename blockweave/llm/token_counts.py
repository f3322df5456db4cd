"""Token counts with the whole-token shortcut.

Offline, every string of the vocabulary is encoded alone; those that come back as one token are whole tokens, and a
pre-token of a text that is one of them counts one without any merging. Only the other pre-tokens are merged, under the
vocabulary's own merge ranks, each distinct one once while it stays in a bounded memory. The count of a text is the sum over its
pre-tokens, since the vocabulary's pre-tokenizer never lets a merge cross from one to the next.
"""

from __future__ import annotations

import json
import re
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, kept, spread_table, written

#: A document above this many tokens is over the limit.
LIMIT = 512
#: Merged pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: The pre-token pattern of byte-level BPE with prefix spaces, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Texts of these characters alone are cut by the quicker pattern, which says the same of them.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
PLAIN_PATTERN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")


@cache
def tokenizer(path: str):
    """The library's tokenizer of a vocabulary file, once in a process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def whole_tokens(path: str) -> dict[str, int]:
    """Every vocabulary string that encodes alone as one token, mapped to 1: the proof is to encode each."""
    t = tokenizer(path)
    special = set(specials(path))
    strings = [s for s in (t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())) if s and s not in special and "�" not in s]
    return {s: 1 for s, e in zip(strings, t.encode_batch_fast(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1 and t.decode(e.ids) == s and len(regex.findall(PATTERN, s)) == 1}


@cache
def specials(path: str) -> tuple[str, ...]:
    """The vocabulary's special strings, which the library cuts out of a text before all else."""
    return tuple(x.content for x in tokenizer(path).get_added_tokens_decoder().values())


@cache
def merger(path: str):
    """A function from a pre-token to its number of tokens, or None if the vocabulary's ids don't follow its merges.

    Byte-level vocabularies number their tokens in the order of the merges that make them, so the ids are the ranks.
    """
    import tiktoken

    model = json.loads(tokenizer(path).to_str())["model"]
    made = [model["vocab"].get(a + b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    if None in made or made != sorted(made):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in the vocabulary's alphabet
    others = [b for b in range(256) if b not in set(shown)]
    letters = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(others)}
    special = set(specials(path))
    ranks = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda part: len(encoding._encode_single_piece(part))


class Counts(dict):
    """Pre-token to number of tokens; what isn't known is merged by the library and remembered."""

    def __init__(self, path: str, known: dict[str, int]):
        self.path, self.known = path, known
        super().__init__(self.known)

    def learn(self, parts: set[str]) -> None:
        if new := [p for p in parts if p not in self]:
            if len(self) + len(new) > len(self.known) + REMEMBERED:
                self.clear()
                self.update(self.known)
                new = [p for p in parts if p not in self]
            if count := merger(self.path):
                self.update((p, count(p)) for p in new)
            else:
                self.update(zip(new, (len(e.ids) for e in tokenizer(self.path).encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def of(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        special = specials(self.path)
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        find = regex.compile(PATTERN).findall
        out = []
        for text in texts:
            extra = 0
            if cut and any(s in text for s in special):
                pieces = cut.split(text)
                extra = len(pieces) - 1
                parts = [p for piece in pieces for p in find(piece)]
            else:
                parts = PLAIN_PATTERN.findall(text) if PLAIN.fullmatch(text) else find(text)
            try:
                out.append(extra + sum(map(self.__getitem__, parts)))
            except KeyError:
                self.learn(set(parts))
                out.append(extra + sum(map(self.__getitem__, parts)))
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    - A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat; each row is counted by itself.
    - An empty table gives no rows. Other columns are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # no larger than the vocabulary

    def run(batches):
        known = kept("counts", path, lambda: Counts(path, whole.value))
        for b in bounded(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(known.of(b.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = written(rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the whole of ``documents`` under the byte-level vocabulary."""
    import public_tokenizers

    return token_counts(spread_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
