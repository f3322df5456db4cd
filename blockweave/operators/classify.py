"""Content classification: signatures, executables, entropy and printable share, in that order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import SAMPLE, byte_histogram

#: Heads of formats that are compressed already, and of executables. Hex.
SIGNATURES = {
    "matroska": "1A45DFA3",
    "riff": "52494646",
    "id3": "494433",
    "png": "89504E470D0A1A0A",
    "jpeg": "FFD8FF",
    "gif87": "474946383761",
    "gif89": "474946383961",
    "zip": "504B0304",
    "gzip": "1F8B08",
    "zstd": "28B52FFD",
    "xz": "FD377A585A00",
    "bzip2": "425A68",
    "7z": "377ABCAF271C",
    "pdf": "255044462D",
    "flac": "664C6143",
    "ogg": "4F676753",
}
EXECUTABLES = {"mz": "4D5A", "elf": "7F454C46", "macho64": "CFFAEDFE", "macho32": "CEFAEDFE", "machofat": "CAFEBABE"}
#: Blocks shorter than this are judged by their heads alone; bits a byte from which a block counts as compressed; printable share above which it is text.
LEAST, DENSE, PRINTABLE = 1024, 7.0, 0.90
#: Signatures that count only where at least four bytes are there.
_LONG = ("matroska", "riff", "id3")


def starts_with(raw: Column, signature: str) -> Column:
    """Whether bytes start with a signature in hex."""
    return F.substring(raw, 1, len(signature) // 2) == F.unhex(F.lit(signature))


def magic_name(raw: Column) -> Column:
    """The format whose signature heads the bytes, or null."""
    out = F.lit(None).cast("string")
    for name, signature in reversed(SIGNATURES.items()):
        hit = starts_with(raw, signature) & (F.octet_length(raw) >= 4 if name in _LONG else F.lit(True))
        out = F.when(hit, name).otherwise(out)
    return out


def is_executable(raw: Column) -> Column:
    """Whether the bytes are headed as a program; at least four bytes."""
    hit = F.lit(False)
    for signature in EXECUTABLES.values():
        hit = hit | starts_with(raw, signature)
    return (F.octet_length(raw) >= 4) & hit


def kind(raw: Column, entropy: Column, printable: Column) -> Column:
    """Executable, AlreadyCompressed, Text or Binary."""
    return (
        F.when(is_executable(raw), "Executable")
        .when(magic_name(raw).isNotNull(), "AlreadyCompressed")
        .when(F.octet_length(raw) < LEAST, "Binary")
        .when(entropy >= DENSE, "AlreadyCompressed")
        .when(printable > PRINTABLE, "Text")
        .otherwise("Binary")
    )


@F.pandas_udf(T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("printable", T.DoubleType())]))
def byte_stats(raw: pd.Series) -> pd.DataFrame:
    """Entropy in bits a byte and printable share of each sample, vectorised over its byte counts."""
    e, p = np.zeros(len(raw)), np.zeros(len(raw))
    shown = np.zeros(256, bool)
    shown[0x20:0x7F] = True
    shown[[9, 10, 13]] = True
    for i, data in enumerate(raw):
        if data:
            c = np.bincount(np.frombuffer(data, np.uint8, min(len(data), SAMPLE)), minlength=256)
            q = c[c > 0] / c.sum()
            e[i], p[i] = -(q * np.log2(q)).sum(), c[shown].sum() / c.sum()
    return pd.DataFrame({"entropy": np.abs(e), "printable": p})


def classify(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with ``raw``) and entropy, printable, kind. Narrow: one Arrow pass over the samples."""
    stats = blocks.withColumn("_stats", byte_stats(F.substring("raw", 1, SAMPLE)))
    return stats.select(*blocks.columns, F.col("_stats.entropy").alias("entropy"), F.col("_stats.printable").alias("printable"), kind(F.col("raw"), F.col("_stats.entropy"), F.col("_stats.printable")).alias("kind"))


def entropy(blocks: DataFrame, *keys: str, sample: int | None = SAMPLE) -> DataFrame:
    """keys, entropy: the same number from the relational histogram, for analysis by any key; of whole payloads without ``sample``."""
    h = byte_histogram(blocks, *keys, sample=sample)
    total = h.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.log2("cnt")).alias("s"))
    return total.select(*keys, F.abs(F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def route(kind_col: Column) -> Column:
    """Whether a block is stored as it is: only what is compressed already."""
    return kind_col == "AlreadyCompressed"


