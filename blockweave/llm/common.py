"""Helpers shared by the operators: table access, shared storage and bounded batches."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import spread

#: The characters that separate words: space and the five ASCII controls from tab to carriage return.
SPACES = r"\x20\x09-\x0D"
#: A word is a maximal run of anything else.
WORD = rf"[^{SPACES}]+"
#: Rows and bytes of text that Python works on at once, at most; one row may hold more by itself.
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 4 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@cache
def _own_dir() -> str:
    """A temporary folder for local sessions without ``spark.checkpoint.dir`` (tests), removed at exit."""
    path = tempfile.mkdtemp(prefix="blockweave-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a session that runs in one process may leave it unset."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{_own_dir()}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage is cut and a lost executor costs nothing.

    Python stages run in here, so that Arrow batches are small for as long as the write takes; the session's own
    setting is put back then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(ROWS_AT_ONCE))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[str, tuple[str, object]] = {}


def kept(kind: str, token: str, make):
    """What ``make`` gives, kept by a worker process over its tasks until another token comes: one object of each kind."""
    if _kept.get(kind, ("",))[0] != token:
        _kept[kind] = (token, make())
    return _kept[kind][1]


def forget() -> None:
    """Let go of what earlier stages kept in this worker process, for a stage that needs none of it: a pipeline's workers live on."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, dealt out where it has fewer partitions than the cluster has slots."""
    return spread(table(spark, sf_dir, name))


def bounded(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold few rows and little text in their column ``at``.

    Spark bounds a batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``); what Python makes of a text takes
    many times its size, so it works on less at once.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < len(b):
            most = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BYTES_AT_ONCE, side="right"))
            j = min(i + ROWS_AT_ONCE, max(i + 1, most), len(b))
            yield b.slice(i, j - i)
            i = j


def sortable(df: DataFrame, id_col: str) -> list[Column]:
    """Columns no_id and doc that order rows by id with null ids last; doc is never null."""
    key, kind = F.col(id_col), dict(df.select(id_col).dtypes)[id_col]
    numeric = kind in ("tinyint", "smallint", "int", "bigint")
    return [key.isNull().alias("no_id"), F.coalesce(key.cast("long" if numeric else "string"), F.lit(0 if numeric else "")).alias("doc")]


#: Rows of a table of keys up to which it is sent to every executor; beyond it joins shuffle.
FEW = 250_000


def is_few(keys: DataFrame) -> bool:
    """Whether a written table has no more than FEW rows."""
    return keys.limit(FEW + 1).count() <= FEW


def sized(keys: DataFrame) -> DataFrame:
    """A written table of short rows, marked for broadcasting if it has no more than FEW."""
    return F.broadcast(keys) if is_few(keys) else keys


def without(docs: DataFrame, key: list[Column], gone: DataFrame, again: DataFrame) -> DataFrame:
    """``docs``, in all its columns, without the rows whose key is in ``gone``; of rows with a key in ``again`` one stays.

    ``key``: columns that are never null, named as those of ``gone`` and ``again``, which hold each key once.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct(*key).alias("_key"))
    as_key = lambda t: sized(written(t.select(F.struct(*t.columns).alias("_key"))))
    left = rows.join(as_key(gone), "_key", "left_anti")
    twice = written(again)
    if not twice.isEmpty():
        twice = as_key(twice)
        left = left.join(twice, "_key", "left_anti").unionByName(left.join(twice, "_key", "left_semi").dropDuplicates(["_key"]))
    return left.select("_row.*")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; texts without other letters take the quick way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
