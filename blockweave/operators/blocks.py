"""Blocks: the unit everything works on. A payload is cut into fixed-size pieces, the last one short."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block's head that classification looks at.
SAMPLE = 65_536


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has slots, dealt out evenly; any other as it is.

    Coders take far longer than moving what a few partitions hold. A large input has more partitions than slots, so
    nothing moves there. Only for scans: asking another plan for its partitions may run it.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * slots) if scan.rdd.getNumPartitions() < slots else scan


def gathered(scan: DataFrame) -> DataFrame:
    """A scan as ``spread`` gives it; where it has far more partitions than the cluster has slots, a task takes several,
    16 at most, without a shuffle: coders of long blocks are faster on many together."""
    slots, n = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    return scan.coalesce(max(4 * slots, -(-n // 16))) if n > 4 * slots else spread(scan)


def payload(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """archive_id, raw: one payload of UTF-8 bytes for each row; null texts are empty."""
    return df.select(F.col(id_col).alias("archive_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))


def split_blocks(payloads: DataFrame, block_size: int, *also: str) -> DataFrame:
    """archive_id, further columns asked for, block_idx, orig_size, raw. An empty payload has no blocks. Narrow: blocks stay
    where their payload is."""
    n = F.octet_length("raw")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(block_size))
    cut = payloads.filter(n > 0).select("archive_id", *also, "raw", F.posexplode(starts).alias("block_idx", "start"))
    piece = F.expr(f"substring(raw, start + 1, {int(block_size)})")
    return cut.select("archive_id", *also, F.col("block_idx").cast("long").alias("block_idx"), F.octet_length(piece).alias("orig_size"), piece.alias("raw"))


def byte_rows(blocks: DataFrame, *keys: str, sample: int | None = SAMPLE) -> DataFrame:
    """keys, byte (0 to 255): a row for each byte of the sample at the head of ``raw``."""
    head = F.substring("raw", 1, sample) if sample else F.col("raw")
    return blocks.select(*keys, F.explode(F.regexp_extract_all(F.hex(head), F.lit("(..)"), 1)).alias("h")).select(*keys, F.conv("h", 16, 10).cast("int").alias("byte"))


def byte_histogram(blocks: DataFrame, *keys: str, sample: int | None = SAMPLE) -> DataFrame:
    """keys, byte, cnt. Counts combine on the map side; at most 256 rows leave a task for each key."""
    return byte_rows(blocks, *keys, sample=sample).groupBy(*keys, "byte").agg(F.count(F.lit(1)).alias("cnt"))


def table_blocks(payloads: DataFrame, block_size: int) -> DataFrame:
    """block_id, raw, members: rows gathered into blocks of about ``block_size`` bytes where they stand, without a shuffle.

    Coders need long blocks to say anything about a table of short rows. ``members`` lists each row's id, offset and
    size; a row never spans blocks, so a block may be longer by what its last row has.
    """
    kind = dict(payloads.dtypes)["archive_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, members = bytearray(), []
        for pdf in batches:
            for i, data in zip(pdf["archive_id"], pdf["raw"], strict=True):
                members.append({"id": i, "offset": len(raw), "size": len(data)})
                raw += data
                if len(raw) >= block_size:
                    yield pd.DataFrame({"raw": [bytes(raw)], "members": [members]})
                    raw, members = bytearray(), []
        if members:
            yield pd.DataFrame({"raw": [bytes(raw)], "members": [members]})

    cut = payloads.select("archive_id", "raw").mapInPandas(run, f"raw binary, members array<struct<id:{kind},offset:int,size:int>>")
    return cut.select(F.sha2("raw", 256).alias("block_id"), "raw", "members")


def table_rows(blocks: DataFrame) -> DataFrame:
    """archive_id, raw: the rows of ``table_blocks`` again."""
    each = blocks.select("raw", F.explode("members").alias("m"))
    return each.select(F.col("m.id").alias("archive_id"), F.col("raw").substr(F.col("m.offset") + 1, F.col("m.size")).alias("raw"))
