"""The block transforms as relations, for analysis of short blocks: windows in the place of sequential loops.

Every operator partitions by the block's id, so blocks are independent and the plan holds one exchange. Suffixes are
rows here, which costs the square of a block's length in bytes; long blocks belong to the kernels in ``transforms``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



LANES = 8


def positions(blocks: DataFrame, key: str) -> DataFrame:
    """key, pos, byte, n: a row for each byte at its place."""
    h = F.regexp_extract_all(F.hex("raw"), F.lit("(..)"), 1)
    return blocks.select(key, F.octet_length("raw").alias("n"), F.posexplode(h).alias("pos", "h")).select(key, "pos", F.conv("h", 16, 10).cast("int").alias("byte"), "n")


def bwt_symbols(blocks: DataFrame, key: str) -> DataFrame:
    """key, row, sa, sym: sorted suffixes and the byte before each, the last byte before the whole."""
    suffixes = blocks.select(key, "raw", F.octet_length("raw").alias("n")).select(
        key, "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.col("raw").substr(i, F.col("n")).alias("suffix"), F.hex(F.col("raw").substr(F.when(i == 1, F.col("n")).otherwise(i - 1), F.lit(1))).alias("h")))).alias("sa", "s")
    )
    order = Window.partitionBy(key).orderBy("s.suffix")
    return suffixes.select(key, (F.row_number().over(order) - 1).cast("long").alias("row"), F.col("sa").cast("long").alias("sa"), F.conv("s.h", 16, 10).cast("int").alias("sym"), F.col("n").cast("long").alias("n"))


def primary_indexes(symbols: DataFrame, key: str) -> DataFrame:
    """key, lane, pidx: the rank of each lane's start."""
    before = F.expr(f"aggregate(sequence(0, {LANES - 1}), 0L, (a, k) -> a + IF(k < lane, n div {LANES} + IF(n % {LANES} > k, 1, 0), 0))")
    lanes = symbols.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    start = F.when(F.col("lane") == 0, F.lit(0)).otherwise((F.col("n") - before) % F.col("n"))
    return lanes.filter(F.col("sa") == start).select(key, F.col("lane").cast("int").alias("lane"), F.col("row").alias("pidx"))


def lf_mapping(symbols: DataFrame, key: str) -> DataFrame:
    """key, row, lf: where the suffix that is one byte longer stands; the primary row first in its class."""
    order = Window.partitionBy(key).orderBy("sym", F.when(F.col("sa") == 0, 0).otherwise(1), "row")
    return symbols.select(key, "row", (F.row_number().over(order) - 1).cast("long").alias("lf"))


def mtf_ranks(symbols: DataFrame, key: str, order: str = "row", value: str = "sym") -> DataFrame:
    """key, row, rank: how many different symbols stand since a symbol's last place; at its first, itself plus those above it seen before."""
    steps = Window.partitionBy(key).orderBy(order)
    state = F.collect_list(value).over(steps.rowsBetween(Window.unboundedPreceding, -1))
    before = symbols.select(key, F.col(order).alias("row"), F.col(value).alias("s"), F.reverse(state).alias("seen"))
    last = F.array_position("seen", F.col("s"))
    since = F.size(F.array_distinct(F.slice("seen", 1, F.greatest((last - 1).cast("int"), F.lit(0)))))
    fresh = F.col("s") + F.size(F.array_distinct(F.filter("seen", lambda x: x > F.col("s"))))
    return before.select(key, "row", F.when(last > 0, since).otherwise(fresh).cast("int").alias("rank"))


def rle_tokens(ranks: DataFrame, key: str) -> DataFrame:
    """key, pos, token: zero runs as bijective base-2 digits, lowest first; other ranks plus one."""
    w = Window.partitionBy(key).orderBy("row")
    island = F.col("row") - F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).over(w)
    grouped = ranks.select(key, "row", "rank", F.when(F.col("rank") == 0, island).alias("island"), F.when(F.col("rank") != 0, F.col("row")).alias("lone"))
    runs = grouped.groupBy(key, "island", "lone", "rank").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("run"))
    z = F.col("run") + 1
    digits = F.transform(F.sequence(F.lit(0), F.length(F.bin(z)) - 2), lambda j: F.expr("cast(1 as int)") * F.getbit(z, j).cast("int"))
    tokens = runs.select(key, "row", F.posexplode(F.when(F.col("rank") == 0, digits).otherwise(F.array((F.col("rank") + 1).cast("int")))).alias("j", "token"))
    return tokens.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("row", "j")) - 1).cast("long").alias("pos"), "token")


def contexts(tokens: DataFrame, key: str) -> DataFrame:
    """key, pos, token, ctx: the last token up to 255 before each, or 256."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("ctx", F.coalesce(F.last(F.when(F.col("token") <= 255, F.col("token")), ignorenulls=True).over(w), F.lit(256)))


def histogram0(tokens: DataFrame, key: str) -> DataFrame:
    """key, token, cnt."""
    return tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("cnt"))


def histogram1(tokens: DataFrame, key: str) -> DataFrame:
    """key, ctx, token, cnt; sparse, tokens without a context left out."""
    return contexts(tokens, key).filter(F.col("ctx") < 256).groupBy(key, "ctx", "token").agg(F.count(F.lit(1)).alias("cnt"))


def cumulative(hist: DataFrame, key: str) -> DataFrame:
    """key, token, cnt, below: counts and the sum of those of smaller tokens."""
    w = Window.partitionBy(key).orderBy("token")
    return hist.withColumn("below", F.sum("cnt").over(w) - F.col("cnt"))


def conditional_entropy(tokens: DataFrame, key: str) -> DataFrame:
    """key, h1: bits a token given its context, over tokens that have one."""
    h = histogram1(tokens, key)
    by = h.groupBy(key, "ctx").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.log2("cnt")).alias("s"))
    return by.groupBy(key).agg((F.abs(F.sum(F.col("n") * F.log2("n") - F.col("s"))) / F.sum("n")).alias("h1"))


def second_order(tokens: DataFrame, key: str) -> DataFrame:
    """key, pos, token, prev1, prev2: the two tokens before, 0 where there is none."""
    w = Window.partitionBy(key).orderBy("pos")
    return tokens.select(key, "pos", "token", F.lag("token", 1, 0).over(w).alias("prev1"), F.lag("token", 2, 0).over(w).alias("prev2"))


