"""Mixing sources to target weights: totals per source, targets by water-filling, then floor(rate) copies of each
document and one more where a hash of its id falls under the fraction.

Rows meet only in the sums per source, which combine on the map side, so a hot source costs nothing extra. What is
ranked over all sources is one row each. The verdicts go back to the documents by a join on the source; the source
side is as small as the number of sources, and the documents' side is split by adaptive execution where it is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Sources in the order of their names, the null source last, weigh these in turn.
WEIGHTS = (3, 1, 2)
#: The mix takes this share of all words, as a fraction: 150 %.
SHARE = (3, 2)
#: No source and no document is taken more often than this.
MOST = 2
#: Sources up to this many are sent to every executor; beyond it the join shuffles.
BROADCAST_SOURCES = 10_000


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: the first 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """From (source, size) rows: source, source_size, target.

    Each source's target is weight x level, at most MOST x its size. The level is where the targets add up to the
    wanted share; sources reach their bound in the order of bound / weight, so running sums over that order give
    the level at which all others are still below theirs. With no words at all, targets are 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.select("source", "source_size", w.cast("long").alias("w")).withColumn("bound", F.col("source_size") * MOST)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("bound").cast("double") / F.col("w")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "source", "source_size", "w", "bound",
        F.coalesce(F.sum("bound").over(before), F.lit(0)).alias("spent"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
        (F.sum("source_size").over(everything) * SHARE[0]).alias("want_n"),
    )
    level = (F.col("want_n") - F.col("spent") * SHARE[1]).cast("double") / (F.col("w_left") * SHARE[1])
    fits = F.when(level * F.col("w") <= F.col("bound"), level)
    last = F.max(fits).over(everything)  # the first source under its bound has the highest level of those that fit
    return levels.select("source", "source_size", F.least(F.col("bound").cast("double"), F.coalesce(last * F.col("w"), F.col("bound").cast("double"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target, copies, taken.

    - A null text has no words. A null source is a source like any other, ranked last.
    - Every row is judged by its id alone, so rows repeated with their id share one verdict; a null id has one too.
    - A source without words has target 0, and its rows one copy each, of no words. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(source_col).alias("source")
    )
    rows = written(rows)
    targets = written(source_targets(rows))
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    targets = targets.withColumnRenamed("source", "_s")
    joined = rows.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    copies = F.floor(rate) + F.when(uniform(F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in its own columns. A source without any words stays as it is."""
    columns = docs.columns
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    targets = written(source_targets(docs.select(F.col(source_col).alias("source"), size.alias("size"))))
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    t = targets.select(F.struct(*targets.columns).alias("_mix"))
    rate = F.when(F.col("_mix.source_size") > 0, F.col("_mix.target") / F.col("_mix.source_size")).otherwise(F.lit(1.0))
    copies = F.floor(rate) + F.when(uniform(F.col("_row")[id_col]) < rate - F.floor(rate), 1).otherwise(0)
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")).join(F.broadcast(t) if few else t, F.col("_row")[source_col].eqNullSafe(F.col("_mix.source")))
    repeated = joined.select("_row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_n"))
    return repeated.select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole of ``documents``."""
    return mix(table(spark, sf_dir, "documents")).drop("copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, CAST(([3, 1, 2])[1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM t),
b AS (SELECT *, source_size * 2 AS bound FROM r),
l AS (SELECT *, coalesce(sum(bound) OVER o, 0) AS spent, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left, sum(source_size) OVER () * 3 AS want_n
      FROM b WINDOW o AS (ORDER BY bound::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CAST(want_n - spent * 2 AS DOUBLE) / CAST(w_left * 2 AS DOUBLE) AS level FROM l),
m AS (SELECT *, max(CASE WHEN level * w <= bound THEN level END) OVER () AS best FROM v),
s AS (SELECT source, source_size, least(bound::DOUBLE, coalesce(best * w, bound::DOUBLE)) AS target FROM m),
x AS (SELECT d.doc_id, d.size, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0 END AS rate,
      CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0 AS u
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
