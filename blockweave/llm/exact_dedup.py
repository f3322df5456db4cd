"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row of each group.

Everything here is DataFrame expressions. Rows travel as hashes. Only texts whose hash another row has too are read
again and grouped by their bytes, so texts that share a hash without being equal never meet; copies collapse on the map
side before that shuffle, and a group that holds a third of all rows arrives as one row from each task. The verdicts
travel without text and go back to the rows by an equi-join that adaptive execution may split where one group is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, sized, sortable, table, without, written


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; of equal texts the row with the largest id stays.

    - A null text counts as empty, and all empty texts are one group.
    - A null id never is a keep_id unless every id of its group is null; rows are kept where id equals keep_id,
      nulls included, so a row repeated with its id is kept as often as it stands there.
    - An empty table gives no rows. Other columns, whatever their names, are not read.
    ``hash_of`` may be any function of the text: groups stay right however often it collides.
    """
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm")).withColumn("h", hash_of(F.col("norm")))
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    seen = written(rows.select("doc_id", "h", sha))
    met = sized(written(seen.groupBy("h").count().filter("count > 1").select("h")))
    groups = rows.join(met, "h", "left_semi").groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A row finds its text's group by the hash and, among texts that collide in it, by SHA-256. Without one it is alone.
    groups = sized(written(groups.filter("group_size > 1").select("h", sha, "keep_id", "group_size")))
    alone = F.col("group_size").isNull()
    judged = seen.join(groups, ["h", "sha"], "left").withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")))
    return judged.select(
        "doc_id", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, in all its columns: the row that ``exact_dedup`` keeps.

    Of rows that repeat one id and text, one stays. A row without an id stays only if no row of its group has one.
    """
    sha = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("sha")
    judged = exact_dedup(docs, id_col, text_col)
    keys = written(judged.select(*sortable(judged, "doc_id"), F.col("text_sha256").alias("sha"), "kept"))
    gone = keys.filter("NOT kept").drop("kept").distinct()
    again = keys.filter("kept").groupBy("no_id", "doc", "sha").count().filter("count > 1").drop("count")
    return without(docs, [*sortable(docs, id_col), sha], gone, again)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies in the whole of ``documents``."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
