"""SimHash near-dedup with multi-index hashing.

Every text gets a 64-bit fingerprint in one narrow Arrow pass. From then on only distinct fingerprints move. They are
split into two segments of 32 bits; two fingerprints at 2 or fewer differing bits differ by at most one bit in the
first segment or by none in the second, so each fingerprint probes the first segment's table with the 33 keys of the
Hamming ball of radius 1 and the second's with its own key. Table matches are verified over all 64 bits.

Buckets with more than DENSE fingerprints emit no pairs. Fingerprints that touch one are linked exactly another way:
two of them are at 2 or fewer bits if and only if some 64-bit point lies within one bit of both, so each goes to the
65 points around it and is linked to the least fingerprint there. At most 65 distinct fingerprints can meet at a point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, spread_table, written
from .components import components

#: Words in a shingle, differing bits up to which fingerprints link.
SHINGLE, DISTANCE = 3, 2
#: Table buckets with more fingerprints than this are linked through common neighbour points.
DENSE = 64
#: Shingle hashes whose bits are unpacked at once.
AT_ONCE = 32_768


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, unsigned; 0 if it has no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, AT_ONCE):
        own = words[at : at + AT_ONCE + k - 1]
        hashes = np.array([xxh64_intdigest(b" ".join(s), 42) for s in zip(*(own[i:] for i in range(k)), strict=False)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in bounded(batches, 1):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _flips(x: Column, low: int, high: int) -> Column:
    """``x`` and ``x`` with each one of its bits from low up to high flipped."""
    return F.array(x, *[x.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(low, high)])


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``: every pair within DISTANCE is joined by a path of edges, and only such pairs are."""
    fp = F.col("fp")
    first, second = (lambda c: F.shiftrightunsigned(c, 32)), (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)))
    entry = lambda seg, key: F.struct(F.lit(seg).alias("seg"), key.alias("key"))
    index = fps.select(fp.alias("b"), F.explode(F.array(entry(0, first(fp)), entry(1, second(fp)))).alias("e")).select("b", "e.seg", "e.key")
    ball = F.transform(_flips(first(fp), 0, 32), lambda k: entry(0, k))
    probes = fps.select(fp.alias("a"), F.explode(F.concat(ball, F.array(entry(1, second(fp))))).alias("e")).select("a", "e.seg", "e.key")
    crowded = written(index.groupBy("seg", "key").count().filter(F.col("count") > dense).select("seg", "key"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE) & (F.col("a") != F.col("b"))
    if crowded.isEmpty():
        return probes.join(index, ["seg", "key"]).filter(near).select("a", "b")
    sparse = probes.join(index.join(crowded, ["seg", "key"], "left_anti"), ["seg", "key"]).filter(near).select("a", "b")
    touching = written(probes.join(crowded, ["seg", "key"], "left_semi").select(F.col("a").alias("fp")).distinct())
    points = touching.select("fp", F.explode(_flips(F.col("fp"), 0, 64)).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    starred = points.join(least, "point").select(F.col("fp").alias("a"), "b").filter("a != b")
    return sparse.union(starred)


def members(rows: DataFrame, dense: int = DENSE) -> DataFrame:
    """fp, component_id for each fingerprint of written rows (doc_id, fp): the least id of all rows reachable."""
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(fps.select("fp"), dense))
    placed = written(fps.join(labels.toDF("fp", "label"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    return written(placed.join(written(least), "label").select("fp", "component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    - Null, empty and blank texts have fingerprint zero, which links like any other.
    - Ties don't arise: component_id is the least id of all rows reachable; null ids don't count, and where all are
      null it is null. Rows repeated with their id are in one component.
    - An empty table gives no rows. Other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col))
    return rows.join(members(rows, dense), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies in the whole of ``documents``."""
    return near_dedup(spread_table(spark, sf_dir, "documents"))
