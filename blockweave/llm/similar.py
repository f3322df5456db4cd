"""Near-dedup by the share of word shingles that texts have in common, for the pipeline.

Texts with equal shingle sets are one node. SimHash with multi-index hashing (op1's operator) puts nodes into components
first; each node is held against the least of its own. Those links alone don't reach this rule: texts that share four
fifths of their five-word shingles differ in 9.7 of 64 bits on average, and balls of that radius fetch more of the table
than they leave out. So each node also has a MinHash signature whose bands put nodes into buckets. A candidate pair of
either kind is linked if the exact Jaccard similarity of its shingle sets is high enough.

Buckets emit stars, not pairs: each bucket's nodes are held against the least of them. Sketches of the signatures rule
out most false candidates before texts are fetched. Of a bucket whose nodes aren't all linked by that, a small one gives
its few pairs; a larger one is dealt out in pairs of blocks, in which all sets are intersected at once, and only links
that span its components leave such a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bounded, discard, forget, is_few, sized, sortable, without, written
from .components import components
from .substring_dedup import filter_bits, passes

#: Words in a shingle; similarity from which texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of a signature and values in a band: a pair at similarity 0.8 shares no band with probability 0.00006.
BANDS, ROWS = 32, 6
#: Nodes of a torn bucket up to which it gives pairs; nodes in a block of a larger one.
SMALL, BLOCK = 8, 256
#: A sketch has a bit of each value of the signature. Of a pair at the similarity, a tenth of them differ; more than this many do with probability 0.0000002.
APART = 42
#: Shingle hashes that are permuted at once; shingles that are intersected at once.
AT_ONCE, COLUMNS = 512, 4096

_r = np.random.default_rng(7)
_TIMES, _PLUS = _r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> set[bytes]:
    """The distinct shingles of a text; all of its words if there are fewer, none if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(shingle, len(words))
    return {b" ".join(s) for s in zip(*(words[i:] for i in range(k)), strict=False)}


def signature(text: str | None, shingle: int = SHINGLE) -> tuple[int, list[int], list[int]]:
    """A number that equal shingle sets share, the bands' keys and the sketch; no keys without words."""
    from xxhash import xxh64_intdigest

    h = np.sort(np.array([xxh64_intdigest(s, 42) for s in shingles(text, shingle)], "<u8"))
    if not len(h):
        return 0, [], [0, 0, 0]
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), AT_ONCE):
        np.minimum(least, (h[at : at + AT_ONCE, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = [xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))]
    bits = np.packbits((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63) > 0).view("<i8")
    return int(np.uint64(xxh64_intdigest(h.tobytes())).view(np.int64)), np.array(keys, "<u8").view("<i8").tolist(), bits.tolist()


def _close(x: Column, y: Column) -> Column:
    """Whether two sketches may belong to a pair that is similar enough."""
    return sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(3)), F.lit(0)) <= APART


def _texts(nodes: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text for written nodes, from texts (no_id, doc, row, text)."""
    needed = written(nodes.join(reps.select("node", "no_id", "doc", "row"), "node"))
    if not is_few(needed):  # texts that aren't needed stay where they are
        table = texts.sparkSession.sparkContext.broadcast(filter_bits(needed, F.col("row")))

        def wanted(batches):
            for b in batches:
                yield b.filter(pa.array(passes(table.value, b.column(2).to_numpy())))

        texts = texts.mapInArrow(wanted, texts.schema)
    return texts.join(sized(needed), ["no_id", "doc", "row"]).select("node", "text").dropDuplicates(["node"])


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of written pairs (a, b) of nodes, those whose texts are similar enough."""
    some = written(_texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), reps, texts))

    def run(batches):
        last, own = None, set()
        for b in bounded(batches, 3):
            keep = []
            for node, x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if node != last:  # rows come sorted by it
                    last, own = node, shingles(y, shingle)
                x = shingles(x, shingle)
                both = len(x & own)
                keep.append(both >= similarity * (len(x) + len(own) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(some.toDF("a", "ta"), "a").join(some.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    out = written(joined.mapInArrow(run, "a long, b long"))
    discard(some)
    return out


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets (sorted arrays without repeats) have that Jaccard similarity: a symmetric matrix."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    place = np.cumsum(common) - 1
    owner, column = owner[common[column]], place[column[common[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(common.sum()), COLUMNS):
        own = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        part = np.zeros((n, min(COLUMNS, int(common.sum()) - low)), np.float32)
        part[owner[own], column[own] - low] = 1
        both += part @ part.T
    return both >= similarity * (size[:, None] + size[None] - both)


def forest(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join the same components as all links of a symmetric matrix: fewer than it has rows."""
    a, b, unseen = [], [], np.ones(len(hit), bool)
    for root in range(len(hit)):
        stack = [root] if unseen[root] else []
        unseen[root] = False
        while stack:
            x = stack.pop()
            found = np.flatnonzero(hit[x] & unseen).tolist()
            unseen[found] = False
            a += [x] * len(found)
            b += found
            stack += found
    return a, b


def _blocks(left: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) between nodes of different labels in a bucket, from written (band, node, label, n): n nodes in the bucket."""

    def hashed(batches):
        from xxhash import xxh64_intdigest

        for b in bounded(batches, 1):
            sets = [np.sort(np.array([xxh64_intdigest(s, 42) for s in shingles(t, shingle)], "<u8")).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    sets = written(_texts(left.select("node").distinct(), reps, texts).mapInArrow(hashed, "node long, hashes binary"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = left.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "label")

    def run(pdf):
        one = pdf.sort_values("node", ignore_index=True)
        label, node = one["label"].to_numpy(), one["node"].to_numpy()
        hit = linked([np.frombuffer(h, "<u8") for h in one["hashes"]], similarity) & (label[:, None] != label[None])
        a, b = forest(hit)
        return pd.DataFrame({"a": node[a], "b": node[b]})

    out = written(dealt.join(sets, "node").groupBy("band", "low", "high").applyInPandas(run, "a long, b long").distinct())
    discard(sets)
    return out


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of written nodes (node, fp): each node with the least one of its SimHash component."""
    member = simhash.members(nodes.select(F.col("node").alias("doc_id"), "fp"))
    return nodes.join(member, "fp").filter("node <> component_id").select(F.col("component_id").alias("a"), F.col("node").alias("b"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs``: no_id, doc, row (a hash of id and text), component_id, stays.

    component_id is the least id of all rows reachable, null if none has one. A component's row of that id stays; of
    several with it, that of the least hash. Texts without words are one component. Other columns are not read.
    """
    own = F.xxhash64(F.lit("row"), F.col(id_col), F.col(text_col))
    texts = docs.select(*sortable(docs, id_col), own.alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        forget()
        for b in bounded(batches, 3):
            own = b.column(3).to_pylist()
            got = list(zip(*[signature(t, shingle) for t in own], strict=True))
            fps = np.array([simhash.fingerprint(t) for t in own], "<u8").view("<i8")
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got[0], pa.int64()), pa.array(fps), pa.array(got[1], longs), pa.array(got[2], longs)], names=["no_id", "doc", "row", "node", "fp", "bands", "sketch"])

    rows = written(texts.mapInArrow(run, f"no_id boolean, doc {dict(texts.dtypes)['doc']}, row long, node long, fp long, bands array<long>, sketch array<long>"))
    # Texts of one shingle set may repeat shingles differently often: the node has the least of their fingerprints.
    reps = rows.groupBy("node").agg(F.min(F.struct("no_id", "doc", "row")).alias("m"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = written(reps.select("node", "m.*", "fp", "bands", "sketch"))
    buckets = written(reps.select("node", F.explode("bands").alias("band")))
    full = buckets.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = written(buckets.join(full, "band"))
    discard(buckets)
    sketch = reps.select("node", "sketch")
    sketched = lambda pairs: pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    pairs = shared.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    pairs = sketched(pairs).filter(_close(F.col("sa"), F.col("sb"))).select("a", "b")
    pairs = written(pairs.union(by_fingerprint(reps)).distinct())
    edges = _verified(pairs, reps, texts, shingle, similarity)
    # A node's label is the least centre that it is linked to: equal labels mean one component, and that is all that is needed here.
    own = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    placed = shared.drop("centre").join(own, "node", "left").withColumn("label", F.coalesce("label", "node"))
    torn = placed.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("n")).filter("l <> m")
    left = written(placed.join(torn.select("band", "n"), "band"))
    few = left.filter(F.col("n") <= SMALL).join(sketch, "node").select("band", "node", "label", "sketch")
    x, y = few.toDF("band", "a", "la", "sa"), few.toDF("band", "b", "lb", "sb")
    pairs = x.join(y, (x["band"] == y["band"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _close(F.col("sa"), F.col("sb"))).select("a", "b").distinct()
    found = _verified(written(pairs), reps, texts, shingle, similarity)
    edges = edges.union(found).union(_blocks(left.filter(F.col("n") > SMALL), reps, texts, shingle, similarity))
    labels = components(edges).toDF("node", "label")
    nodes = written(reps.drop("fp", "bands", "sketch").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    group = nodes.groupBy("label").agg(F.min(F.struct("no_id", "doc", "row")).alias("least"))
    placed = rows.select("no_id", "doc", "row", "node").join(nodes.select("node", "label").join(group, "label").select("node", "least"), "node")
    stays = F.struct("no_id", "doc", "row") == F.col("least")
    return placed.select("no_id", "doc", "row", F.when(~F.col("least.no_id"), F.col("least.doc")).alias("component_id"), stays.alias("stays"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component, in all its columns: that of the least id, null ids last.

    Rows that share an id are judged by their own texts; of rows that repeat id and text one stays.
    """
    judged = written(similar_groups(docs, id_col, text_col, shingle, similarity))
    key = ["no_id", "doc", "row"]
    gone = judged.filter("NOT stays").select(*key).distinct()
    again = judged.filter("stays").groupBy(*key).count().filter("count > 1").drop("count")
    return without(docs, [*sortable(docs, id_col), F.xxhash64(F.lit("row"), F.col(id_col), F.col(text_col)).alias("row")], gone, again)
