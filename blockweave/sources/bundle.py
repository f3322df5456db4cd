"""Bundles of many members in one payload: by running sums of their sizes, in pieces, or as tar."""

from __future__ import annotations

import io
import os
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.archive import joined_bytes


#: Bytes in a piece of a bundle; names by which a bundle's members are dealt out, at most, and looked at for that.
PIECE, STEPS, LOOK = 1 << 18, 64, 4096


def _steps(members: DataFrame, name: str) -> Column:
    """A number for each row that grows with its name and is shared by equal names, from a bounded look at the names."""
    seen = members.select(name).orderBy(F.xxhash64(name), name).limit(LOOK).collect()
    names = sorted({r[0] for r in seen if r[0] is not None})
    at = [F.lit(x) for x in names[:: -(-len(names) // STEPS) or 1]]
    return F.size(F.filter(F.array(*at), lambda x: x <= F.col(name))) if at else F.lit(0)


def member_offsets(members: DataFrame, key: str, name: str = "path", size: str = "size", tie: str | None = None) -> DataFrame:
    """``members`` and offset: where each one's bytes begin in its bundle, in order of names.

    Members of one name share an end; with ``tie``, a column that orders them, there is ``start`` besides, where each
    one's own bytes begin. A bundle's members are dealt out by steps of their names, so none needs to fit into a task.
    """
    dealt = members.withColumn("_step", F.coalesce(_steps(members, name), F.lit(-1)))
    sums = dealt.groupBy(key, "_step").agg(F.sum(size).alias("_n"))
    order = Window.partitionBy("_key").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_step").alias("_s"), "_n")
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    joined = dealt.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_step") == F.col("_s")))
    w = Window.partitionBy(key, "_step")
    own = {"offset": F.col("_before") + F.sum(size).over(w.orderBy(name)) - F.col(size)}
    if tie:
        own["start"] = F.col("_before") + F.sum(size).over(w.orderBy(name, tie).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return joined.withColumns(own).drop("_step", "_key", "_s", "_before")


def _parts(members: DataFrame, size: str, start: str) -> DataFrame:
    """``members``, a row for each piece that one lies in, with piece, part (0 first) and at and length, its place there."""
    first, last = F.floor(F.col(start) / PIECE), F.floor((F.col(start) + F.col(size) - 1) / PIECE)
    cut = members.filter(F.col(size) > 0).select("*", F.posexplode(F.sequence(first, last)).alias("part", "piece"))
    at = F.greatest(F.col(start) - F.col("piece") * PIECE, F.lit(0))
    end = F.least(F.col(start) + F.col(size) - F.col("piece") * PIECE, F.lit(PIECE))
    return cut.withColumns({"at": at.cast("int"), "length": (end - at).cast("int"), "parts": (last - first + 1).cast("int")})


def bundled(members: DataFrame, key: str, size: str = "size", start: str = "start") -> DataFrame:
    """key, piece, raw: the bundles of members (``raw``) at their places, each as pieces of PIECE bytes, the last one short."""
    skip = F.greatest(F.col("piece") * PIECE - F.col(start), F.lit(0)).cast("int")
    cut = _parts(members, size, start).select(key, "piece", "at", F.col("raw").substr(skip + 1, F.col("length")).alias("raw"))
    g = cut.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("m"))
    return g.select(key, "piece", joined_bytes(F.col("m"), "raw").alias("raw"))


def unbundle(pieces: DataFrame, members: DataFrame, key: str, size: str = "size", start: str = "start") -> DataFrame:
    """``members`` and raw: each one's bytes cut out of its bundle's pieces; empty for size 0, null for none.

    A piece meets the list of what is cut from it once, and only members that lie in several pieces are put together.
    """
    cols = members.columns
    cut = _parts(members, size, start).groupBy(key, "piece").agg(F.collect_list(F.struct("part", "parts", "at", "length", F.struct(*cols).alias("m"))).alias("c"))
    same = cut[key].eqNullSafe(pieces[key]) & (cut["piece"] == pieces["piece"])
    each = F.transform("c", lambda c: F.struct(c["m"].alias("m"), c["part"].alias("part"), c["parts"].alias("parts"), F.col("raw").substr(c["at"] + 1, c["length"]).alias("raw")))
    got = cut.join(pieces, same).select(F.explode(each).alias("e")).select("e.*")
    # Members that are alike in every column have one start only if they have no bytes.
    several = got.filter("parts > 1").groupBy("m").agg(F.array_sort(F.collect_list(F.struct("part", "raw"))).alias("p"))
    whole = got.filter("parts = 1").select("m.*", "raw").union(several.select("m.*", joined_bytes(F.col("p"), "raw").alias("raw")))
    rest = members.filter(F.col(size).isNull() | (F.col(size) <= 0))
    return whole.union(rest.withColumn("raw", F.when(F.col(size) == 0, F.lit(bytearray()).cast("binary"))))


def pack_tar(paths: list[str], target: str) -> int:
    """Files and folders as one tar file, members in order of their names; its size. Streams on the driver."""
    with tarfile.open(target, "w") as t:
        for p in sorted(paths, key=lambda x: os.path.basename(os.path.normpath(x))):
            t.add(p, arcname=os.path.basename(os.path.normpath(p)))
    return os.path.getsize(target)


def unpack_tar(source: str, folder: str) -> list[str]:
    """A tar file's members written under a folder; their names. Members that lead out of it are refused."""
    with tarfile.open(source) as t:
        t.extractall(folder, filter="data")
        return t.getnames()


def tar_members(payloads: DataFrame, key: str) -> DataFrame:
    """key, path, is_dir, size, raw: a row for each member of tar payloads (``raw``), found in one Arrow pass."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, raw in zip(pdf[key], pdf["raw"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                    rows += [(k, m.name, m.isdir(), m.size, t.extractfile(m).read() if m.isfile() else None) for m in t]
            yield pd.DataFrame(rows, columns=[key, "path", "is_dir", "size", "raw"])

    return payloads.select(key, "raw").mapInPandas(run, f"{key} {dict(payloads.dtypes)[key]}, path string, is_dir boolean, size long, raw binary")


def tar_payloads(members: DataFrame, key: str) -> DataFrame:
    """key, raw: members (path, is_dir, raw) as one tar payload for each key, in order of paths; for bundles that fit into a value."""

    def run(k, pdf):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for r in pdf.sort_values("path").itertuples():
                info = tarfile.TarInfo(r.path)
                info.type, info.size = (tarfile.DIRTYPE, 0) if r.is_dir else (tarfile.REGTYPE, len(r.raw or b""))
                t.addfile(info, None if r.is_dir else io.BytesIO(r.raw or b""))
        return pd.DataFrame({key: [k[0]], "raw": [out.getvalue()]})

    return members.select(key, "path", "is_dir", "raw").groupBy(key).applyInPandas(run, f"{key} {dict(members.dtypes)[key]}, raw binary")
