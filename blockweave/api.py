"""Whole files in one call: compress, decompress, look at the header, and test that a file comes back."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import codec, crypto
from .sources import files

MIB = 1 << 20
#: MiB in a block at each level; other levels take those of level 3.
LEVELS = {0: 1, 1: 1, 2: 4, 3: 16, 4: 32, 5: 32, 6: 64, 7: 64, 8: 64, 9: 64}


def block_bytes(level: int) -> int:
    """Bytes in a block at a level."""
    return LEVELS.get(level, LEVELS[3]) * MIB


def item(path: str) -> bytes:
    """A file's entry in an archive's metadata."""
    p = Path(path)
    return json.dumps([{"name": p.name, "size": p.stat().st_size, "type": "File", "modified_ts": int(p.stat().st_mtime), "path": str(p), "is_dir": False}]).encode()


def compress(spark: SparkSession, source: str, target: str | None = None, mode: str = "balanced", level: int | None = None, password: str | None = None, split: int | None = None, overwrite: bool = False, block_size: int | None = None, metadata: bytes | None = None) -> dict:
    """Write a file as an archive (``<source>.ctx``): its totals. Blocks are coded by executors, which must see the file."""
    level = level if level is not None else 19 if mode == "fast" else 3
    size = block_size or block_bytes(level)
    coded = codec.encode_blocks(files.read_blocks(spark, source, size).filter("orig_size > 0"), mode, level)
    sealed = b""
    if password is not None:
        salt, nonce = crypto.salt_and_nonce()
        coded, sealed = crypto.encrypt_blocks(coded, crypto.derive_key(password, salt), nonce, per_archive=False), salt + nonce
    meta = item(source) if metadata is None else metadata
    return files.write_archive(coded, target or f"{source}.ctx", mode, size, os.path.getsize(source), meta, sealed, split, overwrite)


def decoded(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    """An archive's decoded blocks: archive_id, block_idx, orig_size, raw, error."""
    return codec.decode_blocks(files.read_archive(spark, path, password).withColumn("digest", F.lit(None).cast("string")))


def decompress(spark: SparkSession, path: str, target: str | None = None, password: str | None = None, overwrite: bool = False) -> dict:
    """Write what an archive holds as a file, which takes its name when it is complete: its totals. Damage is an error."""
    base = str(files.volume_paths(path)[0])
    target = target or (base.removesuffix(".ctx") if base.endswith(".ctx") else f"{base}.out")
    if os.path.exists(target) and not overwrite:
        raise FileExistsError(target)
    started, head, written, part = time.time(), files.header_of(path), 0, f"{target}.part"
    try:
        with open(part, "wb") as out:
            for r in files.staged(decoded(spark, path, password)).orderBy("block_idx").toLocalIterator():
                if r["error"]:
                    raise ValueError(f"block {r['block_idx']}: {r['error']}")
                out.write(r["raw"])
                written += len(r["raw"])
        if written != head["orig_len"]:
            raise ValueError(f"{written} bytes instead of {head['orig_len']}")
        os.replace(part, target)
    finally:
        Path(part).unlink(missing_ok=True)
    return {"input_size": head["archive_size"], "output_size": written, "elapsed": time.time() - started, "target": target}


def info(path: str) -> dict:
    """What an archive says of itself, without a password: its header, its share of the original and its items."""
    head, meta = files.header_of(path), files.read_metadata(path)
    return head | {"ratio": round(100 * head["archive_size"] / max(head["orig_len"], 1), 2), "items": json.loads(meta) if meta else []}


def test(spark: SparkSession, source: str, mode: str = "balanced", block_size: int | None = None) -> dict:
    """Compress a file, decompress it and compare: ok, and the offset of the first byte that differs."""
    with tempfile.TemporaryDirectory() as folder:
        packed, back = f"{folder}/a.ctx", f"{folder}/a"
        stats = compress(spark, source, packed, mode, block_size=block_size)
        decompress(spark, packed, back)
        at = first_difference(source, back)
        return {"ok": at is None, "first_difference": at, "input_size": stats["input_size"], "output_size": stats["output_size"]}


def first_difference(a: str, b: str, step: int = MIB) -> int | None:
    """The offset of the first byte that two files differ in, None if they are equal."""
    with open(a, "rb") as x, open(b, "rb") as y:
        at = 0
        while True:
            p, q = x.read(step), y.read(step)
            if p != q:
                n = min(len(p), len(q))
                return at + next((i for i in range(n) if p[i] != q[i]), n)
            if not p:
                return None
            at += len(p)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, where it isn't installed there."""
    import shutil

    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="blockweave-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
