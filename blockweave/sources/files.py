"""Files as blocks, and archives as files."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.codec import MAGIC
from ..operators.crypto import decrypt_blocks, derive_key
from .shared import staged


class Range(InputPartition):
    """Blocks of one file from an offset on."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class BlockFileSource(DataSource):
    """``blocks``: a file on storage that every executor mounts, as (archive_id, block_idx, orig_size, raw). Options path, blockSize, blocksPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "archive_id string, block_idx long, orig_size int, raw binary"

    def reader(self, schema) -> DataSourceReader:
        return BlockFileReader(self.options)


class BlockFileReader(DataSourceReader):
    """Partitions by offset, so a large file is read by many tasks and none holds more than a block at once."""

    def __init__(self, options):
        self.path, self.size = options["path"].removeprefix("file://"), int(options.get("blocksize") or options.get("blockSize") or 16 << 20)
        self.step = self.size * int(options.get("blocksperpartition") or options.get("blocksPerPartition") or 8)

    def partitions(self) -> list[Range]:
        n = os.path.getsize(self.path)
        return [Range(self.path, a, min(a + self.step, n)) for a in range(0, n, self.step)] or [Range(self.path, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            for at in range(partition.start, partition.end, self.size):
                raw = f.read(min(self.size, partition.end - at))
                yield partition.path, at // self.size, len(raw), raw


def read_blocks(spark: SparkSession, path: str, block_size: int = 16 << 20) -> DataFrame:
    """A file's blocks."""
    spark.dataSource.register(BlockFileSource)
    return spark.read.format("blocks").option("path", path).option("blockSize", str(block_size)).load()


def _manifest(base: Path) -> Path:
    return base.with_name(f"{base.name}.volumes")


def _parts(first: Path) -> list[Path]:
    """The parts that an archive says it has, or, without a list of them, those that follow one another."""
    if _manifest(first).exists():
        return [first.with_name(x["name"]) for x in json.loads(_manifest(first).read_text())]
    out = [first]
    while (p := first.with_name(f"{first.name}.{len(out):03d}")).exists():
        out.append(p)
    return out


def volume_paths(base: str) -> list[Path]:
    """The parts of a volume set in order; a missing one is an error. Any part's name may be given."""
    first = Path(base)
    stem = Path(re.sub(r"\.[0-9]{3,}$", "", base))
    if stem != first and (stem.exists() or _manifest(stem).exists()):
        first = stem
    parts = _parts(first)
    if gone := [p for p in parts if not p.exists()]:
        raise FileNotFoundError(f"volumes are missing: {', '.join(map(str, gone))}")
    return parts


def write_archive(encoded: DataFrame, path: str, mode: str, block_size: int, orig_len: int, metadata: bytes = b"", sealed: bytes = b"", split: int | None = None, overwrite: bool = False) -> dict:
    """Write one archive, or its volumes and a list of them, in order of blocks. The driver holds one partition's blocks at a time.

    Blocks are coded once, into the shared folder. New files take their names when all are complete, so a failed write
    leaves an earlier archive as it was; only files that the earlier archive lists are removed on overwriting.
    """
    base = Path(path)
    old = [p for p in [*_parts(base), _manifest(base)] if p.exists()]
    if old and not overwrite:
        raise FileExistsError(path)
    started = time.time()
    head = MAGIC[mode] + orig_len.to_bytes(8, "little") + (b"\1" if sealed else b"\0") + block_size.to_bytes(4, "little") + len(metadata).to_bytes(4, "little") + sealed + metadata
    token, names, sizes, chunks, room, out = uuid.uuid4().hex[:8], [], [], 0, 0, None
    fresh = lambda name: base.with_name(f".{name}.{token}")
    try:
        for data in _stream(staged(encoded), head):
            chunks += 1
            while data:
                if not room:
                    if out:
                        out.close()
                    names.append(f"{base.name}.{len(names):03d}" if names else base.name)
                    sizes.append(0)
                    out, room = open(fresh(names[-1]), "wb"), split or 1 << 62
                out.write(data[:room])
                sizes[-1] += len(data[:room])
                data, room = data[room:], max(0, room - len(data))
        out.close()
        if taken := [n for n in names if base.with_name(n).exists() and base.with_name(n) not in old]:
            raise FileExistsError(f"not part of the archive that is overwritten: {', '.join(taken)}")
    except BaseException:
        if out:
            out.close()
        for n in names:
            fresh(n).unlink(missing_ok=True)
        raise
    for p in old:
        p.unlink()
    for n in names:
        fresh(n).rename(base.with_name(n))
    if len(names) > 1:
        _manifest(base).write_text(json.dumps([{"name": n, "size": k} for n, k in zip(names, sizes, strict=True)]))
    return {"input_size": orig_len, "output_size": sum(sizes), "chunks": chunks - 1, "volumes": len(names), "elapsed": time.time() - started}


def _stream(encoded: DataFrame, head: bytes) -> Iterator[bytes]:
    yield head
    for row in encoded.select("block_idx", "payload").orderBy("block_idx").toLocalIterator():
        yield len(row["payload"]).to_bytes(4, "little") + bytes(row["payload"])


def read_metadata(path: str) -> bytes | None:
    """An archive's metadata, without a password and without reading a block."""
    paths = volume_paths(path)
    sizes = [p.stat().st_size for p in paths]
    head = _bytes_at(paths, sizes, 0, 21)
    if len(head) < 21 or head[:4] not in MAGIC.values():
        raise ValueError("not an archive of a known format")
    length = int.from_bytes(head[17:21], "little")
    found = _bytes_at(paths, sizes, 21 + (28 if head[12] & 1 else 0), length)
    if len(found) < length:
        raise ValueError("metadata cut short")
    return found or None


def header_of(path: str) -> dict:
    """What an archive's header says: mode, orig_len, encrypted, block_size, meta_len, and its size on storage."""
    paths = volume_paths(path)
    sizes = [p.stat().st_size for p in paths]
    head = _bytes_at(paths, sizes, 0, 21)
    if len(head) < 21 or head[:4] not in MAGIC.values():
        raise ValueError("not an archive of a known format")
    mode = next(k for k, v in MAGIC.items() if v == head[:4])
    number = lambda a, n: int.from_bytes(head[a : a + n], "little")
    return {"mode": mode, "orig_len": number(4, 8), "encrypted": bool(head[12] & 1), "block_size": number(13, 4), "meta_len": number(17, 4), "archive_size": sum(sizes), "volumes": len(paths)}


def read_archive(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    """archive_id, block_idx, mode, orig_size, payload of an archive's blocks, decrypted. Frames are found in one walk over lengths; executors read the bytes."""
    paths = volume_paths(path)
    sizes = [p.stat().st_size for p in paths]
    total = sum(sizes)
    head = _bytes_at(paths, sizes, 0, 49)
    if len(head) < 21 or head[:4] not in MAGIC.values():
        raise ValueError("not an archive of a known format")
    mode = next(k for k, v in MAGIC.items() if v == head[:4])
    orig_len, block_size = int.from_bytes(head[4:12], "little"), int.from_bytes(head[13:17], "little")
    if not block_size:
        raise ValueError("block size is zero")
    sealed = bool(head[12] & 1)
    if sealed and password is None:
        raise ValueError("a password is needed")
    at, frames, done = 21 + 28 * sealed + int.from_bytes(head[17:21], "little"), [], 0
    while at < total:
        length = int.from_bytes(_bytes_at(paths, sizes, at, 4), "little")
        if at + 4 + length > total:
            raise ValueError("archive cut short")
        orig = max(0, min(block_size, orig_len - done))
        frames.append((path, len(frames), mode, orig, at + 4, length))
        at, done = at + 4 + length, done + orig
    if done != orig_len:
        raise ValueError("blocks are missing")
    names = [str(p) for p in paths]

    def fetch(batches):
        for pdf in batches:
            yield pdf.assign(payload=[_bytes_at([Path(n) for n in names], sizes, int(a), int(n)) for a, n in zip(pdf["at"], pdf["length"], strict=True)]).drop(columns=["at", "length"])

    table = spark.createDataFrame(frames, "archive_id string, block_idx long, mode string, orig_size int, at long, length long").repartition(max(1, len(frames) // 4))
    blocks = table.mapInPandas(fetch, "archive_id string, block_idx long, mode string, orig_size int, payload binary")
    return decrypt_blocks(blocks, derive_key(password, head[21:37]), head[37:49], per_archive=False) if sealed else blocks


def _bytes_at(paths: list[Path], sizes: list[int], at: int, n: int) -> bytes:
    """Bytes of a volume set as if it were one file."""
    out = b""
    for p, size in zip(paths, sizes, strict=True):
        if at < size and n > 0:
            with open(p, "rb") as f:
                f.seek(at)
                got = f.read(min(n, size - at))
            out, n, at = out + got, n - len(got), 0
        else:
            at -= size
    return out
