"""Table operators: queries against their SQL at the smallest size, archives on disk, damage, empty tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from blockweave.operators import archive, blocks, codec, crypto
from blockweave.plans import registry
from blockweave.sources import bundle, files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "documents pages benchmark conversations events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in map(tuple, data)) if None not in {x for r in data for x in r} else sorted((tuple(str(r[i]) for i in order) for r in data))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if sql := registry.oracle_sql().get(name):
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
    else:
        assert got


def payloads(spark, texts):
    return blocks.payload(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")


@pytest.mark.parametrize("mode", codec.MAGIC)
@pytest.mark.parametrize("split", [None, 100])
def test_archive_on_disk(spark, tmp_path, mode, split):
    path, text = str(tmp_path / "a.ctx"), "some text, and more of it; " * 60
    raw = blocks.split_blocks(payloads(spark, [text]), 256)
    key, salt, nonce = crypto.derive_key("pw", bytes(16)), bytes(16), bytes(range(12))
    sealed = crypto.encrypt_blocks(codec.encode_blocks(raw, mode, 3), key, nonce, per_archive=False)
    stats = files.write_archive(sealed, path, mode, 256, len(text), b"[]", salt + nonce, split)
    assert stats["chunks"] == -(-len(text) // 256) and files.read_metadata(path) == b"[]"
    with pytest.raises(FileExistsError):
        files.write_archive(sealed, path, mode, 256, len(text))
    opened = files.read_archive(spark, path + (".001" if split else ""), "pw").selectExpr("*", "CAST(NULL AS STRING) AS digest")
    got = sorted((r["block_idx"], bytes(r["raw"])) for r in codec.decode_blocks(opened).collect())
    assert b"".join(b for _, b in got) == text.encode()
    wrong = files.read_archive(spark, path, "no").selectExpr("*", "CAST(NULL AS STRING) AS digest")
    assert {(r["raw"], r["error"]) for r in codec.decode_blocks(wrong).collect()} == {(None, "no payload: wrong password or damaged block")}
    with pytest.raises(ValueError):
        files.read_archive(spark, path)
    if split:
        (tmp_path / "a.ctx.001").unlink()
        with pytest.raises(FileNotFoundError):
            files.read_archive(spark, path, "pw")


def test_truncation_is_noticed(spark):
    coded = codec.encode_blocks(blocks.split_blocks(payloads(spark, ["x" * 1000]), 256), "fast", 3)
    whole = archive.assemble(coded, 256)
    n = whole.selectExpr("octet_length(content) AS n").first()["n"]
    size = coded.selectExpr("4 + octet_length(payload) AS n", "block_idx").orderBy("block_idx").collect()[-1]["n"]
    for cut, said in ((n - 3, "archive cut short"), (n - size, "blocks are missing"), (10, "archive too short")):
        short = whole.selectExpr("archive_id", f"substring(content, 1, {cut}) AS content")
        frames = archive.frames(short).withColumn("digest", F.lit(None).cast("string"))
        assert said in [r["error"] for r in frames.collect()]
        decoded = codec.decode_blocks(frames).collect()  # an error stays one, and whole blocks before it are decoded
        assert said in [r["error"] for r in decoded] and all((r["raw"] is None) == (r["error"] is not None) for r in decoded)


def test_missing_volume_and_wrong_digest(spark):
    parts = archive.split_volumes(spark.createDataFrame([(1, bytearray(b"abcdefghij"))], "archive_id long, content binary"), 4)
    assert bytes(archive.join_volumes(parts).first()["content"]) == b"abcdefghij"
    assert archive.join_volumes(parts.filter("part_index <> 1")).first()["error"] == "volumes are missing"
    coded = codec.encode_blocks(blocks.split_blocks(payloads(spark, ["abc"]), 10), "fast").withColumn("digest", F.lit("0"))
    assert codec.decode_blocks(coded).first()["error"] == "digest differs"


def test_volume_pieces(spark):
    sized = spark.createDataFrame([("a", 0, 30), ("a", 1, 5), ("a", 2, 41)], "k string, o int, n long")
    got = archive.volume_pieces(sized, "k", "o", "n", 20).groupBy("volume").sum("length").collect()
    assert sorted(tuple(r) for r in got) == [(0, 20), (1, 20), (2, 20), (3, 16)]


def test_file_source(spark, tmp_path):
    p = tmp_path / "f.bin"
    data = bytes(range(256)) * 5
    p.write_bytes(data)
    got = files.read_blocks(spark, str(p), 100).orderBy("block_idx").collect()
    assert b"".join(bytes(r["raw"]) for r in got) == data and [r["orig_size"] for r in got] == [100] * 12 + [80]


def test_empty_and_null_payloads(spark):
    assert blocks.split_blocks(payloads(spark, ["", None, "ab"]), 1).count() == 2
    assert blocks.split_blocks(payloads(spark, ["", None]).filter("archive_id < 0"), 1).count() == 0


def test_overwriting_leaves_foreign_files(spark, tmp_path):
    path = tmp_path / "b[1].ctx"
    for foreign in (f"{path}.2024", f"{path}.12345"):
        open(foreign, "w").write("mine")
    coded = codec.encode_blocks(blocks.split_blocks(payloads(spark, ["text " * 200]), 100), "fast", 3)
    assert files.write_archive(coded, str(path), "fast", 100, 1000, b"m" * 500, split=120)["volumes"] > 4
    assert files.read_metadata(str(path)) == b"m" * 500 and files.read_archive(spark, str(path)).count() == 10
    with pytest.raises(FileExistsError):
        files.write_archive(coded, str(path), "fast", 100, 1000)
    broken = coded.withColumn("payload", F.expr("IF(block_idx = 7, raise_error('no'), payload)"))
    with pytest.raises(Exception, match="no"):
        files.write_archive(broken, str(path), "fast", 100, 1000, overwrite=True)
    assert files.read_archive(spark, str(path)).count() == 10  # a failed write changes nothing
    assert files.write_archive(coded, str(path), "fast", 100, 1000, overwrite=True)["volumes"] == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b[1].ctx", "b[1].ctx.12345", "b[1].ctx.2024"]
    assert files.read_archive(spark, str(path)).count() == 10
    (tmp_path / "c.ctx.001").write_text("mine")
    with pytest.raises(FileExistsError):
        files.write_archive(coded, str(tmp_path / "c.ctx"), "fast", 100, 1000, overwrite=False)
    (tmp_path / "x.2024").write_bytes(path.read_bytes())
    assert files.volume_paths(str(tmp_path / "x.2024")) == [tmp_path / "x.2024"]


def test_metadata_cut_short(spark, tmp_path):
    coded = codec.encode_blocks(blocks.split_blocks(payloads(spark, ["abc"]), 10), "fast", 3)
    files.write_archive(coded, str(tmp_path / "a.ctx"), "fast", 10, 3, b"m" * 50)
    (tmp_path / "cut.ctx").write_bytes((tmp_path / "a.ctx").read_bytes()[:60])
    with pytest.raises(ValueError):
        files.read_metadata(str(tmp_path / "cut.ctx"))


def test_archives_under_one_password_share_no_key_stream(spark):
    coded = codec.encode_blocks(blocks.split_blocks(payloads(spark, ["same text here", "same text here"]), 100), "fast", 3)
    key, nonce = bytes(32), bytes(12)
    sealed = crypto.encrypt_blocks(coded, key, nonce)
    a, b = (bytes(r["payload"]) for r in sealed.collect())
    assert a != b and a[:4] != b[:4]
    assert codec.decode_blocks(crypto.decrypt_blocks(sealed, key, nonce)).filter("error IS NULL").count() == 2
    assert crypto.decrypt_blocks(sealed, key, b"x" * 12).filter("payload IS NULL").count() == 2
    salts = {crypto.salt_and_nonce() for _ in range(4)}
    assert len(salts) == 4 and all((len(s), len(n)) == (16, 12) for s, n in salts)


def test_command_line(spark, tmp_path, capsys):
    import json

    from blockweave.__main__ import main

    source = tmp_path / "f.txt"
    source.write_bytes(b"some words and some more words\n" * 500)
    said = lambda *a: (main(list(map(str, a))), capsys.readouterr())
    code, out = said("compress", source, "-p", "pw", "--fast", "-s", 1)
    assert code == 0 and json.loads(out.out)["input_size"] == source.stat().st_size
    assert said("compress", source)[0] == 1 and said("compress", source, "-f", "-p", "pw", "--fast", "-q")[1].out == ""
    head = json.loads(said("info", f"{source}.ctx")[1].out)
    assert head["mode"] == "fast" and head["encrypted"] and head["items"][0]["name"] == "f.txt" and head["block_size"] == 16 << 20
    assert said("decompress", f"{source}.ctx", tmp_path / "g")[0] == 1 and said("decompress", f"{source}.ctx", tmp_path / "g", "-p", "no")[0] == 1
    assert not (tmp_path / "g").exists() and not (tmp_path / "g.part").exists()
    assert said("decompress", f"{source}.ctx", tmp_path / "g", "-p", "pw")[0] == 0 and (tmp_path / "g").read_bytes() == source.read_bytes()
    assert json.loads(said("test", source)[1].out)["ok"]
    (tmp_path / "folder").mkdir()
    (tmp_path / ".hidden").write_text("x")
    listed = json.loads(said("list", tmp_path)[1].out)
    assert [(x["name"], x["type"], x["is_dir"]) for x in listed] == [("folder", "Folder", True), ("f.txt", "File", False), ("f.txt.ctx", "Archive", False), ("g", "File", False)]
    assert [x["name"] for x in json.loads(said("list", f"{source}.ctx")[1].out)] == ["f.txt"]


def test_tar_of_files_and_folders(spark, tmp_path):
    from blockweave.sources import bundle

    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x").write_bytes(b"1")
    (tmp_path / "y").write_bytes(b"22")
    bundle.pack_tar([str(tmp_path / "y"), str(tmp_path / "d")], str(tmp_path / "t.tar"))
    assert bundle.unpack_tar(str(tmp_path / "t.tar"), str(tmp_path / "out")) == ["d", "d/e", "d/e/x", "y"]
    assert (tmp_path / "out" / "d" / "e" / "x").read_bytes() == b"1"
    raw = spark.createDataFrame([(1, bytearray((tmp_path / "t.tar").read_bytes()))], "archive_id long, raw binary")
    assert sorted((r["path"], r["is_dir"], r["size"]) for r in bundle.tar_members(raw, "archive_id").collect()) == [("d", True, 0), ("d/e", True, 0), ("d/e/x", False, 1), ("y", False, 2)]


def test_mode_sizes_against_the_coder(spark):
    raw = spark.createDataFrame([(bytearray(b"words and words " * 90),), (bytearray(b"PK\x03\x04" + bytes(50)),)], "raw binary").withColumn("orig_size", F.octet_length("raw"))
    for mode in codec.MAGIC:
        own = [bytes(r["raw"]) for r in raw.collect()]
        got = archive.stats(codec.encode_blocks(raw, mode, 19), "mode").first()
        assert got["input_size"] == sum(map(len, own)) and got["output_size"] == sum(4 + len(codec.encode_block(x, mode, 19)) for x in own) and got["chunks"] == 2
        assert got["stored"] == (mode != "fast")


def test_flags_are_no_paths(spark):
    from blockweave.functions import scalars

    d = spark.createDataFrame([("-f",), ("a.ctx",)], "a string")
    assert [r[0] for r in d.select(scalars.is_flag(F.col("a"))).collect()] == [True, False]


def test_bundles_in_pieces(spark, monkeypatch):
    """Members over several pieces, ties, nulls and empty ones; no piece is longer than it may be."""
    monkeypatch.setattr(bundle, "PIECE", 7)
    monkeypatch.setattr(bundle, "STEPS", 3)
    data = [("a", i, bytes([65 + i]) * (i * 5 % 23)) for i in range(12)] + [("b", 1, b"xy"), ("b", 1, b"pqrst"), ("b", 1, b"xy"), (None, 2, b"null key"), ("a", 40, None), ("b", 9, b"")]
    d = spark.createDataFrame(data, "k string, path long, raw binary").withColumn("size", F.octet_length("raw").cast("long")).repartition(3)
    placed = bundle.member_offsets(d.withColumn("md5", F.md5("raw")), "k", tie="md5")
    pieces = bundle.bundled(placed, "k")
    got = sorted((str(r["k"]), r["path"], r["raw"] if r["raw"] is None else bytes(r["raw"])) for r in bundle.unbundle(pieces, placed.drop("raw", "md5"), "k").collect() if r["raw"] is not None)
    assert got == sorted((str(k), p, x) for k, p, x in data if x is not None)
    whole = {k: b"".join(bytes(r["raw"]) for r in sorted((r for r in pieces.collect() if r["k"] == k), key=lambda r: r["piece"])) for k in ("a", "b")}
    assert whole["a"] == b"".join(x or b"" for k, _, x in data if k == "a") and sorted(whole["b"]) == sorted(b"xypqrstxy")
    assert max(len(r["raw"]) for r in pieces.collect()) == 7
    con = duckdb.connect()
    con.execute("CREATE TABLE d (k VARCHAR, path BIGINT, size BIGINT)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?)", [(k, p, None if x is None else len(x)) for k, p, x in data])
    want = con.execute("SELECT k, path, size, sum(size) OVER (PARTITION BY k ORDER BY path) - size FROM d").fetchall()
    assert sorted(map(str, want)) == sorted(str((r["k"], r["path"], r["size"], r["offset"])) for r in placed.collect())


def test_modes_of_a_table_in_one_pass(spark, monkeypatch):
    """Every row of each mode is what that mode alone gives; blocks stay whole where a batch is cut."""
    import pyarrow as pa

    from blockweave.operators import codec

    monkeypatch.setattr(codec, "AT_ONCE_LONG", 3000)
    data = [(i, bytearray(bytes([65 + i % 7]) * (i * 97 % 1500) + b"tail %d" % i)) for i in range(40)]
    df = spark.createDataFrame(data, "id int, raw binary").repartition(3)
    got = {(r.id, r.mode): (bytes(r.payload), r.digest, r.enc_size) for r in codec.encode_modes(df, list(codec.MAGIC), 3).collect()}
    want = {(r.id, r.mode): (bytes(r.payload), r.digest, r.enc_size) for mode in codec.MAGIC for r in codec.encode_blocks(df, mode, 3).collect()}
    assert got == want and len(got) == 120
    assert codec.encode_modes(df.limit(0), list(codec.MAGIC)).count() == 0
    batch = [pa.record_batch({"raw": [bytes(x) for _, x in data]})]
    parts = [len(x) for x in codec._even(batch[0])]
    assert sum(parts) == 40 and 5 < len(parts) < 15


@pytest.mark.parametrize("mode", codec.MAGIC)
def test_archives_of_odd_rows(spark, tmp_path, mode):
    """Rows without text, with an empty one, with one key or none: each comes back by itself, as in the SQL."""
    data = [(1, ""), (2, None), (3, "x"), (4, "a" * 5000), (4, "twice"), (4, "a" * 5000), (None, "no key"), (None, "no key either"), (None, ""), (2**53 + 1, "a long key"), (5, "\0")]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()[f"archive_roundtrip_{mode}"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(registry.oracle_sql()[f"archive_roundtrip_{mode}"])
    assert got.columns == rel.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rel.fetchall())) and got.count() == len(data)
