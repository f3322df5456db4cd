"""The engine's own queries over the driver's tables, and DuckDB SQL that says the same independently.

Roundtrip queries decode what they encoded and return each payload's length and digest; their SQL computes both from
the source column, so a wrong coder fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive, blocks, classify, codec, crypto, kernels, relational
from ..sources import bundle, catalog
from ..streaming import progress

#: Bytes in a block of the roundtrip queries: small, so that most payloads have several.
BLOCK = 4096
VOLUME = 1000


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.payload(blocks.spread(_table(spark, sf, "documents")), "doc_id", "text")


def _bench(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws(":", "conv_id", "turn")
    return blocks.spread(_table(spark, sf, "conversations")).select(key.alias("archive_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))


def _digest(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    return df.select(F.col(key).alias(name or key), F.octet_length("raw").cast("long").alias("n_bytes"), F.md5("raw").alias("md5"))


# Blocks and sizes


def block_split(spark, sf):
    cut = blocks.split_blocks(_docs(spark, sf), BLOCK)
    return cut.select(F.col("archive_id").alias("doc_id"), "block_idx", F.col("orig_size").cast("long").alias("orig_size"), F.md5("raw").alias("md5"))


def block_sizes_by_level(spark, sf):
    levels = spark.range(-1, 12).withColumnRenamed("id", "level")
    return levels.select("level", S.block_size_for_level(F.col("level")).alias("block_size"), S.default_level(F.when(F.col("level") >= 0, F.col("level")), F.lit("fast")).alias("fast_level"))


def byte_histogram(spark, sf):
    return blocks.byte_histogram(_docs(spark, sf).select("raw"), sample=None)


def byte_entropy(spark, sf):
    d = classify.classify(_docs(spark, sf))
    return d.select(F.col("archive_id").alias("doc_id"), F.round("entropy", 6).alias("entropy"), F.round("printable", 6).alias("printable"))


def entropy_by_lang(spark, sf):
    raw = _table(spark, sf, "documents").select("lang", F.encode("text", "UTF-8").alias("raw"))
    return classify.entropy(raw, "lang", sample=None).select("lang", F.round("entropy", 6).alias("entropy"))


#: Heads put before texts to give every kind its cases, in turn; an empty one leaves the text as it is.
HEADS = ["", *classify.SIGNATURES.values(), *classify.EXECUTABLES.values()]


def _headed(spark, sf):
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) if h else F.lit(bytearray()).cast("binary") for h in HEADS]), (F.pmod("doc_id", F.lit(len(HEADS))) + 1).cast("int"))
    docs = _table(spark, sf, "documents")
    return docs.select("doc_id", "lang", F.concat(head, F.encode("text", "UTF-8")).alias("raw"))


def classify_kind(spark, sf):
    return classify.classify(_headed(spark, sf)).select("doc_id", "kind", classify.route(F.col("kind")).alias("stored"))


def classify_summary(spark, sf):
    return classify.classify(_headed(spark, sf)).groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


def magic_hits(spark, sf):
    return _headed(spark, sf).select(classify.magic_name(F.col("raw")).alias("magic")).groupBy("magic").agg(F.count(F.lit(1)).alias("n"))


def exec_hits(spark, sf):
    return _headed(spark, sf).select("doc_id", classify.is_executable(F.col("raw")).alias("executable"))


# Transforms


def bwt_symbols(spark, sf):
    return relational.bwt_symbols(_bench(spark, sf), "item_id").drop("n")


def bwt_primary_indexes(spark, sf):
    return relational.primary_indexes(relational.bwt_symbols(_bench(spark, sf), "item_id"), "item_id")


def kernel_primary_indexes(spark, sf):
    return kernels.token_blocks(_bench(spark, sf), "item_id").select("item_id", F.posexplode("pidx").alias("lane", "pidx"))


def lf_mapping(spark, sf):
    return relational.lf_mapping(relational.bwt_symbols(_bench(spark, sf), "item_id"), "item_id")


def mtf_ranks(spark, sf):
    return relational.mtf_ranks(relational.bwt_symbols(_bench(spark, sf), "item_id"), "item_id")


def rle_tokens(spark, sf):
    return relational.rle_tokens(mtf_ranks(spark, sf), "item_id")


def kernel_tokens(spark, sf):
    return kernels.token_rows(_bench(spark, sf), "item_id")


def token_hist0(spark, sf):
    return relational.histogram0(kernel_tokens(spark, sf), "item_id")


def token_hist1(spark, sf):
    return relational.histogram1(kernel_tokens(spark, sf), "item_id")


def token_contexts(spark, sf):
    return relational.second_order(kernel_tokens(spark, sf), "item_id")


def symbol_cumulative(spark, sf):
    return relational.cumulative(token_hist0(spark, sf), "item_id").select("item_id", "token", "cnt", F.col("below").cast("long").alias("below"))


def cond_entropy(spark, sf):
    return relational.conditional_entropy(kernel_tokens(spark, sf), "item_id").select("item_id", F.round("h1", 6).alias("h1"))


def normalized_counts(spark, sf):
    return kernels.normalised_counts(_bench(spark, sf), "item_id").select("item_id", "token", "cnt", "norm")


# Coders


def e8e9_roundtrip(spark, sf):
    pages = _table(spark, sf, "pages").select("page_id", F.concat(F.unhex(F.lit("4D5AE8E9E8")), F.encode("html", "UTF-8"), F.unhex(F.lit("E8FFFFFFFFE9"))).alias("raw"))
    coded = kernels.e8e9_blocks(pages, "page_id").select(F.col("page_id").alias("k"), F.substring("raw", 1, 9).alias("head"), F.md5("raw").alias("code"))
    back = kernels.roundtrip(pages, "page_id", "e8e9").join(coded, F.col("page_id") == F.col("k"))
    # The first call stands at offset 2; its target, the four bytes after it, grows by 2.
    return back.select("page_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.md5("raw").alias("md5"), F.hex("head").alias("head"), (F.col("code") != F.md5("raw")).alias("changed"))


def store_roundtrip(spark, sf):
    return _through(_table(spark, sf, "pages"), "page_id", F.concat(F.unhex(F.lit("504B0304")), F.encode("html", "UTF-8")), "balanced", 1024)


def tans_roundtrip(spark, sf):
    return _digest(kernels.roundtrip(_docs(spark, sf), "archive_id", "tans"), "archive_id", "doc_id")


def range_roundtrip(spark, sf):
    return _digest(kernels.roundtrip(_turns(spark, sf), "archive_id", "range"), "archive_id")


def _rejoined(decoded: DataFrame, *also: str) -> DataFrame:
    g = decoded.groupBy("archive_id", *also).agg(F.array_sort(F.collect_list(F.struct("block_idx", "raw"))).alias("b"))
    return g.select("archive_id", *also, archive.joined_bytes(F.col("b"), "raw").alias("raw"))


def spark_slots(df: DataFrame) -> int:
    """Tasks that the session's cluster runs at once."""
    return df.sparkSession.sparkContext.defaultParallelism


def _through(scan: DataFrame, key: str, raw: Column, mode: str, block_size: int) -> DataFrame:
    """Each row's payload into an archive of its own and back, whatever its key: rows may share one, or have none.

    Rows are numbered before they are dealt out, so that a task that runs again numbers them alike.
    """
    payloads = blocks.spread(scan.select(F.monotonically_increasing_id().alias("archive_id"), F.col(key), raw.alias("raw")))
    coded = codec.encode_blocks(blocks.split_blocks(payloads, block_size, key), mode, 3)
    opened = archive.frames(archive.assemble(coded, block_size, also=(key,)), key).withColumn("digest", F.lit(None).cast("string"))
    opened = opened.repartition(2 * spark_slots(opened))  # a fixed number: decoding few bytes takes long, so they mustn't be put together
    back = _rejoined(codec.decode_blocks(opened, key), key)
    return _digest(back.unionByName(archive.bare_payloads(archive.bare(payloads, mode, block_size))), key)


def _texts_through(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return _through(_table(spark, sf, "documents"), "doc_id", F.encode("text", "UTF-8"), mode, BLOCK)


def zstd_roundtrip(spark, sf):
    coded = codec.encode_blocks(blocks.split_blocks(_docs(spark, sf), BLOCK), "fast")
    return _digest(_rejoined(codec.decode_blocks(coded)), "archive_id", "doc_id")


def archive_roundtrip_ratio(spark, sf):
    return _texts_through(spark, sf, "ratio")


def archive_roundtrip_balanced(spark, sf):
    return _texts_through(spark, sf, "balanced")


def archive_roundtrip_fast(spark, sf):
    return _texts_through(spark, sf, "fast")


_SALT, _NONCE = bytes(range(16)), bytes(range(12))


def _sealed(spark, sf):
    coded = codec.encode_blocks(blocks.split_blocks(_turns(spark, sf), BLOCK), "fast", 3)
    return crypto.encrypt_blocks(coded, crypto.derive_key("right", _SALT), _NONCE)


def encrypt_roundtrip(spark, sf):
    opened = crypto.decrypt_blocks(_sealed(spark, sf), crypto.derive_key("right", _SALT), _NONCE)
    return _digest(_rejoined(codec.decode_blocks(opened)), "archive_id")


def wrong_password_null(spark, sf):
    opened = crypto.decrypt_blocks(_sealed(spark, sf), crypto.derive_key("wrong", _SALT), _NONCE)
    return opened.groupBy(F.col("payload").isNull().alias("is_null")).agg(F.countDistinct("archive_id").alias("n"))


# Archives and volumes


def volume_split_sizes(spark, sf):
    sized = _table(spark, sf, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("length"))
    return archive.volume_pieces(sized, "source", "doc_id", "length", VOLUME * 64).groupBy("source", "volume").agg(F.sum("length").alias("length"))


def volume_bytes(spark, sf):
    parts = archive.split_volumes(_docs(spark, sf).withColumnRenamed("raw", "content"), VOLUME)
    return parts.select(F.col("archive_id").alias("doc_id"), "part_index", F.md5("bytes").alias("md5"))


def volume_rejoined(spark, sf):
    parts = archive.split_volumes(_docs(spark, sf).withColumnRenamed("raw", "content"), VOLUME)
    joined = archive.join_volumes(parts).filter("error IS NULL").withColumnRenamed("content", "raw")
    return _digest(joined, "archive_id", "doc_id")


def volume_total(spark, sf):
    parts = archive.split_volumes(_docs(spark, sf).withColumnRenamed("raw", "content"), VOLUME)
    return parts.agg(F.sum(F.octet_length("bytes")).cast("long").alias("total"), F.count(F.lit(1)).alias("volumes"))


def header_report(spark, sf):
    meta = F.encode(F.lit("[]"), "UTF-8")
    coded = codec.encode_blocks(blocks.split_blocks(_turns(spark, sf), BLOCK), "fast", 3)
    heads = archive.read_header(archive.assemble(coded, BLOCK, meta))
    return heads.select("archive_id", "mode", "orig_len", "encrypted", "block_size", F.octet_length("metadata").cast("long").alias("meta_len"), "error")


def archive_stats(spark, sf):
    coded = codec.encode_blocks(blocks.split_blocks(_docs(spark, sf), BLOCK), "fast", 3)
    return archive.stats(coded).select("input_size", "chunks", "stored", (F.col("output_size") < F.col("input_size")).alias("smaller"))


def _table_roundtrip(spark, sf, mode):
    cut = blocks.table_blocks(_docs(spark, sf), 1 << 18)
    raw = cut.select(F.col("block_id").alias("archive_id"), F.lit(0).cast("long").alias("block_idx"), F.octet_length("raw").alias("orig_size"), "raw", "members")
    coded = codec.encode_blocks(raw, mode)
    back = codec.decode_blocks(coded, "members")
    return _digest(blocks.table_rows(back), "archive_id", "doc_id")


def table_roundtrip_fast(spark, sf):
    return _table_roundtrip(spark, sf, "fast")


def table_roundtrip_balanced(spark, sf):
    return _table_roundtrip(spark, sf, "balanced")


def table_roundtrip_ratio(spark, sf):
    return _table_roundtrip(spark, sf, "ratio")


def mode_compare_sizes(spark, sf):
    docs = blocks.payload(blocks.gathered(_table(spark, sf, "documents")), "doc_id", "text")
    raw = blocks.table_blocks(docs, 1 << 18).select(F.octet_length("raw").alias("orig_size"), "raw")
    s = archive.stats(codec.encode_modes(raw, list(codec.MAGIC), 19), "mode")
    return s.withColumn("ratio", F.round(S.ratio_percent(F.col("output_size"), F.col("input_size")), 4))


def first_difference(spark, sf):
    docs = _docs(spark, sf)
    changed = F.concat(F.substring("raw", 1, 10), F.unhex(F.lit("00")), F.expr("substring(raw, 12)"))
    pairs = docs.withColumn("other", F.when(F.pmod("archive_id", F.lit(2)) == 0, F.col("raw")).otherwise(changed))
    return kernels.first_difference(pairs, "raw", "other").select(F.col("archive_id").alias("doc_id"), F.coalesce("diff_at", F.lit(-1)).alias("diff_at"))


# Catalog


def _items(spark, sf):
    p = _table(spark, sf, "pages")
    name = S.basename(F.col("url"))
    is_dir = F.pmod("page_id", F.lit(7)) == 0
    name = F.when(name == "", F.concat(F.lit("page"), F.col("page_id"))).otherwise(name)
    return p.select("page_id", name.alias("name"), F.octet_length("html").cast("long").alias("size"), S.item_type(name, is_dir).alias("type"), (F.col("page_id") * 1000).alias("modified_ts"), F.col("url").alias("path"), is_dir.alias("is_dir"))


def metadata_json_roundtrip(spark, sf):
    items = _items(spark, sf).withColumn("archive_id", F.pmod("page_id", F.lit(10)))
    back = catalog.from_metadata(catalog.to_metadata(items.drop("page_id"), "archive_id"), "archive_id")
    return back.select("archive_id", "name", "size", "type", "modified_ts", "path", "is_dir")


def archive_listing(spark, sf):
    items = _items(spark, sf).withColumn("archive_id", F.pmod("page_id", F.lit(10)))
    meta = catalog.to_metadata(items.drop("page_id"), "archive_id")
    head = archive.header(F.lit("balanced"), F.lit(0), BLOCK, F.encode("metadata", "UTF-8"))
    return catalog.list_archive(meta.select("archive_id", head.alias("content"))).select("archive_id", "name", "size", "path")


def listing_order(spark, sf):
    items = _items(spark, sf)
    order = Window.partitionBy("bucket").orderBy(F.desc("is_dir"), F.lower("name"), "path", "page_id")
    return items.withColumn("bucket", F.pmod("page_id", F.lit(10))).select("page_id", "bucket", F.row_number().over(order).alias("place"))


def default_names(spark, sf):
    p = F.concat("url", F.element_at(F.array(*map(F.lit, ["", ".ctx", ".ctx.001", ".002"])), (F.pmod("page_id", F.lit(4)) + 1).cast("int")))
    pages = _table(spark, sf, "pages").select("page_id", p.alias("p"))
    return pages.select("page_id", S.compressed_name(F.col("p")).alias("packed"), S.restored_name(F.col("p")).alias("restored"), S.restored_folder(F.col("p")).alias("folder"), S.is_volume(F.col("p")).alias("volume"), S.basename(F.col("p")).alias("base"), S.parent(F.col("p")).alias("parent"))


def size_labels(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", (F.octet_length("text").cast("long") * F.expr("power(32, doc_id % 6)").cast("long")).alias("n"))
    return docs.select("doc_id", "n", S.format_bytes(F.col("n")).alias("label"), S.format_bytes_short(F.col("n") * 1024 * 1024).alias("short"))


def hidden_filter(spark, sf):
    p = _items(spark, sf).withColumn("name", F.when(F.pmod("page_id", F.lit(5)) == 0, F.concat(F.lit("."), F.col("name"))).otherwise(F.col("name")))
    return p.filter(~S.is_hidden(F.col("name"))).select("page_id", "name")


def mode_selection(spark, sf):
    flags = spark.range(4).select(F.col("id").alias("k"), (F.col("id") % 2 == 1).alias("fast"), (F.col("id") >= 2).alias("ratio"))
    return flags.select("k", S.mode_for_flags(F.col("fast"), F.col("ratio")).alias("mode"), S.split_bytes(F.col("k") * 100).alias("split_bytes"))


def le_numbers(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 7919 + 65_537).alias("n"))
    return docs.select("doc_id", F.hex(S.le_bytes(F.col("n"), 8)).alias("le"), S.le_number(S.le_bytes(F.col("n"), 7), 0, 7).alias("back"), F.hex(S.be_bytes(F.col("n"))).alias("be"))


def bundle_members(spark, sf):
    docs = _table(spark, sf, "documents").select("source", F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("raw"), F.octet_length("text").cast("long").alias("size"))
    placed = bundle.member_offsets(docs.withColumn("md5", F.md5("raw")), "source", tie="md5")
    out = bundle.unbundle(bundle.bundled(placed, "source"), placed.drop("raw", "md5"), "source")
    return out.select("source", F.col("path").alias("doc_id"), "offset", F.md5("raw").alias("md5"))


def progress_speed(spark, sf):
    e = _table(spark, sf, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"), (F.col("event_id") % 1000 + 1).alias("done"))
    e = e.groupBy("user_id", "us").agg(F.sum("done").alias("done")).withColumn("at", F.col("us") / 1e6).withColumn("total", F.lit(1_000_000).cast("long"))
    timed = progress.speed(progress.running(e, "user_id"), "user_id")
    return timed.select("user_id", "us", "processed", F.round("share", 6).alias("share"), F.round("speed", 6).alias("speed"), F.round("eta", 3).alias("eta"))


def stage_profile(spark, sf):
    timed = kernels.stage_times(_bench(spark, sf), "item_id")
    return progress.stage_profile(timed).select("stage", "blocks", (F.col("nanoseconds") > 0).alias("took"))


def tar_roundtrip(spark, sf):
    p = _table(spark, sf, "pages").select(F.pmod("page_id", F.lit(10)).alias("archive_id"), F.concat(F.lit("d/p"), "page_id").alias("path"), F.lit(False).alias("is_dir"), F.encode("html", "UTF-8").alias("raw"))
    folder = p.select("archive_id").distinct().select("archive_id", F.lit("d").alias("path"), F.lit(True).alias("is_dir"), F.lit(None).cast("binary").alias("raw"))
    back = bundle.tar_members(bundle.tar_payloads(p.unionByName(folder), "archive_id"), "archive_id")
    return back.select("archive_id", "path", "is_dir", "size", F.md5("raw").alias("md5"))


def selection(spark, sf):
    items = _items(spark, sf).withColumn("name", F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat("name", F.lit(".ctx"))).otherwise(F.col("name")))
    first, second = (items.filter(F.pmod("page_id", F.lit(k)) == 0).select("path") for k in (2, 5))
    chosen = items.join(catalog.toggled(first, second), "path")
    return catalog.selected_size(chosen, S.can_extract(F.lit(True), F.col("is_dir"), F.col("name")))


QUERIES = [
    block_split, block_sizes_by_level, byte_histogram, byte_entropy, entropy_by_lang, classify_kind, classify_summary, magic_hits, exec_hits, bwt_symbols,
    bwt_primary_indexes, kernel_primary_indexes, lf_mapping, mtf_ranks, rle_tokens, kernel_tokens, token_hist0, token_hist1, token_contexts, symbol_cumulative,
    cond_entropy, normalized_counts, e8e9_roundtrip, store_roundtrip, tans_roundtrip, range_roundtrip, zstd_roundtrip, archive_roundtrip_ratio,
    archive_roundtrip_balanced, archive_roundtrip_fast, encrypt_roundtrip, wrong_password_null, volume_split_sizes, volume_bytes, volume_rejoined, volume_total,
    header_report, archive_stats, table_roundtrip_fast, table_roundtrip_balanced, table_roundtrip_ratio, mode_compare_sizes, first_difference, metadata_json_roundtrip, archive_listing, listing_order, default_names, size_labels,
    hidden_filter, mode_selection, le_numbers, bundle_members, progress_speed, stage_profile, tar_roundtrip, selection,
]


def queries() -> dict:
    """Query name to ``f(spark, sf_dir)``."""
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    from .oracle import SQL

    return SQL
