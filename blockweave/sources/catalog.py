"""Listings of files and of what archives say they hold."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import basename, is_hidden, item_type
from ..operators.archive import read_header

ITEM = "array<struct<name:string,size:bigint,type:string,modified_ts:bigint,path:string,is_dir:boolean>>"


def ordered(items: DataFrame) -> DataFrame:
    """Folders first, then by lower-case name; paths break ties."""
    return items.orderBy(F.desc("is_dir"), F.lower("name"), "path")


def list_files(spark: SparkSession, path: str, hidden: bool = False) -> DataFrame:
    """name, size, type, modified_ts, path, is_dir of a folder's entries, folders included; an archive lists what it holds.

    The listing asks the file system, on the driver; no contents are read. Entries that can't be read are left out.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    rows = []
    if path.endswith(".ctx") and fs.exists(place) and not fs.getFileStatus(place).isDirectory():
        head = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive_id"), "content")
        return list_archive(head).drop("archive_id")
    entries = fs.listStatusIterator(place)
    while entries.hasNext():
        try:
            e = entries.next()
            rows.append((e.getPath().getName(), 0 if e.isDirectory() else e.getLen(), e.getModificationTime() // 1000, e.getPath().toString(), e.isDirectory()))
        except Py4JJavaError:
            continue
    items = spark.createDataFrame(rows, "name string, size bigint, modified_ts bigint, path string, is_dir boolean")
    items = items.select("name", "size", item_type(F.col("name"), F.col("is_dir")).alias("type"), "modified_ts", "path", "is_dir")
    return ordered(items if hidden else items.filter(~is_hidden(F.col("name"))))


def selected_size(items: DataFrame, selected: Column) -> DataFrame:
    """size, n: totals of the selected items."""
    return items.agg(F.coalesce(F.sum(F.when(selected, F.col("size"))), F.lit(0)).alias("size"), F.count(F.when(selected, 1)).alias("n"))


def toggled(selection: DataFrame, path: DataFrame) -> DataFrame:
    """A selection of paths in which those of ``path`` are added where they are absent and removed where they are present."""
    both = selection.select("path").distinct().unionByName(path.select("path").distinct())
    return both.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("path")


def to_metadata(items: DataFrame, *keys: str) -> DataFrame:
    """keys, metadata: items as a JSON array, in their listing order."""
    item = F.struct((~F.col("is_dir")).alias("o1"), F.lower("name").alias("o2"), "path", F.struct("name", "size", "type", "modified_ts", "path", "is_dir").alias("item"))
    packed = items.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("i"))
    return packed.select(*keys, F.to_json(F.transform("i", lambda x: x["item"])).alias("metadata"))


def from_metadata(df: DataFrame, *keys: str, column: str = "metadata") -> DataFrame:
    """keys and an item's fields: a row for each item of JSON metadata. What isn't such JSON gives no rows."""
    return df.select(*keys, F.inline(F.from_json(F.col(column).cast("string"), ITEM)))


def list_archive(archives: DataFrame) -> DataFrame:
    """archive_id and an item's fields: what archives list, without reading a block or needing a password."""
    return from_metadata(read_header(archives).filter("error IS NULL"), "archive_id")
