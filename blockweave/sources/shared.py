"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame


@cache
def _own_dir() -> str:
    """For sessions in one process that name no folder, as in tests."""
    return f"file://{tempfile.mkdtemp(prefix='blockweave-')}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read again, so that dear columns are made once."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{path or _own_dir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
