"""Authenticated encryption of blocks with the built-in AES functions.

Keys are derived on the driver and reach executors as a one-row broadcast table, so no key stands in a plan's text.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import be_bytes

#: PBKDF2 rounds, bytes of key, salt, nonce and tag.
ROUNDS, KEY, SALT, NONCE, TAG = 600_000, 32, 16, 12, 16


def derive_key(password: str, salt: bytes) -> bytes:
    """The key of a password."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, KEY)


def salt_and_nonce() -> tuple[bytes, bytes]:
    """Fresh random ones."""
    return os.urandom(SALT), os.urandom(NONCE)


def _key_table(spark: SparkSession, key: bytes, nonce: bytes) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(0, bytearray(key), bytearray(nonce))], "_k int, _key binary, _nonce binary"))


def block_nonce(nonce: Column, block_idx: Column) -> Column:
    """The nonce of a block: four bytes of the base and the block's number, big-endian."""
    return F.concat(F.substring(nonce, 1, 4), be_bytes(block_idx))


def _archive_key(per_archive: bool) -> Column:
    """The key of a row's archive: the given one, or one of its own that hangs on key, nonce and archive id."""
    own = F.unhex(F.sha2(F.concat("_key", "_nonce", F.encode(F.coalesce(F.col("archive_id").cast("string"), F.lit("")), "UTF-8")), 256))
    return own if per_archive else F.col("_key")


def encrypt_blocks(encoded: DataFrame, key: bytes, nonce: bytes, per_archive: bool = True) -> DataFrame:
    """``encoded`` with payload encrypted; ciphertext is followed by its tag, and the nonce isn't stored.

    Blocks of a number have one nonce in every archive, so each archive gets a key of its own. ``per_archive`` may be
    false only for a single archive whose salt and nonce are fresh, as an archive file has them.
    """
    joined = encoded.withColumn("_k", F.lit(0)).join(_key_table(encoded.sparkSession, key, nonce), "_k")
    sealed = F.aes_encrypt("payload", _archive_key(per_archive), F.lit("GCM"), F.lit("DEFAULT"), block_nonce(F.col("_nonce"), F.col("block_idx")))
    return joined.withColumn("payload", F.substring(sealed, NONCE + 1, 1 << 30)).select(*encoded.columns)


def decrypt_blocks(encrypted: DataFrame, key: bytes, nonce: bytes, per_archive: bool = True) -> DataFrame:
    """``encrypted`` with payload decrypted, or null where the key is wrong or the block is damaged."""
    joined = encrypted.withColumn("_k", F.lit(0)).join(_key_table(encrypted.sparkSession, key, nonce), "_k")
    opened = F.try_aes_decrypt(F.concat(block_nonce(F.col("_nonce"), F.col("block_idx")), F.col("payload")), _archive_key(per_archive), F.lit("GCM"))
    return joined.withColumn("payload", opened).select(*encrypted.columns)
