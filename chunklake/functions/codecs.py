"""Codecs by id, encryption at rest and content addresses."""

from __future__ import annotations

import hashlib

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

STORE, ZSTD = 0, 1


def content_hash(content: Column) -> Column:
    """The engine's content address: SHA-256 of the plain bytes."""
    return F.unhex(F.sha2(content, 256))


def compressor(level: int = 3):
    """A pandas UDF: bytes to a zstd frame."""

    @F.pandas_udf(BinaryType())
    def compress(content: pd.Series) -> pd.Series:
        made = zstandard.ZstdCompressor(level=max(level, 1))
        return content.map(lambda b: None if b is None else made.compress(bytes(b)))

    return compress


@F.pandas_udf(BinaryType())
def decompress(frame: pd.Series) -> pd.Series:
    made = zstandard.ZstdDecompressor()
    return frame.map(lambda b: None if b is None else made.decompressobj().decompress(bytes(b)))


def decode(codec: Column, frame: Column) -> Column:
    """The plain bytes by codec id; any other id is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown codec "), codec.cast("string")))
    return F.when(codec == STORE, frame).when(codec == ZSTD, decompress(F.when(codec == ZSTD, frame))).otherwise(unknown.cast("binary"))


def encode(content: Column, min_gain: float = 0.05, level: int = 3) -> Column:
    """struct(codec, bytes): compressed if that gains enough, else as it is."""
    packed = compressor(level)(content)
    gain = min_gain if min_gain > 0 else 0.05
    pays = (F.octet_length(content) - F.octet_length(packed)) >= F.octet_length(content) * F.lit(gain)
    return F.struct(F.when(pays, F.lit(ZSTD)).otherwise(F.lit(STORE)).cast("tinyint").alias("codec"), F.when(pays, packed).otherwise(content).alias("bytes"))


def derive_key(password: str, salt: bytes) -> bytes:
    """A 32-byte key, derived once on the driver."""
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def seal(content: Column, key: Column, region: str) -> Column:
    """AES-GCM with the region's name as associated data."""
    return F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(region))


def unseal(content: Column, key: Column, region: str) -> Column:
    """The plain bytes; null for a wrong key, a wrong region or changed bytes."""
    return F.try_aes_decrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(region))
