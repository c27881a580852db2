"""Exchange between blocks of documents and shards of a key space, as packed arrays.

A block sends a shard one row with what it has in that shard's range of hashes, and gets
one row back whose entries stand in the order of those it sent. Blocks are written
bucketed by their name, so answers come to them without shuffling them.
"""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from brightrow.session import shared_folder


def pack(array: np.ndarray, dtype: str) -> bytes:
    """Bytes of equal weight lie together, so that small numbers compress well."""
    plain = np.ascontiguousarray(array.astype(dtype))
    planes = np.ascontiguousarray(plain.view(np.uint8).reshape(-1, plain.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(array: np.ndarray) -> bytes:
    return pack(np.diff(array, prepend=np.uint64(0)), "<u8")


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Range of the hash that a key falls in."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """Write the blocks as a table bucketed by their name, in the shared folder."""
    spark = blocks.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    blocks.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", path).saveAsTable(name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.table(name)
