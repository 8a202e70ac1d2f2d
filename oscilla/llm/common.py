"""What the training-data operators share: written intermediate tables, array codecs and text bytes."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="oscilla-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one of a local session (tests)."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or _own_folder()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack_array(a: np.ndarray) -> bytes:
    """Integers or floats as zstd over their transposed bytes (like bytes of all items stand together)."""
    raw = np.ascontiguousarray(a)
    return zstandard.compress(raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T.tobytes(), 1)


def unpack_array(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """An ascending uint64 array by its differences."""
    return pack_array(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_array(data, np.uint64), dtype=np.uint64)


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null gives empty bytes."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
