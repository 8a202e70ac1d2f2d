"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, text_bytes
from .wordbpe import encoder, tokenizer_path

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int):
    def run(batches):
        encode, part, done = encoder(path).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                ids = [x for own in encode(text_bytes(b.column(1))) for x in (own, end)]
                n = np.array([len(x) + 1 for x in ids[::2]], np.int64)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(done + ends - n), pa.array(n), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                done += int(ends[-1])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20) -> None:
    """Encode every whole text, append end_id and write in ascending document order.

    Documents are dealt into ranges by id (ties by a hash of the text, so one id on very many rows is dealt out
    too; null ids come first) before they are encoded; a file holds one range, ``part`` is its number and
    ``part_start`` the ids before a document in it. Null texts are empty: one end id. Rows that repeat are written each, an empty table
    gives files without rows. A very long text is encoded whole and is one row, whatever the stripe's size. Other columns are ignored.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(*order)
    (
        dealt.sortWithinPartitions(*order)
        .mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The written rows, none for an empty table; files are split at stripes, and filters on doc_id prune stripes and row groups by their statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _digest(batches):
    for b in batches:
        lists = b.column(3)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        crcs = [zlib.crc32(values[s:e].astype("<u4").tobytes()) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from the stored ids."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    read = stored.select("doc_id", "part", "part_start", "ids").mapInArrow(_digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return read.join(bases, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def orc_round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "orc-ids")
    write_ids(docs, path, tokenizer or tokenizer_path(), end_id)
    return digests(read_ids(spark, path))
