"""What the operators of this package share: table access, lookups, Arrow access to UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.shared import scratch, shared_dir, staged

__all__ = ["crc32_of_id", "let", "lookup", "scratch", "shared_dir", "staged", "table", "text_batches", "utf8"]

#: Rows of an Arrow batch: with texts of a few kB a batch holds some MB.
BATCH_ROWS, BATCH_BYTES = "2000", "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that batches of long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def utf8(texts: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes, null as empty; straight from Arrow's buffers."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return []
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    found = [bytes(whole[a:b]) for a, b in zip(at, at[1:], strict=False)]
    if texts.null_count:
        found = [b"" if null else x for null, x in zip(texts.is_null().to_pylist(), found, strict=True)]
    return found


#: A lookup table of up to so many rows is broadcast; a larger one is joined by salted shuffle.
BROADCAST_ROWS, LOOKUP_SALTS = 100_000, 16


def lookup(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """df joined to a table with one row for each value of `on`, nulls being equal.

    The table is counted first: if small it is broadcast, else df's hot keys are dealt over LOOKUP_SALTS tasks.
    """
    rows = small.count() if rows is None else rows
    renamed = small.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    keys = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(on)]
    made = [f"__k{i}" for i in range(len(on))]
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(renamed), keys, how).drop(*made)
    left = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(LOOKUP_SALTS)).cast("int"))
    right = renamed.withColumn("__dealt", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1))))
    return left.join(right, [*keys, F.col("__salt") == F.col("__dealt")], how).drop(*made, "__salt", "__dealt")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]
