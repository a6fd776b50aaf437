"""The descriptor index: Parquet by zoom, and the binary layout that native tools read.

Binary layout, little-endian: int32 number of tiles; then for each tile int32 x, y, zoom, number of descriptors and these
as 128 float32 each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.shared import staged

ROW_SCHEMA = "tile_idx int, tile_x int, tile_y int, zoom int, desc_id int, desc array<float>"


def write_index(descriptors: DataFrame, path: str) -> None:
    descriptors.write.partitionBy("zoom").mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encode(tiles: list[tuple[int, int, int, np.ndarray]]) -> bytes:
    """Tiles (x, y, zoom, descriptors) in the binary layout; the count is that of the tiles written."""
    parts = [struct.pack("<i", len(tiles))]
    for x, y, zoom, desc in tiles:
        parts += [struct.pack("<4i", x, y, zoom, len(desc)), np.ascontiguousarray(desc, "<f4").tobytes()]
    return b"".join(parts)


def decode(data: bytes, dim: int = 128) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Tiles of a binary index; ValueError if it is cut off or longer than its count says."""
    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError(f"index is cut off at byte {len(data)}, wanted {at + n}")
        at += n
        return data[at - n : at]

    at = 0
    for _ in range(struct.unpack("<i", take(4))[0]):
        x, y, zoom, n = struct.unpack("<4i", take(16))
        yield x, y, zoom, np.frombuffer(take(n * dim * 4), "<f4").reshape(n, dim)
    if at != len(data):
        raise ValueError(f"index has {len(data) - at} bytes behind its last tile")


def read_binary(spark: SparkSession, path: str, dim: int = 128) -> DataFrame:
    """The rows of binary index files."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                for k, (x, y, zoom, desc) in enumerate(decode(blob, dim)):
                    n = len(desc)
                    ints = [pa.array(np.full(n, v, np.int32)) for v in (k, x, y, zoom)]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(desc.ravel()))
                    yield pa.record_batch([*ints, pa.array(np.arange(n, dtype=np.int32)), flat], names=["tile_idx", "tile_x", "tile_y", "zoom", "desc_id", "desc"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, ROW_SCHEMA)


def write_binary(descriptors: DataFrame, folder: str, dim: int = 128, columns: int | None = 64) -> DataFrame:
    """Write binary index files of bounded areas (`columns` tile columns each) below a folder that executors share: file,
    bytes. A repeated task replaces its files."""
    import pyarrow.fs as pafs

    def sink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for zoom, area, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = f"{root}/z{zoom}-{area}.bin"
                with fs.open_output_stream(name) as out:
                    out.write(content)
                yield pa.record_batch([pa.array([name]), pa.array([len(content)], pa.int64())], names=["file", "bytes"])

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    return staged(to_binary(descriptors, dim, columns).select("zoom", "area", "content").mapInArrow(sink, "file string, bytes bigint"), "binary-files")


def to_binary(descriptors: DataFrame, dim: int = 128, columns: int | None = None) -> DataFrame:
    """A row (zoom, area, content) with the binary index of each zoom, or of each so many tile columns of it; descriptors of
    another length are left out.

    A native tool loads one file for its area at once, so a file's descriptors are one group by nature.
    """
    area = F.lit(0) if columns is None else F.floor(F.col("tile_x") / columns).cast("int")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values(["tile_idx", "desc_id"])
        tiles = [(int(t.tile_x.iloc[0]), int(t.tile_y.iloc[0]), int(t.zoom.iloc[0]), np.stack(t["desc"].to_numpy())) for _, t in frame.groupby("tile_idx")]
        return pa.table({"zoom": pa.array([key[0].as_py()], pa.int32()), "area": pa.array([key[1].as_py()], pa.int32()), "content": pa.array([encode(tiles)], pa.binary())})

    rows = descriptors.where(F.size("desc") == dim).select("tile_idx", "tile_x", "tile_y", F.col("zoom").cast("int").alias("zoom"), area.alias("area"), "desc_id", F.col("desc").cast("array<float>").alias("desc"))
    return rows.groupBy("zoom", "area").applyInArrow(build, "zoom int, area int, content binary")
