"""Photo to position: features, votes for tiles, exact matching against stitched neighbourhoods, the first accepted one."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.config import BATCH, Localizer
from tilewright.functions.geo import lat_of, lon_of
from tilewright.operators import features, robust
from tilewright.operators.match import candidates, knn, neighbours, ratio_matches, votes

Backend = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]
KEYPOINT = "struct<x:float,y:float,size:float,angle:float>"


def image_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """A grey image from the data of Spark's image struct."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else features.grey(a[..., :3])


def image_features(images: DataFrame, most: int, least: int, backend: Backend = features.extract) -> DataFrame:
    """The keys of images (all columns but image) with a row for each descriptor: desc_id, kp, desc. Images with fewer
    than `least` keypoints have none."""
    keys = [c for c in images.columns if c != "image"]
    schema = images.select(*keys).withColumns({"desc_id": F.lit(0), "kp": F.lit(None).cast(KEYPOINT), "desc": F.lit(None).cast("array<float>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for b in batches:
            for row in b.to_pylist():
                i = row["image"]
                points, desc = backend(image_array(i["data"], i["height"], i["width"], i["nChannels"]), most)
                if len(points) >= least:
                    yield pa.record_batch([*[pa.array([row[k]] * len(points), kind.field(k).type) for k in keys], pa.array(range(len(points)), pa.int32()), pa.array([dict(zip(("x", "y", "size", "angle"), p.tolist(), strict=True)) for p in points], kind.field("kp").type), pa.array(list(desc), kind.field("desc").type)], schema=kind)

    return images.select(*keys, F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image")).mapInArrow(run, schema)


def build_index(tiles: DataFrame, cfg: Localizer = BATCH, backend: Backend = features.extract) -> DataFrame:
    """Descriptor rows of tiles with enough keypoints."""
    rows = image_features(tiles.select("zoom", "tile_x", "tile_y", "image"), cfg.index_keypoints, cfg.least_keypoints, backend)
    return rows.withColumn("tile_idx", (F.col("tile_x").cast("bigint") * (1 << 24) + F.col("tile_y")))


def index_stats(tiles: DataFrame, index: DataFrame) -> DataFrame:
    """Tiles kept, tiles skipped, descriptors."""
    kept = index.agg(F.countDistinct("zoom", "tile_x", "tile_y").alias("tiles"), F.count("*").alias("descriptors"))
    return kept.join(tiles.agg(F.count("*").alias("seen"))).select("tiles", (F.col("seen") - F.col("tiles")).alias("skipped"), "descriptors")


RESULT = "photo_id string, rank int, tile_x int, tile_y int, zoom int, inliers int, px double, py double, reason string"


def _judge(key: tuple, frame: pd.DataFrame, cfg: Localizer, backend: Backend) -> pd.DataFrame:
    """Candidates of one photo in rank order until one is accepted; the reasons why those before it were not."""
    side, out = (2 * cfg.radius + 1) * cfg.tile_size, []
    photo = frame["photo"].iloc[0]
    grey = image_array(photo["data"], photo["height"], photo["width"], photo["nChannels"])
    points, desc = backend(grey, cfg.query_keypoints)
    for rank, tiles in sorted(frame.groupby("rank"), key=lambda x: x[0]):
        composite = np.zeros((side, side), np.uint8)
        for t in tiles.itertuples():
            if t.tile is not None:
                piece = image_array(t.tile["data"], t.tile["height"], t.tile["width"], t.tile["nChannels"])
                composite[t.top_px : t.top_px + cfg.tile_size, t.left_px : t.left_px + cfg.tile_size] = piece[: cfg.tile_size, : cfg.tile_size]
        c_points, c_desc = backend(composite, cfg.composite_keypoints)
        inliers, px, py, reason = 0, None, None, None
        if len(points) < cfg.least_keypoints:
            reason = "few query keypoints"
        elif len(c_points) < cfg.min_inliers:
            reason = "few composite keypoints"
        else:
            a, b = features.two_nearest(desc.astype(np.float64), c_desc.astype(np.float64), cfg.ratio)
            if len(a) < cfg.min_inliers:
                reason = "few matches"
            else:
                h, mask = robust.homography(points[a, :2], c_points[b, :2], cfg.ransac_px, zlib.crc32(f"{key[0]}/{rank}".encode()))
                inliers = int(mask.sum())
                if h is None:
                    reason = "no homography"
                elif inliers < cfg.min_inliers:
                    reason = "few inliers"
                else:
                    px, py, reason = _placed(h, grey.shape[1], grey.shape[0], side, cfg)
        first = tiles.iloc[0]
        out.append((key[0], rank, first.tile_x, first.tile_y, first.zoom, inliers, px, py, reason))
        if reason is None:
            break
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def _placed(h: np.ndarray, width: int, height: int, side: int, cfg: Localizer) -> tuple[float | None, float | None, str | None]:
    """The photo's centre in the composite, or why its outline is not believable."""
    def at(x: float, y: float) -> np.ndarray:
        p = h @ np.array([x, y, 1.0])
        return p[:2] / p[2]

    quad = np.array([at(0, 0), at(width, 0), at(width, height), at(0, height)])
    if cfg.quad_checks:
        x, y = quad.T
        area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
        if not cfg.area_low <= area / (width * height) <= cfg.area_high:
            return None, None, "area"
        edge = np.roll(np.trunc(quad), -1, 0) - np.trunc(quad)
        turns = edge[:, 0] * np.roll(edge, -1, 0)[:, 1] - edge[:, 1] * np.roll(edge, -1, 0)[:, 0]
        if not ((turns > 0).all() or (turns < 0).all()):
            return None, None, "not convex"
    px, py = at(width / 2, height / 2)
    if not (-cfg.margin_px <= px <= side + cfg.margin_px and -cfg.margin_px <= py <= side + cfg.margin_px):
        return None, None, "centre outside"
    return float(px), float(py), None


def localize(photos: DataFrame, tiles: DataFrame, index: DataFrame, cfg: Localizer = BATCH, backend: Backend = features.extract) -> DataFrame:
    """photo_id, lat, lon, inliers, rank, tile of the accepted candidate of each photo; photos (photo_id, image) without
    one have no row. A photo's candidates are judged in one task, so they can stop at the first accepted one."""
    rows = image_features(photos, cfg.query_keypoints, cfg.least_keypoints, backend).withColumn("query_idx", F.xxhash64("photo_id", "desc_id"))
    train = index.withColumn("train_idx", F.xxhash64("tile_idx", "desc_id"))
    near = knn(rows, train.select(F.col("train_idx").alias("desc_id"), "desc")).join(rows.select("photo_id", "query_idx"), "query_idx")
    good = ratio_matches(near, ["photo_id", "query_idx"], cfg.ratio).join(train.select(F.col("train_idx").alias("desc_id"), "zoom", "tile_x", "tile_y", "tile_idx"), "desc_id")
    ranked = candidates(votes(good, ["photo_id", "zoom", "tile_x", "tile_y"]), ["photo_id"], cfg.top_candidates)
    grid = neighbours(ranked.select("photo_id", "rank", "zoom", "tile_x", "tile_y"), tiles, cfg)
    pixels = tiles.select("zoom", F.col("tile_x").alias("n_x"), F.col("tile_y").alias("n_y"), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("tile"))
    work = grid.join(pixels, ["zoom", "n_x", "n_y"], "left").join(photos.select("photo_id", F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("photo")), "photo_id")
    judged = work.groupBy("photo_id").applyInPandas(lambda key, frame: _judge(key, frame, cfg, backend), RESULT)
    x = F.col("tile_x") - cfg.radius + F.col("px") / cfg.tile_size
    y = F.col("tile_y") - cfg.radius + F.col("py") / cfg.tile_size
    return judged.where("reason is null").select("photo_id", lat_of(y, F.col("zoom")).alias("lat"), lon_of(x, F.col("zoom")).alias("lon"), "inliers", "rank", "tile_x", "tile_y", "zoom")


def odometry(frames: DataFrame, backend: Backend = features.extract, most: int = 4000, crop: float = 0.8, ratio: float = BATCH.ratio, limit_px: float = 4.0) -> DataFrame:
    """flight, frame, next_frame, n_matches, n_inliers and the similarity m between consecutive frames.

    frames: flight, frame, ts, image. Each frame's features are extracted once and meet their neighbour's by a join.
    """
    from tilewright.operators.track import pairs

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                i = row["image"]
                part, left, top = features.central_crop(image_array(i["data"], i["height"], i["width"], i["nChannels"]), crop)
                points, desc = backend(part, most)
                at = (points[:, :2] + [left, top]).astype(np.float32)
                yield pa.record_batch([pa.array([row["flight"]], pa.int64()), pa.array([row["frame"]], pa.int64()), pa.array([at.tobytes()]), pa.array([desc.astype(np.float32).tobytes()])], names=["flight", "frame", "at", "desc"])

    found = frames.select("flight", "frame", F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image")).mapInArrow(feature_rows, "flight bigint, frame bigint, at binary, desc binary")
    both = pairs(frames.select("flight", "frame", "ts")).join(found.toDF("flight", "frame", "at1", "desc1"), ["flight", "frame"]).join(found.toDF("flight", "next_frame", "at2", "desc2"), ["flight", "next_frame"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p1, p2 = (np.frombuffer(row[k], np.float32).reshape(-1, 2).astype(np.float64) for k in ("at1", "at2"))
                d1, d2 = (np.frombuffer(row[k], np.float32).reshape(-1, 128).astype(np.float64) for k in ("desc1", "desc2"))
                a, c = features.two_nearest(d1, d2, ratio)
                m, mask = robust.similarity(p1[a], p2[c], limit_px, zlib.crc32(f"{row['flight']}/{row['frame']}".encode()))
                values = [[row["flight"]], [row["frame"]], [row["next_frame"]], [row["dt_s"]], [len(a)], [int(mask.sum())], [None if m is None else m.ravel().tolist()]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
                yield pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["flight", "frame", "next_frame", "dt_s", "n_matches", "n_inliers", "m"])

    return both.mapInArrow(fitted, "flight bigint, frame bigint, next_frame bigint, dt_s double, n_matches bigint, n_inliers bigint, m array<double>")
