"""Generated tiles through the whole localizer, transforms recovered from points and frames, the index format."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.config import Localizer
from tilewright.operators import features, robust
from tilewright.plans import localize
from tilewright.sources import index, tiles


def png(path, image):
    rows = b"".join(b"\0" + row.tobytes() for row in image)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def ground(size, seed=3):
    """A landscape of blobs."""
    rng = np.random.default_rng(seed)
    out = np.full((size, size), 120.0)
    y, x = np.mgrid[:size, :size]
    for _ in range(size * size // 700):
        cx, cy, r, v = rng.uniform(0, size), rng.uniform(0, size), rng.uniform(2, 7), rng.uniform(-90, 90)
        box = np.s_[max(0, int(cy - 4 * r)) : int(cy + 4 * r) + 1, max(0, int(cx - 4 * r)) : int(cx + 4 * r) + 1]
        out[box] += v * np.exp(-((x[box] - cx) ** 2 + (y[box] - cy) ** 2) / (2 * r * r))
    return np.clip(out, 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    folder, land = tmp_path_factory.mktemp("tiles"), ground(768)
    for i in range(3):
        for j in range(3):
            png(folder / "19" / str(1000 + i) / f"{2000 + j}.png", land[j * 256 : (j + 1) * 256, i * 256 : (i + 1) * 256])
    png(folder / "19" / "1003" / "2000.png", np.full((256, 256), 90, np.uint8))  # nothing to see
    (folder / "19" / "1003" / "2001.png").write_bytes(b"broken")
    photos = tmp_path_factory.mktemp("photos")
    png(photos / "self.png", land[256:512, 256:512])
    png(photos / "moved.png", land[300:520, 270:500])
    png(photos / "blank.png", np.full((200, 200), 50, np.uint8))
    return folder, photos


def test_tiles_to_position(spark, world):
    folder, photos = map(str, world)
    cfg = Localizer(min_inliers=8, top_candidates=5)
    images = tiles.read_tiles(spark, folder).cache()
    assert images.count() == 10 and tiles.tile_files(spark, folder).count() == 11
    built = localize.build_index(images, cfg).cache()
    assert tuple(localize.index_stats(images, built).select("tiles", "skipped").first()) == (9, 1)
    pics = spark.read.format("image").load(photos).select(F.regexp_extract("image.origin", r"(\w+)\.png$", 1).alias("photo_id"), "image")
    found = {r.photo_id: r for r in localize.localize(pics, images, built, cfg).collect()}
    assert set(found) == {"self", "moved"}

    def pixel(row):
        n = 2**19
        x = (row.lon + 180) / 360 * n
        y = (1 - np.arcsinh(np.tan(np.radians(row.lat))) / np.pi) / 2 * n
        return (x - 1000) * 256, (y - 2000) * 256

    assert pixel(found["self"]) == pytest.approx((384, 384), abs=1)
    assert pixel(found["moved"]) == pytest.approx((270 + 115, 300 + 110), abs=1)
    assert (found["self"].tile_x, found["self"].tile_y) == (1001, 2001)


def test_photo_files(spark, world):
    assert tiles.read_photos(spark, str(world[1])).count() == 3


def test_odometry_recovers_a_shift(spark, tmp_path):
    land = ground(500, 5)
    for k, (dx, dy) in enumerate(((0, 0), (12, -7), (30, -7))):
        png(tmp_path / f"{k}.png", land[60 + dy : 360 + dy, 40 + dx : 440 + dx])
    images = spark.read.format("image").load(str(tmp_path)).withColumn("frame", F.regexp_extract("image.origin", r"(\d+)\.png$", 1).cast("bigint"))
    frames = images.select(F.lit(1).cast("bigint").alias("flight"), "frame", F.timestamp_seconds("frame").alias("ts"), "image")
    rows = {r.frame: r for r in localize.odometry(frames).collect()}
    assert [round(rows[0].m[i]) for i in (2, 5)] == [-12, 7] and [round(rows[1].m[i]) for i in (2, 5)] == [-18, 0]
    assert rows[0].dt_s == 1.0 and rows[0].n_inliers >= 12


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6])
def test_transforms_with_outliers(share):
    rng = np.random.default_rng(1)
    src = rng.uniform(0, 600, (80, 2))
    h = np.array([[1.1, 0.05, 20], [-0.04, 0.95, 10], [1e-5, 2e-5, 1]])
    p = np.c_[src, np.ones(80)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    bad = rng.permutation(80)[: int(80 * share)]
    dst[bad] += rng.uniform(30, 200, (len(bad), 2))
    found, mask = robust.homography(src, dst, seed=5)
    assert mask.sum() == 80 - len(bad) and not mask[bad].any() and np.allclose(found, h, atol=1e-6)
    again, _ = robust.homography(src, dst, seed=5)
    assert np.array_equal(found, again)
    moved = src @ np.array([[0.9, 0.2], [-0.2, 0.9]]) + 5
    moved[bad] += rng.uniform(20, 300, (len(bad), 2))
    m, mask = robust.similarity(src, moved, seed=5)
    assert mask.sum() == 80 - len(bad) and m[0, 0] == pytest.approx(0.9)


def test_degenerate_points():
    line = np.stack([np.arange(10.0), np.arange(10.0)], 1)
    assert robust.homography(line, line)[0] is None
    assert robust.homography(line[:3], line[:3])[0] is None
    assert robust.similarity(line[:3], line[:3])[0] is None


def test_samples_are_fitted_at_once(monkeypatch):
    """One decomposition a fit, of the pairs themselves and not of their square; samples give what single fits give."""
    met, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *a, **b: (met.append(out := svd(*a, **b)), out)[1])
    rng = np.random.default_rng(3)
    src = rng.uniform(0, 600, (600, 2))
    dst = src @ np.array([[1.1, 0.1], [-0.1, 1.1]]) + 5
    dst[::3] += 60
    for fit, calls in ((robust.homography, 1), (robust.similarity, 0)):
        met.clear()
        _, mask = fit(src, dst, seed=1)
        assert mask.sum() == 400 and not mask[::3].any() and len(met) == calls
        assert all(x[0].size < 20 * len(src) for x in met)
    noise = dst + rng.normal(0, 30, dst.shape)
    for sampled, single, n in ((robust._sampled_homographies, robust.fit_homography, 4), (robust._sampled_similarities, robust.fit_similarity, 2)):
        pick = robust._samples(rng, len(src), n, 50)
        assert all(len(set(x)) == n for x in pick.tolist()) and pick.min() >= 0 and pick.max() < len(src)
        for m, k in zip(sampled(src[pick], noise[pick]), pick, strict=True):
            assert np.allclose(m / m.ravel()[-1] if n == 4 else m, single(src[k], noise[k]), rtol=1e-5, atol=1e-5)
    pick = robust._samples(rng, 5, 4, 4000)
    assert pick.max() == 4 and abs(np.bincount(pick.ravel(), minlength=5) / 3200 - 1).max() < 0.1
    flat = np.stack([src[:4], np.repeat(src[:1], 4, 0)])
    assert len(robust._sampled_homographies(flat, noise[:8].reshape(2, 4, 2))) == 1 and len(robust._sampled_similarities(flat[:, :2], flat[:, :2])) == 1


def test_crop_warp_and_grey():
    image = ground(100)
    part, left, top = features.central_crop(image)
    assert part.shape == (80, 80) and (left, top) == (10, 10)
    assert np.array_equal(features.warp(image, np.eye(3)), image)
    shifted = features.warp(image, np.array([[1.0, 0, 5], [0, 1, 0], [0, 0, 1]]))
    assert np.array_equal(shifted[:, 5:], image[:, :-5])
    assert features.grey(np.full((2, 2, 3), 255, np.uint8)).tolist() == [[255, 255], [255, 255]]
    assert len(features.extract(np.zeros((64, 64), np.uint8), 100)[0]) == 0


def test_binary_index():
    rng = np.random.default_rng(2)
    made = [(1, 2, 19, rng.random((3, 128), np.float32)), (4, 5, 19, np.zeros((0, 128), np.float32)), (7, 8, 19, rng.random((1, 128), np.float32))]
    data = index.encode(made)
    back = list(index.decode(data))
    assert index.encode(back) == data and len(back) == 3
    assert list(index.decode(index.encode([]))) == []
    for wrong in (data[:-1], struct.pack("<i", 4) + data[4:], data + b"x", b"\1"):
        with pytest.raises((ValueError, struct.error)):
            list(index.decode(wrong))


def test_parquet_and_binary_files(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 2).cast("int").alias("tile_idx"), F.lit(3).alias("tile_x"), (F.col("id") % 2).cast("int").alias("tile_y"), F.lit(19).alias("zoom"), F.col("id").cast("int").alias("desc_id"), F.array_repeat(F.col("id").cast("float"), 128).alias("desc"))
    index.write_index(rows, str(tmp_path / "p"))
    assert index.read_index(spark, str(tmp_path / "p")).count() == 20
    (tmp_path / "i.bin").write_bytes(bytes(index.to_binary(rows).first().content))
    back = index.read_binary(spark, str(tmp_path / "i.bin"))
    assert back.count() == 20 and back.agg(F.sum(F.element_at("desc", 128))).first()[0] == 190.0
