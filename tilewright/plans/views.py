"""Deterministic projections of the test tables that stand for telemetry, legs, captures and descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("flight"),
        e.alias("msg"),
        "ts",
        F.expr("mod(value, 80)").alias("alt_m"),
        (25.02 + 0.07 * ((e * 7919) % 10007) / 10007).alias("lat"),
        (121.43 + 0.08 * ((e * 104729) % 10009) / 10009).alias("lon"),
        ((e * 31) % 41 - 20).alias("roll_deg"),
        ((e * 17) % 37 - 18).alias("pitch_deg"),
        ((e * 37) % 120).alias("inliers"),
    )


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs_of(_events(spark, sf_dir))


def legs_of(events: DataFrame) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    m, b = F.expr("mod(value, 20)"), F.radians((e * 29) % 360)
    return events.select(
        F.col("user_id").alias("flight"),
        e.alias("leg"),
        "ts",
        (kind != "error").alias("ok"),
        (kind == "click").alias("confident"),
        (kind == "purchase").alias("anchor"),
        m.alias("magnitude_m"),
        (m * F.cos(b)).alias("dx_m"),
        (-m * F.sin(b)).alias("dy_m"),
        ((e * 13) % 31 - 15).cast("double").alias("yaw_deg"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("flight"), F.col("event_id").alias("capture"), "ts")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type <> 'click'").select(F.col("user_id").alias("flight"), F.col("event_id").alias("msg"), "ts", "value")


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        label.alias("tile_idx"),
        F.col("vec_id").alias("desc_id"),
        F.lit(19).alias("zoom"),
        (438990 + label % 5).cast("int").alias("tile_x"),
        (224430 + F.floor(label / 5)).cast("int").alias("tile_y"),
        F.col("embedding").cast("array<double>").alias("desc"),
    )


def queries_vec(spark: SparkSession, sf_dir: str, one_photo: bool = False) -> DataFrame:
    """Every fifth vector, each a little moved, as the descriptors of some photos (or of one)."""
    v = F.col("vec_id")
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + (F.floor(v / 5) % 10) * 0.05 * F.sin((v + 64 * (i + 1)).cast("double")))
    photo = F.lit(0).cast("bigint") if one_photo else F.floor(v / 125)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 5 = 0").select(photo.alias("photo_id"), v.alias("query_idx"), moved.alias("desc"))
