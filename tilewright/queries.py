"""A query for each operator over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.config import BATCH, LIVE, LIVE_SENDING, PASSIVE, Odometry
from tilewright.functions import geo, geometry, quality, text
from tilewright.operators import match, robust, survey, telemetry, track
from tilewright.plans import localize, runs, views
from tilewright.shared import scratch
from tilewright.sources import index, tiles
from tilewright.streaming import telemetry as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOME = (25.05, 121.47, 0.0)

TELEMETRY_SQL = """telemetry AS (
  SELECT user_id AS flight, event_id AS msg, ts, mod(value, 80) AS alt_m,
         25.02e0 + 0.07e0 * ((event_id * 7919) % 10007) / 10007 AS lat, 121.43e0 + 0.08e0 * ((event_id * 104729) % 10009) / 10009 AS lon,
         (event_id * 31) % 41 - 20 AS roll_deg, (event_id * 17) % 37 - 18 AS pitch_deg, (event_id * 37) % 120 AS inliers
  FROM events)"""
LEGS_SQL = """legs AS (
  SELECT flight, leg, ts, ok, confident, anchor, m AS magnitude_m, m * cos(b) AS dx_m, -m * sin(b) AS dy_m, yaw_deg
  FROM (SELECT user_id AS flight, event_id AS leg, ts, event_type <> 'error' AS ok, event_type = 'click' AS confident, event_type = 'purchase' AS anchor,
               mod(value, 20) AS m, radians((event_id * 29) % 360) AS b, CAST((event_id * 13) % 31 - 15 AS DOUBLE) AS yaw_deg FROM events))"""
DESCRIPTORS_SQL = """descriptors AS (
  SELECT label AS tile_idx, vec_id AS desc_id, 19 AS zoom, CAST(438990 + label % 5 AS INT) AS tile_x, CAST(224430 + label // 5 AS INT) AS tile_y, CAST(embedding AS DOUBLE[]) AS d
  FROM embeddings)"""
QUERIES_SQL = """queries_vec AS (
  SELECT {photo} AS photo_id, vec_id AS query_idx,
         list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) + ((vec_id // 5) % 10) * 0.05e0 * sin(CAST(vec_id + 64 * i AS DOUBLE))) AS d
  FROM embeddings WHERE vec_id % 5 = 0)"""
NEAR_SQL = """near AS (
  SELECT * FROM (
    SELECT photo_id, query_idx, desc_id, tile_idx, dist, row_number() OVER (PARTITION BY query_idx ORDER BY dist, desc_id) AS rank
    FROM (SELECT photo_id, query_idx, desc_id, tile_idx, list_distance(q.d, t.d) AS dist FROM queries_vec q, descriptors t))
  WHERE rank <= 2)"""
GOOD_SQL = """good AS (
  SELECT a.photo_id, a.query_idx, a.desc_id, a.tile_idx FROM near a JOIN near b ON a.query_idx = b.query_idx AND a.rank = 1 AND b.rank = 2 WHERE a.dist < 0.75e0 * b.dist)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _lat_sql(y: str, z: str) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({y}) / pow(2e0, {z})))))"


def _lon_sql(x: str, z: str) -> str:
    return f"(({x}) / pow(2e0, {z}) * 360 - 180)"


def _hav_sql(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))))"


TX_SQL = "CAST(floor((lon + 180) / 360 * pow(2e0, zoom)) AS INT)"
TY_SQL = "CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2e0, zoom)) AS INT)"


# Geographic functions


@query("geo_tiles", f"""
WITH {TELEMETRY_SQL},
t AS (SELECT msg, zoom, {TX_SQL} AS tile_x, {TY_SQL} AS tile_y FROM telemetry, (SELECT unnest([17, 18, 19]) AS zoom))
SELECT msg, zoom, tile_x, tile_y, round({_lat_sql('tile_y', 'zoom')}, 7) AS lat_nw, round({_lon_sql('tile_x', 'zoom')}, 7) AS lon_nw,
       round({_lat_sql('tile_y + 1', 'zoom')}, 7) AS lat_se, round({_lon_sql('tile_x + 1', 'zoom')}, 7) AS lon_se,
       round(({_lat_sql('tile_y', 'zoom')} + {_lat_sql('tile_y + 1', 'zoom')}) / 2, 7) AS lat_mid, round(({_lon_sql('tile_x', 'zoom')} + {_lon_sql('tile_x + 1', 'zoom')}) / 2, 7) AS lon_mid
FROM t""")
def geo_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, x, y = F.col("zoom"), F.col("tile_x"), F.col("tile_y")
    t = views.telemetry(spark, sf_dir).withColumn("zoom", F.explode(F.array(*map(F.lit, (17, 18, 19)))))
    t = t.select("msg", "zoom", geo.tile_x(F.col("lon"), z).alias("tile_x"), geo.tile_y(F.col("lat"), z).alias("tile_y"))
    t = t.withColumns({"b": geo.tile_bounds(x, y, z), "c": geo.tile_centre(x, y, z)})
    return t.select("msg", "zoom", "tile_x", "tile_y", *[F.round(f"b.{k}", 7).alias(k) for k in ("lat_nw", "lon_nw", "lat_se", "lon_se")], F.round("c.lat", 7).alias("lat_mid"), F.round("c.lon", 7).alias("lon_mid"))


@query("geo_pixels", f"""
WITH {TELEMETRY_SQL}, t AS (SELECT msg, lat, 19 AS zoom, msg % 256 AS px, (msg * 7) % 256 AS py, lon FROM telemetry),
u AS (SELECT *, {TX_SQL} AS x, {TY_SQL} AS y FROM t)
SELECT msg, round({_lat_sql('y + py / 256e0', 'zoom')}, 7) AS lat_exact, round({_lon_sql('x + px / 256e0', 'zoom')}, 7) AS lon_exact,
       round({_lat_sql('y', 'zoom')} + ({_lat_sql('y + 1', 'zoom')} - {_lat_sql('y', 'zoom')}) * py / 256e0, 7) AS lat_linear,
       round({_lon_sql('x', 'zoom')} + ({_lon_sql('x + 1', 'zoom')} - {_lon_sql('x', 'zoom')}) * px / 256e0, 7) AS lon_linear,
       round(156543.03e0 * cos(radians(lat)) / pow(2e0, zoom), 6) AS m_per_px
FROM u""")
def geo_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(19)
    t = views.telemetry(spark, sf_dir).withColumns({"x": geo.tile_x(F.col("lon"), z), "y": geo.tile_y(F.col("lat"), z), "px": F.col("msg") % 256, "py": (F.col("msg") * 7) % 256})
    args = (F.col("x"), F.col("y"), z, F.col("px"), F.col("py"))
    t = t.withColumns({"e": geo.pixel_to_latlon(*args), "l": geo.pixel_to_latlon(*args, exact=False)})
    return t.select("msg", F.round("e.lat", 7).alias("lat_exact"), F.round("e.lon", 7).alias("lon_exact"), F.round("l.lat", 7).alias("lat_linear"), F.round("l.lon", 7).alias("lon_linear"), F.round(geo.metres_per_pixel(F.col("lat"), z), 6).alias("m_per_px"))


BOX = (25.02, 121.43, 25.09, 121.51)


@query("geo_tile_plan", f"""
WITH {TELEMETRY_SQL},
z AS (SELECT unnest([17, 18]) AS zoom),
box AS (SELECT zoom, CAST(floor((121.43e0 + 180) / 360 * pow(2e0, zoom)) AS INT) AS x0, CAST(floor((121.51e0 + 180) / 360 * pow(2e0, zoom)) AS INT) AS x1,
        CAST(floor((1 - asinh(tan(radians(25.09e0))) / pi()) / 2 * pow(2e0, zoom)) AS INT) AS y0, CAST(floor((1 - asinh(tan(radians(25.02e0))) / pi()) / 2 * pow(2e0, zoom)) AS INT) AS y1 FROM z),
xs AS (SELECT zoom, CAST(unnest(range(x0, x1 + 1)) AS INT) AS tile_x, y0, y1 FROM box),
planned AS (SELECT zoom, tile_x, CAST(unnest(range(y0, y1 + 1)) AS INT) AS tile_y FROM xs),
present AS (SELECT DISTINCT zoom, {TX_SQL} AS tile_x, {TY_SQL} AS tile_y FROM telemetry, z),
missing AS (SELECT * FROM planned p WHERE NOT EXISTS (SELECT 1 FROM present q WHERE q.zoom = p.zoom AND q.tile_x = p.tile_x AND q.tile_y = p.tile_y))
SELECT p.zoom, p.tile_x, p.tile_y, m.zoom IS NOT NULL AS fetch FROM planned p LEFT JOIN missing m ON m.zoom = p.zoom AND m.tile_x = p.tile_x AND m.tile_y = p.tile_y""")
def geo_tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = tiles.box_tiles(spark, *BOX, 17).union(tiles.box_tiles(spark, *BOX, 18))
    seen = views.telemetry(spark, sf_dir).withColumn("zoom", F.explode(F.array(F.lit(17), F.lit(18))))
    present = seen.select("zoom", geo.tile_x(F.col("lon"), F.col("zoom")).alias("tile_x"), geo.tile_y(F.col("lat"), F.col("zoom")).alias("tile_y")).distinct()
    missing = tiles.to_fetch(planned, present).withColumn("fetch", F.lit(True))
    return planned.join(missing, ["zoom", "tile_x", "tile_y"], "left").withColumn("fetch", F.coalesce("fetch", F.lit(False)))


@query("geo_distances", f"""
WITH {TELEMETRY_SQL},
o AS (SELECT msg, lat, lon, lat + (msg % 200 - 100) / 111111e0 AS lat2, lon + (msg % 150 - 75) / (111111e0 * cos(radians(lat))) AS lon2 FROM telemetry)
SELECT msg, round(lat2, 7) AS lat2, round(lon2, 7) AS lon2, round({_hav_sql('lat', 'lon', 'lat2', 'lon2')}, 3) AS metres,
       round(degrees(atan2({_hav_sql('lat', 'lon', 'lat2', 'lon2')}, 100e0)), 4) AS bearing_error FROM o""")
def geo_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = geo.offset_latlon(F.col("lat"), F.col("lon"), F.col("msg") % 200 - 100, F.col("msg") % 150 - 75)
    t = views.telemetry(spark, sf_dir).withColumn("o", o)
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("o.lat"), F.col("o.lon"))
    return t.select("msg", F.round("o.lat", 7).alias("lat2"), F.round("o.lon", 7).alias("lon2"), F.round(d, 3).alias("metres"), F.round(geo.bearing_error_deg(d, F.lit(100.0)), 4).alias("bearing_error"))


@query("geo_units", f"""
WITH {TELEMETRY_SQL}, e AS (SELECT msg, lat, lon, epoch_us(ts) // 1000 - 315964800000 AS ms FROM telemetry)
SELECT msg, CAST(trunc(lat * 1e7) AS BIGINT) AS lat_e7, CAST(trunc(lon * 1e7) AS BIGINT) AS lon_e7, round(CAST(trunc(lat * 1e7) AS BIGINT) / 1e7, 7) AS lat_back,
       ms // 604800000 AS gps_week, ms % 604800000 AS gps_ms,
       printf('https://www.google.com/maps?q=%.7f,%.7f', lat, lon) AS pin, printf('https://www.google.com/maps/@%.7f,%.7f,100m/data=!3m1!1e3', lat, lon) AS satellite FROM e""")
def geo_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir).withColumns({"e7": geo.to_e7(F.col("lat")), "g": geo.gps_week_ms(F.col("ts"))})
    return t.select("msg", F.col("e7").alias("lat_e7"), geo.to_e7(F.col("lon")).alias("lon_e7"), F.round(geo.from_e7(F.col("e7")), 7).alias("lat_back"), F.col("g.week").alias("gps_week"), F.col("g.ms").alias("gps_ms"), geo.maps_pin(F.col("lat"), F.col("lon")).alias("pin"), geo.maps_satellite(F.col("lat"), F.col("lon")).alias("satellite"))


@query("geo_ground_sampling", f"""
WITH {TELEMETRY_SQL}, p AS (
  SELECT msg, CASE WHEN msg % 5 = 0 THEN NULL WHEN msg % 7 = 0 THEN 0e0 ELSE alt_m + 0.0123457e0 END AS a, CASE WHEN msg % 3 = 0 THEN NULL ELSE 50e0 END AS b FROM telemetry),
u AS (SELECT msg, coalesce((nullif(a, 0) + nullif(b, 0)) / 2, nullif(a, 0), nullif(b, 0), 60e0) AS alt FROM p)
SELECT msg, round(alt, 6) AS altitude_m, round(alt / (640e0 * (60e0 / 35)), 9) AS gsd_x, round(alt / (360e0 * (60 / 27.5e0)), 9) AS gsd_y FROM u""")
def geo_ground_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("msg")
    a = F.when(m % 5 == 0, None).when(m % 7 == 0, 0.0).otherwise(F.col("alt_m") + 0.0123457)
    t = views.telemetry(spark, sf_dir).withColumn("alt", geo.altitude_used(a, F.when(m % 3 != 0, 50.0))).withColumn("g", geo.ground_sampling(F.col("alt")))
    return t.select("msg", F.round("alt", 6).alias("altitude_m"), F.round("g.x", 9).alias("gsd_x"), F.round("g.y", 9).alias("gsd_y"))


# Text


_NAMES_SQL = f"""WITH {TELEMETRY_SQL}, n AS (
  SELECT msg, ts, alt_m, msg % 4 = 0 AS lost, printf('%.7f_%.7f-', lat, lon) AS p, printf('%.7f_%.7f__%.1fm', lat + 1e-5, lon + 2e-5, (msg % 400) / 16e0 + 0.03e0) AS q, lat, lon FROM telemetry),
names AS (
  SELECT msg, unnest([1, 2, 3, 4]) AS form,
    unnest([p || CASE WHEN lost THEN 'NOFIX_NOFIX__NAm' ELSE q END || '.png',
            p || CASE WHEN lost THEN 'NOFIX_NOFIX__NAm' ELSE q END || printf('__%.1fm', round(alt_m) + 0.03e0) || '.png',
            p || CASE WHEN lost THEN 'NOFIX_NOFIX__NAm' ELSE q END || printf('_pos%s_alt%.0fm', 'N', round(alt_m) + 0.03e0) || '.png',
            strftime(ts, '%Y%m%d_%H%M%S') || printf('__live__%.1fm.jpg', round(alt_m) + 0.03e0)]) AS name FROM n)"""


@query("text_names", f"""{_NAMES_SQL}
SELECT msg, form, name, TRY_CAST(nullif(regexp_extract(name, '(?i)__[A-Za-z0-9]*__(\\d+(?:\\.\\d+)?)m', 1), '') AS DOUBLE) AS altitude,
       TRY_CAST(nullif(regexp_extract(name, '(?i)__[A-Za-z0-9.]*__(\\d+(?:\\.\\d+)?)m', 1), '') AS DOUBLE) AS any_altitude,
       TRY_CAST(nullif(regexp_extract(name, '^(-?\\d+\\.\\d+)_(-?\\d+\\.\\d+)-', 1), '') AS DOUBLE) AS lat, TRY_CAST(nullif(regexp_extract(name, '^(-?\\d+\\.\\d+)_(-?\\d+\\.\\d+)-', 2), '') AS DOUBLE) AS lon,
       trim(',' || name || ',,', ',') AS trimmed
FROM names""")
def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir).withColumns({"alt": F.round("alt_m") + 0.03, "lost": F.col("msg") % 4 == 0})
    lat, lon, alt = F.col("lat"), F.col("lon"), F.col("alt")
    known = (lat, lon, F.when(~F.col("lost"), lat + 1e-5), F.when(~F.col("lost"), lon + 2e-5), (F.col("msg") % 400) / 16.0 + 0.03)
    forms = F.array(text.fix_name(*known), text.fix_name(*known, alt), text.fix_name(*known, alt, F.lit("N")), text.live_name(F.col("ts"), alt))
    t = t.select("msg", F.posexplode(forms).alias("k", "name")).withColumn("gps", text.parse_gps(F.col("name")))
    name = F.col("name")
    return t.select("msg", (F.col("k") + 1).alias("form"), "name", text.parse_altitude(name).alias("altitude"), text.parse_altitude(name, text.ANY_ALTITUDE_PATTERN).alias("any_altitude"), "gps.lat", "gps.lon", text.without_commas(F.concat(F.lit(","), name, F.lit(",,"))).alias("trimmed"))


@query("text_waypoints", f"""
WITH {TELEMETRY_SQL}, s AS (SELECT msg, printf('%.5f,%.5f', lat, lon) || ' ' || CASE WHEN msg % 3 = 0 THEN '1,2,3' WHEN msg % 3 = 1 THEN 'x,y' ELSE '' END || ' ' || printf('%.5f,%.5f', lat + 0.01e0, lon) AS t FROM telemetry),
i AS (SELECT msg, unnest(range(len(p))) AS k, unnest(p) AS item FROM (SELECT msg, list_filter(string_split(t, ' '), lambda x: x <> '') AS p FROM s)),
c AS (SELECT msg, k, string_split(item, ',') AS p FROM i)
SELECT msg, CAST(k AS INT) AS k, CASE WHEN len(p) = 2 AND TRY_CAST(p[2] AS DOUBLE) IS NOT NULL THEN TRY_CAST(p[1] AS DOUBLE) END AS lat, CASE WHEN len(p) = 2 AND TRY_CAST(p[1] AS DOUBLE) IS NOT NULL THEN TRY_CAST(p[2] AS DOUBLE) END AS lon FROM c""")
def text_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, lat, lon = F.col("msg"), F.col("lat"), F.col("lon")
    extra = F.when(m % 3 == 0, "1,2,3").when(m % 3 == 1, "x,y").otherwise("")
    t = F.concat_ws(" ", F.format_string("%.5f,%.5f", lat, lon), extra, F.format_string("%.5f,%.5f", lat + 0.01, lon))
    rows = views.telemetry(spark, sf_dir).select("msg", F.posexplode(telemetry.parse_waypoints(t)).alias("k", "p"))
    return rows.select("msg", "k", "p.lat", "p.lon")


# Guards and grades


@query("quality_fixes", f"""
WITH {TELEMETRY_SQL}
SELECT msg, CASE WHEN inliers > 80 THEN 10e0 WHEN inliers >= 40 THEN 30e0 WHEN inliers >= 20 THEN 60e0 ELSE 100e0 END AS hacc_m,
       CASE WHEN inliers >= 200 THEN 'excellent' WHEN inliers >= 50 THEN 'reliable' WHEN inliers >= 10 THEN 'weak' ELSE 'reject' END AS grade,
       abs(roll_deg) <= 15 AND abs(pitch_deg) <= 15 AS level, inliers >= 10 AS sent, NOT (msg % 9 = 0) AS fix,
       msg % 30 >= 4 AND inliers >= 12 AS leg_ok, coalesce(CAST(inliers AS DOUBLE) / nullif(msg % 300, 0) >= 0.3e0, false) AS confident, inliers * 0.5e0 < 25 AS trusted,
       msg % 6 <= 3 AND abs(alt_m - 40) <= 2.5e0 AS arrived
FROM telemetry""")
def quality_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.col("inliers"), F.col("msg")
    lost = F.when(m % 9 == 0, 0.0)
    four = F.lit(4)
    return views.telemetry(spark, sf_dir).select(
        "msg",
        quality.hacc_m(n).alias("hacc_m"),
        quality.match_grade(n).alias("grade"),
        quality.is_level(F.col("roll_deg"), F.col("pitch_deg")).alias("level"),
        quality.is_sent(n).alias("sent"),
        quality.has_fix(F.coalesce(lost, F.col("lat")), F.coalesce(lost, F.col("lon"))).alias("fix"),
        quality.leg_ok(four, four, m % 30, n).alias("leg_ok"),
        quality.leg_confident(m % 300, n).alias("confident"),
        quality.is_trusted(n * 0.5).alias("trusted"),
        quality.has_arrived(m % 6, F.col("alt_m") - 40).alias("arrived"),
    )


@query("quality_buckets", f"""
WITH {TELEMETRY_SQL}
SELECT CASE WHEN inliers > 80 THEN 10e0 WHEN inliers >= 40 THEN 30e0 WHEN inliers >= 20 THEN 60e0 ELSE 100e0 END AS hacc_m, count(*) AS n, min(inliers) AS least, max(inliers) AS most
FROM telemetry WHERE inliers >= 10 GROUP BY 1""")
def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("inliers")
    return views.telemetry(spark, sf_dir).where(quality.is_sent(n)).groupBy(quality.hacc_m(n).alias("hacc_m")).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("quality_spacing", f"""
WITH {TELEMETRY_SQL}, p AS (SELECT flight, msg, lat, lon, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM telemetry WINDOW w AS (PARTITION BY flight ORDER BY ts, msg))
SELECT flight, msg, round({_hav_sql('a', 'b', 'lat', 'lon')}, 3) AS metres, coalesce({_hav_sql('a', 'b', 'lat', 'lon')} >= 300, true) AS apart FROM p""")
def quality_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.spacing(views.telemetry(spark, sf_dir), telemetry.ordered())
    return found.select("flight", "msg", F.round("metres", 3).alias("metres"), "apart")


_QUAD_SQL = f"""WITH {TELEMETRY_SQL}, h AS (
  SELECT msg, inliers, msg % 25 AS good, 0.2e0 + (msg % 83) / 10e0 AS s, ((msg * 7) % 11 - 5) / 10e0 AS k, ((msg * 3) % 2400) - 800e0 AS tx, ((msg * 5) % 1900) - 600e0 AS ty, ((msg % 13) - 6) / 4000e0 AS px FROM telemetry),
c AS (SELECT *, tx / 1e0 AS x1, ty / 1e0 AS y1, (s * 320 + tx) / (px * 320 + 1) AS x2, (k * 320 + ty) / (px * 320 + 1) AS y2,
  (s * 320 - k * 240 + tx) / (px * 320 + 1) AS x3, (k * 320 + s * 240 + ty) / (px * 320 + 1) AS y3, -k * 240 + tx AS x4, s * 240 + ty AS y4,
  (s * 160 - k * 120 + tx) / (px * 160 + 1) AS cx, (k * 160 + s * 120 + ty) / (px * 160 + 1) AS cy FROM h),
t AS (SELECT *, trunc(x1) AS a1, trunc(y1) AS b1, trunc(x2) AS a2, trunc(y2) AS b2, trunc(x3) AS a3, trunc(y3) AS b3, trunc(x4) AS a4, trunc(y4) AS b4,
  abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2 AS area FROM c),
v AS (SELECT *, (a2 - a1) * (b3 - b2) - (b2 - b1) * (a3 - a2) AS t1, (a3 - a2) * (b4 - b3) - (b3 - b2) * (a4 - a3) AS t2,
  (a4 - a3) * (b1 - b4) - (b4 - b3) * (a1 - a4) AS t3, (a1 - a4) * (b2 - b1) - (b1 - b4) * (a2 - a1) AS t4 FROM t)"""


@query("geometry_quads", f"""{_QUAD_SQL}
SELECT msg, round(area, 3) AS area, round(cx, 6) AS centre_x, round(cy, 6) AS centre_y,
  CASE WHEN inliers < 5 THEN 'few query keypoints' WHEN good < 6 THEN 'few matches' WHEN inliers < 6 THEN 'few inliers'
       WHEN NOT (area BETWEEN 0.05e0 * 76800 AND 50e0 * 76800) THEN 'area'
       WHEN NOT ((t1 > 0 AND t2 > 0 AND t3 > 0 AND t4 > 0) OR (t1 < 0 AND t2 < 0 AND t3 < 0 AND t4 < 0)) THEN 'not convex'
       WHEN NOT (cx BETWEEN -256 AND 1024 AND cy BETWEEN -256 AND 1024) THEN 'centre outside' END AS reason
FROM v""")
def geometry_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w, h = F.col("msg"), F.lit(320.0), F.lit(240.0)
    s, k = 0.2 + (m % 83) / 10.0, ((m * 7) % 11 - 5) / 10.0
    matrix = F.array(s, -k, (m * 3) % 2400 - 800.0, k, s, (m * 5) % 1900 - 600.0, ((m % 13) - 6) / 4000.0, F.lit(0.0), F.lit(1.0))
    t = views.telemetry(spark, sf_dir).withColumn("h", matrix)
    centre = geometry.project(F.col("h"), w / 2, h / 2)
    why = geometry.rejection(F.col("inliers"), F.lit(100), m % 25, F.col("inliers"), F.col("h"), w, h)
    return t.select("msg", F.round(geometry.quad_area(geometry.quad_of(F.col("h"), w, h)), 3).alias("area"), F.round(centre["x"], 6).alias("centre_x"), F.round(centre["y"], 6).alias("centre_y"), why.alias("reason"))


@query("geometry_tilt", f"""
WITH {TELEMETRY_SQL}, a AS (SELECT msg, radians(-pitch_deg) AS p, radians(-roll_deg) AS r, radians(-((msg * 13) % 31 - 15)) AS y, abs(pitch_deg) > 0.5e0 OR abs(roll_deg) > 0.5e0 OR abs((msg * 13) % 31 - 15) > 0.5e0 AS tilted, 1280 / (2 * tan(radians(40e0))) AS f FROM telemetry),
rot AS (SELECT msg, tilted, f, cos(r) * cos(y) AS r0, -cos(r) * sin(y) AS r1, sin(r) AS r2, cos(p) * sin(y) + sin(p) * sin(r) * cos(y) AS r3, cos(p) * cos(y) - sin(p) * sin(r) * sin(y) AS r4, -sin(p) * cos(r) AS r5,
        sin(p) * sin(y) - cos(p) * sin(r) * cos(y) AS r6, sin(p) * cos(y) + cos(p) * sin(r) * sin(y) AS r7, cos(p) * cos(r) AS r8 FROM a),
k AS (SELECT *, f * r0 + 640 * r6 AS k0, f * r1 + 640 * r7 AS k1, f * r2 + 640 * r8 AS k2, f * r3 + 360 * r6 AS k3, f * r4 + 360 * r7 AS k4, f * r5 + 360 * r8 AS k5 FROM rot)
SELECT msg, tilted, CASE WHEN tilted THEN round(k0 / f, 6) END AS h0, CASE WHEN tilted THEN round(k2 - k0 * 640 / f - k1 * 360 / f, 4) END AS h2, CASE WHEN tilted THEN round(k4 / f, 6) END AS h4, CASE WHEN tilted THEN round(r6 / f, 9) + 0 END AS h6,
       CASE WHEN tilted THEN round(r8 - r6 * 640 / f - r7 * 360 / f, 6) END AS h8 FROM k""")
def geometry_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    yaw = (F.col("msg") * 13) % 31 - 15
    t = views.telemetry(spark, sf_dir).withColumn("h", geometry.tilt_homography(F.col("pitch_deg"), F.col("roll_deg"), yaw, 1280, 720))
    return t.select("msg", F.col("h").isNotNull().alias("tilted"), *[(F.round(F.col("h")[i], n) + 0.0).alias(f"h{i}") for i, n in ((0, 6), (2, 4), (4, 6), (6, 9), (8, 6))])


@query("geometry_displacement", f"""
WITH {TELEMETRY_SQL}, m AS (SELECT msg, CASE WHEN msg % 50 = 0 THEN 0e0 ELSE 0.8e0 + (msg % 41) / 100e0 END AS s, radians(CAST(msg % 61 - 30 AS DOUBLE)) AS t, CAST(msg % 97 - 48 AS DOUBLE) AS tx, CAST(msg % 89 - 44 AS DOUBLE) AS ty, 20.0123457e0 + alt_m AS alt FROM telemetry),
d AS (SELECT *, -(s * cos(t) * 640 - s * sin(t) * 360 + tx - 640) * alt / (640e0 * 60 / 35) AS dx, -(s * sin(t) * 640 + s * cos(t) * 360 + ty - 360) * alt / (360e0 * 60 / 27.5e0) AS dy FROM m)
SELECT msg, round(dx, 4) + 0 AS dx_m, round(dy, 4) + 0 AS dy_m, round(sqrt(dx * dx + dy * dy), 4) AS magnitude_m, CASE WHEN s > 0 THEN round(-degrees(atan2(s * sin(t), s * cos(t))), 4) + 0 ELSE 0e0 END AS yaw_change_deg, round(s, 6) AS scale,
       CASE WHEN s > 0 THEN round(alt * (1 / s - 1), 4) END AS altitude_change_m FROM d""")
def geometry_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("msg")
    s, a = F.when(m % 50 == 0, 0.0).otherwise(0.8 + (m % 41) / 100.0), F.radians((m % 61 - 30).cast("double"))
    matrix = F.array(s * F.cos(a), -s * F.sin(a), (m % 97 - 48).cast("double"), s * F.sin(a), s * F.cos(a), (m % 89 - 44).cast("double"))
    t = views.telemetry(spark, sf_dir).withColumn("d", geometry.displacement(matrix, 20.0123457 + F.col("alt_m")))
    yaw = F.when(F.col("d.scale") > 0, F.round("d.yaw_change_deg", 4) + 0.0).otherwise(0.0)
    return t.select("msg", (F.round("d.dx_m", 4) + 0.0).alias("dx_m"), (F.round("d.dy_m", 4) + 0.0).alias("dy_m"), F.round("d.magnitude_m", 4).alias("magnitude_m"), yaw.alias("yaw_change_deg"), F.round("d.scale", 6).alias("scale"), F.round(F.nanvl("d.altitude_change_m", F.lit(None).cast("double")), 4).alias("altitude_change_m"))


# Matching


def _photo(one: bool) -> str:
    return QUERIES_SQL.format(photo="0" if one else "vec_id // 125")


@query("match_knn", f"WITH {DESCRIPTORS_SQL}, {_photo(False)}, {NEAR_SQL} SELECT query_idx, desc_id, CAST(rank AS INT) AS rank, round(dist, 6) AS dist FROM near")
def match_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.knn(views.queries_vec(spark, sf_dir), views.descriptors(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


_CENTRE_SQL = f"round(({_lat_sql('tile_y', '19')} + {_lat_sql('tile_y + 1', '19')}) / 2, 7) AS lat, round(({_lon_sql('tile_x', '19')} + {_lon_sql('tile_x + 1', '19')}) / 2, 7) AS lon"


def _locate_sql(one: bool, top: int) -> str:
    return f"""WITH {DESCRIPTORS_SQL}, {_photo(one)}, {NEAR_SQL}, {GOOD_SQL},
voted AS (SELECT photo_id, tile_idx, count(*) AS votes FROM good GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY votes DESC, tile_idx) AS rank FROM voted)
SELECT photo_id, CAST(rank AS INT) AS rank, r.tile_idx, votes, tile_x, tile_y, {_CENTRE_SQL}
FROM ranked r JOIN (SELECT DISTINCT tile_idx, tile_x, tile_y FROM descriptors) t ON r.tile_idx = t.tile_idx WHERE rank <= {top}"""


def _located(spark: SparkSession, sf_dir: str, one: bool, top: int) -> DataFrame:
    from dataclasses import replace

    found = match.locate_tiles(views.queries_vec(spark, sf_dir, one), views.descriptors(spark, sf_dir), replace(BATCH, top_candidates=top))
    return found.select("photo_id", "rank", "tile_idx", "votes", "tile_x", "tile_y", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("match_locate", _locate_sql(False, 20))
def match_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, False, 20)


@query("match_locate_one_photo", _locate_sql(True, 5))
def match_locate_one_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, True, 5)


@query("match_within_tiles", f"""
WITH {DESCRIPTORS_SQL}, {_photo(False)}, q AS (SELECT v.*, e.label AS tile_idx FROM queries_vec v JOIN embeddings e ON v.query_idx = e.vec_id),
n AS (SELECT tile_idx, query_idx, desc_id, dist, row_number() OVER (PARTITION BY tile_idx, query_idx ORDER BY dist, desc_id) AS rank
      FROM (SELECT q.tile_idx, query_idx, desc_id, list_distance(q.d, t.d) AS dist FROM q JOIN descriptors t ON q.tile_idx = t.tile_idx))
SELECT tile_idx, query_idx, desc_id, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM n WHERE rank <= 2""")
def match_within_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = views.descriptors(spark, sf_dir)
    q = views.queries_vec(spark, sf_dir).join(train.select(F.col("desc_id").alias("query_idx"), "tile_idx"), "query_idx")
    return match.knn_within(q, train, ["tile_idx"]).withColumn("dist", F.round("dist", 6))


@query("match_hamming_all", """
WITH b AS (SELECT vec_id, label, list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INT) ELSE 0 END)) AS lo,
  list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 33] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INT) ELSE 0 END)) AS hi FROM embeddings),
p AS (SELECT q.label AS tile_idx, q.vec_id AS query_idx, t.vec_id AS desc_id, bit_count(xor(CAST(q.lo AS BIGINT), CAST(t.lo AS BIGINT))) + bit_count(xor(CAST(q.hi AS BIGINT), CAST(t.hi AS BIGINT))) AS dist FROM b q JOIN b t ON q.label = t.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY dist, desc_id) AS rank FROM p)
SELECT tile_idx, query_idx, desc_id, CAST(dist AS DOUBLE) AS dist, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""")
def match_hamming_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of all components as two words of 32 bits."""
    def word(first: int) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"), lambda s, i: F.when(F.element_at("embedding", i + first) > 0, s + F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(s))

    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("tile_idx"), F.col("vec_id").alias("desc_id"), F.array(word(1), word(33)).alias("desc"))
    return match.knn_within(t.withColumnRenamed("desc_id", "query_idx"), t, ["tile_idx"], distance=match.hamming)


@query("match_offsets", f"""
WITH {DESCRIPTORS_SQL}, n AS (SELECT tile_idx, count(*) AS n FROM descriptors GROUP BY 1), o AS (SELECT tile_idx, CAST(sum(n) OVER (ORDER BY tile_idx) AS BIGINT) AS stop, n FROM n)
SELECT CAST(r.row AS BIGINT) AS "row", tile_idx FROM (SELECT unnest(range(0, (SELECT count(*) FROM descriptors))) AS row) r JOIN o ON r.row >= stop - n AND r.row < stop""")
def match_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.descriptors(spark, sf_dir)
    stop = F.sum("n").over(W.orderBy("tile_idx"))  # as many rows as tiles
    offsets = d.groupBy("tile_idx").agg(F.count("*").alias("n")).select("tile_idx", (stop - F.col("n")).alias("first"), stop.alias("stop"))
    return match.tile_of_row(spark.range(d.count()).select(F.col("id").alias("row")), offsets).select("row", "tile_idx")


@query("match_neighbours", f"""
WITH {DESCRIPTORS_SQL}, t AS (SELECT DISTINCT zoom, tile_x, tile_y FROM descriptors), s AS (SELECT unnest([-1, 0, 1]) AS d)
SELECT g.zoom, g.tile_x, g.tile_y, g.tile_x + a.d AS n_x, g.tile_y + b.d AS n_y, (a.d + 1) * 256 AS left_px, (b.d + 1) * 256 AS top_px, u.zoom IS NOT NULL AS present
FROM t g, s a, s b LEFT JOIN t u ON u.zoom = g.zoom AND u.tile_x = g.tile_x + a.d AND u.tile_y = g.tile_y + b.d""")
def match_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.descriptors(spark, sf_dir).select("zoom", "tile_x", "tile_y").distinct()
    return match.neighbours(t, t).select("zoom", "tile_x", "tile_y", "n_x", "n_y", "left_px", "top_px", "present")


@query("match_first_accepted", f"""
WITH {DESCRIPTORS_SQL}, {_photo(False)}, {NEAR_SQL}, {GOOD_SQL},
voted AS (SELECT photo_id, tile_idx, count(*) AS votes FROM good GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY votes DESC, tile_idx) AS rank, (votes * 5 + tile_idx * 3) % 16 AS inliers FROM voted)
SELECT photo_id, CAST(min(rank) AS INT) AS rank, arg_min(tile_idx, rank) AS tile_idx, arg_min(inliers, rank) AS inliers FROM ranked WHERE rank <= 20 AND inliers >= 6 GROUP BY photo_id""")
def match_first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = match.locate_tiles(views.queries_vec(spark, sf_dir), views.descriptors(spark, sf_dir))
    judged = ranked.withColumn("inliers", (F.col("votes") * 5 + F.col("tile_idx") * 3) % 16)
    return match.first_accepted(judged, ["photo_id"], ["tile_idx", "inliers"], F.col("inliers") >= BATCH.min_inliers)


# Telemetry


@query("telemetry_as_of", """
WITH c AS (SELECT user_id AS flight, event_id AS capture, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id AS flight, event_id AS msg, ts, value FROM events WHERE event_type <> 'click')
SELECT c.flight, c.capture, p.msg, p.value FROM c ASOF LEFT JOIN p ON c.flight = p.flight AND c.ts >= p.ts""")
def telemetry_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.as_of(views.captures(spark, sf_dir), views.positions(spark, sf_dir), ["msg", "value"]).select("flight", "capture", "msg", "value")


@query("telemetry_latest", f"""
WITH {TELEMETRY_SQL} SELECT flight, arg_max(CASE WHEN msg % 3 = 0 THEN alt_m END, CASE WHEN msg % 3 = 0 THEN ts END) AS alt_m, arg_max(inliers, ts) AS inliers FROM telemetry GROUP BY flight""")
def telemetry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.telemetry(spark, sf_dir).withColumn("alt_m", F.when(F.col("msg") % 3 == 0, F.col("alt_m")))
    return telemetry.latest(rows, ["alt_m", "inliers"])


@query("telemetry_first_fix", f"""
WITH {TELEMETRY_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY ts, msg) AS k FROM telemetry WHERE msg % 4 <> 0)
SELECT flight, ts, msg, round(lat, 7) AS lat, round(lon, 7) AS lon FROM f WHERE k = 1""")
def telemetry_first_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.when(F.col("msg") % 4 == 0, 0.0)
    rows = views.telemetry(spark, sf_dir).withColumns({"lat": F.coalesce(lost, "lat"), "lon": F.coalesce(lost, "lon")})
    return telemetry.first_fix(rows).withColumns({"lat": F.round("lat", 7), "lon": F.round("lon", 7)})


def _hysteresis_sql(high: float, low: float) -> str:
    return f"coalesce(last_value(CASE WHEN alt_m >= {high}e0 THEN 1 WHEN alt_m < {low}e0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY flight ORDER BY ts, msg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"


@query("telemetry_hysteresis", f"WITH {TELEMETRY_SQL} SELECT flight, msg, {_hysteresis_sql(30, 10)} AS live, {_hysteresis_sql(50, 10)} AS sending, {_hysteresis_sql(30, 20)} AS passive FROM telemetry")
def telemetry_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = {"live": BATCH, "sending": LIVE_SENDING, "passive": PASSIVE}
    return views.telemetry(spark, sf_dir).select("flight", "msg", *[telemetry.hysteresis(F.col("alt_m"), c.capture_on_m, c.capture_off_m, telemetry.ordered()).alias(k) for k, c in forms.items()])


FOUR_HOURS = 4 * 3600
_ROWS_SQL = "o AS (SELECT flight, msg, ts, roll_deg, pitch_deg, row_number() OVER (PARTITION BY flight ORDER BY ts, msg) AS k FROM telemetry)"
THROTTLE_SQL = f"""WITH RECURSIVE {TELEMETRY_SQL}, {_ROWS_SQL},
r AS (SELECT flight, msg, k, ts AS last, true AS fire FROM o WHERE k = 1
      UNION ALL SELECT o.flight, o.msg, o.k, CASE WHEN o.ts - r.last >= INTERVAL 4 HOURS THEN o.ts ELSE r.last END, o.ts - r.last >= INTERVAL 4 HOURS FROM r JOIN o ON o.flight = r.flight AND o.k = r.k + 1)
SELECT flight, msg, fire FROM r"""


@query("telemetry_throttle", THROTTLE_SQL)
def telemetry_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.throttle(views.telemetry(spark, sf_dir), FOUR_HOURS).select("flight", "msg", "fire")


@query("telemetry_capture_slots", f"""WITH RECURSIVE {TELEMETRY_SQL}, {_ROWS_SQL},
f AS (SELECT flight, msg, ts, k, msg % 11 <> 0 AS fix, abs(roll_deg) <= 15 AND abs(pitch_deg) <= 15 AS level FROM o),
r AS (SELECT flight, msg, k, CASE WHEN fix AND NOT level THEN ts - INTERVAL 11520 SECONDS ELSE ts END AS last, CASE WHEN NOT fix THEN 'no fix' WHEN NOT level THEN 'tilted' ELSE 'shot' END AS outcome FROM f WHERE k = 1
      UNION ALL SELECT f.flight, f.msg, f.k, CASE WHEN f.ts - r.last < INTERVAL 4 HOURS THEN r.last WHEN f.fix AND NOT f.level THEN f.ts - INTERVAL 11520 SECONDS ELSE f.ts END,
             CASE WHEN f.ts - r.last < INTERVAL 4 HOURS THEN 'wait' WHEN NOT f.fix THEN 'no fix' WHEN NOT f.level THEN 'tilted' ELSE 'shot' END FROM r JOIN f ON f.flight = r.flight AND f.k = r.k + 1)
SELECT flight, msg, outcome FROM r""")
def telemetry_capture_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.telemetry(spark, sf_dir).withColumns({"fix": F.col("msg") % 11 != 0, "level": quality.is_level(F.col("roll_deg"), F.col("pitch_deg"))})
    return telemetry.capture_slots(rows, FOUR_HOURS)


@query("telemetry_missions", """
WITH i AS (SELECT event_id // 8 AS mission, event_id % 8 AS seq, CASE WHEN event_id % 5 = 0 THEN 22 ELSE 16 END AS command, CASE WHEN event_id % 6 = 0 THEN 0 ELSE 250000000 + event_id END AS x, 1214000000 + event_id AS y FROM events WHERE event_id % 37 <> 0),
w AS (SELECT *, count(*) OVER (PARTITION BY mission) AS n FROM i)
SELECT mission, seq, x / 1e7 AS lat, y / 1e7 AS lon FROM w WHERE n = 8 AND seq > 0 AND command = 16 AND x <> 0 AND y <> 0""")
def telemetry_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    items = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 37 <> 0").select(F.floor(e / 8).alias("mission"), F.lit(8).alias("expected"), (e % 8).alias("seq"), F.when(e % 5 == 0, 22).otherwise(16).alias("command"), F.when(e % 6 == 0, 0).otherwise(250000000 + e).alias("x"), (1214000000 + e).alias("y"))
    return telemetry.complete_mission(items)


@query("telemetry_anchors", """
WITH f AS (SELECT DISTINCT user_id AS flight FROM events),
r AS (SELECT flight, CASE WHEN flight % 3 = 0 THEN 25.1e0 END AS lat, CASE WHEN flight % 3 = 0 THEN 121.5e0 END AS lon, CASE WHEN flight % 4 = 0 THEN 90e0 END AS heading, CASE WHEN flight % 5 = 0 THEN 30e0 END AS agl FROM f),
l AS (SELECT flight, CASE WHEN flight % 2 = 0 THEN 25.2e0 END AS lat, 121.6e0 AS lon, 100e0 AS alt_msl, CASE WHEN flight % 7 <> 0 THEN 45e0 END AS heading, CASE WHEN flight % 2 = 0 THEN 40e0 END AS agl FROM f WHERE flight % 8 <> 0),
c AS (SELECT flight, 25.3e0 AS lat, 121.7e0 AS lon, 110e0 AS alt_msl FROM f WHERE flight % 9 <> 0),
j AS (SELECT r.flight, coalesce(r.lat, l.lat, c.lat) AS lat, coalesce(r.lon, l.lon, c.lon) AS lon, coalesce(l.alt_msl, c.alt_msl) AS alt_msl, coalesce(r.heading, l.heading) AS heading, coalesce(r.agl, l.agl, 60e0) AS agl FROM r LEFT JOIN l ON r.flight = l.flight LEFT JOIN c ON r.flight = c.flight)
SELECT *, lat IS NOT NULL AND lon IS NOT NULL AND alt_msl IS NOT NULL AND heading IS NOT NULL AS resolved FROM j""")
def telemetry_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, flights = F.col("flight"), views.telemetry(spark, sf_dir).select("flight").distinct()
    asked = flights.select("flight", F.when(f % 3 == 0, 25.1).alias("lat"), F.when(f % 3 == 0, 121.5).alias("lon"), F.lit(None).cast("double").alias("alt_msl"), F.when(f % 4 == 0, 90.0).alias("heading"), F.when(f % 5 == 0, 30.0).alias("agl"))
    now = flights.where("flight % 8 <> 0").select("flight", F.when(f % 2 == 0, 25.2).alias("lat"), F.lit(121.6).alias("lon"), F.lit(100.0).alias("alt_msl"), F.when(f % 7 != 0, 45.0).alias("heading"), F.when(f % 2 == 0, 40.0).alias("agl"))
    cache = flights.where("flight % 9 <> 0").select("flight", F.lit(25.3).alias("lat"), F.lit(121.7).alias("lon"), F.lit(110.0).alias("alt_msl"))
    return telemetry.resolve_anchor(asked, now, cache)


@query("telemetry_messages", f"""
WITH {TELEMETRY_SQL} SELECT flight, msg, CAST(trunc(lat * 1e7) AS BIGINT) AS lat_e7, CAST(trunc(lon * 1e7) AS BIGINT) AS lon_e7, CASE WHEN inliers > 80 THEN 10e0 WHEN inliers >= 40 THEN 30e0 WHEN inliers >= 20 THEN 60e0 ELSE 100e0 END AS hacc_m, 191 AS ignore_flags, 3 AS fix_type
FROM telemetry WHERE inliers >= 10""")
def telemetry_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.telemetry(spark, sf_dir).where(quality.is_sent(F.col("inliers")))
    return tiles.gps_input(rows, quality.hacc_m(F.col("inliers")))


@query("telemetry_sidecars", f"""
WITH {TELEMETRY_SQL} SELECT msg, round(roll_deg + (msg % 1009) / 99991e0, 4) + 0e0 AS roll_deg, round(pitch_deg - (msg % 1013) / 99989e0, 4) + 0e0 AS pitch_deg, round((msg % 360) + (msg % 997) / 99971e0, 4) AS yaw_deg, round(alt_m, 1) AS alt_m, round(lat, 7) AS lat, round(lon, 7) AS lon FROM telemetry""")
def telemetry_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("msg")
    j = tiles.attitude_json(F.col("roll_deg") + m % 1009 / 99991.0, F.col("pitch_deg") - m % 1013 / 99989.0, m % 360 + m % 997 / 99971.0, F.col("alt_m"), F.col("lat"), F.col("lon"))
    back = F.from_json(j, tiles.ATTITUDE)
    return views.telemetry(spark, sf_dir).select("msg", back.alias("a")).select("msg", (F.col("a.roll_deg") + 0.0).alias("roll_deg"), (F.col("a.pitch_deg") + 0.0).alias("pitch_deg"), "a.yaw_deg", "a.alt_m", "a.lat", "a.lon")


@query("telemetry_positions", f"""
WITH {TELEMETRY_SQL} SELECT flight, msg, epoch_us(ts) AS time_usec, (epoch_us(ts) // 1000 - 315964800000) // 604800000 AS time_week, (epoch_us(ts) // 1000 - 315964800000) % 604800000 AS time_week_ms,
  CAST(trunc(lat * 1e7) AS BIGINT) AS lat_e7, CAST(trunc(lon * 1e7) AS BIGINT) AS lon_e7, alt_m AS alt, roll_deg / 10e0 AS vn, pitch_deg / 10e0 AS ve, CASE WHEN inliers > 80 THEN 10e0 WHEN inliers >= 40 THEN 30e0 WHEN inliers >= 20 THEN 60e0 ELSE 100e0 END AS horiz_accuracy,
  1 AS gps_id, 176 AS ignore_flags, 3 AS fix_type, 10 AS satellites_visible, 0 AS yaw, 1e0 AS hdop, 1.5e0 AS vdop, 0e0 AS vd, 0.3e0 AS speed_accuracy, 0e0 AS vert_accuracy FROM telemetry WHERE inliers >= 10""")
def telemetry_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.telemetry(spark, sf_dir).where(quality.is_sent(F.col("inliers")))
    return tiles.position_messages(rows, F.col("roll_deg") / 10.0, F.col("pitch_deg") / 10.0, quality.hacc_m(F.col("inliers")))


_NEWEST = "last_value({} IGNORE NULLS) OVER (PARTITION BY flight ORDER BY ts, msg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("telemetry_state", f"""
WITH m AS (SELECT user_id AS flight, event_id AS msg, ts, event_id % 3 AS kind, event_id FROM events)
SELECT flight, msg, {_NEWEST.format("CASE WHEN kind = 0 THEN (250000000 + event_id) / 1e7 END")} AS lat, {_NEWEST.format("CASE WHEN kind = 0 THEN event_id % 90000 / 1e3 END")} AS alt_m,
  round({_NEWEST.format("CASE WHEN kind = 1 THEN degrees((event_id % 7) / 10e0) END")}, 9) AS yaw_deg, {_NEWEST.format("CASE WHEN kind = 2 AND event_id % 5 <> 0 THEN event_id % 2 = 1 END")} AS armed, {_NEWEST.format("CASE WHEN kind = 0 THEN 1 END")} IS NOT NULL AS gps_ok FROM m""")
def telemetry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kinds = F.element_at(F.array(*map(F.lit, ("GLOBAL_POSITION_INT", "ATTITUDE", "HEARTBEAT"))), (e % 3 + 1).cast("int"))
    angle = (e % 7) / 10.0
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("flight"), e.alias("msg"), "ts", kinds.alias("kind"), (250000000 + e).alias("lat_e7"), (1214000000 + e).alias("lon_e7"), (e % 90000).alias("rel_alt_mm"), angle.alias("roll_rad"), angle.alias("pitch_rad"), angle.alias("yaw_rad"), (e % 2 * 128 + 1).alias("base_mode"), F.when(e % 5 == 0, 6).otherwise(2).alias("vehicle_type"))
    return tiles.merged_state(rows).select("flight", "msg", "lat", "alt_m", F.round("yaw_deg", 9).alias("yaw_deg"), "armed", "gps_ok")


@query("index_downloads", f"""
WITH {DESCRIPTORS_SQL}, p AS (SELECT x, y FROM (SELECT unnest(range(438988, 438997)) AS x) a, (SELECT unnest(range(224428, 224440)) AS y) b), t AS (SELECT DISTINCT tile_x, tile_y FROM descriptors)
SELECT 19 AS zoom, count(tile_x) AS ok, count(*) - count(tile_x) AS failed FROM p LEFT JOIN t ON x = tile_x AND y = tile_y""")
def index_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = spark.range(9 * 12).select(F.lit(19).alias("zoom"), (F.col("id") % 9 + 438988).cast("int").alias("tile_x"), F.floor(F.col("id") / 9 + 224428).cast("int").alias("tile_y"))
    return tiles.download_counts(plan, views.descriptors(spark, sf_dir))


@query("telemetry_simulated", """
WITH s AS (SELECT unnest(range(0, 200)) AS k)
SELECT k AS step, round(CASE WHEN k < 20 THEN k * 2.75e0 ELSE 55 + 1.2e0 * sin(0.3e0 * k) END, 6) AS alt_m, round(25.05e0 + sum(1e-6 * sin(0.1e0 * k)) OVER w, 9) AS lat, round(121.47e0 + sum(1e-6 * cos(0.1e0 * k)) OVER w, 9) AS lon
FROM s WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def telemetry_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.simulated_vehicle(spark, 200).select("step", F.round("alt_m", 6).alias("alt_m"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


# Tracking


@query("track_pairs", """
WITH f AS (SELECT user_id AS flight, event_id AS frame, ts FROM events), p AS (SELECT flight, frame, lead(frame) OVER w AS next_frame, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS us FROM f WINDOW w AS (PARTITION BY flight ORDER BY ts, frame))
SELECT flight, frame, next_frame, CASE WHEN us > 0 THEN us / 1e6 END AS dt_s FROM p WHERE next_frame IS NOT NULL""")
def track_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.pairs(views.telemetry(spark, sf_dir).select("flight", F.col("msg").alias("frame"), "ts"))


@query("track_trajectory", f"""
WITH {LEGS_SQL}, h AS (SELECT *, ok AND confident AS used, sum(CASE WHEN ok AND confident THEN yaw_deg ELSE 0 END) OVER (PARTITION BY flight ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM legs)
SELECT flight, leg, heading, round(sum(CASE WHEN used THEN dx_m * cos(radians(heading)) - dy_m * sin(radians(heading)) ELSE 0 END) OVER w, 4) + 0 AS x_m, round(sum(CASE WHEN used THEN dx_m * sin(radians(heading)) + dy_m * cos(radians(heading)) ELSE 0 END) OVER w, 4) + 0 AS y_m
FROM h WINDOW w AS (PARTITION BY flight ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def track_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.trajectory(views.legs(spark, sf_dir)).withColumns({"x_m": F.round("x_m", 4) + 0.0, "y_m": F.round("y_m", 4) + 0.0})


@query("track_dead_reckoning", f"""
WITH {LEGS_SQL}, s AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY flight ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment, ok AND NOT anchor AS moves FROM legs),
h AS (SELECT *, sum((NOT anchor)::INT) OVER w AS legs_since_anchor, sum(CASE WHEN moves THEN yaw_deg ELSE 0 END) OVER w AS heading, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY flight, segment ORDER BY ts, leg))) / 1e6 AS dt FROM s WINDOW w AS (PARTITION BY flight, segment ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN moves THEN -dy_m * cos(radians(heading)) - dx_m * sin(radians(heading)) ELSE 0 END AS n, CASE WHEN moves THEN -dy_m * sin(radians(heading)) + dx_m * cos(radians(heading)) ELSE 0 END AS e FROM h),
a AS (SELECT *, 25.05e0 + sum(n / 111111e0) OVER (PARTITION BY flight, segment ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lat FROM m),
b AS (SELECT *, 121.47e0 + sum(e / (111111e0 * cos(radians(lat)))) OVER (PARTITION BY flight, segment ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lon FROM a)
SELECT flight, leg, CAST(segment AS BIGINT) AS segment, CAST(legs_since_anchor AS BIGINT) AS legs_since_anchor, heading, round(lat, 7) AS lat, round(lon, 7) AS lon, round(CASE WHEN dt > 0 THEN n / dt ELSE 0 END, 8) + 0 AS vn, round(CASE WHEN dt > 0 THEN e / dt ELSE 0 END, 8) + 0 AS ve FROM b""")
def track_dead_reckoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track.dead_reckoning(views.legs(spark, sf_dir), HOME)
    return rows.withColumns({"lat": F.round("lat", 7), "lon": F.round("lon", 7), "vn": F.round("vn", 8) + 0.0, "ve": F.round("ve", 8) + 0.0})


@query("track_accuracy", f"""
WITH RECURSIVE {LEGS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY ts, leg) AS k FROM legs),
z AS (SELECT DISTINCT flight, 0e0 AS z FROM legs),
r AS (SELECT flight, CAST(-1 AS BIGINT) AS leg, CAST(0 AS BIGINT) AS k, 0.5e0 AS h FROM z
      UNION ALL SELECT o.flight, o.leg, o.k, CASE WHEN anchor THEN 0.5e0 WHEN NOT ok THEN least(50e0, h + 5) WHEN confident THEN least(50e0, sqrt(h * h + pow(0.15e0 * magnitude_m, 2))) ELSE least(50e0, sqrt(h * h + pow(0.6e0 * magnitude_m, 2)) + 2) END FROM r JOIN o ON o.flight = r.flight AND o.k = r.k + 1)
SELECT flight, leg, round(h, 6) AS hacc_m FROM r WHERE k > 0""")
def track_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.accuracy(views.legs(spark, sf_dir), Odometry()).withColumn("hacc_m", F.round("hacc_m", 6))


@query("track_resend_all", f"""
WITH {TELEMETRY_SQL}, s AS (SELECT flight, msg, ts, lead(ts) OVER (PARTITION BY flight ORDER BY ts, msg) AS nxt FROM telemetry),
u AS (SELECT flight, msg, ts, coalesce(greatest(ts, nxt - INTERVAL 1 MICROSECOND), ts) AS til FROM s)
SELECT flight, msg, unnest(generate_series(ts, til, INTERVAL 3600 SECONDS)) AS sent FROM u""")
def track_resend_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resent(views.telemetry(spark, sf_dir))


def _resent(rows: DataFrame) -> DataFrame:
    return track.resend(rows.select("flight", "msg", "ts"), 3600).select("flight", "msg", "sent")


@query("track_interpolate_all", f"""
WITH {TELEMETRY_SQL}, m AS (SELECT msg AS move, lat AS lat0, lon AS lon0, lat + 0.001e0 AS lat1, lon - 0.002e0 AS lon1, (msg % 7) / 2e0 AS seconds FROM telemetry),
n AS (SELECT *, CAST(greatest(1, floor(seconds * 5)) AS INT) AS n FROM m), e AS (SELECT *, CAST(unnest(range(0, n + 1)) AS INT) AS i FROM n)
SELECT move, i, round(CASE WHEN i = n THEN lat1 ELSE lat0 + (lat1 - lat0) * (CAST(i AS DOUBLE) / n) END, 7) AS lat, round(CASE WHEN i = n THEN lon1 ELSE lon0 + (lon1 - lon0) * (CAST(i AS DOUBLE) / n) END, 7) AS lon,
       round(CASE WHEN i = n THEN 0 ELSE (lat1 - lat0) * 111111e0 / nullif(seconds, 0) END, 5) AS vn, round(CASE WHEN i = n THEN 0 ELSE (lon1 - lon0) * 111111e0 * cos(radians(lat0)) / nullif(seconds, 0) END, 5) AS ve FROM e""")
def track_interpolate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interpolated(views.telemetry(spark, sf_dir))


def _interpolated(rows: DataFrame) -> DataFrame:
    moves = rows.select(F.col("msg").alias("move"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), (F.col("lat") + 0.001).alias("lat1"), (F.col("lon") - 0.002).alias("lon1"), ((F.col("msg") % 7) / 2.0).alias("seconds"))
    return track.interpolate(moves, 5.0).withColumns({"lat": F.round("lat", 7), "lon": F.round("lon", 7), "vn": F.round("vn", 5), "ve": F.round("ve", 5)})


@query("track_out_and_back_all", f"""
WITH {TELEMETRY_SQL}, p AS (SELECT msg, lat, lon, list_concat(range(1, 11), list_reverse(range(0, 10))) AS path FROM telemetry),
w AS (SELECT msg, lat, lon, unnest(range(0, len(path))) AS i, unnest(path) AS k FROM p)
SELECT msg, CAST(i AS INT) AS i, round(lat + k * 20e0 / 111111e0, 7) AS lat, round(lon, 7) AS lon FROM w""")
def track_out_and_back_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waypoints(views.telemetry(spark, sf_dir))


def _waypoints(rows: DataFrame) -> DataFrame:
    rows = rows.select("msg", F.posexplode(track.out_and_back(F.col("lat"), F.col("lon"))).alias("i", "p"))
    return rows.select("msg", "i", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))


_OWN_SQL = """lat_a AS (SELECT *, CASE WHEN anchor THEN 25.02e0 + 0.07e0 * ((leg * 7919) % 10007) / 10007 END AS lat_own, CASE WHEN anchor AND leg % 4 <> 0 THEN 121.43e0 + 0.08e0 * ((leg * 104729) % 10009) / 10009 END AS lon_own,
  CASE WHEN anchor THEN CAST((leg * 37) % 360 AS DOUBLE) END AS heading_own, CASE WHEN anchor THEN 40e0 + leg % 30 END AS alt_own, CASE WHEN anchor AND leg % 3 <> 0 THEN 0.5e0 + (leg % 10) / 4e0 END AS hacc_own, ((leg * 11) % 9 - 4) / 2e0 AS climb FROM legs)"""
_BASE = "coalesce(first_value(CASE WHEN anchor THEN {}_own END) OVER w, {})"


def _anchored_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs whose anchors have their own fix; some lack the longitude or the accuracy."""
    k = F.col("leg")
    own = {"anchor_lat": 25.02 + 0.07 * ((k * 7919) % 10007) / 10007, "anchor_lon": F.when(k % 4 != 0, 121.43 + 0.08 * ((k * 104729) % 10009) / 10009), "anchor_heading": ((k * 37) % 360).cast("double"), "anchor_alt_m": 40.0 + k % 30, "anchor_hacc_m": F.when(k % 3 != 0, 0.5 + k % 10 / 4.0)}
    return views.legs(spark, sf_dir).withColumns({c: F.when(F.col("anchor"), v) for c, v in own.items()}).withColumn("altitude_change_m", ((k * 11) % 9 - 4) / 2.0)


@query("track_anchored", f"""
WITH RECURSIVE {LEGS_SQL}, {_OWN_SQL}, s AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY flight ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment, ok AND NOT anchor AS moves FROM lat_a),
h AS (SELECT *, sum((NOT anchor)::INT) OVER w AS legs_since_anchor, {_BASE.format('lat', '25.05e0')} AS lat0, {_BASE.format('lon', '121.47e0')} AS lon0, {_BASE.format('alt', '0e0')} + sum(CASE WHEN moves THEN climb ELSE 0 END) OVER w AS alt_m,
  {_BASE.format('heading', '0e0')} + 90 + sum(CASE WHEN moves THEN yaw_deg ELSE 0 END) OVER w AS heading FROM s WINDOW w AS (PARTITION BY flight, segment ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN moves THEN -dy_m * cos(radians(heading)) - dx_m * sin(radians(heading)) ELSE 0 END AS n, CASE WHEN moves THEN -dy_m * sin(radians(heading)) + dx_m * cos(radians(heading)) ELSE 0 END AS e FROM h),
a AS (SELECT *, lat0 + sum(n / 111111e0) OVER (PARTITION BY flight, segment ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lat FROM m),
b AS (SELECT *, lon0 + sum(e / (111111e0 * cos(radians(lat)))) OVER (PARTITION BY flight, segment ORDER BY ts, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lon FROM a),
o AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY ts, leg) AS k FROM lat_a), z AS (SELECT DISTINCT flight FROM legs),
r AS (SELECT flight, CAST(-1 AS BIGINT) AS leg, CAST(0 AS BIGINT) AS k, 0.5e0 AS h FROM z
      UNION ALL SELECT o.flight, o.leg, o.k, CASE WHEN anchor THEN coalesce(hacc_own, 0.5e0) WHEN NOT ok THEN least(50e0, h + 5) WHEN confident THEN least(50e0, sqrt(h * h + pow(0.15e0 * magnitude_m, 2))) ELSE least(50e0, sqrt(h * h + pow(0.6e0 * magnitude_m, 2)) + 2) END FROM r JOIN o ON o.flight = r.flight AND o.k = r.k + 1)
SELECT b.flight, b.leg, CAST(legs_since_anchor AS BIGINT) AS legs_since_anchor, heading, round(lat, 7) AS lat, round(lon, 7) AS lon, alt_m, round(h, 6) AS hacc_m FROM b JOIN r ON b.flight = r.flight AND b.leg = r.leg""")
def track_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with their own fix, heading, altitude and accuracy; the camera is mounted 90 degrees from forward."""
    rows = runs.tracked(_anchored_legs(spark, sf_dir), HOME, mount_deg=90.0, altitude=True)
    return rows.select("flight", "leg", "legs_since_anchor", "heading", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "alt_m", F.round("hacc_m", 6).alias("hacc_m"))


# Surveys


CELLS_SQL = """cells AS (
  SELECT user_id AS survey, event_id AS cell, event_id % 5 AS pos_idx, ['C', 'N', 'E', 'S', 'W'][event_id % 5 + 1] AS pos_name, (event_id // 5) % 5 AS alt_idx, 20e0 + 10 * ((event_id // 5) % 5) AS alt_m,
         CASE event_type WHEN 'error' THEN 'NOFIX' WHEN 'signup' THEN 'NOT_TESTED' ELSE 'OK' END AS status, CASE WHEN event_type NOT IN ('error', 'signup') THEN value / 4 END AS err_m, CAST(event_id % 40 AS DOUBLE) AS seconds
  FROM events)"""
PLACES = ["C", "N", "E", "S", "W"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "error", "NOFIX").when(kind == "signup", "NOT_TESTED").otherwise("OK")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("survey"), e.alias("cell"), (e % 5).alias("pos_idx"), F.element_at(F.array(*map(F.lit, PLACES)), (e % 5 + 1).cast("int")).alias("pos_name"), (F.floor(e / 5) % 5).alias("alt_idx"), (20.0 + 10 * (F.floor(e / 5) % 5)).alias("alt_m"), status.alias("status"), F.when(status == "OK", F.col("value") / 4).alias("err_m"), (e % 40).cast("double").alias("seconds"))


@query("survey_matrix", f"WITH {CELLS_SQL} SELECT alt_m, " + ", ".join(f"min(CASE WHEN pos_name = '{p}' THEN err_m END) AS \"{p}\"" for p in PLACES) + " FROM cells WHERE status = 'OK' GROUP BY alt_m")
def survey_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.matrix(_cells(spark, sf_dir), PLACES)


@query("survey_means", f"WITH {CELLS_SQL} SELECT alt_m, round(avg(CASE WHEN status = 'OK' THEN err_m END), 6) AS mean_err_m, count(CASE WHEN status = 'OK' THEN 1 END) AS n FROM cells GROUP BY alt_m")
def survey_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.means(_cells(spark, sf_dir)).withColumn("mean_err_m", F.round("mean_err_m", 6))


@query("survey_best", f"WITH {CELLS_SQL} SELECT alt_m, pos_name, err_m FROM cells WHERE status = 'OK' ORDER BY err_m, alt_idx, pos_idx LIMIT 1")
def survey_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.best(_cells(spark, sf_dir))


@query("survey_budget", f"""WITH {CELLS_SQL}, b AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY survey ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM cells),
c AS (SELECT survey, cell, CASE WHEN used >= 110 THEN 'NOT_TESTED' ELSE status END AS status, CASE WHEN used < 110 THEN err_m END AS err_m FROM b)
SELECT *, CASE status WHEN 'OK' THEN err_m WHEN 'NOFIX' THEN -1e0 ELSE -2e0 END AS shown FROM c""")
def survey_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = survey.within_budget(_cells(spark, sf_dir), 110.0, ["cell"]).select("survey", "cell", "status", "err_m")
    return cells.withColumn("shown", survey.display(F.col("status"), F.col("err_m")))


@query("survey_wait_all", f"""
WITH {TELEMETRY_SQL}, s AS (SELECT flight, ts AS started FROM telemetry),
r AS (SELECT s.flight, started, min(ts) AS reached FROM s JOIN telemetry t ON s.flight = t.flight AND ts >= started AND ts < started + INTERVAL 86400 SECONDS AND abs(alt_m - 40) <= 2.5e0 GROUP BY ALL)
SELECT s.flight, s.started, reached FROM s LEFT JOIN r ON s.flight = r.flight AND s.started = r.started""")
def survey_wait_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waited(views.telemetry(spark, sf_dir))


def _waited(rows: DataFrame) -> DataFrame:
    return survey.wait_until(rows.select("flight", "ts", "alt_m"), rows.select("flight", F.col("ts").alias("started")), F.abs(F.col("alt_m") - 40) <= 2.5, 86400)


# Index and robust fits


@query("index_binary", f"WITH {DESCRIPTORS_SQL} SELECT zoom, tile_x, tile_y, count(*) AS n, round(sum(d[1]), 4) AS first_sum, round(sum(d[64]), 4) AS last_sum FROM descriptors GROUP BY ALL")
def index_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptors written in the binary layout and read again."""
    folder = scratch(spark, "binary")
    index.write_binary(views.descriptors(spark, sf_dir).where(F.size("desc") == 64), folder, 64)
    decoded = index.read_binary(spark, folder, 64)
    return decoded.groupBy("zoom", "tile_x", "tile_y").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("desc", 1).cast("double")), 4).alias("first_sum"), F.round(F.sum(F.element_at("desc", 64).cast("double")), 4).alias("last_sum"))


@query("index_stats", f"""WITH {DESCRIPTORS_SQL}, n AS (SELECT tile_idx, count(*) AS n, count(CASE WHEN len(d) = 64 THEN 1 END) AS good FROM descriptors WHERE desc_id % 17 <> 0 OR tile_idx <> 3 GROUP BY 1)
SELECT count(CASE WHEN good >= 45 THEN 1 END) AS tiles, count(CASE WHEN good < 45 THEN 1 END) AS skipped, CAST(coalesce(sum(CASE WHEN good >= 45 THEN good END), 0) AS BIGINT) AS descriptors FROM n""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.descriptors(spark, sf_dir).where("desc_id % 17 <> 0 or tile_idx <> 3")
    w = W.partitionBy("tile_idx")
    kept = rows.where(F.size("desc") == 64).withColumn("good", F.count("*").over(w)).where("good >= 45")
    return localize.index_stats(rows.select("zoom", "tile_x", "tile_y").distinct(), kept)


@query("robust_fits", """
WITH n AS (SELECT user_id AS flight, count(*) AS n FROM events GROUP BY 1)
SELECT flight, n, n - (n + 2) // 3 AS good, CASE WHEN n >= 8 THEN n - (n + 2) // 3 END AS similar, CASE WHEN n >= 8 THEN n - (n + 2) // 3 END AS projective, CASE WHEN n >= 8 THEN round(1 + (flight % 7) / 50e0, 6) END AS scale FROM n""")
def robust_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flight's points moved by a known similarity and homography, every third one wrong, and what is found again."""
    import numpy as np
    import pyarrow as pa

    kinds = {"flight": pa.int64(), "n": pa.int64(), "good": pa.int64(), "similar": pa.int64(), "projective": pa.int64(), "scale": pa.float64()}

    def fit(flight: int | None, lat: np.ndarray, lon: np.ndarray) -> tuple:
        src = np.stack([(lat - 25.02) * 7000, (lon - 121.43) * 7000], 1)
        f = flight or 0
        k, t = 1 + (f % 7) / 50, np.radians(f % 31 - 15)
        move = np.array([[k * np.cos(t), -k * np.sin(t), 5.0], [k * np.sin(t), k * np.cos(t), -3.0]])
        dst = src @ move[:, :2].T + move[:, 2]
        dst[::3] += 40 + 10 * (np.arange(len(dst[::3])) % 5)[:, None]
        m, inliers = robust.similarity(src, dst, seed=f)
        h, mask = robust.homography(src, dst, seed=f)
        good = len(src) - len(src[::3])
        return flight, len(src), good, int(inliers.sum()), int(mask.sum()), None if m is None or flight is None else round(float(np.hypot(m[0, 0], m[1, 0])), 6)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flights in telemetry.whole(batches, "flight"):
            found = [fit(flight, *(rows[c].to_numpy() for c in ("lat", "lon"))) for flight, rows in flights]
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds.values(), strict=True)], names=list(kinds))

    rows = views.telemetry(spark, sf_dir).select("flight", "msg", "lat", "lon")
    return rows.repartition("flight").sortWithinPartitions("flight", "msg").mapInArrow(fitted, "flight bigint, n bigint, good bigint, similar bigint, projective bigint, scale double")


# Whole runs


@query("run_captures", f"""WITH RECURSIVE {TELEMETRY_SQL}, h AS (SELECT *, {_hysteresis_sql(30, 10)} AS up FROM telemetry),
f AS (SELECT flight, msg, ts, lat, lon, alt_m, inliers, abs(roll_deg) <= 15 AND abs(pitch_deg) <= 15 AS level, row_number() OVER (PARTITION BY flight ORDER BY ts, msg) AS k FROM h WHERE up = 1),
r AS (SELECT flight, msg, k, CASE WHEN NOT level THEN ts - INTERVAL 11520 SECONDS ELSE ts END AS last, level AS shot FROM f WHERE k = 1
      UNION ALL SELECT f.flight, f.msg, f.k, CASE WHEN f.ts - r.last < INTERVAL 4 HOURS THEN r.last WHEN NOT f.level THEN f.ts - INTERVAL 11520 SECONDS ELSE f.ts END, f.ts - r.last >= INTERVAL 4 HOURS AND f.level FROM r JOIN f ON f.flight = r.flight AND f.k = r.k + 1),
s AS (SELECT f.*, CASE WHEN inliers >= 6 THEN lat + (f.msg % 50) * 1e-6 END AS lat_est, CASE WHEN inliers >= 6 THEN lon - (f.msg % 70) * 1e-6 END AS lon_est FROM f JOIN r ON f.flight = r.flight AND f.msg = r.msg AND r.shot)
SELECT flight, msg, round({_hav_sql('lat', 'lon', 'lat_est', 'lon_est')}, 3) AS error_m, CASE WHEN inliers >= 10 THEN CASE WHEN inliers > 80 THEN 10e0 WHEN inliers >= 40 THEN 30e0 WHEN inliers >= 20 THEN 60e0 ELSE 100e0 END END AS hacc_m, inliers >= 10 AS sent FROM s""")
def run_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.telemetry(spark, sf_dir)
    estimates = rows.where(F.col("inliers") >= LIVE.min_inliers).select("flight", "msg", (F.col("lat") + (F.col("msg") % 50) * 1e-6).alias("lat_est"), (F.col("lon") - (F.col("msg") % 70) * 1e-6).alias("lon_est"), "inliers")
    return runs.compared(runs.captures(rows, FOUR_HOURS), estimates).select("flight", "msg", F.round("error_m", 3).alias("error_m"), "hacc_m", "sent")


@query("run_passive", SQL["run_captures"].replace("abs(roll_deg) <= 15 AND abs(pitch_deg) <= 15", "true").replace(_hysteresis_sql(30, 10), _hysteresis_sql(30, 20)))
def run_passive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passive run: it goes on down to 20 m and takes photos at any tilt."""
    rows = views.telemetry(spark, sf_dir)
    estimates = rows.where(F.col("inliers") >= PASSIVE.min_inliers).select("flight", "msg", (F.col("lat") + (F.col("msg") % 50) * 1e-6).alias("lat_est"), (F.col("lon") - (F.col("msg") % 70) * 1e-6).alias("lon_est"), "inliers")
    return runs.compared(runs.captures(rows, FOUR_HOURS, PASSIVE, guarded=False), estimates, PASSIVE).select("flight", "msg", F.round("error_m", 3).alias("error_m"), "hacc_m", "sent")


@query("run_tracked", f"SELECT a.flight, a.leg, a.lat, a.lon, a.heading, b.hacc_m, b.hacc_m < 25 AS trusted FROM ({SQL['track_dead_reckoning']}) a JOIN ({SQL['track_accuracy']}) b ON a.flight = b.flight AND a.leg = b.leg")
def run_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.tracked(views.legs(spark, sf_dir), HOME)
    return rows.select("flight", "leg", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "heading", F.round("hacc_m", 6).alias("hacc_m"), "trusted")


@query("run_leg_errors", f"""
WITH {TELEMETRY_SQL}, n AS (SELECT flight, msg, alt_m, round(lat, 7) AS lat, round(lon, 7) AS lon, lead(round(lat, 7)) OVER w AS lat2, lead(round(lon, 7)) OVER w AS lon2 FROM telemetry WINDOW w AS (PARTITION BY flight ORDER BY ts, msg)),
d AS (SELECT flight, msg, alt_m * 100 AS m, {_hav_sql('lat', 'lon', 'lat2', 'lon2')} AS t FROM n WHERE lat2 IS NOT NULL)
SELECT flight, msg, round(t, 2) AS true_m, round(abs(m - t) / nullif(t, 0) * 100, 2) AS error_pct FROM d""")
def run_leg_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    named = views.telemetry(spark, sf_dir).withColumn("name", text.fix_name(F.col("lat"), F.col("lon"), none, none, none))
    pairs = named.select("flight", "msg", "name", F.lead("name").over(telemetry.ordered()).alias("next_name"), (F.col("alt_m") * 100).alias("magnitude_m")).where("next_name is not null")
    return runs.leg_errors(pairs).select("flight", "msg", F.round("true_m", 2).alias("true_m"), F.round("error_pct", 2).alias("error_pct"))


@query("run_survey_all", f"""
WITH {TELEMETRY_SQL}, p AS (SELECT flight, ts AS started, (msg // 10) % 5 AS pos_idx, (msg // 50) % 5 AS alt_idx, 20e0 + 10 * ((msg // 50) % 5) AS goal FROM telemetry),
r AS (SELECT p.flight, started, min(ts) AS ts FROM p JOIN telemetry t ON p.flight = t.flight AND ts >= started AND ts < started + INTERVAL 172800 SECONDS AND abs(t.alt_m - goal) <= 5 GROUP BY ALL),
c AS (SELECT ['C', 'N', 'E', 'S', 'W'][pos_idx + 1] AS pos_name, goal AS alt_m, CASE WHEN t.inliers >= 6 THEN t.inliers / 4e0 END AS err_m FROM p LEFT JOIN r ON p.flight = r.flight AND p.started = r.started LEFT JOIN telemetry t ON r.flight = t.flight AND r.ts = t.ts)
SELECT alt_m, {", ".join(f"min(CASE WHEN pos_name = '{p}' THEN err_m END) AS {chr(34)}{p}{chr(34)}" for p in PLACES)}, round(avg(err_m), 6) AS mean_err_m, count(err_m) AS n_cells FROM c GROUP BY alt_m""")
def run_survey_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surveyed(views.telemetry(spark, sf_dir))


def _surveyed(rows: DataFrame) -> DataFrame:
    m = F.col("msg")
    pos, alt = F.floor(m / 10) % 5, F.floor(m / 50) % 5
    plan = rows.select("flight", F.col("ts").alias("started"), pos.alias("pos_idx"), F.element_at(F.array(*map(F.lit, PLACES)), (pos + 1).cast("int")).alias("pos_name"), alt.alias("alt_idx"), (20.0 + 10 * alt).alias("alt_m"))
    errors = rows.where(F.col("inliers") >= LIVE.min_inliers).select("flight", "ts", (F.col("inliers") / 4.0).alias("err_m"))
    return runs.survey_report(runs.survey_cells(rows, plan, errors, 5.0, 172800), PLACES).withColumn("mean_err_m", F.round("mean_err_m", 6))


# Streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry projection as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.select(F.col("user_id").alias("flight"), F.col("event_id").alias("msg"), "ts", F.expr("mod(value, 80)").alias("alt_m"))


@query("stream_hysteresis", f"WITH {TELEMETRY_SQL} SELECT flight, msg, {_hysteresis_sql(30, 10)} AS \"on\" FROM telemetry")
def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.run_available(live.hysteresis(_stream(spark, sf_dir), 30, 10), scratch(spark, "stream"))


@query("stream_throttle", THROTTLE_SQL)
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.run_available(live.throttle(_stream(spark, sf_dir), FOUR_HOURS), scratch(spark, "stream"))


@query("stream_capture_slots", SQL["telemetry_capture_slots"])
def stream_capture_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("msg")
    level = quality.is_level((m * 31) % 41 - 20, (m * 17) % 37 - 18)
    rows = _stream(spark, sf_dir).withColumns({"fix": m % 11 != 0, "level": level})
    return live.run_available(live.capture_slots(rows, FOUR_HOURS), scratch(spark, "stream"))


@query("stream_tracked", f"SELECT a.flight, a.leg, a.heading, a.lat, a.lon, b.hacc_m FROM ({SQL['track_dead_reckoning']}) a JOIN ({SQL['track_accuracy']}) b ON a.flight = b.flight AND a.leg = b.leg")
def stream_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    found = live.run_available(live.tracked(views.legs_of(rows), HOME), scratch(spark, "stream"))
    return found.select("flight", "leg", "heading", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("hacc_m", 6).alias("hacc_m"))
