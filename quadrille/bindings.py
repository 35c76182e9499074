"""Queries over the driver's tables, each with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernel as K
from .operators import graph, hull, spatial
from .operators.validate import record_violations
from .plans import engine, samples
from .schema import EDGES, POLYGON
from .security import review
from .security.settings import CAMPUS_FENCE, Settings
from .session import cut
from .streaming.windows import windowed_rates

MONTH = Settings(start=1_704_067_200, end=1_706_659_200)
WEEK = MONTH.but(end=1_704_672_000)
CONCAVE = ((-120.0, -120.0), (120.0, -120.0), (120.0, 120.0), (0.0, 10.0), (-120.0, 120.0))
BOWTIE = ((0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0))
EPS, MIN_PTS = 20.0, 4

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- frames from tables, and the same as SQL


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pts_embed(spark: SparkSession, sf: str) -> DataFrame:
    x = lambda k: (F.get("embedding", F.lit(k)).cast("double") * 1000).alias("xy"[k])
    return _table(spark, sf, "embeddings").filter("embedding IS NOT NULL").select(F.lit("e").alias("scene"), F.col("vec_id").alias("id"), x(0), x(1))


def pts_part(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select(F.lit("p").alias("scene"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def pts_brand(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select(F.col("p_brand").alias("scene"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events").withColumn("n", F.floor(F.col("value") * 10).cast("long") + 1)
    place = lambda a, b, c, d: F.lit(a) + (F.pmod(F.col("user_id") * b, F.lit(c)) - d) * F.lit(1e-4)
    label = F.when(F.col("event_type") == "error", "suspicious").when(F.col("event_type") == "signup", "unknown").otherwise("benign")
    return e.select(
        F.col("event_id").alias("idx"),
        F.col("event_id").cast("string").alias("event_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("timestamp"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("device-"), F.col("user_id").cast("string")).alias("device_id"),
        place(20.2961, 37, 101, 50).alias("latitude"),
        place(85.8245, 53, 97, 48).alias("longitude"),
        F.col("n").alias("requests"),
        F.when(F.col("event_type") == "error", F.col("n")).otherwise(0).cast("long").alias("failures"),
        label.alias("label"),
        F.col("event_type").alias("summary"),
    )


def n_vertices(spark: SparkSession, sf: str) -> int:
    """Customers are the vertices, numbered from 0."""
    return int(_table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]) + 1


def road_edges(spark: SparkSession, sf: str) -> DataFrame:
    n = F.lit(n_vertices(spark, sf))
    o = _table(spark, sf, "orders").select(F.col("o_custkey").alias("s"), F.pmod(F.col("o_orderkey") * 7919, n).alias("t"), F.floor(F.col("o_totalprice") / 1000 + 0.5).alias("w"), (F.col("o_orderstatus") == "F").alias("f"))
    return o.filter("s <> t").groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.min("w").cast("double").alias("weight"), F.min("f").alias("blocked")).select(F.lit("g").alias("scene"), "a", "b", "weight", "blocked")


def road_points(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(n_vertices(spark, sf)).select(F.lit("g").alias("scene"), "id", (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))


def start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("g", 0)], "scene string, id long")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    s = _table(spark, sf, "supplier")
    x, y = F.col("s_suppkey"), F.col("s_acctbal")
    return s.select(F.lit("s").alias("scene"), x.alias("seg"), (x % 37).cast("double").alias("ax"), (y / 100).alias("ay"), ((x * 7) % 41).cast("double").alias("bx"), (F.col("s_nationkey") * 4).cast("double").alias("by"))


def polygon(spark: SparkSession, vertices, scene: str = "e") -> DataFrame:
    return spark.createDataFrame([(scene, i, x, y) for i, (x, y) in enumerate(vertices)], "scene string, seq int, x double, y double")


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Query points beside the data: the vectors whose id is divisible by 100, moved a little."""
    return pts_embed(spark, sf).filter("id % 100 = 0").select("scene", "id", (F.col("x") + 1.5).alias("x"), (F.col("y") - 2.5).alias("y"))


EMBED = "embed AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings WHERE embedding IS NOT NULL)"
PART = "part_ AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y, p_brand AS scene FROM part)"
PROBES = "probes AS (SELECT id, x + 1.5::DOUBLE AS x, y - 2.5::DOUBLE AS y FROM embed WHERE id % 100 = 0)"
EVENTS = """ev AS (SELECT event_id AS idx, event_id::VARCHAR AS event_id, (epoch_us(ts) // 1000000)::BIGINT AS timestamp, 'user-' || user_id AS user_id, 'device-' || user_id AS device_id,
  20.2961::DOUBLE + ((user_id * 37) % 101 - 50)::DOUBLE * 0.0001::DOUBLE AS latitude, 85.8245::DOUBLE + ((user_id * 53) % 97 - 48)::DOUBLE * 0.0001::DOUBLE AS longitude,
  floor(value * 10::DOUBLE)::BIGINT + 1 AS requests, CASE WHEN event_type = 'error' THEN floor(value * 10::DOUBLE)::BIGINT + 1 ELSE 0 END AS failures,
  CASE event_type WHEN 'error' THEN 'suspicious' WHEN 'signup' THEN 'unknown' ELSE 'benign' END AS label, event_type AS summary FROM events)"""
SEGS = "segs AS (SELECT s_suppkey AS seg, (s_suppkey % 37)::DOUBLE AS ax, s_acctbal / 100::DOUBLE AS ay, ((s_suppkey * 7) % 41)::DOUBLE AS bx, (s_nationkey * 4)::DOUBLE AS by FROM supplier)"
ROADS = """roads AS (SELECT least(s, t) AS a, greatest(s, t) AS b, min(w)::DOUBLE AS weight, bool_and(f) AS blocked FROM
  (SELECT o_custkey AS s, (o_orderkey * 7919) % (SELECT max(c_custkey) + 1 FROM customer) AS t, floor(o_totalprice / 1000::DOUBLE + 0.5::DOUBLE) AS w, o_orderstatus = 'F' AS f FROM orders) WHERE s <> t GROUP BY ALL HAVING true),
steps AS (SELECT a AS u, b AS v, weight FROM roads WHERE NOT blocked UNION ALL SELECT b, a, weight FROM roads WHERE NOT blocked)""".replace("GROUP BY ALL HAVING true", "GROUP BY 1, 2")
COSTS = "costs AS (SELECT v, min(d) AS cost FROM (WITH RECURSIVE t(r, v, d) AS (SELECT 0, 0::BIGINT, 0::DOUBLE UNION ALL SELECT r + 1, v, min(d) FROM (SELECT r, v, d FROM t UNION ALL SELECT r, steps.v, t.d + weight FROM t JOIN steps ON t.v = steps.u) GROUP BY r, v HAVING r < 60) SELECT v, d FROM t) GROUP BY v)"


def micro(x: str) -> str:
    return f"floor(({x}) * 1000000::DOUBLE + 0.5::DOUBLE)::BIGINT"


def sql_cross(a: str, b: str, c: str) -> str:
    """a, b, c: pairs 'x,y'."""
    (ax, ay), (bx, by), (cx, cy) = (p.split(",") for p in (a, b, c))
    return f"(({bx}-{ax})*({cy}-{ay})-({by}-{ay})*({cx}-{ax}))"


def sql_length(a: str, b: str) -> str:
    (ax, ay), (bx, by) = (p.split(",") for p in (a, b))
    return f"sqrt(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay}))"


def sql_turn(a: str, b: str, c: str) -> str:
    slack = f"(1e-9::DOUBLE * greatest(1::DOUBLE, {sql_length(a, b)}*{sql_length(a, c)}))"
    return f"(CASE WHEN {sql_cross(a, b, c)} > {slack} THEN 1 WHEN {sql_cross(a, b, c)} < -{slack} THEN -1 ELSE 0 END)"


def sql_on(p: str, a: str, b: str) -> str:
    slack = f"(1e-9::DOUBLE * greatest(1::DOUBLE, {sql_length(a, b)}))"
    (px, py), (ax, ay), (bx, by) = (q.split(",") for q in (p, a, b))
    within = [f"{q} >= least({r},{s}) - {slack} AND {q} <= greatest({r},{s}) + {slack}" for q, r, s in ((px, ax, bx), (py, ay, by))]
    return f"({sql_turn(a, b, p)} = 0 AND {within[0]} AND {within[1]})"


def sql_meet(a: str, b: str, c: str, d: str) -> str:
    proper = f"({sql_turn(a, b, c)} * {sql_turn(a, b, d)} < 0 AND {sql_turn(c, d, a)} * {sql_turn(c, d, b)} < 0)"
    return f"({proper} OR {sql_on(a, c, d)} OR {sql_on(b, c, d)} OR {sql_on(c, a, b)} OR {sql_on(d, a, b)})"


def sql_fence(vertices) -> str:
    rows = ", ".join(f"({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for (ax, ay), (bx, by) in zip(vertices, (*vertices[1:], vertices[0])))
    return f"fence(ax, ay, ex, ey) AS (VALUES {rows})"


def sql_classes(source: str) -> str:
    """id and cls of the points of a view with id, x, y against the view fence."""
    crossing = "((ay > y) <> (ey > y) AND x < (ex - ax) * (y - ay) / (CASE WHEN ay <> ey THEN ey - ay END) + ax)"
    return f"SELECT id, CASE WHEN bool_or({sql_on('x,y', 'ax,ay', 'ex,ey')}) THEN 0 WHEN sum(CASE WHEN {crossing} THEN 1 ELSE 0 END) % 2 = 1 THEN 1 ELSE -1 END AS cls FROM {source}, fence GROUP BY id"


def sql_dbscan(source: str, eps: float, min_pts: int, key: str = "'e'") -> str:
    """Views pairs, core, reach, comps, labels (scene, id, label, kind) of a view with id, x, y."""
    return f"""
dbp AS (SELECT {key} AS scene, id, x, y FROM {source}),
pairs AS (SELECT a.scene, a.id AS a, b.id AS b FROM dbp a JOIN dbp b ON a.scene = b.scene AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= {eps}::DOUBLE*{eps}::DOUBLE),
core AS (SELECT scene, a AS id FROM pairs GROUP BY 1, 2 HAVING count(*) >= {min_pts}),
links AS (SELECT p.scene, p.a, p.b FROM pairs p JOIN core s ON p.scene = s.scene AND p.a = s.id JOIN core t ON p.scene = t.scene AND p.b = t.id),
comps AS (SELECT scene, a AS id, min(b) AS comp FROM (WITH RECURSIVE reach(scene, a, b) AS (SELECT scene, id, id FROM core UNION SELECT r.scene, r.a, l.b FROM reach r JOIN links l ON r.scene = l.scene AND r.b = l.a) SELECT * FROM reach) GROUP BY 1, 2),
numbered AS (SELECT scene, id, dense_rank() OVER (PARTITION BY scene ORDER BY comp) - 1 AS label FROM comps),
edge AS (SELECT p.scene, p.a AS id, min(n.label) AS label FROM pairs p JOIN numbered n ON p.scene = n.scene AND p.b = n.id WHERE NOT EXISTS (FROM core c WHERE c.scene = p.scene AND c.id = p.a) GROUP BY 1, 2),
labels AS (SELECT scene, dbp.id, coalesce(numbered.label, edge.label, -1)::INTEGER AS label, CASE WHEN numbered.id IS NOT NULL THEN 2 WHEN edge.id IS NOT NULL THEN 1 ELSE 0 END AS kind
  FROM dbp LEFT JOIN numbered USING (scene, id) LEFT JOIN edge USING (scene, id))"""


def sql_selected(s: Settings) -> str:
    return f"sel AS (SELECT * FROM ev WHERE timestamp >= {s.start} AND timestamp < {s.end})"


def sql_rates(s: Settings) -> str:
    return f"rates AS (SELECT device_id, sum(requests)::BIGINT AS requests, sum(failures)::BIGINT AS failures, count(*) AS n_events, sum(requests)::DOUBLE / {s.minutes}::DOUBLE / {s.request_scale}::DOUBLE AS x, sum(failures)::DOUBLE / {s.minutes}::DOUBLE / {s.failure_scale}::DOUBLE AS y FROM sel GROUP BY device_id)"


def sql_metres() -> str:
    import math

    return f"({K.EARTH}::DOUBLE * (longitude - 85.8245::DOUBLE) * {math.pi / 180!r}::DOUBLE * {math.cos(20.2961 * math.pi / 180)!r}::DOUBLE) AS x, ({K.EARTH}::DOUBLE * (latitude - 20.2961::DOUBLE) * {math.pi / 180!r}::DOUBLE) AS y"


def sql_candidates(s: Settings) -> str:
    """Views up to cand (idx, event_id, label, candidate, feature_noise, outside)."""
    return f"""WITH RECURSIVE {EVENTS}, {sql_selected(s)}, {sql_rates(s)}, rp AS (SELECT device_id AS id, x, y FROM rates), {sql_dbscan('rp', s.feature_radius, s.min_pts)}, {sql_fence(CAMPUS_FENCE)},
placed AS (SELECT idx AS id, {sql_metres()} FROM sel), cls AS ({sql_classes('placed')}),
cand AS (SELECT sel.idx, event_id, sel.label, labels.label = -1 AS feature_noise, cls = -1 AS outside, (labels.label = -1 OR cls = -1) AS candidate FROM sel JOIN labels ON labels.id = device_id JOIN cls ON cls.id = sel.idx)"""


# ---- selection, views, aggregation


@query(f"WITH {EVENTS} SELECT idx, event_id, timestamp, user_id, device_id, {micro('latitude')} AS lat, {micro('longitude')} AS lon, requests, failures, label FROM ev")
def scan_events(spark, sf):
    return events(spark, sf).select("idx", "event_id", "timestamp", "user_id", "device_id", K.micro(F.col("latitude")).alias("lat"), K.micro(F.col("longitude")).alias("lon"), "requests", "failures", "label")


@query(f"WITH {EVENTS}, {sql_selected(WEEK)} SELECT idx, timestamp FROM sel")
def select_window(spark, sf):
    return review.select_events(events(spark, sf), WEEK).select("idx", "timestamp")


@query(f"WITH {EVENTS}, {sql_selected(MONTH)} SELECT idx, user_id, requests FROM sel WHERE user_id = 'user-7' AND device_id = 'device-7'")
def select_identity(spark, sf):
    return review.select_events(events(spark, sf), MONTH.but(user="user-7", device="device-7")).select("idx", "user_id", "requests")


@query(f"WITH {EVENTS}, {sql_selected(MONTH)} SELECT name, {micro('x')} AS x, {micro('y')} AS y FROM (SELECT event_id AS name, {sql_metres()} FROM sel)")
def project_geo(spark, sf):
    return review.geo_view(events(spark, sf), MONTH).select("name", K.micro(F.col("x")).alias("x"), K.micro(F.col("y")).alias("y"))


@query(f"WITH {EVENTS}, {sql_selected(MONTH)} SELECT event_id AS name, {micro('latitude')} AS lat, {micro('longitude')} AS lon FROM sel")
def unproject_geo(spark, sf):
    lat, lon = K.unproject(K.point(""), MONTH.lat0, MONTH.lon0)
    return review.geo_view(events(spark, sf), MONTH).select("name", K.micro(lat).alias("lat"), K.micro(lon).alias("lon"))


@query(f"WITH {EVENTS}, {sql_selected(MONTH)}, {sql_rates(MONTH)} SELECT device_id, requests, failures, n_events, {micro('x')} AS x, {micro('y')} AS y FROM rates")
def device_rates(spark, sf):
    return review.device_rates(events(spark, sf), MONTH).select("device_id", "requests", "failures", "n_events", K.micro(F.col("x")).alias("x"), K.micro(F.col("y")).alias("y"))


@query(f"WITH {EVENTS}, {sql_selected(MONTH)} SELECT device_id AS name, count(*) AS n, min(idx) AS first, max(idx) AS last, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS events FROM sel GROUP BY device_id")
def feature_view(spark, sf):
    e = F.col("events")
    return review.feature_view(events(spark, sf), MONTH).select("name", F.size(e).cast("long").alias("n"), F.element_at(e, 1).alias("first"), F.element_at(e, -1).alias("last"), F.array_join(e.cast("array<string>"), ",").alias("events"))


@query(f"""WITH {EVENTS} SELECT sum((length(event_id) = 0)::INT)::BIGINT AS bad_names, sum((length(summary) > 512)::INT)::BIGINT AS bad_summary, sum((timestamp < 0)::INT)::BIGINT AS bad_time,
sum((abs(latitude) > 90 OR abs(longitude) > 180)::INT)::BIGINT AS bad_place, sum((failures < 0 OR failures > requests OR requests > 1000000000)::INT)::BIGINT AS bad_counts, sum((label NOT IN ('benign', 'suspicious', 'unknown'))::INT)::BIGINT AS bad_label,
(SELECT count(*) FROM (SELECT event_id FROM ev GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids FROM ev""")
def event_validation_counts(spark, sf):
    return record_violations(events(spark, sf))


@query(f"WITH {EVENTS} SELECT time_bucket(INTERVAL 10 MINUTE, make_timestamp(timestamp * 1000000))::VARCHAR AS start, device_id, sum(requests)::BIGINT AS requests, sum(failures)::BIGINT AS failures FROM ev GROUP BY 1, 2")
def windowed_device_rates(spark, sf):
    return windowed_rates(events(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# ---- geometry


@query(f"WITH {EMBED}, {sql_fence(CONCAVE)} {sql_classes('embed')}")
def geofence_points(spark, sf):
    return hull.point_in_polygon(pts_embed(spark, sf), polygon(spark, CONCAVE)).drop("scene")


@query(f"WITH {EMBED}, {sql_fence(CONCAVE)} SELECT cls, count(*) AS n FROM ({sql_classes('embed')}) GROUP BY cls")
def fence_counts(spark, sf):
    return hull.point_in_polygon(pts_embed(spark, sf), polygon(spark, CONCAVE)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS}, {sql_selected(MONTH)}, {sql_fence(CAMPUS_FENCE)}, placed AS (SELECT idx AS id, {sql_metres()} FROM sel) SELECT id AS idx, cls = -1 AS outside FROM ({sql_classes('placed')})")
def outside_fence(spark, sf):
    return review.outside_fence(events(spark, sf), MONTH, polygon(spark, CAMPUS_FENCE))


@query("SELECT * FROM (VALUES ('bowtie', 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT, 1::BIGINT), ('campus', 0, 0, 0, 0, 0), ('concave', 0, 0, 0, 0, 0), ('fold', 0, 0, 2, 0, 1), ('twice', 1, 2, 0, 0, 1)) t(scene, few, repeated, folded, crossing, flat)")
def polygon_validity(spark, sf):
    shapes = {"bowtie": BOWTIE, "campus": CAMPUS_FENCE, "concave": CONCAVE, "fold": ((0.0, 0.0), (4.0, 0.0), (2.0, 0.0)), "twice": ((1.0, 1.0), (1.0, 1.0))}
    frames = [polygon(spark, v, k) for k, v in shapes.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return hull.polygon_violations(out)


@query(f"""WITH {PART}, v AS (SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY id) - 1 AS seq, x, y, count(*) OVER (PARTITION BY scene) AS n FROM part_),
e AS (SELECT a.scene, a.seq, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, a.n FROM v a JOIN v b ON a.scene = b.scene AND b.seq = (a.seq + 1) % a.n),
crossed AS (SELECT e.scene, count(*) AS crossing FROM e JOIN e f ON e.scene = f.scene AND f.seq - e.seq > 1 AND NOT (e.seq = 0 AND f.seq = e.n - 1) WHERE {sql_meet('e.ax,e.ay', 'e.bx,e.by', 'f.ax,f.ay', 'f.bx,f.by')} GROUP BY 1),
turned AS (SELECT e.scene, sum(({sql_turn('e.ax,e.ay', 'e.bx,e.by', 'f.bx,f.by')} = 0 AND (e.bx-e.ax)*(f.bx-f.ax)+(e.by-e.ay)*(f.by-f.ay) < 0)::INT)::BIGINT AS folded FROM e JOIN e f ON e.scene = f.scene AND f.seq = (e.seq + 1) % e.n GROUP BY 1),
sums AS (SELECT e.scene, (count(*) < 3)::BIGINT AS few, sum(((e.bx-e.ax)*(e.bx-e.ax)+(e.by-e.ay)*(e.by-e.ay) < 1e-18)::INT)::BIGINT AS repeated, (abs(sum((e.ax-o.ax)*(e.by-o.ay)-(e.bx-o.ax)*(e.ay-o.ay))) < 1e-9)::BIGINT AS flat FROM e JOIN e o ON e.scene = o.scene AND o.seq = 0 GROUP BY 1)
SELECT scene, few, repeated, coalesce(folded, 0) AS folded, coalesce(crossing, 0) AS crossing, flat FROM sums LEFT JOIN turned USING (scene) LEFT JOIN crossed USING (scene)""")
def brand_polygons(spark, sf):
    """Each brand's parts, in the order of their ids, as a polygon."""
    ranks = graph.ranked(pts_brand(spark, sf), "id")
    return hull.polygon_violations(ranks.select("scene", F.col("rank").cast("int").alias("seq"), "x", "y"))


@query(f"WITH {PART}, t AS (SELECT a.id, {sql_turn('a.x,a.y', 'b.x,b.y', 'c.x,c.y')} AS turn FROM part_ a JOIN part_ b ON b.id = a.id + 1 JOIN part_ c ON c.id = a.id + 2) SELECT id, turn FROM t")
def orientation_steps(spark, sf):
    p = pts_part(spark, sf)
    a, b, c = (p.select((F.col("id") - k).alias("id"), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for k, n in enumerate("abc"))
    return a.join(b, "id").join(c, "id").select("id", K.orientation(K.point("a"), K.point("b"), K.point("c")).alias("turn"))


@query(f"WITH {PART} SELECT scene, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM part_ GROUP BY scene")
def bounding_boxes(spark, sf):
    return spatial.bounding_boxes(pts_brand(spark, sf))


@query(f"WITH {PART}, t AS (SELECT id, x, y, least(greatest(((x - 0)*(50 - 0) + (y - 900::DOUBLE)*(1500 - 900::DOUBLE)) / (50*50 + 600*600)::DOUBLE, 0), 1) AS t FROM part_) SELECT id, {micro('sqrt((x-t*50)*(x-t*50)+(y-(900+t*600))*(y-(900+t*600)))')} AS d FROM t")
def point_segment_distance(spark, sf):
    at = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    return pts_part(spark, sf).select("id", K.micro(K.point_segment_distance(K.point(""), at(0, 900), at(50, 1500))).alias("d"))


_HULL = f"""WITH {PART}, q AS (SELECT scene, x, y, min(id) AS id FROM part_ GROUP BY 1, 2, 3),
e AS (SELECT a.scene, a.id AS a, b.id AS b FROM q a JOIN q b ON a.scene = b.scene AND a.id <> b.id JOIN q c ON c.scene = a.scene
  GROUP BY 1, 2, 3 HAVING bool_and({sql_turn('a.x,a.y', 'b.x,b.y', 'c.x,c.y')} > 0 OR ({sql_turn('a.x,a.y', 'b.x,b.y', 'c.x,c.y')} = 0 AND {sql_on('c.x,c.y', 'a.x,a.y', 'b.x,b.y')})))
SELECT scene, id, count(*) OVER (PARTITION BY scene) AS n FROM (SELECT DISTINCT scene, a AS id FROM e)"""


@query(_HULL)
def hull_vertices(spark, sf):
    found = hull.convex_hull(pts_brand(spark, sf))
    n = found.groupBy("scene").agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, "scene").select("scene", "id", "n")


@query(f"WITH {SEGS} SELECT s.seg AS i, t.seg AS j FROM segs s JOIN segs t ON s.seg < t.seg WHERE {sql_meet('s.ax,s.ay', 's.bx,s.by', 't.ax,t.ay', 't.bx,t.by')}")
def segment_collisions(spark, sf):
    return spatial.segment_collisions(segments(spark, sf)).select("i", "j")


@query(f"WITH {SEGS}, m AS (SELECT s.seg AS i, t.seg AS j FROM segs s JOIN segs t ON s.seg < t.seg WHERE {sql_meet('s.ax,s.ay', 's.bx,s.by', 't.ax,t.ay', 't.bx,t.by')}) SELECT seg, count(*) AS n FROM (SELECT i AS seg FROM m UNION ALL SELECT j FROM m) GROUP BY seg")
def colliding_segments(spark, sf):
    return spatial.collision_counts(segments(spark, sf)).select("seg", "n")


# ---- neighbours

_D2 = "(p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)"
_NEAREST = f"WITH {EMBED}, {PROBES}, r AS (SELECT q.id AS query, p.id, {_D2} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {_D2}, p.id) AS k FROM probes q, embed p) SELECT query, id, {micro('sqrt(d2)')} AS d FROM r WHERE k = 1"


@query(_NEAREST)
def kd_nearest(spark, sf):
    return spatial.nearest(pts_embed(spark, sf), probes(spark, sf)).select("query", "id", K.micro(F.col("distance")).alias("d"))


@query(f"WITH {EMBED}, {PROBES} SELECT q.id AS query, coalesce(string_agg(p.id::VARCHAR, ',' ORDER BY p.id), '') AS ids, count(p.id) AS n FROM probes q LEFT JOIN embed p ON {_D2} <= 30::DOUBLE*30::DOUBLE GROUP BY q.id")
def kd_radius(spark, sf):
    return spatial.within_radius(pts_embed(spark, sf), probes(spark, sf), 30.0).select("query", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n")


@query(f"WITH {PART} SELECT q.id, count(*) AS n FROM part_ q JOIN part_ p ON p.x BETWEEN q.x - 3 AND q.x + 3 AND {_D2} <= 2.5::DOUBLE*2.5::DOUBLE GROUP BY q.id")
def radius_counts(spark, sf):
    return spatial.radius_counts(pts_part(spark, sf), 2.5).select("id", "n")


@query(f"WITH {EMBED} SELECT q.id AS a, p.id AS b, {micro(_D2)} AS d2 FROM embed q JOIN embed p ON q.id < p.id AND {_D2} <= 20::DOUBLE*20::DOUBLE")
def epsilon_pairs(spark, sf):
    p = pts_embed(spark, sf)
    return spatial.epsilon_join(p, p, EPS).filter("a < b").select("a", "b", K.micro(F.col("d2")).alias("d2"))


@query(f"WITH {EMBED} SELECT i, j, {micro('sqrt(d2)')} AS d FROM (SELECT q.id AS i, p.id AS j, {_D2} AS d2 FROM embed q JOIN embed p ON q.id < p.id) ORDER BY d2, i, j LIMIT 1")
def closest_pair(spark, sf):
    return spatial.closest_pair(pts_embed(spark, sf)).select("i", "j", K.micro(F.col("distance")).alias("d"))


@query(f"WITH {PART}, r AS (SELECT q.scene, q.id AS i, p.id AS j, {_D2} AS d2 FROM part_ q JOIN part_ p ON q.scene = p.scene AND q.id < p.id), k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY d2, i, j) AS n FROM r) SELECT scene, i, j, {micro('sqrt(d2)')} AS d FROM k WHERE n = 1")
def closest_pair_by_scene(spark, sf):
    return spatial.closest_pair(pts_brand(spark, sf)).select("scene", "i", "j", K.micro(F.col("distance")).alias("d"))


# ---- clusters

_LABELS = f"WITH RECURSIVE {EMBED}, {sql_dbscan('embed', EPS, MIN_PTS)}"


@query(f"{_LABELS} SELECT id, label, kind FROM labels")
def dbscan_indexed(spark, sf):
    return graph.dbscan(pts_embed(spark, sf), EPS, MIN_PTS).drop("scene")


@query(f"{_LABELS} SELECT id, label, kind FROM labels")
def dbscan_scan(spark, sf):
    return graph.dbscan(pts_embed(spark, sf), EPS, MIN_PTS, "scan").drop("scene")


@query(f"{_LABELS} SELECT max(label) + 1 AS clusters, count(*) FILTER (label = -1) AS noise, count(*) FILTER (kind = 2) AS core, count(*) FILTER (kind = 1) AS border FROM labels")
def dbscan_summary(spark, sf):
    is_ = lambda c, v: F.sum((F.col(c) == v).cast("long"))
    return graph.dbscan(pts_embed(spark, sf), EPS, MIN_PTS).agg((F.max("label") + 1).alias("clusters"), is_("label", -1).alias("noise"), is_("kind", 2).alias("core"), is_("kind", 1).alias("border"))


@query(f"WITH RECURSIVE {PART}, {sql_dbscan('part_', 8.0, 3, 'scene')} SELECT scene, id, label, kind FROM labels")
def dbscan_by_scene(spark, sf):
    return graph.dbscan(pts_brand(spark, sf), 8.0, 3)


@query("SELECT count(*) AS n_rows, 0::BIGINT AS n_different, true AS agree FROM embeddings WHERE embedding IS NOT NULL")
def compare_dbscan(spark, sf):
    p = pts_embed(spark, sf)
    return engine.compare(engine.run("dbscan", p, EPS, MIN_PTS), engine.run("indexed_dbscan", p, EPS, MIN_PTS), ["scene", "id"])


@query(f"WITH {EMBED}, {sql_fence(CONCAVE)} SELECT count(*) AS n_rows, 0::BIGINT AS n_different, true AS agree FROM embed")
def verify_geofence(spark, sf):
    p, f = pts_embed(spark, sf), polygon(spark, CONCAVE)
    return engine.compare(engine.run("geofence", p, f), engine.winding(p, f), ["scene", "id"])


# ---- routes


@query(f"WITH RECURSIVE {ROADS}, {COSTS} SELECT v AS id, cost::BIGINT AS cost FROM costs")
def shortest_costs_all(spark, sf):
    return graph.shortest_costs(road_edges(spark, sf), start(spark)).select("id", F.col("cost").cast("long").alias("cost"))


def _params(spark, sf):
    return spark.createDataFrame([("g", 0, n_vertices(spark, sf) - 1, False)], "scene string, source long, goal long, grid boolean")


_GOAL = "(SELECT max(c_custkey) FROM customer)"


@query(f"WITH RECURSIVE {ROADS}, {COSTS} SELECT cost::BIGINT AS cost, 0::BIGINT AS starts_at, v::BIGINT AS ends_at, true AS sums_up FROM costs WHERE v = {_GOAL}")
def shortest_path(spark, sf):
    edges = road_edges(spark, sf)
    route = graph.routes(road_points(spark, sf), edges, _params(spark, sf))
    steps = route.select("scene", "cost", F.posexplode("path").alias("at", "u"), "path").withColumn("v", F.get("path", F.col("at") + 1))
    along = steps.join(graph.directed(edges).groupBy("scene", "u", "v").agg(F.min("weight").alias("weight")), ["scene", "u", "v"]).agg(F.sum("weight").alias("along"))
    return route.join(along).select(F.col("cost").cast("long").alias("cost"), F.element_at("path", 1).alias("starts_at"), F.element_at("path", -1).alias("ends_at"), (F.col("along") == F.col("cost")).alias("sums_up"))


@query(f"WITH RECURSIVE {ROADS}, {COSTS} SELECT cost::BIGINT AS cost FROM costs WHERE v = {_GOAL}")
def astar(spark, sf):
    return graph.routes(road_points(spark, sf), road_edges(spark, sf), _params(spark, sf), "astar").select(F.col("cost").cast("long").alias("cost"))


@query(f"WITH RECURSIVE {ROADS}, {COSTS} SELECT cost::BIGINT AS cost, 0::BIGINT AS starts_at, v::BIGINT AS ends_at, true AS sums_up FROM costs WHERE v = {_GOAL}")
def shortest_path_rows(spark, sf):
    """The path of a graph of any size, a row a vertex; its steps are edges that sum up to its cost."""
    edges = road_edges(spark, sf)
    rows = graph.shortest_paths(edges, _params(spark, sf))
    after = rows.select("scene", (F.col("step") - 1).alias("step"), F.col("id").alias("v"), F.col("cost").alias("next"))
    steps = rows.select("scene", "step", F.col("id").alias("u")).join(after, ["scene", "step"])
    along = steps.join(graph.directed(edges).groupBy("scene", "u", "v").agg(F.min("weight").alias("weight")), ["scene", "u", "v"]).agg(F.sum("weight").alias("along"))
    ends = rows.groupBy("scene").agg(F.max("cost").alias("cost"), F.min_by("id", "step").alias("starts_at"), F.max_by("id", "step").alias("ends_at"))
    return ends.join(along).select(F.col("cost").cast("long").alias("cost"), "starts_at", "ends_at", (F.col("along") == F.col("cost")).alias("sums_up"))


@query(f"""WITH {ROADS}, p AS (SELECT v, (v % 20)::DOUBLE AS x, (v // 20)::DOUBLE AS y FROM range((SELECT max(c_custkey) + 1 FROM customer)) t(v)), g AS (SELECT x, y FROM p WHERE v = {_GOAL}),
h AS (SELECT weight, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS ab, sqrt((a.x-g.x)*(a.x-g.x)+(a.y-g.y)*(a.y-g.y)) AS ag, sqrt((b.x-g.x)*(b.x-g.x)+(b.y-g.y)*(b.y-g.y)) AS bg FROM roads JOIN p a ON a.v = roads.a JOIN p b ON b.v = roads.b, g WHERE NOT blocked)
SELECT 'g' AS scene, bool_and(weight >= ab AND ag <= weight + bg AND bg <= weight + ag) AS fits FROM h""")
def heuristic_fits(spark, sf):
    last = n_vertices(spark, sf) - 1
    goal = spark.createDataFrame([("g", float(last % 20), float(last // 20))], "scene string, gx double, gy double")
    return graph.heuristic_fits(road_points(spark, sf), road_edges(spark, sf), goal)


@query("SELECT 0::BIGINT AS broken, 0::BIGINT AS unexplained")
def verify_costs(spark, sf):
    edges, source = road_edges(spark, sf), start(spark)
    return engine.verify_costs(edges, source, graph.shortest_costs(edges, source))


# ---- review of events


@query(f"{sql_candidates(MONTH)} SELECT event_id, feature_noise, outside, candidate FROM cand")
def review_candidates(spark, sf):
    return review.candidates(events(spark, sf), MONTH, polygon(spark, CAMPUS_FENCE)).select("event_id", "feature_noise", "outside", "candidate")


_COUNTS = """SELECT count(*) FILTER (label = 'suspicious' AND candidate) AS tp, count(*) FILTER (label = 'benign' AND candidate) AS fp, count(*) FILTER (label = 'benign' AND NOT candidate) AS tn,
count(*) FILTER (label = 'suspicious' AND NOT candidate) AS fn, count(*) FILTER (label = 'unknown') AS unknown, count(*) FILTER (candidate) AS flagged"""


@query(f"{sql_candidates(MONTH)} {_COUNTS} FROM cand")
def candidate_confusion(spark, sf):
    return review.evaluate(events(spark, sf), MONTH, polygon(spark, CAMPUS_FENCE)).select("tp", "fp", "tn", "fn", "unknown", "flagged")


@query(f"{sql_candidates(MONTH)}, c AS ({_COUNTS} FROM cand) SELECT {micro('tp / nullif(tp + fp, 0)::DOUBLE')} AS precision, {micro('tp / nullif(tp + fn, 0)::DOUBLE')} AS recall, {micro('fp / nullif(fp + tn, 0)::DOUBLE')} AS false_positive_rate FROM c")
def candidate_ratios(spark, sf):
    found = review.evaluate(events(spark, sf), MONTH, polygon(spark, CAMPUS_FENCE))
    return found.select(*(K.micro(F.col(c)).alias(c) for c in ("precision", "recall", "false_positive_rate")))


@query(f"{sql_candidates(MONTH)} SELECT count(*) FILTER (candidate AND idx % 5 = 0) AS reviewed, count(*) FILTER (candidate AND idx % 10 = 0) AS reviewed_benign FROM cand")
def review_join(spark, sf):
    e = events(spark, sf)
    told = review.set_reviews(review.no_reviews(spark), e.filter("idx % 5 = 0"), "suspicious", at=1)
    told = review.set_reviews(told, e.filter("idx % 10 = 0"), "benign", "seen", at=2)
    return review.evaluate(e, MONTH, polygon(spark, CAMPUS_FENCE), told).select("reviewed", "reviewed_benign")


def _sweep_sql() -> str:
    parts = []
    for k, (factor, delta) in enumerate([(f, d) for f in (0.75, 1.0, 1.25) for d in (-1, 0, 1)]):
        s = MONTH.but(feature_radius=MONTH.feature_radius * factor, min_pts=MONTH.min_pts + delta)
        parts.append((k, f"'radius' AS kind, {factor}::DOUBLE AS factor, {s.min_pts} AS min_pts", s))
    for k, factor in enumerate((0.75, 1.25), 9):
        parts.append((k, f"'scale' AS kind, {factor}::DOUBLE AS factor, {MONTH.min_pts} AS min_pts", MONTH.but(request_scale=MONTH.request_scale * factor, failure_scale=MONTH.failure_scale * factor)))
    views, rows = [], []
    core = "EXISTS (SELECT 1 FROM n{k} c WHERE c.n >= {m} AND (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y) <= {r!r}::DOUBLE*{r!r}::DOUBLE)"
    for k, head, s in [(99, "", MONTH), *parts]:
        views.append(f"r{k} AS (SELECT device_id, sum(requests)::DOUBLE / {s.minutes}::DOUBLE / {s.request_scale}::DOUBLE AS x, sum(failures)::DOUBLE / {s.minutes}::DOUBLE / {s.failure_scale}::DOUBLE AS y FROM sel GROUP BY 1)")
        views.append(f"n{k} AS (SELECT a.device_id, a.x, a.y, count(*) AS n FROM r{k} a JOIN r{k} b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= {s.feature_radius!r}::DOUBLE*{s.feature_radius!r}::DOUBLE GROUP BY 1, 2, 3)")
        views.append(f"z{k} AS (SELECT device_id, NOT {core.format(k=k, m=s.min_pts, r=s.feature_radius)} AS noise FROM n{k} p)")
        if head:
            changed = f"count(*) FILTER (z{k}.noise <> z99.noise)" if "radius" in head else "NULL::BIGINT"
            rows.append(f"SELECT {head}, count(*) FILTER (z{k}.noise) AS noise, {changed} AS changed FROM z{k} JOIN z99 USING (device_id)")
    return f"WITH {EVENTS}, {sql_selected(MONTH)}, {', '.join(views)} {' UNION ALL '.join(rows)}"


@query(_sweep_sql())
def sensitivity_sweep(spark, sf):
    return review.sensitivity(events(spark, sf), MONTH).drop("radius")


def sql_place_labels(name: str, source: str, eps: float, min_pts: int) -> str:
    """View {name} (id, label) of a view with id, x, y, by its distinct places."""
    n = name
    return f"""{n}_p AS (SELECT x, y, min(id) AS id, count(*) AS w FROM {source} GROUP BY 1, 2),
{n}_n AS (SELECT a.id AS a, b.id AS b, b.w FROM {n}_p a JOIN {n}_p b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= {eps}::DOUBLE*{eps}::DOUBLE),
{n}_c AS (SELECT a AS id FROM {n}_n GROUP BY 1 HAVING sum(w) >= {min_pts}),
{n}_l AS (SELECT a, b FROM {n}_n WHERE a IN (FROM {n}_c) AND b IN (FROM {n}_c)),
{n}_k AS (SELECT a AS id, min(b) AS comp FROM (WITH RECURSIVE r(a, b) AS (SELECT id, id FROM {n}_c UNION SELECT r.a, l.b FROM r JOIN {n}_l l ON r.b = l.a) SELECT * FROM r) GROUP BY 1),
{n}_r AS (SELECT id, dense_rank() OVER (ORDER BY comp) - 1 AS label FROM {n}_k),
{n}_b AS (SELECT a AS id, min(label) AS label FROM {n}_n JOIN {n}_r ON b = {n}_r.id WHERE a NOT IN (FROM {n}_c) GROUP BY 1),
{n}_z AS (SELECT p.x, p.y, coalesce(r.label, b.label, -1)::INTEGER AS label FROM {n}_p p LEFT JOIN {n}_r r USING (id) LEFT JOIN {n}_b b USING (id)),
{n} AS (SELECT s.id, z.label FROM {source} s JOIN {n}_z z ON s.x = z.x AND s.y = z.y)"""


@query(f"""{sql_candidates(MONTH)},
gp AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS id, idx, event_id AS name, {sql_metres()} FROM sel), {sql_place_labels('gl', 'gp', MONTH.geo_radius, MONTH.min_pts)},
fp AS (SELECT row_number() OVER (ORDER BY device_id) - 1 AS id, device_id AS name, x, y FROM rates), {sql_place_labels('fl', 'fp', MONTH.feature_radius, MONTH.min_pts)},
told AS (SELECT 'geo' AS view, gp.id, name, x, y, gl.label AS cluster, idx FROM gp JOIN gl USING (id) UNION ALL SELECT 'feature', fp.id, name, x, y, fl.label, idx FROM fp JOIN fl USING (id) JOIN sel ON device_id = name)
SELECT view, id, name, {micro('x')} AS x, {micro('y')} AS y, cluster, cluster = -1 AS noise, idx, event_id, label AS truth, candidate, feature_noise, outside AS outside_region FROM told JOIN cand USING (idx)""")
def evidence_rows(spark, sf):
    found = review.evidence_rows(events(spark, sf), MONTH, polygon(spark, CAMPUS_FENCE))
    return found.select("view", "id", "name", K.micro(F.col("x")).alias("x"), K.micro(F.col("y")).alias("y"), "cluster", "noise", "idx", "event_id", "truth", "candidate", "feature_noise", "outside_region")


@query(f"""{sql_candidates(MONTH)}, fp AS (SELECT row_number() OVER (ORDER BY device_id) - 1 AS id, device_id AS name, x, y FROM rates), {sql_place_labels('fl', 'fp', MONTH.feature_radius, MONTH.min_pts)},
dev AS (SELECT device_id AS name, count(*) AS n_sources, count(*) FILTER (candidate) AS n_candidates, max(outside::INT) = 1 AS outside FROM cand JOIN sel USING (idx) GROUP BY 1)
SELECT id, name, n_sources, n_candidates, outside, fl.label AS cluster, fl.label = -1 AS noise FROM dev JOIN fp USING (name) JOIN fl USING (id)""")
def evidence_observations(spark, sf):
    found = review.evidence(events(spark, sf), MONTH, polygon(spark, CAMPUS_FENCE)).filter("view = 'feature'")
    return found.select("id", "name", F.size("sources").cast("long").alias("n_sources"), F.size(F.filter("sources", lambda s: s["candidate"])).cast("long").alias("n_candidates"), "outside", "cluster", "noise")


# ---- modes with their checks


def brand_frames(spark: SparkSession, sf: str) -> engine.Frames:
    points = pts_brand(spark, sf)
    params = points.groupBy("scene").agg(F.avg("x").alias("query_x"), F.lit(1200.0).alias("query_y")).select("scene", F.floor("query_x").alias("query_x"), "query_y", F.lit(8.0).alias("radius"), F.lit(3).alias("min_pts"), F.lit(0).cast("long").alias("source"), F.lit(0).cast("long").alias("goal"), F.lit(False).alias("grid"))
    ids = points.withColumn("scene_", F.col("scene"))
    ranked = cut(graph.ranked(ids.drop("scene_"), "id").select("scene", F.col("rank").alias("id"), "x", "y"))
    empty = lambda schema: spark.createDataFrame([], schema)
    return engine.Frames(ranked, empty(POLYGON), empty(EDGES), params.withColumn("query_x", F.col("query_x").cast("double")))


_BRAND_RANKS = f"{PART}, br AS (SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY id) - 1 AS id, x, y FROM part_), bq AS (SELECT scene, floor(avg(x)) AS qx, 1200::DOUBLE AS qy FROM part_ GROUP BY 1)"


@query(_HULL.rsplit("SELECT scene, id, count", 1)[0] + "SELECT scene, n::DOUBLE AS value, true AS ok, 'Hull has ' || n || CASE n WHEN 1 THEN ' vertex.' ELSE ' vertices.' END AS summary FROM (SELECT scene, count(DISTINCT a) AS n FROM e GROUP BY 1)")
def checked_hulls(spark, sf):
    return engine.execute("hull", brand_frames(spark, sf)).answers.select("scene", "value", "ok", "summary")


@query(f"""WITH {_BRAND_RANKS}, r AS (SELECT q.scene, q.id AS i, p.id AS j, {_D2} AS d2 FROM br q JOIN br p ON q.scene = p.scene AND q.id < p.id), k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY d2, i, j) AS n FROM r)
SELECT scene, {micro('sqrt(d2)')} AS value, i || ',' || j AS answer, true AS ok FROM k WHERE n = 1""")
def checked_closest_pairs(spark, sf):
    return engine.execute("closest_pair", brand_frames(spark, sf)).answers.select("scene", K.micro(F.col("value")).alias("value"), F.array_join(F.col("answer").cast("array<string>"), ",").alias("answer"), "ok")


@query(f"""WITH {_BRAND_RANKS}, r AS (SELECT scene, id, (x-qx)*(x-qx)+(y-qy)*(y-qy) AS d2, row_number() OVER (PARTITION BY scene ORDER BY (x-qx)*(x-qx)+(y-qy)*(y-qy), id) AS k FROM br JOIN bq USING (scene))
SELECT scene, {micro('sqrt(d2)')} AS value, id::VARCHAR AS answer, true AS ok FROM r WHERE k = 1""")
def checked_nearest(spark, sf):
    return engine.execute("nearest", brand_frames(spark, sf)).answers.select("scene", K.micro(F.col("value")).alias("value"), F.array_join(F.col("answer").cast("array<string>"), ",").alias("answer"), "ok")


@query(f"""WITH {_BRAND_RANKS}, r AS (SELECT scene, count(id) AS n, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS answer FROM bq LEFT JOIN br USING (scene) WHERE (x-qx)*(x-qx)+(y-qy)*(y-qy) <= 64 GROUP BY 1)
SELECT scene, coalesce(n, 0)::DOUBLE AS value, coalesce(answer, '') AS answer, true AS ok, coalesce(n, 0) || CASE coalesce(n, 0) WHEN 1 THEN ' point inside radius.' ELSE ' points inside radius.' END AS summary FROM bq LEFT JOIN r USING (scene)""")
def checked_radius(spark, sf):
    return engine.execute("radius", brand_frames(spark, sf)).answers.select("scene", "value", F.array_join(F.col("answer").cast("array<string>"), ",").alias("answer"), "ok", "summary")


@query(f"WITH RECURSIVE {_BRAND_RANKS}, {sql_dbscan('br', 8.0, 3, 'scene')}, s AS (SELECT scene, max(label) + 1 AS c, count(*) FILTER (label = -1) AS z FROM labels GROUP BY 1) SELECT scene, c::DOUBLE AS value, true AS ok, c || CASE c WHEN 1 THEN ' cluster; ' ELSE ' clusters; ' END || z || CASE z WHEN 1 THEN ' noise point.' ELSE ' noise points.' END AS summary FROM s")
def checked_clusters(spark, sf):
    return engine.execute("indexed_dbscan", brand_frames(spark, sf)).answers.select("scene", "value", "ok", "summary")


@query(f"WITH {EMBED}, {sql_fence(CONCAVE)} {sql_classes('embed')}")
def winding_points(spark, sf):
    return engine.winding(pts_embed(spark, sf), polygon(spark, CONCAVE)).drop("scene")


def _samples(spark: SparkSession, mode: str) -> engine.Frames:
    return engine.Frames.of(spark, {f"{v} {samples.sample_name(mode, v)}": samples.sample(mode, v) for v in range(samples.VARIANTS)})


@query("""SELECT * FROM (VALUES ('0 Reference scene', 403434::BIGINT, 9::BIGINT, 5::BIGINT, true), ('1 Campus deliveries', 982884, 24, 21, true), ('2 Warehouse aisles', 966200, 22, 16, true),
('3 Valley detour', 956556, 17, 15, true), ('4 Island bridges', 1070000, 14, 14, true), ('5 Terrace switchbacks', 861540, 17, 15, true)) t(scene, cost, settled, settled_astar, agree)""")
def sample_routes(spark, sf):
    """The published costs (in thousandths) and settled vertices of the built-in road scenes."""
    frames = _samples(spark, "dijkstra")
    a, b = engine.execute("dijkstra", frames).answers, engine.execute("astar", frames).answers
    both = a.join(b.select("scene", F.col("value").alias("other"), F.col("settled").alias("settled_astar"), F.col("ok").alias("fine")), "scene")
    return both.select("scene", F.round(F.col("value") * 1000).cast("long").alias("cost"), "settled", "settled_astar", (K.same_cost(F.col("value"), F.col("other")) & F.col("ok") & F.col("fine")).alias("agree"))


@query("""SELECT * FROM (VALUES ('0 Reference scene', 26::BIGINT, '2 clusters; 2 noise points.', true), ('1 Festival courtyards', 52, '3 clusters; 4 noise points.', true), ('2 Curved sensor swarms', 48, '2 clusters; 4 noise points.', true),
('3 Mixed-density survey', 52, '2 clusters; 22 noise points.', true), ('4 Lagoon rings', 67, '2 clusters; 3 noise points.', true), ('5 Garden islands', 76, '4 clusters; 4 noise points.', true)) t(scene, points, summary, ok)""")
def sample_clusters(spark, sf):
    """The published clusters and noise of the built-in density scenes."""
    frames = _samples(spark, "indexed_dbscan")
    n = frames.points.groupBy("scene").agg(F.count(F.lit(1)).alias("points"))
    return engine.execute("indexed_dbscan", frames).answers.join(n, "scene").select("scene", "points", "summary", "ok")
