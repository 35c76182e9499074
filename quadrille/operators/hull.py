"""Convex hulls, polygons and points in them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..session import cut
from .spatial import collision_counts


#: Parts whose hulls are merged before the last step, and scenes that a task keeps hulls of at a time.
MERGES, MAX_HELD = 64, 10_000
#: Polygons up to so many vertices in all are broadcast to the points.
BROADCAST_VERTICES = 50_000


def _turn(a, b, c) -> int:
    value = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    length = lambda p, q: ((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2) ** 0.5
    slack = K.TOLERANCE * max(1.0, length(a, b) * length(a, c))
    return 1 if value > slack else -1 if value < -slack else 0


def chain(points: list[tuple[float, float, int]]) -> list[tuple[float, float, int]]:
    """Hull of (x, y, id), counter-clockwise from the smallest; places once, points on sides left out."""
    places = []
    for p in sorted(points):
        if not places or places[-1][:2] != p[:2]:
            places.append(p)
    if len(places) < 3:
        return places
    halves = []
    for line in (places, places[::-1]):
        half: list = []
        for p in line:
            while len(half) > 1 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def convex_hull(points: DataFrame) -> DataFrame:
    """scene, seq, id: vertices counter-clockwise from the smallest (x, y, id).

    The hull of a scene is the hull of its parts' hulls: each task keeps the vertices of what it has read alone, then each of MERGES parts of a
    scene, and so the last step, one task a scene, sees few points.
    """
    schema = "scene string, x double, y double, id long"
    columns = ["scene", "x", "y", "id"]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}  # what is inside the hull of a part can't be a vertex of the whole
        for f in batches:
            for scene, g in f.groupby("scene", sort=False):
                held[scene] = chain(held.get(scene, []) + list(zip(g.x.tolist(), g.y.tolist(), g.id.tolist())))
            if len(held) > MAX_HELD:
                yield pd.DataFrame([(s, *p) for s, kept in held.items() for p in kept], columns=columns)
                held = {}
        yield pd.DataFrame([(s, *p) for s, kept in held.items() for p in kept], columns=columns)

    small = points.select(*columns).mapInPandas(part, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(g.scene.iloc[0], *p) for p in chain(list(zip(g.x.tolist(), g.y.tolist(), g.id.tolist())))], columns=columns)

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        kept = chain(list(zip(g.x.tolist(), g.y.tolist(), g.id.tolist())))
        return pd.DataFrame([(g.scene.iloc[0], i, p[2]) for i, p in enumerate(kept)], columns=["scene", "seq", "id"])

    return small.groupBy("scene", "part").applyInPandas(merge, schema).groupBy("scene").applyInPandas(finish, "scene string, seq int, id long")


def polygon_edges(polygon: DataFrame) -> DataFrame:
    """scene, seq, ax, ay, bx, by, n; the last edge leads back to the first vertex."""
    order = Window.partitionBy("scene").orderBy("seq")
    whole = Window.partitionBy("scene")
    first = F.first_value(F.struct("x", "y")).over(order)
    after = F.coalesce(F.lead(F.struct("x", "y")).over(order), first)
    edges = polygon.select("scene", (F.row_number().over(order) - 1).alias("seq"), F.col("x").alias("ax"), F.col("y").alias("ay"), after.alias("next"), F.count(F.lit(1)).over(whole).alias("n"))
    return edges.select("scene", "seq", "ax", "ay", F.col("next.x").alias("bx"), F.col("next.y").alias("by"), "n")


def polygon_violations(polygon: DataFrame) -> DataFrame:
    """scene, few, repeated, folded, crossing, flat: numbers of violations; all 0 for a simple polygon.

    Meetings of edges are counted by collision_counts; those of neighbours, which always share a vertex, are taken off."""
    e = cut(polygon_edges(polygon).filter("scene IS NOT NULL"))
    f = e.select("scene", F.col("seq").alias("t"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    a, b, c, d = (K.point(p) for p in "abcd")
    following = e.withColumn("t", F.pmod(F.col("seq") + 1, F.col("n"))).join(f, ["scene", "t"])
    beside = (F.col("n") > 2) | ((F.col("n") == 2) & (F.col("seq") == 0))  # each pair of neighbours once
    near = following.filter(beside & K.segments_meet(a, b, c, d)).groupBy("scene").agg(F.count(F.lit(1)).alias("near"))
    met = collision_counts(e.select("scene", F.col("seq").cast("long").alias("seg"), "ax", "ay", "bx", "by")).groupBy("scene").agg((F.sum("n") / 2).cast("long").alias("met"))
    crossing = met.join(near, "scene", "left").select("scene", (F.col("met") - F.coalesce("near", F.lit(0))).alias("crossing"))
    dot = (b[0] - a[0]) * (d[0] - c[0]) + (b[1] - a[1]) * (d[1] - c[1])
    folded = following.groupBy("scene").agg(F.sum(((K.orientation(a, b, d) == 0) & (dot < 0)).cast("long")).alias("folded"))
    origin = polygon.groupBy("scene").agg(F.min_by("x", "seq").alias("ox"), F.min_by("y", "seq").alias("oy"))
    area = (F.col("ax") - F.col("ox")) * (F.col("by") - F.col("oy")) - (F.col("bx") - F.col("ox")) * (F.col("ay") - F.col("oy"))
    sums = e.join(origin, "scene").groupBy("scene").agg((F.count(F.lit(1)) < 3).cast("long").alias("few"), F.sum((K.distance2(a, b) < 1e-18).cast("long")).alias("repeated"), (F.abs(F.sum(area)) < 1e-9).cast("long").alias("flat"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sums.join(folded, "scene", "left").join(crossing, "scene", "left").select("scene", "few", "repeated", zero("folded"), zero("crossing"), "flat")


def edges_of(polygon: DataFrame) -> DataFrame:
    """scene, edges (an array); as a broadcast if all polygons together have at most BROADCAST_VERTICES vertices."""
    edges = polygon_edges(polygon).groupBy("scene").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))
    return F.broadcast(edges) if polygon.limit(BROADCAST_VERTICES + 1).count() <= BROADCAST_VERTICES else edges


def point_in_polygon(points: DataFrame, polygon: DataFrame) -> DataFrame:
    """scene, id, cls: -1 outside, 0 on the boundary, 1 inside. A polygon's edges travel as one array to each point of its scene."""
    edges = edges_of(polygon)
    p = K.point("")
    ends = lambda e: ((e["ax"], e["ay"]), (e["bx"], e["by"]))
    on = F.exists("edges", lambda e: K.on_segment(p, *ends(e)))
    odd = F.size(F.filter("edges", lambda e: K.ray_crosses(p, *ends(e)))) % 2 == 1
    return points.join(edges, "scene").select("scene", "id", F.when(on, 0).when(odd, 1).otherwise(-1).alias("cls"))
