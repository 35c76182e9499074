"""Edits of a scene as new frames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EDGES, POINTS


def remove_point(points: DataFrame, edges: DataFrame, gone: int) -> tuple[DataFrame, DataFrame]:
    """Without the point and its edges; ids above it move down by one."""
    down = lambda c: (F.col(c) - (F.col(c) > gone).cast("long")).alias(c)
    kept = edges.filter((F.col("a") != gone) & (F.col("b") != gone))
    return points.filter(F.col("id") != gone).select("scene", down("id"), "x", "y"), kept.select("scene", down("a"), down("b"), "weight", "blocked")


def move_point(points: DataFrame, moved: int, x: float, y: float) -> DataFrame:
    here = F.col("id") == moved
    return points.withColumns({"x": F.when(here, F.lit(float(x))).otherwise(F.col("x")), "y": F.when(here, F.lit(float(y))).otherwise(F.col("y"))})


def add_point(points: DataFrame, scene: str, x: float, y: float) -> DataFrame:
    last = points.filter(F.col("scene") == scene).agg(F.coalesce(F.max("id") + 1, F.lit(0)).cast("long").alias("id"))
    return points.unionByName(last.select(F.lit(scene).alias("scene"), "id", F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")))


def set_edge(edges: DataFrame, a: int, b: int, weight: float | None = None, blocked: bool | None = None) -> DataFrame:
    here = (F.least("a", "b") == min(a, b)) & (F.greatest("a", "b") == max(a, b))
    change = {"weight": weight, "blocked": blocked}
    return edges.withColumns({k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in change.items() if v is not None})


def add_edge(edges: DataFrame, scene: str, a: int, b: int, weight: float, blocked: bool = False) -> DataFrame:
    """Raises if the scene has an edge between the two already, whichever way."""
    there = edges.filter((F.col("scene") == scene) & (F.least("a", "b") == min(a, b)) & (F.greatest("a", "b") == max(a, b)))
    if a == b or not there.isEmpty():
        raise ValueError("an edge joins two vertices that have none")
    return edges.unionByName(edges.sparkSession.createDataFrame([(scene, a, b, float(weight), blocked)], EDGES))


def move_vertex(polygon: DataFrame, moved: int, x: float, y: float) -> DataFrame:
    here = F.col("seq") == moved
    return polygon.withColumns({"x": F.when(here, F.lit(float(x))).otherwise(F.col("x")), "y": F.when(here, F.lit(float(y))).otherwise(F.col("y"))})


def add_vertex(polygon: DataFrame, scene: str, x: float, y: float) -> DataFrame:
    last = polygon.filter(F.col("scene") == scene).agg(F.coalesce(F.max("seq") + 1, F.lit(0)).cast("int").alias("seq"))
    return polygon.unionByName(last.select(F.lit(scene).alias("scene"), "seq", F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")))


def set_points(frames, scene: str, places: list[tuple[float, float]]):
    """Frames with other points in one scene: its edges go, it is no grid, and its route leads from the first point to the last."""
    spark = frames.points.sparkSession
    here = F.col("scene") == scene
    new = spark.createDataFrame([(scene, i, float(x), float(y)) for i, (x, y) in enumerate(places)], POINTS)
    route = {"source": F.lit(0).cast("long"), "goal": F.lit(max(0, len(places) - 1)).cast("long"), "grid": F.lit(False)}
    params = frames.params.withColumns({k: F.when(here, v).otherwise(F.col(k)) for k, v in route.items()})
    return replace(frames, points=frames.points.filter(~here).unionByName(new), edges=frames.edges.filter(~here), params=params)
