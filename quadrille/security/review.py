"""From events to review candidates: selection, views, candidate rule, evaluation, sensitivity, reviews, evidence."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..operators.graph import dbscan, noise, ranked
from ..operators.hull import point_in_polygon
from ..schema import REVIEWS, VERDICTS
from ..session import cut
from .settings import Settings


def select_events(events: DataFrame, s: Settings) -> DataFrame:
    """Half-open window and identity filters; * stands for all."""
    keep: Column = (F.col("timestamp") >= s.start) & (F.col("timestamp") < s.end)
    for column, wanted in (("user_id", s.user), ("device_id", s.device)):
        if wanted != "*":
            keep = keep & (F.col(column) == wanted)
    return events.filter(keep)


def geo_view(events: DataFrame, s: Settings) -> DataFrame:
    """name, x, y, events, request_rate, failure_rate: one row a selected event, in metres around the origin."""
    x, y = K.project(F.col("latitude"), F.col("longitude"), s.lat0, s.lon0)
    return select_events(events, s).select(F.col("event_id").alias("name"), x.alias("x"), y.alias("y"), F.array("idx").alias("events"), F.lit(0.0).alias("request_rate"), F.lit(0.0).alias("failure_rate"))


def device_rates(events: DataFrame, s: Settings) -> DataFrame:
    """device_id, requests, failures, rates a minute over the whole window, and scaled rates x, y."""
    sums = select_events(events, s).groupBy("device_id").agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"), F.count(F.lit(1)).alias("n_events"))
    rate = lambda c: F.col(c) / F.lit(s.minutes)
    return sums.withColumns({"request_rate": rate("requests"), "failure_rate": rate("failures")}).withColumns({"x": F.col("request_rate") / s.request_scale, "y": F.col("failure_rate") / s.failure_scale})


def feature_view(events: DataFrame, s: Settings) -> DataFrame:
    """name (the device), x, y, events (ascending), request_rate, failure_rate."""
    lists = select_events(events, s).groupBy("device_id").agg(F.array_sort(F.collect_list("idx")).alias("events"))
    return device_rates(events, s).join(lists, "device_id").select(F.col("device_id").alias("name"), "x", "y", "events", "request_rate", "failure_rate")


def feature_points(events: DataFrame, s: Settings, scene: str = "feature") -> DataFrame:
    """Devices as points. An id is a hash of the name: only whether a device is noise is asked of them, not a cluster's number."""
    return device_rates(events, s).select(F.lit(scene).alias("scene"), F.xxhash64("device_id").alias("id"), "x", "y", "device_id")


def noisy_devices(events: DataFrame, s: Settings) -> DataFrame:
    """device_id, noise: whether the device is noise among the devices of the window."""
    points = cut(feature_points(events, s))
    found = noise(points.drop("device_id"), s.feature_radius, s.min_pts)
    return points.join(found.select("id", "noise"), "id").select("device_id", "noise")


def outside_fence(events: DataFrame, s: Settings, fence: DataFrame | None) -> DataFrame:
    """idx, outside of selected events; the boundary is inside. Without a fence none is outside."""
    if fence is None:
        return select_events(events, s).select("idx", F.lit(False).alias("outside"))
    x, y = K.project(F.col("latitude"), F.col("longitude"), s.lat0, s.lon0)
    points = select_events(events, s).select(F.lit("fence").alias("scene"), F.col("idx").alias("id"), x.alias("x"), y.alias("y"))
    return point_in_polygon(points, fence.withColumn("scene", F.lit("fence"))).select(F.col("id").alias("idx"), (F.col("cls") == -1).alias("outside"))


def candidates(events: DataFrame, s: Settings, fence: DataFrame | None) -> DataFrame:
    """Selected events with feature_noise, outside, candidate: their device is noise, or they lie strictly outside the fence."""
    rows = select_events(events, s).join(noisy_devices(events, s), "device_id").join(outside_fence(events, s, fence), "idx")
    return rows.withColumnRenamed("noise", "feature_noise").withColumn("candidate", F.col("feature_noise") | F.col("outside"))


def evaluate(events: DataFrame, s: Settings, fence: DataFrame | None, reviews: DataFrame | None = None) -> DataFrame:
    """One row: tp, fp, tn, fn, unknown, flagged, reviewed, reviewed_benign and precision, recall, false_positive_rate (null without a base)."""
    rows = candidates(events, s, fence).select("event_id", "label", "candidate")
    if reviews is None:
        rows = rows.withColumn("verdict", F.lit("unreviewed"))
    else:
        rows = rows.join(reviews.select("event_id", "verdict"), "event_id", "left")
    flag, bad, known = F.col("candidate"), F.col("label") == "suspicious", F.col("label") != "unknown"
    seen = flag & (F.coalesce("verdict", F.lit("unreviewed")) != "unreviewed")
    counts = {"tp": known & flag & bad, "fp": known & flag & ~bad, "tn": known & ~flag & ~bad, "fn": known & ~flag & bad, "unknown": ~known, "flagged": flag, "reviewed": seen, "reviewed_benign": seen & (F.col("verdict") == "benign")}
    sums = rows.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in counts.items()))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return sums.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "false_positive_rate": ratio("fp", "tn")})


def sensitivity(events: DataFrame, s: Settings) -> DataFrame:
    """Eleven rows: noise and changed noise for three radii times three min_pts, and noise for two scalings of both rates.

    Devices are summed up once; each run is a scene of its own, with its own scales, radius and min_pts, and all go through one clustering."""
    runs = [("base", 1.0, s)]
    for factor in (0.75, 1.0, 1.25):
        for delta in (-1, 0, 1):
            runs.append(("radius", factor, s.but(feature_radius=min(1e7, s.feature_radius * factor), min_pts=min(256, max(1, s.min_pts + delta)))))
    for factor in (0.75, 1.25):
        runs.append(("scale", factor, s.but(request_scale=min(1e9, s.request_scale * factor), failure_scale=min(1e9, s.failure_scale * factor))))
    fields = [F.struct(F.lit(f"{k:02d}").alias("scene"), F.lit(kind).alias("kind"), F.lit(factor).alias("factor"), F.lit(r.min_pts).alias("min_pts"), F.lit(r.feature_radius).alias("radius"), F.lit(r.request_scale).alias("a"), F.lit(r.failure_scale).alias("b")) for k, (kind, factor, r) in enumerate(runs)]
    devices = device_rates(events, s).select(F.xxhash64("device_id").alias("id"), "request_rate", "failure_rate", F.explode(F.array(*fields)).alias("run"))
    points = cut(devices.select("run.*", "id", (F.col("request_rate") / F.col("run.a")).alias("x"), (F.col("failure_rate") / F.col("run.b")).alias("y")))
    found = cut(noise(points.select("scene", "id", "x", "y", "radius", "min_pts"), "radius", "min_pts"))
    base = found.filter("scene = '00'").select("id", F.col("noise").alias("before"))
    sums = found.join(base, "id").groupBy("scene").agg(F.sum(F.col("noise").cast("long")).alias("noise"), F.sum((F.col("noise") != F.col("before")).cast("long")).alias("changed"))
    told = events.sparkSession.range(1).select(F.explode(F.array(*fields)).alias("run")).select("run.*").filter("kind <> 'base'").join(sums, "scene", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return told.select("kind", "factor", "min_pts", "radius", none("noise").alias("noise"), F.when(F.col("kind") == "radius", none("changed")).alias("changed"))


def no_reviews(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REVIEWS)


def set_reviews(reviews: DataFrame, event_ids: DataFrame, verdict: str, note: str = "", at: int = 0) -> DataFrame:
    """Reviews with one verdict for all of event_ids (column event_id), in place of what they had; at 0 means now."""
    if verdict not in VERDICTS or len(note.encode()) > 1024 or at < 0:
        raise ValueError("verdict, note or time out of range")
    new = event_ids.select("event_id").distinct().withColumns({"verdict": F.lit(verdict), "note": F.lit(note), "reviewed_utc": F.lit(at or int(time.time())).cast("long")})
    return reviews.join(new.select("event_id"), "event_id", "left_anti").unionByName(new)


def stray_reviews(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Reviews that name no event; there should be none."""
    return reviews.join(events.select("event_id"), "event_id", "left_anti")


SOURCE = ["event_id", "truth", "candidate", "feature_noise", "outside_region", "review", "review_note", "reviewed_utc"]


def observations(events: DataFrame, s: Settings, view: str) -> DataFrame:
    """id, name, x, y and the rates of a view's points. Ids run from 0: in `geo` in the order of the events, in `feature` in that of the devices' names."""
    if view == "geo":
        x, y = K.project(F.col("latitude"), F.col("longitude"), s.lat0, s.lon0)
        rows = select_events(events, s).select("idx", F.col("event_id").alias("name"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("request_rate"), F.lit(0.0).alias("failure_rate"))
        return ranked(rows.withColumn("scene", F.lit(view)), "idx").select(F.col("rank").alias("id"), "name", "x", "y", "request_rate", "failure_rate")
    rows = device_rates(events, s).select(F.col("device_id").alias("name"), "x", "y", "request_rate", "failure_rate")
    return ranked(rows.withColumn("scene", F.lit(view)), "name").select(F.col("rank").alias("id"), "name", "x", "y", "request_rate", "failure_rate")


def evidence_rows(events: DataFrame, s: Settings, fence: DataFrame | None, reviews: DataFrame | None = None) -> DataFrame:
    """view, id, name, x, y, cluster, kind, noise and the columns of SOURCE with idx: a row for each point of each view and event behind it."""
    reviews = no_reviews(events.sparkSession) if reviews is None else reviews
    found = candidates(events, s, fence).join(reviews, "event_id", "left")
    told = [F.col("label").alias("truth"), "candidate", "feature_noise", F.col("outside").alias("outside_region"), F.coalesce("verdict", F.lit("unreviewed")).alias("review"), F.coalesce("note", F.lit("")).alias("review_note"), F.coalesce("reviewed_utc", F.lit(0)).cast("long").alias("reviewed_utc")]
    found = cut(found.select("idx", "event_id", "device_id", *told))
    out = None
    for view, key, radius in (("geo", "event_id", s.geo_radius), ("feature", "device_id", s.feature_radius)):
        frame = cut(observations(events, s, view))
        labels = dbscan(frame.select(F.lit(view).alias("scene"), "id", "x", "y"), radius, s.min_pts).select("id", F.col("label").alias("cluster"), "kind")
        rows = frame.join(labels, "id").join(found.withColumn("name", F.col(key)), "name")
        rows = rows.select(F.lit(view).alias("view"), "id", "name", "x", "y", "cluster", "kind", (F.col("cluster") == -1).alias("noise"), "idx", *SOURCE)
        out = rows if out is None else out.unionByName(rows)
    return out


def evidence(events: DataFrame, s: Settings, fence: DataFrame | None, reviews: DataFrame | None = None) -> DataFrame:
    """view, id, name, x, y, cluster, noise, outside, sources (structs of SOURCE in the order of the events): evidence_rows as one row a point,
    for views whose points have few events each."""
    rows = evidence_rows(events, s, fence, reviews)
    point = ["view", "id", "name", "x", "y", "cluster", "noise"]
    sources = F.array_sort(F.collect_list(F.struct("idx", *SOURCE)))
    rows = rows.groupBy(*point).agg(F.max("outside_region").alias("outside"), sources.alias("all"))
    return rows.select(*point, "outside", F.transform("all", lambda e: F.struct(*(e[f].alias(f) for f in SOURCE))).alias("sources"))
