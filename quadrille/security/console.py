"""Events, settings, fence and reviews as one value: every change gives a new one, and checked() raises unless all rules hold."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..functions import text as X
from ..operators.graph import dbscan
from ..operators.hull import point_in_polygon, polygon_violations
from ..operators.spatial import within_radius
from ..operators.validate import record_violations, require
from ..plans.engine import Frames
from ..schema import EDGES, PARAMS, POLYGON, VERDICTS
from ..session import cut
from ..sources.csv_strict import CsvEvents, EventSource
from . import review
from .settings import CAMPUS_FENCE, Settings

EXTENT = 50_000.0
Fence = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Console:
    events: DataFrame
    settings: Settings
    fence: Fence
    reviews: DataFrame

    @classmethod
    def of(cls, events: DataFrame, settings: Settings | None = None, fence: Fence = ()) -> Console:
        return cls(events, settings or Settings(), tuple(fence), review.no_reviews(events.sparkSession)).checked()

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession

    # ---- changes

    def with_events(self, events: DataFrame) -> Console:
        """Other events; reviews of the old ones go."""
        return replace(self, events=events, reviews=review.no_reviews(self.spark)).checked()

    def with_settings(self, **changes) -> Console:
        return replace(self, settings=self.settings.but(**changes)).checked()

    def without_filters(self) -> Console:
        return self.with_settings(user="*", device="*")

    def with_fence(self, fence: Fence) -> Console:
        return replace(self, fence=tuple(fence)).checked()

    def reviewed(self, event_ids: DataFrame, verdict: str, note: str = "", at: int = 0) -> Console:
        return replace(self, reviews=cut(review.set_reviews(self.reviews, event_ids, verdict, note, at))).checked()

    # ---- rules

    def violations(self) -> DataFrame:
        """One row: how many events and reviews break each rule, events over 50 km from the origin and reviews without an event included."""
        s = self.settings
        x, y = K.project(F.col("latitude"), F.col("longitude"), s.lat0, s.lon0)
        none = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
        far = self.events.agg(none(F.sqrt(x * x + y * y) > EXTENT, "too_far"))
        strays = review.stray_reviews(self.reviews, self.events).agg(F.count(F.lit(1)).alias("stray_reviews"))
        bad = ~F.col("verdict").isin(*VERDICTS) | (F.octet_length("note") > 1024) | (F.col("reviewed_utc") < 0)
        twice = self.reviews.groupBy("event_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_reviews"))
        return record_violations(self.events).join(far).join(strays).join(twice).join(self.reviews.agg(none(bad, "bad_reviews")))

    def checked(self) -> Console:
        require(self.violations(), "events and reviews")
        if self.fence:
            require(polygon_violations(self.fence_frame("fence")).drop("scene"), "fence")
        return self

    # ---- views

    def fence_frame(self, scene: str = "fence") -> DataFrame:
        return self.spark.createDataFrame([(scene, i, float(x), float(y)) for i, (x, y) in enumerate(self.fence)], POLYGON)

    def _fence(self) -> DataFrame | None:
        return self.fence_frame() if self.fence else None

    def observations(self, view: str) -> DataFrame:
        return review.observations(self.events, self.settings, view)

    def scene(self, view: str) -> Frames:
        """A view as a scene for every mode; the fence is the polygon of the geographic one alone."""
        s, feature = self.settings, view == "feature"
        points = cut(self.observations(view).select(F.lit(view).alias("scene"), "id", "x", "y"))
        query = s.feature_query if feature else s.geo_query
        goal = max(0, points.count() - 1)
        params = [(view, float(query[0]), float(query[1]), float(s.feature_radius if feature else s.geo_radius), s.min_pts, 0, goal, False)]
        polygon = self.fence_frame(view) if self.fence and not feature else self.spark.createDataFrame([], POLYGON)
        return Frames(points, polygon, self.spark.createDataFrame([], EDGES), self.spark.createDataFrame(params, PARAMS))

    def evaluation(self) -> DataFrame:
        return review.evaluate(self.events, self.settings, self._fence(), self.reviews)

    def evaluation_text(self) -> str:
        r = self.evaluation().first()
        ratio = lambda x: "N/A" if x is None else X.format_number(x)
        return (
            "Review-candidate rule: feature DBSCAN noise OR strictly outside permitted polygon. Boundary is permitted.\n"
            "Labels are evaluation truth, never model inputs. Unit: selected source event (device flags propagate to its events).\n"
            f"TP={r.tp} FP={r.fp} TN={r.tn} FN={r.fn} unknown={r.unknown}\n"
            f"Candidate precision={ratio(r.precision)} recall={ratio(r.recall)} false-positive rate={ratio(r.false_positive_rate)}\n"
            f"Flagged events={r.flagged} analyst-reviewed={r.reviewed} reviewed benign={r.reviewed_benign}\n"
        )

    def sensitivity(self) -> DataFrame:
        return review.sensitivity(self.events, self.settings)

    def sensitivity_text(self) -> str:
        lines = ["SENSITIVITY (comparison of settings, not an estimate of accuracy)"]
        for r in self.sensitivity().orderBy("kind", "factor", "min_pts").collect():  # eleven rows
            if r.kind == "radius":
                lines.append(f"radius={r.radius:.17g} MinPts={r.min_pts} noise={r.noise} changed_noise_status={r.changed}")
            else:
                lines.append(f"both scale factor={r.factor:g} noise={r.noise}")
        return "\n".join(lines) + "\n"

    def evidence_rows(self) -> DataFrame:
        return review.evidence_rows(self.events, self.settings, self._fence(), self.reviews)

    def evidence(self) -> DataFrame:
        return review.evidence(self.events, self.settings, self._fence(), self.reviews)

    def prepared(self) -> Prepared:
        """Both views and the evaluation, calculated before anything is shown or saved; raises if one can't be."""
        self.checked()
        return Prepared(self, {view: cut(self.observations(view)) for view in ("geo", "feature")}, cut(self.evaluation()))

    def inspect(self, view: str, name: str) -> DataFrame:
        """One row for the point of a view with that name: id, x, y, rates, neighbours (ids within the radius, its own included), label, kind,
        cls (place in the fence, geographic view with a fence only), sources (structs of the events behind it)."""
        s = self.settings
        points = cut(self.observations(view).withColumn("scene", F.lit(view)))
        radius = s.feature_radius if view == "feature" else s.geo_radius
        one = points.filter(F.col("name") == name)
        near = within_radius(points.select("scene", "id", "x", "y"), one.select("scene", "id", "x", "y"), radius).select(F.col("query").alias("id"), F.col("ids").alias("neighbours"))
        labels = dbscan(points.select("scene", "id", "x", "y"), radius, s.min_pts).select("id", "label", "kind")
        key = "device_id" if view == "feature" else "event_id"
        told = review.select_events(self.events, s).filter(F.col(key) == name).join(self.reviews.select("event_id", "verdict"), "event_id", "left")
        fields = ["idx", "event_id", "user_id", "device_id", "timestamp", "requests", "failures", "label", "summary"]
        sources = told.groupBy(F.col(key).alias("name")).agg(F.array_sort(F.collect_list(F.struct(*fields, F.coalesce("verdict", F.lit("unreviewed")).alias("review")))).alias("sources"))
        out = one.join(near, "id").join(labels, "id").join(sources, "name")
        if view == "geo" and self.fence:
            out = out.join(point_in_polygon(one.withColumn("scene", F.lit("fence")), self.fence_frame()).select("id", "cls"), "id")
        else:
            out = out.withColumn("cls", F.lit(None).cast("int"))
        return out.select("id", "name", "x", "y", "request_rate", "failure_rate", "neighbours", "label", "kind", "cls", "sources")

    def key(self) -> str:
        """A digest of all inputs: equal for equal workspaces. Events and reviews enter by sums of row hashes, so their size doesn't matter."""
        rows = lambda f: f.agg(F.count(F.lit(1)), *(F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*f.columns), {"ignoreNullFields": "false"}), 256), 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(3))).first()
        said = repr((self.settings, self.fence, tuple(rows(self.events)), tuple(rows(self.reviews))))
        return hashlib.sha256(said.encode()).hexdigest()


@dataclass(frozen=True)
class Prepared:
    console: Console
    views: dict[str, DataFrame]
    evaluation: DataFrame


def load_scenario(spark: SparkSession, folder: str, entry, source: EventSource | None = None) -> Console:
    """The console of a catalogue's entry (a row of read_catalogue): its events and radii, and as fence the campus or its first four events, which
    sets the geographic query to the first corner."""
    events = (source or CsvEvents(os.path.join(folder, entry.file))).load(spark)
    settings = Settings(geo_radius=entry.geo_radius, feature_radius=entry.feature_radius, min_pts=entry.min_pts)
    if entry.fence != "event_corners":
        return Console.of(events, settings, CAMPUS_FENCE)
    x, y = K.project(F.col("latitude"), F.col("longitude"), settings.lat0, settings.lon0)
    corners = tuple((r.x, r.y) for r in events.filter("idx < 4").orderBy("idx").select(x.alias("x"), y.alias("y")).collect())
    if len(corners) < 4:
        raise ValueError("a fence of event corners takes four events")
    return Console.of(events, settings.but(geo_query=corners[0]), corners)
