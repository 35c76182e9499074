"""Consoles and their evidence as files: snapshots (versions 1 and 2), a readable report, JSON, scenes and sensitivity, published together."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import engine
from ..schema import EVENTS, REVIEWS
from ..session import cut
from ..sources.csv_strict import _whole_file
from ..sources.scene_text import MAX_POINTS, Publisher, Scene, dump
from .console import Console
from .settings import Settings

#: Other programs' files differ in these words alone; the functions take theirs.
MAGIC, SCHEMA = "PLANAR_SECURITY", "planar.evidence.v1"
MAX_EVENTS = 4096
_WORD = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[^\s"]+)', re.S)


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _double(x: float) -> str:
    return f"{x:.17g}"


def _rows(frame: DataFrame, order: str, most: int) -> list:
    rows = frame.orderBy(order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a file holds at most {most} rows of a kind; write larger tables as Parquet")
    return rows


def dump_snapshot(console: Console, magic: str = MAGIC) -> str:
    s = console.checked().settings
    events, reviews = _rows(console.events, "idx", MAX_EVENTS), _rows(console.reviews, "event_id", MAX_EVENTS)
    numbers = (s.request_scale, s.failure_scale, s.feature_radius, s.geo_radius, s.min_pts, s.lat0, s.lon0, *s.geo_query, *s.feature_query)
    lines = [f"{magic} 2", f"{s.start} {s.end} {quoted(s.user)} {quoted(s.device)}", " ".join(map(_double, numbers)), str(len(console.fence))]
    lines += [f"{_double(x)} {_double(y)}" for x, y in console.fence]
    lines.append(str(len(events)))
    lines += [f"{quoted(e.event_id)} {e.timestamp} {quoted(e.user_id)} {quoted(e.device_id)} {_double(e.latitude)} {_double(e.longitude)} {e.requests} {e.failures} {quoted(e.label)} {quoted(e.summary or '')}" for e in events]
    lines.append(str(len(reviews)))
    lines += [f"{quoted(r.event_id)} {quoted(r.verdict)} {quoted(r.note)} {r.reviewed_utc}" for r in reviews]
    return "\n".join(lines) + "\n"


def parse_snapshot(spark: SparkSession, text: str, magic: str = MAGIC) -> Console:
    """The console of a snapshot; everything is read and checked before anything is given out."""
    at = 0

    def take(kind):
        nonlocal at
        found = _WORD.match(text, at)
        if found is None:
            raise ValueError("malformed or incomplete snapshot")
        at, word = found.end(), found[1]
        if kind is str:
            return re.sub(r"\\(.)", r"\1", word[1:-1], flags=re.S) if word[0] == '"' else word
        try:
            return kind(word)
        except ValueError:
            raise ValueError("malformed or incomplete snapshot") from None

    def count(most: int) -> range:
        n = take(int)
        if not 0 <= n <= most:
            raise ValueError("record count out of range")
        return range(n)

    word, version = take(str), take(str)
    if word != magic or version not in ("1", "2"):
        raise ValueError("unknown format or version")
    start, end, user, device = take(int), take(int), take(str), take(str)
    scales = [take(float) for _ in range(4)]
    min_pts, lat0, lon0 = take(int), take(float), take(float)
    queries = [(take(float), take(float)) for _ in range(2)]
    settings = Settings(start, end, user, device, *scales, min_pts, lat0, lon0, *queries)
    fence = tuple((take(float), take(float)) for _ in count(MAX_POINTS))
    kinds = (str, int, str, str, float, float, int, int, str, str)
    events = [(i, *(take(kind) for kind in kinds)) for i in count(MAX_EVENTS)]
    reviews = {}
    for _ in count(MAX_EVENTS):
        name, verdict = take(str), take(str)
        if name in reviews:
            raise ValueError("duplicate review")
        reviews[name] = (name, verdict, *((take(str), take(int)) if version == "2" else ("", 0)))
    if text[at:].strip():
        raise ValueError("trailing content")
    return Console(spark.createDataFrame(events, EVENTS), settings, fence, spark.createDataFrame(list(reviews.values()), REVIEWS)).checked()


def save_snapshot(console: Console, path: str, magic: str = MAGIC, files: Publisher | None = None) -> None:
    text, own = dump_snapshot(console, magic), files or Publisher()
    with open(own.stage(path), "w", encoding="utf-8", newline="") as out:
        out.write(text)
    if files is None:
        own.commit()


def load_snapshot(spark: SparkSession, path: str, magic: str = MAGIC) -> Console:
    return parse_snapshot(spark, _whole_file(spark, path, None), magic)


def input_hash(console: Console) -> str:
    """FNV-1a of the events' canonical text."""
    said = []
    for e in _rows(console.events, "idx", MAX_EVENTS):
        said.append(f"{quoted(e.event_id)}{e.timestamp}{quoted(e.user_id)}{quoted(e.device_id)}{_double(e.latitude)},{_double(e.longitude)},{e.requests},{e.failures}{quoted(e.label)}{quoted(e.summary or '')}")
    return X.fnv1a64("".join(said).encode())


class Held:
    """What the files of one export share, each calculated once: the scenes of both views, density runs checked by each other, and the evidence."""

    def __init__(self, console: Console):
        self.console = console
        self.scenes = {view: console.scene(view) for view in ("geo", "feature")}
        self.scans, self.runs = {}, {}
        for view, frames in self.scenes.items():
            engine.validate(frames)
            labels = engine.calculate("dbscan", frames)[1]
            self.scans[view] = engine.Run("dbscan", frames, frames.params, labels)
            self.runs[view] = engine.execute("indexed_dbscan", frames, validated=True, twin=self.scans[view])
        self.rows = cut(console.evidence())


def evidence_lines(console: Console, found: DataFrame | None = None) -> DataFrame:
    """view, id, line: each observation with its sources as JSON, for views of any size (write.text makes files of them)."""
    found = console.evidence() if found is None else found
    return found.select("view", "id", F.to_json(F.struct(*(c for c in found.columns if c != "view"))).alias("line"))


def evidence_json(console: Console, revision: str = "local", schema: str = SCHEMA, held: Held | None = None) -> str:
    """The evidence of both views as one document."""
    held = held or Held(console)
    s, j = console.settings, X.json_text
    told = {"start_utc": s.start, "end_utc": s.end, "user": j(s.user), "device": j(s.device), "origin_lat": _double(s.lat0), "origin_lon": _double(s.lon0), "request_scale": _double(s.request_scale), "failure_scale": _double(s.failure_scale), "feature_radius": _double(s.feature_radius), "geo_radius_m": _double(s.geo_radius), "min_pts": s.min_pts}
    lines = evidence_lines(console, held.rows)
    views = []
    for view, units in (("geo", "metres"), ("feature", "scaled requests/failures per minute")):
        check = held.runs[view].answers.first()["check"]
        rows = ",".join(r.line for r in _rows(lines.filter(F.col("view") == view), "id", MAX_EVENTS))
        views.append(f'{{"units":{j(units)},"algorithm":"Indexed DBSCAN","check":{j(check)},"observations":[{rows}]}}')
    head = f'"schema":{j(schema)},"source_revision":{j(revision)},"input_hash":{j(input_hash(console))},"hash_scope":"canonical source records, consistency only; unsigned"'
    params = ",".join(f"{j(k)}:{v}" for k, v in told.items())
    rule = "Load adjacent .security snapshot; feature noise OR outside is the event candidate rule. Geographic noise is a separate view result."
    return f'{{{head},"parameters":{{{params}}},"views":[{",".join(views)}],"reproduce":{j(rule)}}}\n'


def _scene(frames: engine.Frames) -> Scene:
    p = frames.params.first()
    return Scene(
        points=[(r.x, r.y) for r in _rows(frames.points, "id", MAX_POINTS)], polygon=[(r.x, r.y) for r in _rows(frames.polygon, "seq", MAX_POINTS)],
        edges=[(r.a, r.b, r.weight, r.blocked) for r in frames.edges.limit(MAX_EVENTS + 1).collect()],
        query=(p.query_x, p.query_y), radius=p.radius, min_pts=p.min_pts, source=p.source, goal=p.goal, grid=p.grid,
    )


def evidence_text(console: Console, held: Held | None = None) -> str:
    """Settings, evaluation and, for both views, checks, queries, points and the events behind them."""
    held = held or Held(console)
    s = console.settings
    out = [
        "SPATIAL SECURITY EVIDENCE",
        f"UTC epoch window [start,end): {s.start} {s.end}",
        f"User={s.user} device={s.device}",
        f"Projection: local equirectangular, R=6371000 metres; origin lat/lon={_double(s.lat0)} {_double(s.lon0)}",
        "Supported radius from origin: 50 km; latitude +/-80; approximate local distances.",
        f"Feature x=(sum requests/window minutes)/{_double(s.request_scale)}; y=(sum failures/window minutes)/{_double(s.failure_scale)}",
        f"Feature radius={_double(s.feature_radius)} geographic radius(m)={_double(s.geo_radius)} MinPts(including self)={s.min_pts}",
        "Stable order: geographic input CSV order; feature device lexicographic order.",
        console.evaluation_text().rstrip("\n"),
    ]
    events = {e.event_id: e for e in _rows(console.events, "idx", MAX_EVENTS)}
    rows = held.rows
    for view, title in (("geo", "GEOGRAPHIC (metres)"), ("feature", "FEATURE (scaled rates)")):
        frames, indexed = held.scenes[view], held.runs[view]
        nearest, nearby = (engine.execute(m, frames, validated=True) for m in ("nearest", "radius"))
        agree = engine.compare(held.scans[view].labels, indexed.labels, ["scene", "id"]).first().agree
        near, within = nearest.answers.first(), nearby.answers.first()
        query = s.feature_query if view == "feature" else s.geo_query
        n = frames.points.count()
        out += ["", f"VIEW {title}", indexed.answers.first()["check"], f"Baseline/indexed labels agree={int(agree)}", f"Scan distance tests={n * n}"]
        out += [f"Query x={_double(query[0])} y={_double(query[1])} nearest distance={X.format_number(near.value, 12)} nearest IDs:" + "".join(f" {i}" for i in near.answer), "Radius matches:" + "".join(f" {i}" for i in within.answer), near["check"], within["check"]]
        if view == "geo" and console.fence:
            out.append(f"Query permitted-region classification={int(engine.execute('geofence', frames, validated=True).answers.first().value)}")
            places = {r.id: r.cls for r in engine.run("geofence", frames.points, frames.polygon).limit(MAX_EVENTS).collect()}
        kind = {r.id: r.kind for r in _rows(indexed.labels, "id", MAX_EVENTS)}
        for o in _rows(rows.filter(F.col("view") == view), "id", MAX_EVENTS):
            at = f" geofence={places[o.id]}" if view == "geo" and console.fence else ""
            out.append(f"Point {o.id} {o.name} x={_double(o.x)} y={_double(o.y)} cluster={o.cluster} kind={kind[o.id]}{at}")
            for source in o.sources:
                e = events[source.event_id]
                out.append(f"  source={e.event_id} utc={e.timestamp} user={e.user_id} device={e.device_id} requests={e.requests} failures={e.failures} label={e.label} review={source.review} summary={e.summary or ''}")
    return "\n".join(out) + "\n"


def export_evidence(console: Console, path: str, revision: str = "local", files: Publisher | None = None) -> None:
    """path, path.json, path.security, path.geo.scene, path.feature.scene and path.sensitivity.txt, all or none."""
    snapshot, held = dump_snapshot(console), Held(console)  # the snapshot checks all rules first
    texts = {"": evidence_text(console, held), ".json": evidence_json(console, revision, held=held), ".security": snapshot, ".sensitivity.txt": console.sensitivity_text()}
    texts |= {f".{view}.scene": dump(_scene(frames)) for view, frames in held.scenes.items()}
    own = files or Publisher()
    for suffix, text in texts.items():
        with open(own.stage(path + suffix), "w", encoding="utf-8", newline="") as out:
            out.write(text)
    if files is None:
        own.commit()


def run_summary(run: engine.Run) -> str:
    """The report of a run of one scene."""
    r, p = run.answers.first(), run.frames.params.first()
    labels = _rows(run.labels, "id", MAX_EVENTS) if run.labels is not None else []
    listed = lambda values: "".join(f" {v}" for v in values)
    return "\n".join([
        "CHECKED RUN", f"Algorithm: {engine.TITLES[run.mode][0]}", f"Result: {r.summary}", r.check,
        f"Visited/expanded: {0 if r.settled is None else r.settled}", f"Radius: {_double(p.radius)}", f"MinPts: {p.min_pts}",
        "Tie policy: ascending input index; heap (f,g,index); strict coordinate sort.", "Tolerance: 1e-9 scale-aware orientation; exact radius inclusion.",
        f"Value: {X.format_number(r.value, 12)}", f"Answer indices:{listed(r.answer)}", f"Cluster labels:{listed(x.label for x in labels)}", f"Kinds (0 noise,1 border,2 core):{listed(x.kind for x in labels)}",
        "Reproduce: load the adjacent .scene snapshot, select this algorithm, and run.",
    ]) + "\n"


def export_summary(run: engine.Run, path: str, files: Publisher | None = None) -> None:
    """The report and, beside it, the scene that it came from."""
    own = files or Publisher()
    for suffix, text in (("", run_summary(run)), (".scene", dump(_scene(run.frames)))):
        with open(own.stage(path + suffix), "w", encoding="utf-8", newline="") as out:
            out.write(text)
    if files is None:
        own.commit()


def export_comparison(previous: engine.Run, current: engine.Run, previous_path: str, current_path: str) -> str:
    """Writes the reports of two runs together and returns both results in one line."""
    files = Publisher()
    export_summary(previous, previous_path, files)
    export_summary(current, current_path, files)
    files.commit()
    said = lambda run: f"{engine.TITLES[run.mode][0]}: {run.answers.first().summary}"
    return f"Previous {said(previous)}; current {said(current)}"
