import math
import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import kernel as K
from quadrille.functions import text as X
from quadrille.operators import edits, graph, hull, spatial
from quadrille.operators.validate import edge_violations, point_violations
from quadrille.plans import engine
from quadrille.security import review
from quadrille.security.settings import CAMPUS_FENCE, Settings
from quadrille.sources import csv_strict, scene_text
from quadrille.sources.scene_text import Scene, sample_scene

POINTS = "scene string, id long, x double, y double"


def points(spark, places, scene=""):
    return spark.createDataFrame([(scene, i, float(x), float(y)) for i, (x, y) in enumerate(places)], POINTS)


@pytest.mark.parametrize("a,b,c,d,meet", [((0, 0), (4, 4), (0, 4), (4, 0), True), ((0, 0), (4, 0), (2, 0), (6, 0), True), ((0, 0), (4, 0), (4, 0), (4, 4), True), ((2, 0), (2, 0), (0, 0), (4, 0), True), ((0, 0), (1, 0), (2, 0), (3, 0), False)])
def test_segments_meet(spark, a, b, c, d, meet):
    at = lambda p: (F.lit(float(p[0])), F.lit(float(p[1])))
    assert spark.range(1).select(K.segments_meet(at(a), at(b), at(c), at(d))).first()[0] is meet


def test_sample_scene(spark):
    p, fence, _ = sample_scene().frames(spark)
    assert [r.id for r in hull.convex_hull(p).orderBy("seq").collect()] == [0, 1, 5, 6, 7, 8, 9]
    q = spark.createDataFrame([("", 0, 300.0, 220.0)], POINTS)
    assert hull.point_in_polygon(q, fence).first().cls == engine.winding(q, fence).first().cls == 1
    near = spatial.nearest(p, q).first()
    assert near.id == 11 and round(near.distance, 3) == 53.852
    assert spatial.within_radius(p, q, 75.0).first().ids == [11]
    pair = spatial.closest_pair(p).first()
    assert (pair.i, pair.j, round(pair.distance, 3)) == (0, 1, 82.462)
    s, _, _ = sample_scene("segments").frames(spark)
    assert spatial.segment_collisions(spatial.segments_of(s)).count() == 2


@pytest.mark.parametrize("mode", ["dijkstra", "astar"])
def test_routes(spark, mode):
    scene = sample_scene("roads")
    p, _, e = scene.frames(spark)
    params = spark.createDataFrame([("", 0, 11, False)], "scene string, source long, goal long, grid boolean")
    r = engine.run(mode, p, e, params).first()
    assert (round(r.cost, 3), r.path, r.settled, r.fallback) == (403.434, [0, 1, 2, 10, 11], 9 if mode == "dijkstra" else 5, False)
    p, _, e = scene_text.grid_scene().frames(spark)
    r = engine.run(mode, p, e, params.withColumns({"goal": F.lit(69).cast("long"), "grid": F.lit(True)})).first()
    assert r.cost == 15
    short = e.withColumn("weight", F.lit(0.01))
    assert engine.run("astar", p, short, params.withColumns({"goal": F.lit(9).cast("long"), "grid": F.lit(True)})).first().fallback
    costs = graph.shortest_costs(e, spark.createDataFrame([("", 0)], "scene string, id long"))
    assert {x.id: x.cost for x in costs.collect()}[69] == 15


def test_dbscan_cases(spark):
    p = points(spark, [(0, 0), (1, 0), (1.1, 0), (1, 0.2), (20, 20)])
    got = sorted((r.id, r.label, r.kind) for r in graph.dbscan(p, 1.01, 4).collect())
    assert [x[1:] for x in got] == [(0, 1), (0, 2), (0, 1), (0, 1), (-1, 0)]
    c = sample_scene("clusters")
    found = graph.dbscan(c.frames(spark)[0], c.radius, c.min_pts).collect()
    assert (max(r.label for r in found) + 1, sum(r.label == -1 for r in found)) == (2, 2)
    assert graph.dbscan(p.limit(0), 1.0, 2).count() == 0


def plain_dbscan(places, eps, min_pts):
    near = [[j for j, q in enumerate(places) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in places]
    labels, k = [None] * len(places), 0
    core = [len(x) >= min_pts for x in near]
    for i in range(len(places)):
        if core[i] and labels[i] is None:
            todo = [i]
            while todo:
                j = todo.pop()
                if labels[j] is None:
                    labels[j] = k
                    todo += [m for m in near[j] if core[m]]
            k += 1
    return [labels[i] if core[i] else min((labels[j] for j in near[i] if core[j]), default=-1) for i in range(len(places))]


def test_random_scenes(spark):
    rng, scenes = random.Random(5), {}
    for k in range(12):
        scenes[f"s{k}"] = [(rng.randrange(-40, 40) / rng.choice([1, 2, 4]), rng.randrange(-40, 40)) for _ in range(rng.randrange(0, 50))]
    rows = [(s, i, float(x), float(y)) for s, p in scenes.items() for i, (x, y) in enumerate(p)]
    frame = spark.createDataFrame(rows, POINTS).cache()
    got = {(r.scene, r.id): r.label for r in graph.dbscan(frame, 9.0, 4).collect()}
    noisy = {(r.scene, r.id): r.noise for r in graph.noise(frame, 9.0, 4).collect()}
    pairs = {r.scene: (r.i, r.j) for r in spatial.closest_pair(frame).collect()}
    corners = {}
    for r in hull.convex_hull(frame).orderBy("seq").collect():
        corners.setdefault(r.scene, []).append(r.id)
    for s, p in scenes.items():
        want = plain_dbscan(p, 9.0, 4)
        assert [got[s, i] for i in range(len(p))] == want
        assert [noisy[s, i] for i in range(len(p))] == [x == -1 for x in want]
        d2 = lambda i, j: (p[i][0] - p[j][0]) ** 2 + (p[i][1] - p[j][1]) ** 2
        if len(p) > 1:
            assert pairs[s] == min(((d2(i, j), i, j) for i in range(len(p)) for j in range(i + 1, len(p))))[1:]
        assert corners.get(s, []) == [v[2] for v in hull.chain([(x, y, i) for i, (x, y) in enumerate(map(lambda q: (float(q[0]), float(q[1])), p))])]


def test_nearest_of_many_queries(spark, monkeypatch):
    rng = random.Random(8)
    p = points(spark, [(rng.randrange(100), rng.randrange(100)) for _ in range(300)])
    q = points(spark, [(rng.uniform(-300, 300), rng.uniform(-50, 150)) for _ in range(60)])
    want = sorted(map(tuple, spatial.nearest(p, q).collect()))
    monkeypatch.setattr(spatial, "BROADCAST_QUERIES", 0)
    assert sorted(map(tuple, spatial.nearest(p, q).collect())) == want


def test_numbers_and_times(spark):
    assert [X.format_number(x) for x in (1.0, 0.0, 1e-5, float("inf"), 0.0625)] == ["1.000", "0.000", "1.000e-05", "INF", "0.062"]
    texts = ["2026-02-28 00:00:00", "2026-02-30 00:00:00", "2026-01-01 24:00:00", "1800000000", "-5", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.utc_epoch(F.col("t"))).collect()]
    assert got == [1772236800, None, None, 1800000000, None, None, None]
    assert [r[0] for r in spark.createDataFrame([(1772236800,), (-1,), (10**12,)], "e long").select(X.utc_text(F.col("e"))).collect()] == ["2026-02-28 00:00:00", "-1", "1000000000000"]
    assert X.fnv1a64(b"") == "fnv1a64:cbf29ce484222325" and X.fnv1a64(b"a") == "fnv1a64:af63dc4c8601ec8c"


@pytest.mark.parametrize("line", ['a"b,c', '"a"b,c', '"a,c'])
def test_malformed_csv(line):
    with pytest.raises(csv_strict.CsvError):
        csv_strict.parse_csv_line(line)


def test_csv_round_trip(spark, tmp_path):
    assert csv_strict.parse_csv_line('a,"b,""c",,') == ["a", 'b,"c', "", ""]
    header = "event_id,timestamp,user_id,device_id,latitude,longitude,requests,failures,label,summary"
    path = tmp_path / "security_a.csv"
    path.write_text(f'{header}\r\ne1,1800000100,u,d,20.2961,85.8245,5,1,benign,"one, two"\n\ne2,1800000599,u,"d 2",20.3,85.8,9,0,suspicious,\n')
    events = csv_strict.read_events(spark, str(path))
    assert [(r.idx, r.event_id, r.summary) for r in events.orderBy("idx").collect()] == [(0, "e1", "one, two"), (1, "e2", "")]
    assert review.select_events(events, Settings()).count() == 2
    assert review.select_events(events, Settings(end=1800000599)).count() == 1
    for bad in ("e1,x,u,d,1,1,1,1,benign,", "e1,5,u,d,1,1,1,2,benign,", "e1,5,u,d,91,1,2,1,benign,", "e1,5,u,d,1,1,1,1,odd,", "e1,5,,d,1,1,1,1,benign,", "e1,5,u,d,nan,1,1,1,benign,", "e1,5,u,d,1,1,1,1", 'e1,5,u,d,1,1,1,1,benign,x\ne1,5,u,d,1,1,1,1,benign,x'):
        path.write_text(f"{header}\n{bad}\n")
        with pytest.raises(ValueError):
            csv_strict.read_events(spark, str(path))


def test_scene_text(tmp_path):
    scene = sample_scene("roads")
    text = scene_text.dump(scene)
    assert scene_text.parse(text) == scene
    for cut in range(0, len(text) - 1, 37):
        with pytest.raises(ValueError):
            scene_text.parse(text[:cut])
    with pytest.raises(ValueError):
        scene_text.parse(text + " 1")
    with pytest.raises(ValueError):
        Scene(points=[(math.inf, 0.0)]).validate()
    p, target = scene_text.Publisher(), tmp_path / "a.txt"
    target.write_text("before")
    open(p.stage(str(target)), "w").write("after")
    p.stage(str(tmp_path / "never-written.txt"))
    with pytest.raises(OSError):
        p.commit()
    assert target.read_text() == "before" and [x.name for x in tmp_path.iterdir()] == ["a.txt"]


def test_edits_and_rules(spark):
    p, _, e = sample_scene("roads").frames(spark)
    left, edges = edits.remove_point(p, e, 10)
    assert left.count() == 11 and edges.count() == 12 and left.agg(F.max("id")).first()[0] == 10
    assert point_violations(p).first().asDict() == {"bad_coordinates": 0, "repeated_ids": 0}
    assert edge_violations(e, left).first().unknown_ends == 3
    assert edits.set_edge(e, 1, 0, blocked=True).filter("blocked").count() == 1
    assert edits.add_point(p, "", 1, 2).count() == 13


def test_evaluation_without_selected_events(spark):
    rows = [(0, "e", 5, "u", "d", 20.0, 85.0, 1, 0, "benign", "")]
    from quadrille.schema import EVENTS

    fence = spark.createDataFrame([("", i, x, y) for i, (x, y) in enumerate(CAMPUS_FENCE)], "scene string, seq int, x double, y double")
    r = review.evaluate(spark.createDataFrame(rows, EVENTS), Settings(), fence).first()
    assert (r.tp, r.flagged, r.precision, r.recall) == (0, 0, None, None)


def test_batch_and_stream_agree(spark, sf, tmp_path):
    from quadrille.bindings import events
    from quadrille.streaming.windows import windowed_rates

    batch = events(spark, sf)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = windowed_rates(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed_rates(batch).collect()))


def crowded_segments(spark):
    """Scenes of segments that share few cells: lattice ends that touch and overlap, long ones, single points, missing ends, and ids that repeat."""
    rng, rows = random.Random(11), []
    for i in range(420):
        x, y, size = rng.randrange(-40, 40) / 2, rng.randrange(-60, 60) / 4, rng.choice([0, 1, 3, 12, 40])
        rows.append(("s" if i % 3 else "t", i - i % 70 // 69, x, y, x + rng.randrange(-size, size + 1), y + rng.randrange(-size, size + 1) / 2))
    rows += [("s", 500, 1.0, None, 6.0, 2.0), ("s", 501, None, None, 3.0, 2.0), ("s", None, 0.0, 0.0, 5.0, 5.0)]
    s = spark.createDataFrame([(a, b, *(None if v is None else float(v) for v in r)) for a, b, *r in rows], "scene string, seg long, ax double, ay double, bx double, by double")
    t = s.toDF("scene", "other", "cx", "cy", "dx", "dy")
    hit = s.join(t, "scene").filter((F.col("seg") < F.col("other")) & K.segments_meet(*(K.point(p) for p in "abcd")))
    return s, sorted(map(tuple, hit.select("scene", "seg", "other").collect()))


def test_segments_of_crowded_cells(spark, monkeypatch):
    """Cells of many are compared in tiles of blocks; the pairs are those of all pairs."""
    monkeypatch.setattr(spatial, "CROWDED", 16)
    monkeypatch.setattr(spatial, "BLOCK", 32)
    s, want = crowded_segments(spark)
    assert sorted(map(tuple, spatial.segment_collisions(s).collect())) == want and len(want) > 500


def test_counts_of_crowded_cells(spark, monkeypatch):
    """Counts are those of the pairs, with tiles and without."""
    s, pairs = crowded_segments(spark)
    want = {}
    for scene, i, j in pairs:
        for k in (i, j):
            want[scene, k] = want.get((scene, k), 0) + 1
    assert {(r.scene, r.seg): r.n for r in spatial.collision_counts(s).collect()} == want
    monkeypatch.setattr(spatial, "CROWDED", 16)
    monkeypatch.setattr(spatial, "BLOCK", 32)
    assert {(r.scene, r.seg): r.n for r in spatial.collision_counts(s).collect()} == want


def test_crossings_of_large_polygons(spark, monkeypatch):
    """Edges are counted in tiles, neighbours left out, as by all pairs; polygons of one to three vertices and of none missing."""
    monkeypatch.setattr(spatial, "CROWDED", 16)
    monkeypatch.setattr(spatial, "BLOCK", 32)
    rng = random.Random(6)
    shapes = {f"p{n}": [(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(n)] for n in (1, 2, 3, 4, 5, 90, 150)}
    rows = [(k, i, x, y) for k, v in shapes.items() for i, (x, y) in enumerate(v)]
    polygon = spark.createDataFrame(rows, "scene string, seq int, x double, y double")
    e = hull.polygon_edges(polygon)
    f = e.toDF("scene", "t", "cx", "cy", "dx", "dy", "m")
    apart = (F.col("t") - F.col("seq") > 1) & ~((F.col("seq") == 0) & (F.col("t") == F.col("n") - 1))
    want = {r.scene: r["count"] for r in e.join(f, "scene").filter(apart & K.segments_meet(*(K.point(p) for p in "abcd"))).groupBy("scene").count().collect()}
    got = hull.polygon_violations(polygon).collect()
    assert {r.scene: r.crossing for r in got} == {k: want.get(k, 0) for k in shapes} and want["p150"] > 100
    assert {r.scene: r.few for r in got} == {k: int(len(v) < 3) for k, v in shapes.items()}


def test_scan_lists_no_pairs(spark, monkeypatch):
    """900 places within eps of each other are one cluster, and no table of either strategy has more rows than a few a place; the scan wrote all 810,000 pairs."""
    rows, cut = [], graph.cut

    def counted(frame):
        kept = cut(frame)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(graph, "cut", counted)
    frame = spark.createDataFrame([("s", i, float(i % 30), float(i // 30)) for i in range(900)], POINTS)
    for strategy in ("scan", "indexed"):
        assert {(r.label, r.kind) for r in graph.dbscan(frame, 50.0, 4, strategy).collect()} == {(0, 2)}
    assert max(rows) <= 4 * 900


def test_scan_in_blocks(spark, monkeypatch):
    """Scan and cells have the labels of plain DBSCAN: small blocks, repeated places, several scenes, two of them long, one sparse, one of a single point, one with a point that isn't finite."""
    monkeypatch.setattr(graph, "SCAN_BLOCK", 16, raising=False)
    rng = random.Random(9)
    shapes = ((40, 40, 300), (4, 160, 180), (160, 6, 170), (6, 6, 120), (90, 90, 150), (9, 9, 1))
    scenes = {f"s{k}": [(rng.randrange(-w, w) / 2, rng.randrange(-h, h) / 2) for _ in range(n)] for k, (w, h, n) in enumerate(shapes)}
    scenes["odd"] = scenes["s1"][:40] + [(float("inf"), 0.0)]
    frame = spark.createDataFrame([(s, i, x, y) for s, p in scenes.items() for i, (x, y) in enumerate(p)], POINTS)
    for strategy, (eps, min_pts) in (("scan", (1.5, 4)), ("scan", (3.0, 9)), ("indexed", (1.5, 4)), ("indexed", (3.0, 9))):
        got = {(r.scene, r.id): r.label for r in graph.dbscan(frame if strategy == "scan" else frame.filter("scene <> 'odd'"), eps, min_pts, strategy).collect()}
        for s, p in scenes.items():
            if strategy == "scan" or s != "odd":
                assert [got[s, i] for i in range(len(p))] == plain_dbscan(p, eps, min_pts), (strategy, eps, s)
    assert len(set(plain_dbscan(scenes["s0"], 1.5, 4))) > 5


def test_united_keeps_sets():
    """A set that two smaller ones reach in one step is joined with both; the tiles that were taken back lost one."""
    np = pytest.importorskip("numpy")
    from quadrille.functions.arrays import united

    assert united(np.arange(4), np.array([2, 2]), np.array([0, 1])).tolist() == [0, 0, 0, 3]
    rng = np.random.default_rng(4)
    for n, m in ((6, 4), (40, 30), (300, 280), (300, 900)):
        a, b = rng.integers(0, n, (2, m))
        want = list(range(n))
        for p, q in zip(a, b):
            low, high = sorted((want[p], want[q]))
            want = [low if v == high else v for v in want]
        some = united(np.arange(n), a[: m // 2], b[: m // 2])
        assert united(some, a[m // 2 :], b[m // 2 :]).tolist() == united(np.arange(n), a, b).tolist() == want
