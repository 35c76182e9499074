"""Neighbour joins on a grid: pairs within a distance, nearest point, closest pair, meeting segments.

Points are frames (scene, id, x, y); every operator works on all scenes at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..functions.arrays import meeting
from ..session import cut

#: Cells are wider than eps by this factor, so that rounding can't part two points that are within eps.
INFLATE = 1 + 1e-9
#: Up to so many queries meet every point of their scene; more are joined on cells.
BROADCAST_QUERIES = 128
#: Segments of a cell that are joined row by row; the cells of more are compared in tiles of two blocks.
CROWDED, BLOCK = 64, 4096
#: Pairs that a task of tiles compares, about, and the most tasks.
TASK_PAIRS, MAX_TASKS = 20_000_000, 4000
#: By how much boxes of segments are wider: more than the tolerance of the predicate at the coordinates allowed.
SLACK = 1e-6
#: What names a cell of segments; the pairs of a tile.
CELL = ["scene", "at", "cx", "cy"]
PAIRS = pa.schema([("scene", pa.string()), ("i", pa.int64()), ("j", pa.int64())])


def cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("long")


def epsilon_join(left: DataFrame, right: DataFrame, eps: Column | float) -> DataFrame:
    """scene, a, b, d2 for all pairs with d2 <= eps * eps. eps is a number or a column of left and right.

    Columns other than scene, id, x, y are left out.
    """
    size = (F.lit(eps) if isinstance(eps, (int, float)) else eps) * F.lit(INFLATE)
    near = F.explode(F.expr("transform(sequence(0, 8), k -> struct(int(k div 3 - 1) AS i, int(k % 3 - 1) AS j))"))
    a = left.select("scene", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), size.alias("size"))
    a = a.withColumn("near", near).select("scene", "a", "ax", "ay", "size", (cell(F.col("ax"), F.col("size")) + F.col("near.i")).alias("cx"), (cell(F.col("ay"), F.col("size")) + F.col("near.j")).alias("cy"))
    b = right.select("scene", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    pairs = a.join(b, ["scene", "cx", "cy"]).withColumn("d2", K.distance2(K.point("a"), K.point("b")))
    limit = F.col("size") / F.lit(INFLATE) if not isinstance(eps, (int, float)) else F.lit(float(eps))
    return pairs.filter(F.col("d2") <= limit * limit).select("scene", "a", "b", "d2")


def distinct_points(points: DataFrame) -> DataFrame:
    """scene, x, y, id (the smallest), weight (how many points stand there)."""
    return points.groupBy("scene", "x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))


def bounding_boxes(points: DataFrame) -> DataFrame:
    """scene, x0, y0, x1, y1, n."""
    return points.groupBy("scene").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))


def within_radius(points: DataFrame, queries: DataFrame, radius: float | str) -> DataFrame:
    """scene, query, ids (ascending), n for each query point (scene, id, x, y); the radius is inclusive. It is a number or a column of both,
    the same in all of a scene."""
    found = epsilon_join(queries, points, F.col(radius) if isinstance(radius, str) else radius).groupBy("scene", F.col("a").alias("query")).agg(F.array_sort(F.collect_list("b")).alias("ids"))
    every = queries.select("scene", F.col("id").alias("query"))
    ids = F.coalesce("ids", F.array().cast("array<long>"))
    return every.join(found, ["scene", "query"], "left").select("scene", "query", ids.alias("ids"), F.size(ids).cast("long").alias("n"))


def radius_counts(points: DataFrame, radius: float) -> DataFrame:
    """scene, id, n: points within the radius of each point, itself counted. Equal places are compared once."""
    places = cut(distinct_points(points))
    weights = places.select("scene", F.col("id").alias("b"), "weight")
    n = epsilon_join(places, places, radius).join(weights, ["scene", "b"]).groupBy("scene", "a").agg(F.sum("weight").alias("n"))
    n = n.join(places.select("scene", F.col("id").alias("a"), "x", "y"), ["scene", "a"]).select("scene", "x", "y", "n")
    return points.join(n, ["scene", "x", "y"]).select("scene", "id", "n")


def nearest(points: DataFrame, queries: DataFrame) -> DataFrame:
    """scene, query, id, distance: the nearest point of each query, ties to the smallest id; null and infinity without points.

    Up to BROADCAST_QUERIES queries, every point meets the queries of its scene and partial minima are merged; more are first bounded by
    the points of their own cells and then joined within that bound.
    """
    q = queries.select("scene", F.col("id").alias("query"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    best = lambda f: f.groupBy("scene", "query").agg(F.min(F.struct("d2", "id")).alias("best"))
    if queries.count() <= BROADCAST_QUERIES:
        pairs = points.join(F.broadcast(q), "scene").withColumn("d2", K.distance2(K.point(""), K.point("q")))
        found = best(pairs)
    else:
        box = points.groupBy("scene").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"))
        box = cut(box.select("scene", "x0", "y0", F.greatest(F.col("side") / F.sqrt("n") * 2, F.lit(1e-9)).alias("size")))
        found, left = None, cut(q.join(box, "scene", "left_semi"))
        while not left.isEmpty():  # cells double until all queries have a point that is nearer than their ring of cells
            sized = points.join(box, "scene").select("scene", "id", "x", "y", cell(F.col("x") - F.col("x0"), F.col("size")).alias("cx"), cell(F.col("y") - F.col("y0"), F.col("size")).alias("cy"))
            near = F.explode(F.expr("transform(sequence(0, 8), k -> struct(int(k div 3 - 1) AS i, int(k % 3 - 1) AS j))"))
            asked = left.join(box, "scene").withColumn("near", near)
            asked = asked.select("scene", "query", "qx", "qy", "size", (cell(F.col("qx") - F.col("x0"), F.col("size")) + F.col("near.i")).alias("cx"), (cell(F.col("qy") - F.col("y0"), F.col("size")) + F.col("near.j")).alias("cy"))
            hit = asked.join(sized, ["scene", "cx", "cy"]).withColumn("d2", K.distance2(K.point(""), K.point("q"))).groupBy("scene", "query").agg(F.min(F.struct("d2", "id")).alias("best"), F.max("size").alias("size"))
            done = cut(hit.filter(F.col("best.d2") <= F.col("size") * F.col("size")).select("scene", "query", "best"))
            found = done if found is None else found.unionByName(done)
            left = cut(left.join(done, ["scene", "query"], "left_anti"))
            box = box.withColumn("size", F.col("size") * 2)
        if found is None:
            return q.select("scene", "query", F.lit(None).cast("long").alias("id"), F.lit(float("inf")).alias("distance"))
    return q.join(found, ["scene", "query"], "left").select("scene", "query", F.col("best.id").alias("id"), F.coalesce(F.sqrt("best.d2"), F.lit(float("inf"))).alias("distance"))


def closest_pair(points: DataFrame) -> DataFrame:
    """scene, i, j, distance of the closest pair, ties to the smallest (i, j); scenes of fewer than two points have no row.

    Points at one place are found by grouping. Else neighbours in (x, y, id) order within strips bound the distance, and a grid of that size finds all pairs within it.
    """
    same = points.groupBy("scene", "x", "y").agg(F.min("id").alias("i"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    second = points.join(same.select("scene", "x", "y", "i"), ["scene", "x", "y"]).filter("id > i").groupBy("scene", "i").agg(F.min("id").alias("j"))
    zero = second.groupBy("scene").agg(F.min(F.struct(F.lit(0.0).alias("d2"), "i", "j")).alias("best"))
    zero = cut(zero)
    rest = cut(points.join(zero.select("scene"), "scene", "left_anti").select("scene", "id", "x", "y"))
    loose = rest.groupBy("scene").agg(F.min(F.struct("x", "y", "id")).alias("f"), F.max(F.struct("x", "y", "id")).alias("l"), F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1")).filter("n > 1")
    loose = cut(loose.withColumn("height", (F.col("y1") - F.col("y0")) / F.sqrt("n")))
    # strips of about sqrt(n) points each: neighbours within a strip are about as near as a grid of one point a cell has them
    strips = rest.join(loose.select("scene", "y0", "height"), "scene").withColumn("strip", F.when(F.col("height") > 0, F.floor((F.col("y") - F.col("y0")) / F.col("height"))).otherwise(0))
    order = Window.partitionBy("scene", "strip").orderBy("x", "y", "id")
    step = strips.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order)}).withColumn("d", K.distance(K.point("p"), K.point("")))
    bound = loose.select("scene", K.distance((F.col("f.x"), F.col("f.y")), (F.col("l.x"), F.col("l.y"))).alias("far")).join(step.groupBy("scene").agg(F.min("d").alias("d")), "scene")
    bound = cut(bound.select("scene", (F.least("d", "far") * F.lit(1 + 1e-12)).alias("eps")))
    sized = rest.join(bound, "scene")
    pairs = epsilon_join(sized, sized, F.col("eps")).filter("a < b")
    best = pairs.groupBy("scene").agg(F.min(F.struct("d2", F.col("a").alias("i"), F.col("b").alias("j"))).alias("best"))
    return zero.unionByName(best).select("scene", F.col("best.i").alias("i"), F.col("best.j").alias("j"), F.sqrt("best.d2").alias("distance"))


def segments_of(points: DataFrame) -> DataFrame:
    """scene, seg, ax, ay, bx, by from points 2k and 2k + 1; a point without a partner is left out."""
    p = points.withColumn("seg", F.floor(F.col("id") / 2).cast("long"))
    at = lambda k, c: F.max(F.when(F.pmod("id", F.lit(2)) == k, F.col(c)))
    return p.groupBy("scene", "seg").agg(F.count(F.lit(1)).alias("n"), at(0, "x").alias("ax"), at(0, "y").alias("ay"), at(1, "x").alias("bx"), at(1, "y").alias("by")).filter("n = 2").drop("n")


def _in_cells(segments: DataFrame) -> DataFrame:
    """The segments in the cells of their own level (`home`) and of the wider ones; low_x, low_y: whether a cell holds the lower side of their box."""
    low = lambda c: F.least(f"a{c}", f"b{c}") - SLACK
    high = lambda c: F.greatest(f"a{c}", f"b{c}") + SLACK
    s = segments.filter("seg IS NOT NULL").select("scene", "seg", "ax", "ay", "bx", "by", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
    s = s.withColumn("level", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))) / 2).cast("int"))
    levels = s.groupBy("scene").agg(F.collect_set("level").alias("levels"))  # at most some twenty for any coordinates allowed
    s = s.join(levels, "scene").withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).withColumn("size", F.pow(F.lit(4.0), "at"))
    span = lambda c: F.explode(F.sequence(cell(F.col(f"{c}0"), F.col("size")), cell(F.col(f"{c}1"), F.col("size"))))
    s = s.withColumn("cx", span("x")).withColumn("cy", span("y"))
    lower = lambda c: (cell(F.col(f"{c}0"), F.col("size")) == F.col(f"c{c}")).alias(f"low_{c}")
    return s.select("scene", "seg", "ax", "ay", "bx", "by", "at", "cx", "cy", (F.col("at") == F.col("level")).alias("home"), lower("x"), lower("y"))


def _tiled(s: DataFrame, crowded: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn on tiles of the crowded cells (with homes, guests): a block of segments that are at home there with another, with itself (`alone`) or with a block of guests."""
    work = crowded.agg(F.sum(F.col("homes") * (F.col("homes") + F.col("guests")))).first()[0]
    parts = min(MAX_TASKS, max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), work // TASK_PAIRS))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    s = s.join(crowded.withColumns({"homes": blocks("homes"), "guests": blocks("guests")}), CELL)
    s = s.withColumn("own", F.pmod(F.xxhash64("seg", "ax", "ay"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int"))
    at = lambda kind, i, j, second: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), second.alias("second"))
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    own, no = F.col("own"), F.lit(False)
    with_homes = F.transform(numbers("homes"), lambda j: F.when(F.col("home"), at(0, F.least(own, j), F.greatest(own, j), own > j)).otherwise(at(1, j, own, ~no)))
    with_guests = F.transform(numbers("guests"), lambda j: at(1, own, j, no))
    tiles = s.withColumn("to", F.explode(F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(with_homes)))
    alone = ((F.col("to.kind") == 0) & (F.col("to.i") == F.col("to.j"))).alias("alone")
    low = (F.col("low_x").cast("byte") + F.col("low_y").cast("byte") * 2).cast("byte").alias("low")
    tiles = tiles.select(F.xxhash64(*CELL, "to.kind", "to.i", "to.j").alias("tile"), "scene", "seg", "ax", "ay", "bx", "by", low, alone, "to.second")
    return tiles.repartition(parts, "tile").groupBy("tile").applyInArrow(fn, schema)


def _tile_hits(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids, matrix): which segments of a tile meet, each pair in the one cell that holds the lower corner of what their boxes share."""
    seg, low, second = (table.column(c).to_numpy() for c in ("seg", "low", "second"))
    ends = np.stack([table.column(c).to_numpy() for c in ("ax", "ay", "bx", "by")])
    alone, own = table.column("alone")[0].as_py(), np.flatnonzero(~second)
    other = own if alone else np.flatnonzero(second)
    if not own.size or not other.size:
        return
    i, j, low_i, low_j = seg[own], seg[other], low[own], low[other]
    repeated = np.unique(np.concatenate((i, j) if not alone else (i,))).size < i.size + (0 if alone else j.size)
    everywhere = (low_i == 3).all() or (low_j == 3).all()
    for a, b, hit in meeting(ends[:, own], None if alone else ends[:, other]):
        lines = slice(a, a + len(hit))
        if not everywhere:
            hit &= (low_i[lines, None] | low_j[None, b:]) == 3
        if repeated:
            hit &= i[lines, None] != j[None, b:]
        yield i[lines], j[b:], hit


def _tile_pairs(table: pa.Table) -> pa.Table:
    scene, out = table.column("scene")[0], []
    for i, j, hit in _tile_hits(table):
        a, b = np.nonzero(hit)
        a, b = i[a], j[b]
        out.append(pa.RecordBatch.from_arrays([pa.repeat(scene, a.size), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=PAIRS))
    return pa.Table.from_batches(out, PAIRS).combine_chunks()


def _tile_counts(table: pa.Table) -> pa.Table:
    scene, ids, counts = table.column("scene")[0], [], []
    for i, j, hit in _tile_hits(table):
        ids += [i, j]
        counts += [np.count_nonzero(hit, axis=1), np.count_nonzero(hit, axis=0)]
    ids, place = np.unique(np.concatenate(ids or [np.zeros(0, np.int64)]), return_inverse=True)
    n = np.bincount(place, np.concatenate(counts or [np.zeros(0)]), ids.size).astype(np.int64)
    some = n > 0
    return pa.table({"scene": pa.repeat(scene, int(some.sum())), "seg": ids[some], "n": n[some]})


def _joined(s: DataFrame) -> DataFrame:
    """scene, i, j of the segments in cells of few."""
    t = s.select(*CELL, F.col("seg").alias("j"), F.col("home").alias("home_j"), *(F.col(c).alias(f"t{c}") for c in ("ax", "ay", "bx", "by", "low_x", "low_y")))
    pairs = s.filter("home").withColumnRenamed("seg", "i").join(t, CELL)
    pairs = pairs.filter(F.when(F.col("home_j"), F.col("i") < F.col("j")).otherwise(F.col("i") != F.col("j")) & (F.col("low_x") | F.col("tlow_x")) & (F.col("low_y") | F.col("tlow_y")))
    low, high = (lambda p, c: F.least(f"{p}a{c}", f"{p}b{c}") - SLACK), (lambda p, c: F.greatest(f"{p}a{c}", f"{p}b{c}") + SLACK)
    for c in "xy":  # boxes are cheaper to compare than segments
        pairs = pairs.filter((low("", c) <= high("t", c)) & (low("t", c) <= high("", c)))
    return pairs.filter(K.segments_meet(K.point("a"), K.point("b"), K.point("ta"), K.point("tb"))).select("scene", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def _few_and_crowded(segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The segments in cells, those in cells of few, and the crowded cells, if there are any."""
    s = cut(_in_cells(segments))
    home = F.col("home").cast("long")
    crowded = cut(s.groupBy(*CELL).agg(F.sum(home).alias("homes"), F.sum(1 - home).alias("guests")).filter((F.col("homes") > 0) & (F.col("homes") + F.col("guests") > CROWDED)))
    return (s, s, None) if crowded.isEmpty() else (s, s.join(crowded, CELL, "left_anti"), crowded)


def segment_collisions(segments: DataFrame) -> DataFrame:
    """scene, i, j (i < j) of segments that cross, touch or overlap.

    The grid has levels, with cells of sides of powers of 4. A segment is at home on the level whose cells are just wider than its box, so it lies
    in at most four of them, and it is a guest on the wider levels that its scene has. Two segments whose boxes meet are compared once: on the
    wider of their levels, in the cell that holds the lower corner of what their boxes share. Cells of up to CROWDED segments are joined with themselves;
    others are compared in tiles of BLOCK x BLOCK, so that no cell is one task, however many lie in it.
    """
    s, few, crowded = _few_and_crowded(segments)
    pairs = _joined(few)
    return pairs if crowded is None else pairs.unionByName(_tiled(s, crowded, _tile_pairs, "scene string, i long, j long"))


def collision_counts(segments: DataFrame) -> DataFrame:
    """scene, seg, n: how many segments each one meets, if any, counted where they are compared: pairs aren't listed."""
    s, few, crowded = _few_and_crowded(segments)
    counts = _joined(few).select("scene", F.explode(F.array("i", "j")).alias("seg"), F.lit(1).cast("long").alias("n"))
    counts = counts if crowded is None else counts.unionByName(_tiled(s, crowded, _tile_counts, "scene string, seg long, n long"))
    return counts.groupBy("scene", "seg").agg(F.sum("n").alias("n"))
