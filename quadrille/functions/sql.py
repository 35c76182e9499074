"""The predicates of kernel.py as SQL functions of a session. Their bodies are expressions, which Catalyst inlines."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from .kernel import EARTH, TOLERANCE


def _points(names: str) -> str:
    return ", ".join(f"{n}{c} DOUBLE" for n in names for c in "xy")


def _cross(a: str, b: str, c: str) -> str:
    return f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _distance2(a: str, b: str) -> str:
    return f"(({b}x - {a}x) * ({b}x - {a}x) + ({b}y - {a}y) * ({b}y - {a}y))"


def _turn(a: str, b: str, c: str) -> str:
    value, slack = _cross(a, b, c), f"({TOLERANCE}D * greatest(1D, sqrt({_distance2(a, b)}) * sqrt({_distance2(a, c)})))"
    return f"CASE WHEN {value} > {slack} THEN 1 WHEN {value} < -{slack} THEN -1 ELSE 0 END"


def _call(name: str, points: str) -> str:
    return f"{name}({', '.join(f'{p}{c}' for p in points for c in 'xy')})"


def _on(p: str, a: str, b: str) -> str:
    slack = f"({TOLERANCE}D * greatest(1D, sqrt({_distance2(a, b)})))"
    inside = [f"{p}{c} BETWEEN least({a}{c}, {b}{c}) - {slack} AND greatest({a}{c}, {b}{c}) + {slack}" for c in "xy"]
    return f"({_turn(a, b, p)}) = 0 AND {inside[0]} AND {inside[1]}"


#: Name: parameters, type, body. A point is two numbers, x and y.
FUNCTIONS = {
    "planar_cross": (_points("abc"), "DOUBLE", _cross("a", "b", "c")),
    "planar_distance2": (_points("ab"), "DOUBLE", _distance2("a", "b")),
    "planar_orientation": (_points("abc"), "INT", _turn("a", "b", "c")),
    "planar_on_segment": (_points("pab"), "BOOLEAN", _on("p", "a", "b")),
    "planar_segments_meet": (
        _points("abcd"),
        "BOOLEAN",
        f"({_call('planar_orientation', 'abc')} * {_call('planar_orientation', 'abd')} < 0 AND {_call('planar_orientation', 'cda')} * {_call('planar_orientation', 'cdb')} < 0)"
        f" OR {_call('planar_on_segment', 'acd')} OR {_call('planar_on_segment', 'bcd')} OR {_call('planar_on_segment', 'cab')} OR {_call('planar_on_segment', 'dab')}",
    ),
    "planar_east": ("longitude DOUBLE, lat0 DOUBLE, lon0 DOUBLE", "DOUBLE", f"{EARTH}D * (longitude - lon0) * {math.pi / 180!r}D * cos(lat0 * {math.pi}D / 180D)"),
    "planar_north": ("latitude DOUBLE, lat0 DOUBLE", "DOUBLE", f"{EARTH}D * (latitude - lat0) * {math.pi / 180!r}D"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
