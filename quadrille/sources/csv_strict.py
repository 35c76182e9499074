"""Strict CSV: exact headers, exact field counts, errors with row numbers. Also maps and catalogues."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..operators.graph import ranked
from ..operators.validate import record_violations, require
from ..schema import CATALOGUE, CATALOGUE_HEADER, EVENT_HEADER, EVENTS, MAP_HEADER

MAX_BYTES = 8 * 1024 * 1024
SAFE_FILE = re.compile(r"security_[a-z0-9_.]*\.csv")


class EventSource(Protocol):
    """What events come from: any object that loads them as a frame with the columns of schema.EVENTS."""

    def load(self, spark: SparkSession) -> DataFrame: ...


@dataclass(frozen=True)
class CsvEvents:
    """Events in a CSV file."""

    path: str
    strict: bool = True

    def load(self, spark: SparkSession) -> DataFrame:
        return read_events(spark, self.path, self.strict)


class CsvError(ValueError):
    """A malformed file; the message names the row, the header being row 1."""


def parse_csv_line(line: str) -> list[str]:
    """Fields of one record; a quote opens a field only at its start, and nothing may follow a closing quote."""
    fields, at = [], 0
    while True:
        if at < len(line) and line[at] == '"':
            end, text = at + 1, []
            while True:
                close = line.find('"', end)
                if close < 0:
                    raise CsvError("unterminated quote")
                text.append(line[end:close])
                if line[close + 1 : close + 2] != '"':
                    break
                text.append('"')
                end = close + 2
            at = close + 1
            if at < len(line) and line[at] != ",":
                raise CsvError("text after a closing quote")
            fields.append("".join(text))
        else:
            comma = line.find(",", at)
            field = line[at:] if comma < 0 else line[at:comma]
            if '"' in field:
                raise CsvError("quote inside a field")
            fields.append(field)
            at += len(field)
        if at >= len(line):
            return fields
        at += 1


def csv_quote(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _number(text: str) -> float:
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) or not math.isfinite(float(text)):
        raise CsvError(f"not a number: {text}")
    return float(text)


def _whole(text: str) -> int:
    if not re.fullmatch(r"[+-]?\d+", text):
        raise CsvError(f"not a whole number: {text}")
    return int(text)


def _records(data: str, header: str) -> list[tuple[int, list[str]]]:
    lines = [x.removesuffix("\r") for x in data.split("\n")]
    if not lines or lines[0] != header:
        raise CsvError("row 1: wrong header")
    out = []
    for row, line in enumerate(lines[1:], 2):
        if line:
            try:
                fields = parse_csv_line(line)
            except CsvError as e:
                raise CsvError(f"row {row}: {e}") from None
            if len(fields) != header.count(",") + 1:
                raise CsvError(f"row {row}: {len(fields)} fields")
            out.append((row, fields))
    return out


def _whole_file(spark: SparkSession, path: str, max_bytes: int | None) -> str:
    file = spark.read.format("binaryFile").load(path).select("length", "content")
    size = file.select("length").first()
    if size is None or max_bytes is not None and size.length > max_bytes:
        raise CsvError("no file, or too large for the strict reader")
    try:
        return bytes(file.select("content").first().content).decode("utf-8")
    except UnicodeDecodeError:
        raise CsvError("not UTF-8") from None


def parse_events(data: str) -> list[tuple]:
    out = []
    for row, f in _records(data, EVENT_HEADER):
        try:
            out.append((len(out), f[0], _whole(f[1]), f[2], f[3], _number(f[4]), _number(f[5]), _whole(f[6]), _whole(f[7]), f[8], f[9]))
        except CsvError as e:
            raise CsvError(f"row {row}: {e}") from None
    return out


def read_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events with their source row as idx, from 0. Strict files are read whole, up to MAX_BYTES; the lenient reader takes any size, in parallel, and
    numbers rows by file and place in it."""
    if strict:
        events = spark.createDataFrame(parse_events(_whole_file(spark, path, MAX_BYTES)), EVENTS)
    else:
        columns = EVENTS.split(", ", 1)[1]
        events = spark.read.schema(columns).csv(path, header=True, escape='"', mode="FAILFAST", enforceSchema=False)
        place = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("row"))
        names = events.columns
        events = ranked(events.select(F.lit("").alias("scene"), place.alias("place"), *names), "place").select(F.col("rank").alias("idx"), *names)
    require(record_violations(events), "events")
    return events


def read_map(spark: SparkSession, path: str, lat0: float, lon0: float) -> DataFrame:
    """name, place (order of first appearance), line (array of seq, x, y) in metres."""
    rows = []
    for row, (name, lat, lon) in _records(_whole_file(spark, path, MAX_BYTES), MAP_HEADER):
        try:
            rows.append((row, name, _number(lat), _number(lon)))
        except CsvError as e:
            raise CsvError(f"row {row}: {e}") from None
    x, y = K.project(F.col("lat"), F.col("lon"), lat0, lon0)
    points = spark.createDataFrame(rows, "seq int, name string, lat double, lon double").select("seq", "name", x.alias("x"), y.alias("y"))
    if points.filter(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) > 50_000).count():
        raise CsvError("a vertex lies over 50 km from the origin")
    lines = points.groupBy("name").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("line"))
    return lines.select("name", (F.row_number().over(Window.orderBy("first")) - 1).alias("place"), "line")  # a map has few names


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    rows, seen = [], set()
    for row, f in _records(_whole_file(spark, path, MAX_BYTES), CATALOGUE_HEADER):
        try:
            entry = (f[0], f[1], f[2], _number(f[3]), _number(f[4]), _whole(f[5]), f[6])
        except CsvError as e:
            raise CsvError(f"row {row}: {e}") from None
        if not SAFE_FILE.fullmatch(f[0]) or ".." in f[0] or f[0] in seen or not f[1] or entry[3] <= 0 or entry[4] <= 0 or not 1 <= entry[5] <= 256 or f[6] not in ("campus", "event_corners"):
            raise CsvError(f"row {row}: entry out of range")
        seen.add(f[0])
        rows.append(entry)
    if len(rows) > 32:
        raise CsvError("more than 32 entries")
    return spark.createDataFrame(rows, CATALOGUE)


def write_events(events: DataFrame, path: str) -> None:
    events.orderBy("idx").drop("idx").write.csv(path, header=True, quoteAll=True, escape='"')
