"""Large GeoJSON files in pieces: a data source whose partitions are ranges of bytes.

A partition owns the features that begin in its range. It finds the first one by itself: from an opening brace on, a JSON
object is read, and if its type is Feature and it stands after a comma or bracket, features follow one another from there;
the last one may end behind the range. Quoted text can't be taken for a feature, as its quotes are escaped. What can't be
split is a Feature inside another one's properties. A file that ends early gives the features before its end.

``read_collections`` reads files whole, in pieces too: a first pass cuts each at exact features and finds out whether all of it
is JSON, a second one reads the pieces. No task holds more than a piece.

Rows: the feature's JSON text, the collection's crs (of its first ``HEAD`` bytes), and the box of its coordinates. Comparisons
of the box are pushed down (``spark.sql.python.filterPushdown.enabled``): features outside are left out where they are read.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..shipping import ship

SPLIT, BLOCK, HEAD = 32 << 20, 1 << 20, 1 << 16
#: Bytes of a piece of ``read_collections``, and features of a batch.
PIECE, BATCH = 4 << 20, 5_000
BOX = ("xmin", "ymin", "xmax", "ymax")
_OPEN = re.compile(r"\{\s*\"")
_CRS = re.compile(rb'"crs"\s*:\s*\{[^{}]*\{[^{}]*"name"\s*:\s*"([^"]*)"')
_FEATURES = re.compile(r'"features"\s*:\s*\[')
_SPACE = re.compile(r"[ \t\n\r]*")
_COMPARE = {LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge"}


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    crs: str | None


def _numbers(value) -> Iterator[list]:
    """The positions in nested coordinates."""
    if value and not isinstance(value[0], list):
        yield value
    else:
        for part in value or ():
            yield from _numbers(part)


def _box(feature: dict) -> tuple:
    points = list(_numbers((feature.get("geometry") or {}).get("coordinates") or []))
    if not points:
        return None, None, None, None
    xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def features(source, size: int, start: int, end: int) -> Iterator[tuple[bytes, dict]]:
    """The features of a file that begin in [start, end), as bytes and as decoded."""
    decode = json.JSONDecoder().raw_decode
    base = max(0, start - 64)  # the comma before a feature may stand before the range
    text, read = "", base

    def more() -> bool:
        nonlocal text, read
        if read >= size:
            return False
        source.seek(read)
        data = source.read(min(BLOCK, size - read))
        text, read = text + data.decode("latin-1"), read + len(data)  # a character is a byte
        return bool(data)

    at, found = start - base, False
    while base + at < end:
        m = _OPEN.search(text, at)
        if not m:
            at = max(at, len(text) - 64)
            if not more():
                return
            continue
        if base + m.start() >= end:
            return
        if not found and text[max(0, m.start() - 64) : m.start()].rstrip()[-1:] not in (",", "["):
            at = m.start() + 1
            continue
        try:
            value, stop = decode(text, m.start())
        except ValueError:  # cut off by the block, or the file is broken here
            if not more():
                if found:
                    return
                at = m.start() + 1
            continue
        if value.get("type") == "Feature":
            found = True
            yield text[m.start() : stop].encode("latin-1"), value
            at = stop
            if at > BLOCK:
                base, text, at = base + at, text[at:], 0
        else:
            at = m.start() + 1


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(strict=False, parse_constant=_refuse)  # made where it is used: it can't be pickled with the module


class _Text:
    """A file's characters from a position on, read as needed; a character is a byte."""

    def __init__(self, source, size: int, base: int = 0):
        self.source, self.size, self.base, self.read, self.text = source, size, base, base, ""
        self.decode = _decoder().raw_decode

    def more(self) -> bool:
        if self.read >= self.size:
            return False
        self.source.seek(self.read)
        data = self.source.read(min(max(BLOCK, len(self.text)), self.size - self.read))  # doubled: a long value is tried few times
        self.text, self.read = self.text + data.decode("latin-1"), self.read + len(data)
        return bool(data)

    def drop(self, n: int) -> None:
        self.text, self.base = self.text[n:], self.base + n

    def skip(self, at: int) -> int:
        """Where the next character stands that is no space."""
        while True:
            at = _SPACE.match(self.text, at).end()
            if at < len(self.text):
                return at
            if not self.more():
                raise ValueError("the file ends early")

    def value(self, at: int) -> int:
        """Where the value that begins here ends."""
        while True:
            try:
                stop = self.decode(self.text, at)[1]
            except json.JSONDecodeError as e:
                cut = e.pos >= len(self.text) - 16 or e.msg.startswith("Unterminated")
                if not cut or not self.more():
                    raise
                continue
            if stop < len(self.text) or not self.more():  # a number may go on
                return stop

    def array(self) -> Iterator[tuple[int, int]]:
        """Begin and end, in the file, of the values of the array whose bracket stands before the text; then the text begins
        with the closing bracket."""
        at = self.skip(0)
        while self.text[at] != "]":
            stop = self.value(at)
            yield self.base + at, self.base + stop
            at = self.skip(stop)
            if self.text[at] == ",":
                at = self.skip(at + 1)
                if self.text[at] == "]":
                    raise ValueError("a comma before the end")
            elif self.text[at] != "]":
                raise ValueError("no comma")
            if at > BLOCK:
                self.drop(at)
                at = 0
        self.drop(at)


def cut(source, size: int, split: int = PIECE) -> tuple[str | None, list[tuple[int, int]]]:
    """The crs of a feature collection, and ranges of some ``split`` bytes of its features, from a feature's begin to a
    feature's end. ValueError, if the file can't be parsed as a whole."""
    head, seen, mark = _Text(source, size), 0, "the features stood here"
    while True:
        m = _FEATURES.search(head.text, seen)
        if not m:
            seen = max(seen, len(head.text) - 64)
            if not head.more():
                raise ValueError("no features")
            continue
        rest, pieces = _Text(source, size, m.end()), []
        try:
            for begin, end in rest.array():
                if pieces and end - pieces[-1][0] <= split:
                    pieces[-1] = pieces[-1][0], end
                else:
                    pieces.append((begin, end))
            while rest.more():
                pass
            found = _decoder().decode((head.text[: m.end()] + json.dumps(mark) + rest.text).removeprefix("\xef\xbb\xbf"))
        except ValueError:
            found = None
        if isinstance(found, dict) and found.get("features") == [mark]:  # else: the word stood elsewhere
            named = found.get("crs")
            for key in ("properties", "name"):
                named = named.get(key) if isinstance(named, dict) else None
            return (named if isinstance(named, str) else None), pieces
        seen = m.end()


def values(data: bytes) -> Iterator[str]:
    """The JSON texts in a range that ``cut`` found."""
    text, at, decode = data.decode("latin-1"), 0, _decoder().raw_decode
    while at < len(text):
        stop = decode(text, at)[1]
        yield text[at:stop].encode("latin-1").decode("utf-8", "replace")
        at = _SPACE.match(text, stop).end() + 1  # behind the comma
        at = _SPACE.match(text, at).end() if at < len(text) else at


def batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in tables of bounded length."""
    while some := list(islice(rows, BATCH)):
        yield pd.DataFrame(some, columns=columns)


def in_pieces(files: DataFrame, cut_file: Callable, schema: str, read_piece: Callable, out: str) -> DataFrame:
    """Rows of files, told by a row each: ``cut_file`` (row) gives the pieces, in the columns of ``schema``; they are dealt
    over tasks, and ``read_piece`` (piece) gives each one's rows, in the columns of ``out``."""
    spark = files.sparkSession
    ship(spark)
    names = lambda s: [c.split()[0] for c in s.split(", ")]

    def step(each: Callable, columns: list[str]) -> Callable:
        return lambda tables: (x for table in tables for x in batches((y for row in table.itertuples(index=False) for y in each(row)), columns))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.mapInPandas(step(cut_file, names(schema)), schema).repartition(tasks).mapInPandas(step(read_piece, names(out)), out)


def read_collections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Features (feature, crs) of whole files, as Spark lists them; one that can't be parsed drops out."""

    def cut_file(row) -> Iterator[tuple]:
        system, path = open_path(row.path)
        with system.open_input_file(path) as source:
            try:
                crs, pieces = cut(source, source.size())
            except (ValueError, RecursionError):
                return
        for begin, end in pieces:
            yield row.path, begin, end, crs

    def read_piece(piece) -> Iterator[tuple]:
        system, path = open_path(piece.path)
        with system.open_input_file(path) as source:
            source.seek(piece.begin)
            data = source.read(piece.end - piece.begin)
        for text in values(data):
            yield text, piece.crs

    files = spark.read.format("binaryFile").load(path).select("path")
    return in_pieces(files, cut_file, "path string, begin long, end long, crs string", read_piece, "feature string, crs string")


class FeatureReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.tests = path, split, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kind = _COMPARE.get(type(f))
            if kind and len(f.attribute) == 1 and f.attribute[0] in BOX:
                self.tests.append((BOX.index(f.attribute[0]), kind, float(f.value)))
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[InputPartition]:
        system, path = open_path(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and re.search(r"json$", f.path)]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with system.open_input_file(f.path) as source:
                crs = _CRS.search(source.read(HEAD))
            uri = f.path if isinstance(system, fs.LocalFileSystem) else self.path.split("://")[0] + "://" + f.path
            out += [Piece(uri, a, min(a + self.split, f.size), crs[1].decode() if crs else None) for a in range(0, f.size, self.split)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        system, path = open_path(piece.path)
        compare = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
        with system.open_input_file(path) as source:
            for data, feature in features(source, source.size(), piece.start, piece.end):
                box = _box(feature)
                if all(box[k] is not None and compare[kind](box[k], v) for k, kind, v in self.tests):
                    yield data.decode("utf-8", "replace"), piece.crs, *box


class GeoJsonFeatures(DataSource):
    """``spark.read.format("geojson_features").option("split", bytes).load(path)``: one file, or the json files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "geojson_features"

    def schema(self) -> str:
        return "feature string, crs string, " + ", ".join(f"{c} double" for c in BOX)

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_features(spark: SparkSession, path: str, split: int = SPLIT, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features (feature, crs, xmin, ymin, xmax, ymax) of large files, only those that touch a box if one is given."""
    ship(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark plans a source in a process without shipped files
    spark.dataSource.register(GeoJsonFeatures)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("geojson_features").option("split", str(split)).load(path)
    if box:
        rows = rows.where((rows.xmin <= box[2]) & (rows.xmax >= box[0]) & (rows.ymin <= box[3]) & (rows.ymax >= box[1]))
    return rows
