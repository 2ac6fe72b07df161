"""A PySpark data source of vector files in parts: shapefiles by ranges of their ``.shx`` index, GeoPackages by ranges of row ids.

Planning looks at sizes and headers only.  A task reads its range of the index, then the records through a window of
``WINDOW`` bytes, so memory is bounded by the window and the largest record.  A bounding box is tested on the box that a
record carries, before vertices and attributes are decoded; a GeoPackage's R-tree answers it where there is one.  Filters on
``source_path`` (equal, in) are pushed down and leave out whole files.  A shapefile without index is one range.
"""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition

from basinsift.functions import geo
from basinsift.sources import formats

FEATURES = "source_path string, feature_id long, geometry struct<type:string,parts:array<array<struct<x:double,y:double>>>>, attributes map<string,string>, crs string, error string"
#: Records of a range, bytes read at once, and features of a batch.
RECORDS, WINDOW, BATCH = 50_000, 4 << 20, 512
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARROW = pa.schema([
    ("source_path", pa.string()), ("feature_id", pa.int64()), ("geometry", pa.struct([("type", pa.string()), ("parts", pa.list_(pa.list_(_POINT)))])),
    ("attributes", pa.map_(pa.string(), pa.string())), ("crs", pa.string()), ("error", pa.string()),
])
_ERRORS = (OSError, struct.error, ValueError, IndexError, TypeError, sqlite3.Error)


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def reachable(path: str) -> bool:
    """Whether tasks can open the file themselves, without Spark's readers."""
    return is_local(path) or urlparse(path).scheme in ("s3", "gs", "hdfs")


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def _open(path: str) -> pa.NativeFile:
    if is_local(path):
        return pafs.LocalFileSystem().open_input_file(_local(path))
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _beside(path: str, ending: str) -> bytes | None:
    """A small file of the same stem, in lower or upper case."""
    for name in (ending, ending.upper()):
        try:
            with _open(path.rpartition(".")[0] + "." + name) as file:
                return file.read()
        except OSError:
            continue
    return None


def _sibling(path: str, ending: str) -> pa.NativeFile | None:
    for name in (ending, ending.upper()):
        try:
            return _open(path.rpartition(".")[0] + "." + name)
        except OSError:
            continue
    return None


@dataclass
class Range(InputPartition):
    path: str
    begin: int = 0
    end: int | None = None
    error: str | None = None


class _Window:
    """Reads of a file through one buffer."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.start, self.data, self.size = file, 0, b"", file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(n, WINDOW))
        return self.data[at - self.start : at - self.start + n]


class _Table:
    """Rows of a dBASE file by number."""

    def __init__(self, path: str, columns: list[str] | None):
        self.file = _sibling(path, "dbf")
        if self.file is None:
            return
        self.window, self.encoding = _Window(self.file), formats.code_page(_beside(path, "cpg"))
        self.rows, self.header, self.width = struct.unpack("<IHH", self.window.read(4, 8))
        self.fields, at, place = [], 32, 1
        while self.window.read(at, 1) not in (b"\r", b""):
            field = self.window.read(at, 32)
            name = field[:11].split(b"\0")[0].decode("latin1")
            if columns is None or name in columns:
                self.fields.append((name, place, field[16]))
            place += field[16]
            at += 32

    def row(self, k: int) -> dict[str, str]:
        if self.file is None:
            return {}
        data, out = self.window.read(self.header + k * self.width, self.width), {}
        for name, at, size in self.fields:
            raw = data[at : at + size].strip(b" \0")
            try:
                out[name] = raw.decode(self.encoding)
            except UnicodeDecodeError:
                out[name] = raw.decode("latin1")
        return out


def _meets(box: tuple, bbox: tuple | None) -> bool:
    return bbox is None or (box[2] >= bbox[0] and box[0] <= bbox[2] and box[3] >= bbox[1] and box[1] <= bbox[3])


def _shape_ranges(path: str, records: int) -> list[Range]:
    index, table = _sibling(path, "shx"), _sibling(path, "dbf")
    if index is None:
        return [Range(path)]
    n = (index.size() - 100) // 8
    if table is not None and (rows := struct.unpack("<I", _Window(table).read(4, 4))[0]) != n:
        raise ValueError(f"{n} shapes and {rows} rows")
    return [Range(path, k, min(n, k + records)) for k in range(0, n, records)]


def _shape_records(path: str, begin: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """Number and body of each record of a range; without an index the headers lead from one to the next."""
    with _open(path) as file:
        window, index = _Window(file), None if end is None else _sibling(path, "shx")
        if index is not None:
            places = _Window(index)
            for k in range(begin, end):
                at, size = struct.unpack(">2i", places.read(100 + 8 * k, 8))
                body = window.read(2 * at + 8, 2 * size)
                if len(body) < 2 * size:
                    raise ValueError(f"record {k} ends after {len(body)} of {2 * size} bytes")
                yield k, body
            return
        at, k = 100, 0
        while at + 8 <= window.size:
            size = 2 * struct.unpack(">i", window.read(at + 4, 4))[0]
            body = window.read(at + 8, size)
            if len(body) < size or size < 4:
                raise ValueError(f"record {k} ends after {len(body)} of {size} bytes")
            yield k, body
            at, k = at + 8 + size, k + 1


def _shapes(part: Range, bbox: tuple | None, columns: list[str] | None) -> Iterator[tuple]:
    table, projection = _Table(part.path, columns), _beside(part.path, "prj")
    crs = projection.decode("utf-8", "replace").strip() if projection is not None else None
    count = 0
    for k, body in _shape_records(part.path, part.begin, part.end):
        kind = struct.unpack_from("<i", body)[0]
        if not kind:
            box = None
        else:
            box = struct.unpack_from("<2d", body, 4) * 2 if kind % 10 == 1 else struct.unpack_from("<4d", body, 4)
        count += 1
        if bbox is None or box is not None and _meets(box, bbox):
            yield k, formats.shape_of(kind, body) if kind else None, table.row(k), crs
    if part.end is None and table.file is not None and table.rows != count:
        raise ValueError(f"{count} shapes and {table.rows} rows")


def _database(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(_local(path))}?mode=ro&immutable=1", uri=True)


def _layer(db: sqlite3.Connection, layer: str | None) -> tuple[str, str]:
    found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns WHERE ? IS NULL OR table_name = ?", (layer, layer)).fetchone()
    if found is None:
        raise ValueError(f"no layer {layer or ''}".strip())
    return found


def _row_ranges(path: str, records: int, layer: str | None) -> list[Range]:
    db = _database(path)
    table, _ = _layer(db, layer)
    low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    return [] if low is None else [Range(path, k, min(high + 1, k + records)) for k in range(low, high + 1, records)]


def _rows(part: Range, bbox: tuple | None, columns: list[str] | None, layer: str | None) -> Iterator[tuple]:
    db = _database(part.path)
    table, column = _layer(db, layer)
    names = [r[1] for r in db.execute(f'PRAGMA table_info("{table}")') if r[1] != column and (columns is None or r[1] in columns)]
    chosen = ", ".join(f'"{c}"' for c in ("rowid", column, *names)).replace('"rowid"', "rowid", 1)
    query, values = f'SELECT {chosen} FROM "{table}" WHERE rowid >= ? AND rowid < ?', [part.begin, part.end]
    if bbox is not None and db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (f"rtree_{table}_{column}",)).fetchone():
        query += f' AND rowid IN (SELECT id FROM "rtree_{table}_{column}" WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)'
        values += [bbox[0], bbox[2], bbox[1], bbox[3]]
    for rowid, blob, *others in db.execute(query + " ORDER BY rowid", values):
        geometry, crs, box = formats.gpkg_geometry(blob)
        if bbox is None or box is not None and _meets(box, bbox):
            yield rowid, geometry, {c: str(v) for c, v in zip(names, others, strict=True) if v is not None}, crs


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.files = options["kind"], json.loads(options["files"])
        self.bbox, self.columns, self.layer = (json.loads(options.get(k, "null")) for k in ("bbox", "columns", "layer"))
        self.records = int(options.get("records", RECORDS))

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe) and f.attribute == ("source_path",):
                self.files = [x for x in self.files if x == f.value]
            elif isinstance(f, In) and f.attribute == ("source_path",):
                self.files = [x for x in self.files if x in f.value]
            else:
                yield f

    def partitions(self):
        found = []
        for path in self.files:
            try:
                found += _shape_ranges(path, self.records) if self.kind == "shp" else _row_ranges(path, self.records, self.layer)
            except _ERRORS as error:
                found.append(Range(path, error=f"{type(error).__name__}: {error}"))
        return found or [Range("")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        error = partition.error
        try:
            held = 0
            part = [] if error else _shapes(partition, self.bbox, self.columns) if self.kind == "shp" else _rows(partition, self.bbox, self.columns, self.layer)
            for k, geometry, attributes, crs in part:
                shape = None if geometry is None else {"type": geometry[0], "parts": [[{"x": float(x), "y": float(y)} for x, y in p] for p in geometry[1]]}
                rows.append((partition.path, k, shape, list(attributes.items()), crs, None))
                held += sum(map(len, geometry[1])) if geometry else 0
                if len(rows) >= BATCH or held > WINDOW // 64:
                    yield batch()
                    rows, held = [], 0
        except _ERRORS as failed:
            error = f"{type(failed).__name__}: {failed}"
        if error:
            rows.append((partition.path, None, None, None, None, error))
        if rows:
            yield batch()


class FeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "basinsift_features"

    def schema(self) -> str:
        return FEATURES

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(self.options)


def load(spark: SparkSession, kind: str, files: list[str], bbox: tuple | None = None, columns: list[str] | None = None, records: int = RECORDS, layer: str | None = None) -> DataFrame:
    spark.dataSource.register(FeatureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"kind": kind, "files": json.dumps(files), "bbox": json.dumps(bbox), "columns": json.dumps(columns), "layer": json.dumps(layer), "records": str(records)}
    return spark.read.format(FeatureSource.name()).options(**options).load()


def within(features: DataFrame, bbox: tuple | None, columns: list[str] | None) -> DataFrame:
    """The same choice of features and attributes of features that were read whole."""
    if columns is not None:
        features = features.withColumn("attributes", F.map_filter("attributes", lambda k, _: k.isin(columns)))
    if bbox is not None:
        box = geo.box(F.col("geometry"))
        features = features.filter(F.col("error").isNotNull() | (box["maxx"] >= bbox[0]) & (box["minx"] <= bbox[2]) & (box["maxy"] >= bbox[1]) & (box["miny"] <= bbox[3]))
    return features
