"""Sinks: Parquet layers, CSV with byte-order mark, partitioned sets, workbooks, GeoJSON maps, reports, run metadata."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.functions.text import slug
from basinsift.operators.frames import nulls_to_empty
from basinsift.operators.shared import materialize

#: Rows that a driver-side document (workbook sheet, report, map) may hold; larger frames belong in Parquet or CSV sets.
MAX_DOCUMENT_ROWS = 200_000
#: Rows of a sheet in the workbook format, its header included, and of a compressed piece of one.
SHEET_ROWS, FRAGMENT_ROWS = 1_048_576, 4096


def write_layer(df: DataFrame, path: str) -> None:
    """Parquet, overwritten; null texts become empty."""
    nulls_to_empty(df).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV set with header; the first header carries the byte-order mark."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, place: str, flags: list[str]) -> None:
    """One CSV folder for each place and set flag."""
    labels = F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)))
    df.select("*", F.explode(labels).alias("label"), slug(F.col(place)).alias("slug")).write.mode("overwrite").partitionBy("slug", "label").csv(path, header=True)


def union_frames(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_errors(df: DataFrame, path: str) -> bool:
    """Side table of errors, only if there are any."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def document_rows(df: DataFrame) -> list:
    rows = df.limit(MAX_DOCUMENT_ROWS + 1).collect()
    if len(rows) > MAX_DOCUMENT_ROWS:
        raise ValueError(f"more than {MAX_DOCUMENT_ROWS} rows; write the frame as Parquet or CSV")
    return rows


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
#: Characters that XML doesn't allow.
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _book_parts(names: list[str]) -> dict[str, str]:
    """The parts of a workbook beside its sheets; names are cut to 31 characters."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
    return {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>",
    }


def _cells(row: Iterable, r: int | None = None) -> str:
    """A row of text cells; without a number the cells follow one another, empty ones too."""
    text = lambda v: f'<is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(v)))}</t></is>'
    if r is None:
        return "<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr">{text(v)}</c>' for v in row) + "</row>"
    return f'<row r="{r}">' + "".join(f'<c r="{_column(c)}{r}" t="inlineStr">{text(v)}</c>' for c, v in enumerate(row) if v is not None) + "</row>"


def _sheet_ends(names: list[str], widths: list[int], rows: int) -> tuple[str, str]:
    """What comes before and after the rows: a frozen first row, fitted columns, a filter."""
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
    wide = [min(max(w + 2, 12), 55) for w in widths]
    columns = "<cols>" + "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in enumerate(wide, 1)) + "</cols>" if wide else ""
    return f'<worksheet xmlns="{_MAIN}">{view}{columns}<sheetData>', f'</sheetData><autoFilter ref="A1:{_column(len(names) - 1)}{rows}"/></worksheet>'


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """A workbook with a frozen, filtered header and fitted columns in each sheet, for frames that the driver may hold; see ``write_workbook``."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _book_parts(list(sheets)).items():
            book.writestr(name, text)
        for k, df in enumerate(sheets.values(), 1):
            rows = [df.columns, *document_rows(df)]
            widths = [max((len(str(row[c])) for row in rows if row[c] is not None), default=0) for c in range(len(df.columns))]
            before, after = _sheet_ends(df.columns, widths, len(rows))
            book.writestr(f"xl/worksheets/sheet{k}.xml", before + "".join(_cells(row, r) for r, row in enumerate(rows, 1)) + after)
    return out.getvalue()


def _fragments(df: DataFrame) -> DataFrame:
    """``part, seq, data, crc, size, rows, widths``: compressed pieces of a sheet's rows, in the order of the frame.

    Each piece ends on a byte with a full flush, so pieces joined are one compressed stream.
    """
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        seq = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for at in range(0, batch.num_rows, FRAGMENT_ROWS):
                rows = list(zip(*(c[at : at + FRAGMENT_ROWS] for c in columns), strict=True))
                text = "".join(map(_cells, rows)).encode()
                pack = zlib.compressobj(6, zlib.DEFLATED, -15)
                data = pack.compress(text) + pack.flush(zlib.Z_FULL_FLUSH)
                widths = [max((len(v) for v in c if v is not None), default=0) for c in zip(*rows, strict=True)]
                row = (part, seq, data, zlib.crc32(text), len(text), len(rows), widths)
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["part", "seq", "data", "crc", "size", "rows", "widths"])
                seq += 1

    texts = df.select(*(F.col(f"`{c.replace('`', '``')}`").cast("string").alias(f"c{k}") for k, c in enumerate(names)))
    return materialize(texts.mapInArrow(run, "part int, seq int, data binary, crc long, size long, rows long, widths array<int>"), "sheet")


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, bits in reverse order."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two texts after one another, from those of both and the bytes of the second."""
    power, square, n = 1 << 31, 1 << 30, 8 * size
    while n:
        power, square, n = _times(power, square) if n & 1 else power, _times(square, square), n >> 1
    return _times(power, first) ^ second


def write_workbook(spark: SparkSession, sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook of sheets of up to ``SHEET_ROWS`` rows each, their rows compressed by tasks.

    The driver gets a small row for each fragment (checksum, sizes, widths), writes the ends of each sheet and streams the
    fragments, one partition at a time, between them.
    """
    stream = output_stream(spark, path)
    entries, at = [], 0

    def put(data: bytes) -> None:
        nonlocal at
        stream.write(bytearray(data))
        at += len(data)

    def head(name: str, crc: int, packed: int, size: int) -> None:
        entries.append((name.encode(), crc, packed, size, at))
        put(struct.pack("<4s5H3I2H", b"PK\3\4", 20, 0x800, 8, 0, 0x21, crc, packed, size, len(name.encode()), 0) + name.encode())

    def pack(text: bytes, last: bool) -> bytes:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        return packer.compress(text) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)

    try:
        for name, text in _book_parts(list(sheets)).items():
            data = pack(text.encode(), True)
            head(name, zlib.crc32(text.encode()), len(data), len(text.encode()))
            put(data)
        for k, df in enumerate(sheets.values(), 1):
            pieces = _fragments(df)
            sizes = pieces.select("part", "seq", "crc", "size", F.length("data").alias("packed"), "rows", "widths").orderBy("part", "seq").collect()  # one row for FRAGMENT_ROWS rows of at most SHEET_ROWS
            n_rows = sum(s["rows"] for s in sizes)
            if n_rows >= SHEET_ROWS:
                raise ValueError(f"{n_rows} rows; a sheet holds {SHEET_ROWS - 1} below its header")
            widths = [max([len(c), *(s["widths"][n] for s in sizes)]) for n, c in enumerate(df.columns)]
            before, after = _sheet_ends(df.columns, widths, n_rows + 1)
            first, final = (before + _cells(df.columns)).encode(), after.encode()
            crc, size, packed_first, packed_final = zlib.crc32(first), len(first) + len(final), pack(first, False), pack(final, True)
            for s in sizes:
                crc, size = joined_crc(crc, s["crc"], s["size"]), size + s["size"]
            packed = len(packed_first) + sum(s["packed"] for s in sizes) + len(packed_final)
            if max(size, at + packed) >= 2**32 - 2**20:
                raise ValueError("a workbook holds 4 GB at most")
            head(f"xl/worksheets/sheet{k}.xml", joined_crc(crc, zlib.crc32(final), len(final)), packed, size)
            put(packed_first)
            for row in pieces.select("part", "seq", "data").repartitionByRange(max(1, len(sizes) // 64), "part", "seq").sortWithinPartitions("part", "seq").toLocalIterator():
                put(bytes(row["data"]))
            put(packed_final)
        start = at
        for name, crc, packed, size, place in entries:
            put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 20, 20, 0x800, 8, 0, 0x21, crc, packed, size, len(name), 0, 0, 0, 0, 0, place) + name)
        put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(entries), len(entries), at - start, start, 0))
    finally:
        stream.close()


def feature_collection(features: DataFrame, column: str = "feature") -> str:
    return '{"type":"FeatureCollection","features":[' + ",".join(r[column] for r in document_rows(features.select(column))) + "]}"


#: Draws points, lines and polygons in their box; a feature's ``color`` property is its colour, its other properties its label.
_DRAW = """
const svg = document.getElementById('map'), all = [], ns = 'http://www.w3.org/2000/svg';
const walk = c => typeof c[0] === 'number' ? all.push(c) : c.forEach(walk);
const shapes = features.features.filter(f => f.geometry);
shapes.forEach(f => walk(f.geometry.coordinates));
const xs = all.map(c => c[0]), ys = all.map(c => c[1]), least = v => v.reduce((a, b) => Math.min(a, b), Infinity), most = v => v.reduce((a, b) => Math.max(a, b), -Infinity);
const box = all.length ? [least(xs), least(ys), most(xs), most(ys)] : [center[0] - 1, center[1] - 1, center[0] + 1, center[1] + 1];
const scale = 900 / Math.max(box[2] - box[0], box[3] - box[1], 1e-9), at = c => [(c[0] - box[0]) * scale + 20, (box[3] - c[1]) * scale + 20];
const put = (kind, f, values) => { const e = document.createElementNS(ns, kind), t = document.createElementNS(ns, 'title'), p = f.properties || {};
  Object.entries(values).forEach(([k, v]) => e.setAttribute(k, v));
  t.textContent = Object.entries(p).filter(([k]) => k !== 'color').map(([k, v]) => k + ': ' + v).join('\\n'); e.appendChild(t); svg.appendChild(e); };
const path = (lines, end) => lines.map(l => 'M' + l.map(c => at(c).join(' ')).join('L') + end).join('');
const depth = {LineString: 1, MultiPoint: 1, MultiLineString: 2, Polygon: 2, MultiPolygon: 3};
shapes.forEach(f => { const g = f.geometry, color = (f.properties || {}).color || '#2b8cbe', c = g.coordinates;
  if (g.type === 'Point' || g.type === 'MultiPoint') (g.type === 'Point' ? [c] : c).forEach(q => put('circle', f, {cx: at(q)[0], cy: at(q)[1], r: 5, fill: color}));
  else { const area = g.type.endsWith('Polygon'); put('path', f, {d: path(depth[g.type] === 1 ? [c] : depth[g.type] === 2 ? c : c.flat(), area ? 'Z' : ''), fill: area ? color : 'none', 'fill-rule': 'evenodd', 'fill-opacity': 0.3, stroke: color}); } });
"""


def map_page(title: str, features: DataFrame, center: tuple[float, float], column: str = "feature", legend: dict[str, str] | None = None) -> str:
    """A page that draws GeoJSON features of any kind, needing nothing from a network; a frame without rows gives a placeholder page.

    ``legend`` gives the colour of each label below the map.
    """
    data = feature_collection(features, column).replace("</", "<\\/")
    drawn = f'<svg id="map" viewBox="0 0 940 940"></svg><script>const features = {data}, center = {json.dumps(center)};{_DRAW}</script>'
    labels = "".join(f'<li style="color:{escape(color)}">{escape(label)}</li>' for label, color in (legend or {}).items())
    body = drawn + (f"<ul>{labels}</ul>" if labels else "") if '"Feature"' in data else "<p>Sin registros</p>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def index_page(title: str, entries: list[tuple[str, str, int]]) -> str:
    """Links to pages with their row counts."""
    items = "".join(f'<li><a href="{escape(path)}">{escape(name)}</a> ({n})</li>' for name, path, n in entries)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><ul>{items}</ul></body></html>'


def report(title: str, tables: dict[str, DataFrame]) -> str:
    """Markdown with a table for each (small) frame."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        parts += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        parts += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in document_rows(df)]
    return "\n".join(parts) + "\n"


def run_metadata(df: DataFrame, script: str, source: str, commit: str) -> DataFrame:
    """One row about a run: when, what, from where, how many rows."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return df.agg(F.count("*").alias("registros")).select(stamp.alias("fecha"), F.lit(script).alias("script"), F.lit(commit).alias("commit"), F.lit(source).alias("fuente"), "registros")


def output_stream(spark: SparkSession, path: str):
    """A new file in any file system Hadoop knows, written by the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)


def write_text(df_session, path: str, text: str) -> None:
    """A driver-side document to any file system Hadoop knows."""
    stream = output_stream(df_session, path)
    stream.write(bytearray(text if isinstance(text, bytes) else text.encode("utf-8")))
    stream.close()
