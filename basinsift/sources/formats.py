"""Bytes of vector formats: shapefile records, dBASE rows, well-known binary, GeoPackage rows."""

from __future__ import annotations

import codecs
import sqlite3
import struct
from collections.abc import Iterator

from basinsift.functions import rings


def _polygon_parts(polygons: list[list[list[tuple[float, float]]]]) -> tuple[str, list[list[tuple[float, float]]]]:
    """Type and rings of polygons, each shell (counter-clockwise) before its holes (clockwise)."""
    return ("Polygon" if len(polygons) == 1 else "MultiPolygon"), [ring for polygon in polygons for ring in polygon]


def shape_of(kind: int, body: bytes) -> tuple[str, list[list[tuple[float, float]]]]:
    """Type and parts of one shapefile record body."""
    base = kind % 10
    if base == 1:
        return "Point", [[struct.unpack_from("<2d", body, 4)]]
    if base == 8:
        n = struct.unpack_from("<i", body, 36)[0]
        return "MultiPoint", [[struct.unpack_from("<2d", body, 40 + 16 * k)] for k in range(n)]
    n_parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
    at = 44 + 4 * n_parts
    xy = [struct.unpack_from("<2d", body, at + 16 * k) for k in range(n)]
    parts = [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    if base == 3:
        return ("LineString" if len(parts) == 1 else "MultiLineString"), parts
    return _polygon_parts(rings.assign(parts))


def parse_shp(data: bytes) -> list[tuple[str, list] | None]:
    """Geometries of a shapefile's main file; null shapes are None."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = data[at + 8 : at + 8 + size]
        kind = struct.unpack_from("<i", body)[0]
        out.append(shape_of(kind, body) if kind else None)
        at += 8 + size
    return out


def code_page(data: bytes | None) -> str:
    """Python's name of the encoding that a ``.cpg`` file gives; UTF-8 without one, or where the name is unknown."""
    name = (data or b"").decode("ascii", "ignore").strip()
    for guess in (name, f"cp{name}", name.upper().replace("ANSI ", "cp")):
        try:
            return codecs.lookup(guess).name if guess else "utf-8"
        except LookupError:
            continue
    return "utf-8"


def parse_dbf(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """Rows of a dBASE table as text; falls back to Latin-1 where bytes don't fit the encoding."""
    n, header, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin1"), data[at + 16]))
        at += 32
    rows = []
    for k in range(n):
        at, row = header + k * width + 1, {}
        for name, size in fields:
            raw = data[at : at + size].strip(b" \0")
            try:
                row[name] = raw.decode(encoding)
            except UnicodeDecodeError:
                row[name] = raw.decode("latin1")
            at += size
        rows.append(row)
    return rows


def parse_wkb(data: bytes, at: int = 0) -> tuple[tuple[str, list], int]:
    """Geometry of well-known binary and the offset behind it."""
    order = "<" if data[at] else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    dims = 3 if kind // 1000 in (1, 2) or kind & 0x80000000 else 2
    kind = kind % 1000 & 0xFF
    at += 5

    def run(at: int) -> tuple[list[tuple[float, float]], int]:
        n = struct.unpack_from(order + "I", data, at)[0]
        xy = [struct.unpack_from(order + "2d", data, at + 4 + 8 * dims * k) for k in range(n)]
        return xy, at + 4 + 8 * dims * n

    if kind == 1:
        return ("Point", [[struct.unpack_from(order + "2d", data, at)]]), at + 8 * dims
    if kind == 2:
        xy, at = run(at)
        return ("LineString", [xy]), at
    count = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    parts: list = []
    if kind == 3:
        for _ in range(count):
            ring, at = run(at)
            parts.append(rings.turned(ring, not parts) if len(ring) > 3 else ring)
        return ("Polygon", parts), at
    names = {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
    for _ in range(count):
        (_, inner), at = parse_wkb(data, at)
        parts += inner
    return (names.get(kind, "GeometryCollection"), parts), at


def gpkg_geometry(blob: bytes | None) -> tuple[tuple | None, str | None, tuple | None]:
    """Geometry, reference system and box (from the header, else from the vertices) of a GeoPackage value."""
    if not blob:
        return None, None, None
    order, kind = "<" if blob[3] & 1 else ">", blob[3] >> 1 & 7
    envelope = (0, 32, 48, 48, 64)[kind]
    geometry, _ = parse_wkb(blob, 8 + envelope)
    srs = struct.unpack_from(order + "i", blob, 4)[0]
    if envelope:
        x0, x1, y0, y1 = struct.unpack_from(order + "4d", blob, 8)
        box = (x0, y0, x1, y1)
    else:
        places = [p for part in geometry[1] for p in part]
        box = (min(p[0] for p in places), min(p[1] for p in places), max(p[0] for p in places), max(p[1] for p in places)) if places else None
    return geometry, f"EPSG:{srs}" if srs > 0 else None, box


def parse_gpkg(data: bytes, layer: str | None = None) -> Iterator[tuple[tuple | None, dict[str, str], str | None]]:
    """Features of a GeoPackage, opened in memory, each with its reference system."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    table, column = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns WHERE ? IS NULL OR table_name = ?", (layer, layer)).fetchone()
    cursor = db.execute(f'SELECT * FROM "{table}"')
    names = [c[0] for c in cursor.description]
    for values in cursor:
        row = dict(zip(names, values, strict=True))
        geometry, crs, _ = gpkg_geometry(row.pop(column))
        yield geometry, {k: str(v) for k, v in row.items() if v is not None}, crs
