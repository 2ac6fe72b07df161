"""Sources: file discovery, CSV with unknown encoding, census exports, shapefiles, GeoPackages, workbooks."""

from __future__ import annotations

import io
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.functions import codes
from basinsift.operators.frames import unique_names
from basinsift.sources import vector
from basinsift.sources.formats import code_page, parse_dbf, parse_gpkg, parse_shp

FEATURES = vector.FEATURES
ENCODINGS = ("utf-8-sig", "latin1")
_COLUMNS = ["source_path", "feature_id", "geometry", "attributes", "crs", "error"]


def discover(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Sorted paths below ``root`` whose file name matches a glob; listed by the driver through Hadoop."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found, walk = [], files.listFiles(path, True)
    glob = re.compile(re.escape(pattern).replace(r"\*", ".*").replace(r"\?", "."), re.IGNORECASE)
    while walk.hasNext():
        each = walk.next().getPath()
        if glob.fullmatch(each.getName()):
            found.append(each.toString())
    return sorted(found)


def first_of(spark: SparkSession, root: str, pattern: str) -> str:
    found = discover(spark, root, pattern)
    if not found:
        raise FileNotFoundError(f"no {pattern} below {root}")
    return found[0]


def encodings(spark: SparkSession, path: str) -> dict[str, str]:
    """Encoding of each text file of a path: UTF-8 if all of its lines are, else Latin-1.

    Lines are tested by ranges of the files, so no file is loaded whole; an empty file has no lines and is not listed.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("ok"))
    return {r["path"]: ENCODINGS[0] if r["ok"] else ENCODINGS[1] for r in lines.groupBy("path").agg(F.bool_and("ok").alias("ok")).collect()}  # one row for each file


def sniff(spark: SparkSession, path: str) -> str:
    """The encoding that all files of a path fit."""
    return ENCODINGS[0] if set(encodings(spark, path).values()) <= {ENCODINGS[0]} else ENCODINGS[1]


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file, or all of a folder, each file in its own encoding."""
    found = encodings(spark, path)
    frames = []
    for name, charset in zip(ENCODINGS, ("UTF-8", "ISO-8859-1"), strict=True):
        files = sorted(f for f, e in found.items() if e == name)
        if files or not found and name == ENCODINGS[0]:
            # A single file or encoding is read by the given path, which may be a folder with partition columns.
            df = spark.read.csv(path if len(files) == len(found) else files, header=True, encoding=charset, multiLine=True, escape='"', **options)
            frames.append(df.toDF(*(c.removeprefix("\ufeff").removeprefix("ï»¿") for c in df.columns)))
    return union_by_name(frames)


def sidecar_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """The CSV of the same stem, if there is one."""
    root, _, name = path.rpartition("/")
    found = discover(spark, root, name.rpartition(".")[0] + ".csv")
    return read_csv(spark, found[0]) if found else None


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    root, _, name = path.rstrip("/").rpartition("/")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None


def read_census(spark: SparkSession, path: str, preamble: int = 4, year: str = "ano_censal") -> DataFrame:
    """Census export: preamble lines, clean headers, no unnamed columns, rows whose year is a number."""
    encoding = "UTF-8" if sniff(spark, path) == "utf-8-sig" else "ISO-8859-1"
    lines = spark.read.csv(path, header=False, encoding=encoding, sep="\x01", quote="", schema="value string")
    head = [r["value"] or "" for r in lines.limit(preamble + 1).collect()]  # a few lines of one file
    header = next(pd.read_csv(io.StringIO(head[preamble].removeprefix("﻿")), header=None).itertuples(index=False))
    names = unique_names(["" if pd.isna(c) else c for c in header])
    rows = spark.read.csv(path, header=False, encoding=encoding, schema=", ".join(f"`{n}` string" for n in names))
    rows = rows.select(*(F.regexp_replace(c, "\x00", "").alias(c) for c in names if not c.startswith(("unnamed", "columna"))))
    return rows.filter(codes.safe_number(F.col(year)).isNotNull()).dropna(how="all")


def _features(path: str, features: Iterable[tuple[tuple | None, dict, str | None]]) -> pd.DataFrame:
    rows = []
    for k, (geometry, attributes, crs) in enumerate(features):
        shape = None if geometry is None else {"type": geometry[0], "parts": [[{"x": float(x), "y": float(y)} for x, y in part] for part in geometry[1]]}
        rows.append((path, k, shape, attributes, crs, None))
    return pd.DataFrame(rows, columns=_COLUMNS)


def _broken(path: str, error: Exception) -> pd.DataFrame:
    return pd.DataFrame([(path, None, None, None, None, f"{type(error).__name__}: {error}")], columns=_COLUMNS)


def read_shapefiles(spark: SparkSession, root: str, bbox: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, records: int = vector.RECORDS) -> DataFrame:
    """Features of all shapefiles below a folder, read by ranges of records; a file or range that cannot be read is a row with its error.

    Attributes are decoded as the ``.cpg`` file says; ``crs`` is the text of the ``.prj`` file, or null.  With ``bbox`` only
    features whose box meets it are decoded, with ``columns`` only those attributes.
    """
    files = discover(spark, root, "*.shp")
    if all(map(vector.reachable, files)):
        return vector.load(spark, "shp", files, bbox, columns, records)
    return vector.within(_whole_shapefiles(spark, root), bbox, columns)


def _whole_shapefiles(spark: SparkSession, root: str) -> DataFrame:
    """The same in stores that only Spark reaches: each file is loaded whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{shp,dbf,cpg,prj}").load(root)
    stem, kind = F.regexp_replace("path", r"\.[^.]*$", ""), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    of = [F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("shp", "dbf", "cpg", "prj")]
    pairs = files.select(stem.alias("stem"), kind.alias("kind"), "content").groupBy("stem").agg(*of).filter("shp IS NOT NULL")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stem, shp, dbf, cpg, prj in frame.itertuples(index=False):
                try:
                    shapes = parse_shp(bytes(shp))
                    rows = parse_dbf(bytes(dbf), code_page(cpg and bytes(cpg))) if dbf is not None else [{}] * len(shapes)
                    crs = bytes(prj).decode("utf-8", "replace").strip() if prj is not None else None
                    yield _features(stem + ".shp", ((shape, row, crs) for shape, row in zip(shapes, rows, strict=True)))
                except (struct.error, ValueError, IndexError) as error:
                    yield _broken(stem + ".shp", error)

    return pairs.mapInPandas(run, FEATURES)


def read_geopackages(
    spark: SparkSession, root: str, layer: str | None = None, bbox: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, records: int = vector.RECORDS
) -> DataFrame:
    """Features of a layer (the first one) of all GeoPackages below a folder, read by ranges of row ids; otherwise as ``read_shapefiles``."""
    files = discover(spark, root, "*.gpkg")
    if all(map(vector.is_local, files)):
        return vector.load(spark, "gpkg", files, bbox, columns, records, layer)
    return vector.within(_whole_geopackages(spark, root, layer), bbox, columns)


def _whole_geopackages(spark: SparkSession, root: str, layer: str | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gpkg").load(root).select("path", "content")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                try:
                    yield _features(path, parse_gpkg(bytes(content), layer))
                except (sqlite3.Error, struct.error, TypeError) as error:
                    yield _broken(path, error)

    return files.mapInPandas(run, FEATURES)


def with_provenance(df: DataFrame, layer_type: str) -> DataFrame:
    """Path, file, folder and layer type of each row from its ``source_path``."""
    path = F.col("source_path")
    return df.withColumns({"source_file": F.regexp_extract(path, r"([^/\\]*)$", 1), "source_folder": F.regexp_extract(path, r"([^/\\]*)[/\\][^/\\]*$", 1), "layer_type": F.lit(layer_type)})


def read_workbook(data: bytes, sheet: str | None = None) -> list[list[str]]:
    """Cell texts of a workbook's named sheet, or of its first one."""
    book = zipfile.ZipFile(io.BytesIO(data))
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(".//m:sheet", ns)]
    at = names.index(sheet) if sheet in names else 0
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", ns)) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
    rows = []
    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{at + 1}.xml")).iterfind(".//m:row", ns):
        cells: list[str] = []
        for c in row.iterfind("m:c", ns):
            column = 0
            for letter in re.match("[A-Z]*", c.get("r", "")).group():
                column = column * 26 + ord(letter) - 64
            column = column or len(cells) + 1  # cells without a place follow one another
            value = c.findtext("m:v", "", ns)
            text = "".join(t.text or "" for t in c.iterfind(".//m:t", ns)) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" else value
            cells += [""] * (column - 1 - len(cells)) + [text]
        rows.append(cells)
    return rows


def read_templates(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Review templates by region; missing files are skipped."""
    return {region: read_csv(spark, path) for region, path in paths.items() if discover(spark, path.rpartition("/")[0], path.rpartition("/")[2])}


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
