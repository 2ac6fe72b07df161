"""Paths of source files as columns; both kinds of slashes separate folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative(path: Column, root: str) -> Column:
    """The path below a folder; the whole path where it is not below."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(_plain(path), F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def file_name(path: Column) -> Column:
    return F.regexp_extract(_plain(path), "([^/]*)$", 1)


def origin_folder(path: Column, root: str) -> Column:
    """The file's folder below a root (``.`` for the root itself); elsewhere the name of its folder."""
    plain, root = _plain(path), root.rstrip("/") + "/"
    folder = F.regexp_extract(plain, "^(.*)/[^/]*$", 1)
    below = F.substring(F.concat(folder, F.lit("/")), F.lit(len(root) + 1), F.length(folder))
    inside = F.coalesce(F.nullif(F.rtrim(below, F.lit("/")), F.lit("")), F.lit("."))
    return F.when(F.startswith(plain, F.lit(root)), inside).otherwise(F.regexp_extract(folder, "([^/]*)$", 1))
