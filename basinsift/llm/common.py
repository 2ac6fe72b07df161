"""Shared plumbing of the training-data operators: shared folder, splits, Arrow batch bounds."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch, and of the texts of one portion of it; they keep a Python worker's memory small with long documents.
BATCH_BYTES, PORTION_BYTES = 8 << 20, 4 << 20

_LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def lower_ascii(data: bytes) -> bytes:
    """A-Z to a-z in UTF-8 bytes; every other byte stays."""
    return data.translate(_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where unset, on a local master, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        where = tempfile.mkdtemp(prefix="basinsift-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/basinsift/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame, collect: bool = True) -> None:
    """Removes materialized tables that are read no more; with ``collect`` the driver also drops the files of past shuffles."""
    spark = frames[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for df in frames for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    if collect:
        gc.collect()
        jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, unless a smaller bound is set; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and int(now) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def portions(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some ``PORTION_BYTES`` of texts each; the last text of a slice may exceed that."""
    column = batch.column(text)
    sizes = np.cumsum([0, *pc.fill_null(pc.binary_length(column), 0).to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + PORTION_BYTES, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def least_within(df: DataFrame, hashed: Column, *bounds: tuple[Column, int]) -> DataFrame:
    """All rows, or those with the least of a 64-bit hash, so that the sum of each column stays within its bound.

    The sums of 4096 equal parts of the range that should hold twice as much come to the driver; no task
    sees more than its share of rows.
    """
    totals = df.agg(*(F.sum(c) for c, _ in bounds)).first()
    share = min((most / (t or 1) for t, (_, most) in zip(totals, bounds, strict=True)), default=1)
    if share >= 1 or share <= 0:
        return df if share >= 1 else df.filter("false")
    part = F.floor(F.shiftrightunsigned(hashed, 11) / F.lit(2.0**53 * min(1, 2 * share)) * 4096)
    sums = df.filter(part < 4096).groupBy(part.alias("part")).agg(*(F.sum(c).alias(f"s{k}") for k, (c, _) in enumerate(bounds)))
    held, cut = [0] * len(bounds), 4096
    for p, *more in sorted(sums.collect()):
        held = [a + (b or 0) for a, b in zip(held, more, strict=True)]
        if any(h > most for h, (_, most) in zip(held, bounds, strict=True)):
            cut = p
            break
    return df.filter(part < cut)


def greatest_within(df: DataFrame, count: str, rows: int) -> DataFrame:
    """Rows with the greatest counts, ``rows`` at most; the bounds tried are an eighth of a power of two apart."""
    step = F.floor(F.log2(F.col(count)) * 8).cast("int")
    total, cut = 0, None
    for part, n in sorted(df.groupBy(step.alias("part")).agg(F.count("*")).collect(), reverse=True):  # some 500 rows at most
        total += n
        if total > rows:
            break
        cut = part
    return df.filter(step >= cut) if cut is not None else df.limit(0)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def remainder_py(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_text_score(docs: DataFrame, name: str, scorer: Callable[[], Callable[[list[str | None]], Iterable[float]]]) -> DataFrame:
    """Adds a score of each row's whole text.  ``scorer`` makes, once in each task, the function that scores a list of texts."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index("text")
    schema = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in docs.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in (p for b in batches for p in portions(b, at)):
            found = pa.array(score(batch.column(at).to_pylist()), pa.float64())
            yield pa.record_batch([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(run, f"{schema}, `{name}` double")
