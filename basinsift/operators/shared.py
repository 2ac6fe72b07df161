"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the session's checkpoint folder; on a local master that has neither, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        where = tempfile.mkdtemp(prefix="basinsift-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: cuts lineage, survives lost executors; removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/basinsift/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly to as many tasks as the session shuffles to or runs at once; for work that is long beside the size of its rows."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def map_lists(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType) -> DataFrame:
    """Maps batches, given and returned as lists by column name; nested values are lists and dicts."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [(f.name, to_arrow_type(f.dataType)) for f in kind.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)})
            yield pa.record_batch([pa.array(out[n], t) for n, t in fields], [n for n, _ in fields])

    return df.mapInArrow(run, kind)


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of one key above which ``join_spread`` deals them out.
SPREAD_ROWS = 100_000


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", rows: int = SPREAD_ROWS) -> DataFrame:
    """A join whose left side may hold very many rows of one key: these are dealt out by a hash, and the right side's rows of the key repeated.

    Keys of more than ``rows`` rows are looked for first; there are no more than the left side's rows divided by ``rows``.
    """
    hot = materialize(left.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > rows).withColumn("__parts", F.ceil(F.col("__n") / rows).cast("int")).drop("__n"), "hot")
    if hot.isEmpty():
        return left.join(right, keys, how)
    few = F.broadcast(hot)
    dealt = left.join(few, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copied = right.join(few, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")
