"""Shared helpers: scratch tables in the shared checkpoint folder and columns with safe names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session. Only a session of a single machine may go without: it
    gets a temporary one. On a cluster, executors would write to folders that no other can see."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. Sweep ``tessera-*`` there by age once results are stored."""
    return f"{scratch_root(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def parts(spark: SparkSession, rows: int, each: int = 5000) -> int:
    """Partitions for so many rows: in proportion to them, and enough for all cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def materialize(df: DataFrame, name: str, n_parts: int | None = None) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: lineage is cut, and a
    lost executor costs a reread instead of a recomputation. ``n_parts`` bounds the number of files
    where the last shuffle has many small partitions."""
    path = scratch_path(df.sparkSession, name)
    df = df.coalesce(n_parts) if n_parts else df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_id(column: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A plain string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def trim() -> None:
    """Give the system back what this Python process has freed: its worker serves other stages for as long
    as the executor lives, and the C library else keeps the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of mapInArrow whose worker is trimmed when a task is over."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


#: Bits of a sieve; as 64-bit words they are at most 131,072 rows.
SIEVE_BITS = 1 << 23


def sieve(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split df by its key into rows whose key may be among those of ``wanted`` (its only column) and
    rows whose key is surely not. A bitmap of fixed size is broadcast, whatever the number of keys, so
    that rows surely out need no shuffle; the others need an exact join."""
    name = wanted.columns[0]
    slot = lambda c: f"pmod(xxhash64(`{c}`), {SIEVE_BITS}L)"
    words = wanted.selectExpr(f"{slot(name)} as s").groupBy(F.expr("shiftright(s, 6)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("_bits"))
    joined = df.join(F.broadcast(words), F.expr(f"shiftright({slot(key)}, 6)") == F.col("_word"), "left")
    hit = F.expr(f"coalesce(shiftright(_bits, cast({slot(key)} & 63 as int)) & 1, 0) = 1")
    return joined.filter(hit).select(*[F.col(f"`{c}`") for c in df.columns]), joined.filter(~hit).select(*[F.col(f"`{c}`") for c in df.columns])
