"""Helpers shared by the corpus operators: table access, staged tables and Arrow columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder; on a cluster that
    would be a machine-local path, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch, so that a Python worker's memory doesn't grow with the length of texts.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)([kmgtp]?)", spark.conf.get(key, "64m").lower()).groups()
    if int(number) << 10 * (" kmgtp".index(unit or " ")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def release_memory() -> None:
    """Give a Python worker's free memory back, so that it doesn't hold its peak while other stages run."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: short lineage, safe against lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table written by staged() that nothing will read again."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bytes of a table, in memory, that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row besides its values, when it is held in a hash table.
_ROW_BYTES = 64


def _bytes(df: DataFrame) -> Column:
    """What a row takes in memory: its fixed-size values, its strings and the elements of its arrays."""
    parts = [F.lit(_ROW_BYTES).cast("long")]
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, ArrayType):
            parts.append(F.lit(16 if isinstance(kind.elementType, StructType) else 8) * F.coalesce(F.size(F.col(f"`{field.name}`")), F.lit(0)))
        elif isinstance(kind, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)))
        else:
            parts.append(F.lit(8))
    return reduce(lambda a, b: a + b, parts)


def sized_broadcast(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its summed bytes are few; a larger one is left to a shuffled join. For staged tables, which are cheap to read twice."""
    held = df.agg(F.sum(_bytes(df))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def private(docs: DataFrame, *labels: str) -> list[str]:
    """A column name for each label that none of docs' own columns has, in any case."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for label in labels:
        name = f"_{label}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


class Staging:
    """The staged tables of one operator's run. Those in between are deleted by drop(), once nothing will read them again."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.held.append(staged(df, label))
        return self.held[-1]

    def drop(self, *kept: DataFrame) -> None:
        for df in self.held:
            if not any(df is k for k in kept):
                drop_staged(df)
        self.held = [df for df in self.held if any(df is k for k in kept)]
