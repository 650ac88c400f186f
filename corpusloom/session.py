"""SparkSession with the settings this engine is written for."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that hold at any size; partition sizes are the cluster's business.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "corpusloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one is only taken with a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_STORED: dict[tuple[str, ...], str] = {}


def stored(spark: SparkSession, key: tuple[str, ...], make) -> DataFrame:
    """The table that make() gives, written to the shared folder once for each key and application, then read."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


#: Keys, of a few bytes each, that may be broadcast.
BROADCAST_KEYS = 500_000


def apart(df: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """df's rows whose keys no other row has, and the rest: keys of several rows, or null; None if there are none.

    Only the keys are counted, in a job of their own; the rest of a row isn't shuffled as long as few keys are shared.
    """
    whole = [F.col(k).isNotNull() for k in keys]
    known = reduce(and_, whole)
    shared = df.select(*keys).groupBy(*keys).agg(F.count("*").alias("_rows")).filter((F.col("_rows") > 1) | ~known).select(*keys)
    found = shared.limit(BROADCAST_KEYS + 1).count()
    if not found:
        return df, None
    rows = shared.filter(known)
    rows = F.broadcast(rows) if found <= BROADCAST_KEYS else rows
    return df.filter(known).join(rows, list(keys), "left_anti"), df.filter(known).join(rows, list(keys), "left_semi").unionByName(df.filter(~known))
