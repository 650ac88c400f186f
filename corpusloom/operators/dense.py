"""Dense retrieval: inner products of unit vectors, top k, nearness of packages, reuse of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
#: Packages this much below the nearest one aren't asked.
GATE_MARGIN = 0.10


def dot(vector: Column, query: Column | Sequence[float]) -> Column:
    other = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, other, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: Column | Sequence[float], k: int, id_col: str = "passage_id", vector_col: str = "vector") -> DataFrame:
    """The k rows with the largest inner product, ties by id; a partial top k in each task, then one of those."""
    scored = vectors.withColumn("score", F.round(dot(F.col(vector_col), query), DIGITS))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def package_nearness(vectors: DataFrame, query: Column | Sequence[float], package_col: str = "package", vector_col: str = "vector") -> DataFrame:
    """(package, nearness): the best inner product of each package."""
    return vectors.groupBy(package_col).agg(F.max(F.round(dot(F.col(vector_col), query), DIGITS)).alias("nearness"))


def gate(nearness: DataFrame, margin: float = GATE_MARGIN) -> DataFrame:
    """Packages within the margin of the nearest one."""
    best = nearness.agg(F.max("nearness").alias("best"))
    return nearness.crossJoin(F.broadcast(best)).filter(F.round(F.col("best") - F.col("nearness"), DIGITS) <= margin).drop("best")  # best is one row


def reusable(new: DataFrame, old: DataFrame, digest_col: str = "digest") -> tuple[DataFrame, DataFrame]:
    """new's rows whose digest old has, with old's vector (that of the least id), and the rest, which must be encoded."""
    first = old.withColumn("_n", F.row_number().over(Window.partitionBy(digest_col).orderBy("passage_id"))).filter("_n = 1").select(digest_col, "vector")
    return new.join(first, digest_col), new.join(old.select(digest_col), digest_col, "left_anti")
