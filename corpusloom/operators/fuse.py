"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
DIGITS = 9


def placed(hits: DataFrame, order: list[Column], list_id: int, partition: tuple[str, ...] = ()) -> DataFrame:
    """hits with place (from 1, by order) and list_id; hits are a limited list, or limited within each partition."""
    place = F.row_number().over(Window.partitionBy(*(partition or (F.lit(0),))).orderBy(*order))
    return hits.withColumn("place", place).withColumn("list_id", F.lit(list_id))


def fuse(lists: DataFrame, keys: tuple[str, ...], k: int = RRF_K) -> DataFrame:
    """(keys, score, position): sum of 1 / (k + place), best first; ties by list and place of the first appearance."""
    summed = lists.groupBy(*keys).agg(F.round(F.sum(1.0 / (k + F.col("place"))), DIGITS).alias("score"), F.min(F.struct("list_id", "place")).alias("first"))
    position = F.row_number().over(Window.orderBy(F.desc("score"), "first", *keys))  # limited lists only: limit each before fusing
    return summed.withColumn("position", position).select(*keys, "score", "position")
