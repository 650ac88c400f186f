"""Literal phrases, context and the union of literal and ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_string


def literal_hits(tokens: DataFrame, phrase: str) -> DataFrame:
    """Passages whose normalised text holds the phrase; none for an empty phrase."""
    needle = normalize_string(phrase)
    return tokens.filter(F.contains(F.col("norm"), F.lit(needle)) if needle else F.lit(False))


def preferred_documents(hits: DataFrame) -> DataFrame:
    """(doc_id, preferred): documents with a literal hit, by id from 1."""
    ids = hits.select("doc_id").distinct()
    return ids.select("doc_id", F.col("doc_id").alias("preferred"))


def with_context(parts: DataFrame, reach: int = 1) -> DataFrame:
    """parts with context: the passage and `reach` neighbours on each side, joined by blank lines."""
    near = Window.partitionBy("doc_id").orderBy("position").rowsBetween(-reach, reach)
    return parts.withColumn("context", F.array_join(F.collect_list("text").over(near), "\n\n"))


def first_of_each(hits: DataFrame, order: list[Column], prefix: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of hits with the same keys and first `prefix` characters of text, the first by order."""
    same = Window.partitionBy(*keys, F.substring("text", 1, prefix)).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")


def literal_first(literal: DataFrame, ranked: DataFrame, prefix: int = 80) -> DataFrame:
    """Union without repeats, literal hits before ranked ones; both have doc_id, position, text and place."""
    both = literal.withColumn("engine", F.lit(0)).unionByName(ranked.withColumn("engine", F.lit(1)))
    return first_of_each(both, [F.col("engine"), F.col("place"), F.col("position")], prefix)
