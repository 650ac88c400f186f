"""Passages and the tables of an inverted index: postings, document frequencies, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import apart


def passages(docs: DataFrame, splitter: str = "blank_line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' other columns, position and text, a row for each passage. Splitters: blank_line, block, line."""
    others = [c for c in docs.columns if c not in (text_col, "position")]
    found = docs.select(*others, F.posexplode(T.SPLITTERS[splitter](F.col(text_col))).alias("position", "text"))
    return found if id_col == "doc_id" else found.withColumnRenamed(id_col, "doc_id")


def tokenized(parts: DataFrame) -> DataFrame:
    """parts with the normalised text, its tokens and their number."""
    found = parts.withColumn("_found", T.let(T.normalize(F.col("text")), lambda n: F.struct(n.alias("norm"), T.tokens(n).alias("tokens"))))
    return found.select(*parts.columns, "_found.norm", "_found.tokens", F.size("_found.tokens").alias("length"))


def postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, position, tf, length): one row for each term of each passage, counted inside the passage's row.

    Only passages that share doc_id and position, or lack one, are counted by a shuffle, as one passage each; length is that of the longest.
    """
    alone, shared = apart(tokens.select("doc_id", "position", "length", "tokens"), ("doc_id", "position"))
    # Outer, then filtered: else the planner tests for empty arrays first, and counts each passage twice.
    found = alone.select("doc_id", "position", "length", F.inline_outer(T.tally(F.col("tokens")))).filter("n > 0")
    found = found.select(F.col("item").alias("term"), "doc_id", "position", F.col("n").alias("tf"), "length")
    if shared is None:
        return found
    counted = shared.select("doc_id", "position", "length", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "position").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    return found.unionByName(counted)


def term_frequencies(tokens: DataFrame, minimum: int = 3) -> DataFrame:
    """(term, passages): in how many passages each searchable term stands."""
    term = F.col("term")
    worth = (F.length(term) >= minimum) | ((F.length(term) == 1) & term.rlike(T.UNSPACED))
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).filter(worth).groupBy("term").agg(F.count("*").alias("passages"))


def statistics(tokens: DataFrame, empty_length: float = 60.0) -> DataFrame:
    """One row: n, average_length."""
    return tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(empty_length)).alias("average_length"))


def corpus_stopwords(docs: DataFrame, threshold: float = 0.6, text_col: str = "text") -> DataFrame:
    """(term): terms that a share of the documents hold (two at least), and the markers of every language."""
    terms = docs.select(F.explode(F.array_distinct(T.searchable_terms(T.normalize(F.col(text_col))))).alias("term"))
    limit = docs.agg(F.greatest(F.lit(2), F.floor(F.count("*") * threshold)).alias("least"))
    common = terms.groupBy("term").count().crossJoin(F.broadcast(limit)).filter("count >= least").select("term")  # limit is one row
    markers = docs.sparkSession.createDataFrame([(m,) for m in sorted(T.ALL_MARKERS)], "term string")
    return common.union(markers).distinct()
