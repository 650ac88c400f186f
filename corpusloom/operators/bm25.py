"""BM25 over passages, summed per document, interleaved by document.

A query has few terms, so nothing is exploded: each passage counts the query's
terms in its token array, one aggregate gives the statistics (a single row),
and only passages with a term go on to the windows. Of a passage without a
term the statistics need the length alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

# Fixed values of the ranking.
K1, B = 1.5, 0.45
TOP_PASSAGES = 8
#: Scores are rounded before they are ordered, so equal ones tie on every engine.
DIGITS = 6


def term_counts(terms: list[str]) -> Column:
    """array<int>: how often each term stands in column tokens."""
    if not terms:
        return F.array().cast("array<int>")
    names = F.array(*[F.lit(t) for t in terms])
    return let(F.filter("tokens", lambda t: t.isin(*terms)), lambda held: F.transform(names, lambda term: F.size(F.filter(held, lambda t: t == term))))


def counted(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """What questions of these terms need of tokens: tf for norm and tokens, and the text only where a term stands."""
    found = tokens.withColumn("tf", term_counts(terms))
    return found.withColumn("text", F.when(F.exists("tf", lambda f: f > 0), F.col("text"))).drop("norm", "tokens")


def scored(tokens: DataFrame, terms: list[str], minimum_terms: int = 1, empty_length: float = 1.0) -> DataFrame:
    """Passages that hold enough of the terms, with score and the terms that they hold.

    tokens: as index.tokenized gives them, or counted for the same terms; the statistics are those of all its rows.
    """
    rows = tokens.withColumn("tf", term_counts(terms)) if "tokens" in tokens.columns else tokens
    sums = [F.coalesce(F.sum((F.col("tf")[k] > 0).cast("long")), F.lit(0)) for k in range(len(terms))]
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(empty_length)).alias("average_length"), F.array(*sums).cast("array<double>").alias("df"))
    idf = F.transform("df", lambda df: F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)))
    stats = stats.select("average_length", idf.alias("idf"))
    held = F.size(F.filter("tf", lambda f: f > 0))
    hit = rows.filter((held >= min(minimum_terms, len(terms))) & (held > 0)).crossJoin(F.broadcast(stats))  # stats is one row
    norm = K1 * (1 - B + B * F.greatest(F.col("length"), F.lit(1)) / F.col("average_length"))
    parts = F.zip_with("tf", "idf", lambda f, w: w * (f * (K1 + 1)) / (f + norm))
    names = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    present = F.filter(F.zip_with(names, F.col("tf"), lambda t, f: F.when(f > 0, t)), lambda t: t.isNotNull())
    score = F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), DIGITS)
    return hit.withColumn("score", score).withColumn("terms", present).drop("tf", "idf", "average_length")


def document_scores(hits: DataFrame, terms: int, keep: int = TOP_PASSAGES) -> DataFrame:
    """hits with rank in the document and doc_score: the best passages' sum times the share of terms matched."""
    own = Window.partitionBy("doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "position")))
    best = F.sum(F.when(F.col("rank") <= keep, F.col("score"))).over(own)
    share = F.max(F.size("terms")).over(own) / max(terms, 1)
    return ranked.withColumn("doc_score", F.round(best * share, DIGITS))


def interleaved(ranked: DataFrame, limit: int | None = None, preferred: Column | None = None) -> DataFrame:
    """Every document's best passage first, then the second ones, documents by score; preferred ones before all."""
    first = [preferred.asc_nulls_last()] if preferred is not None else []
    ordered = ranked.filter(F.col("rank") <= TOP_PASSAGES).orderBy("rank", *first, F.desc("doc_score"), "doc_id")
    return ordered.limit(limit) if limit is not None else ordered
