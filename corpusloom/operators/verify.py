"""Verification of conversions: word-multiset coverage, selection, recovery."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import apart

# Limits of the verdicts.
COVERAGE_OK, COVERAGE_WARN, USABLE = 0.995, 0.970, 0.60
SAMPLE = 25
FEW_TOKENS = 15
LINE_RATIO = 0.5
DIGITS = 6
# What headings, tables and list items add to a text's structure.
STRUCTURE = {r"(?m)^#{1,6}\s+\S": 2, r"(?m)^\s*\|[-: |]+\|\s*$": 5, r"(?m)^\s*[-*+]\s+\S": 1}


def words(text: Column) -> Column:
    """Lower-case tokens, not folded and not split in unspaced scripts."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({T.TOKEN})"), F.lit(1)), lambda t: F.lower(t))


def _counts(reference: Column, markdown: Column) -> Column:
    """array<struct<token, of_ref, n>>: the tokens of both texts, each once for each text."""
    none = F.array().cast("array<struct<token:string,of_ref:boolean,n:bigint>>")
    side = lambda text, of_ref: F.coalesce(F.transform(T.tally(words(text)), lambda t: F.struct(t["item"].alias("token"), F.lit(of_ref).alias("of_ref"), t["n"].alias("n"))), none)
    return F.concat(side(reference, True), side(T.strip_markdown_noise(markdown), False))


def _compared(counts: Column) -> Column:
    """array<struct<token, ref, got>> for the tokens of the reference, inside the row."""
    # Sorted, a token of both texts stands there twice, the reference's right after the other.
    got = lambda b, x, k: T.let(F.get(b, k - 1), lambda y: F.when(y["token"] == x["token"], y["n"]).otherwise(F.lit(0).cast("long")))
    of_ref = lambda b: F.transform(b, lambda x, k: F.when(x["of_ref"], F.struct(x["token"].alias("token"), x["n"].alias("ref"), got(b, x, k).alias("got"))))
    return T.let(F.sort_array(counts), lambda b: F.array_compact(of_ref(b)))


def _own(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("own", _compared(_counts(F.col("reference"), F.col("markdown"))))


def _summed(pairs: DataFrame) -> DataFrame:
    """(doc_id, own): the same over all rows of a doc_id, by a shuffle of their tokens."""
    tokens = pairs.select("doc_id", F.explode(_counts(F.col("reference"), F.col("markdown"))).alias("t")).groupBy("doc_id", "t.token")
    total = lambda of_ref: F.sum(F.when(F.col("t.of_ref") == of_ref, F.col("t.n")).otherwise(0))
    # Without an id nothing tells which conversion is a text's, so none is.
    got = F.when(F.col("doc_id").isNotNull(), total(False)).otherwise(0)
    found = tokens.agg(total(True).alias("ref"), got.alias("got")).filter("ref > 0")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("token", "ref", "got")).alias("own"))


def _by_id(pairs: DataFrame) -> DataFrame:
    """(doc_id, own), one row for each doc_id.

    A document's texts are compared inside its row; only those of rows that share a doc_id, or have none, are shuffled.
    """
    alone, shared = apart(pairs, ("doc_id",))
    found = _own(alone).select("doc_id", "own")
    return found if shared is None else found.unionByName(_summed(shared))


def _most_missing(own: Column, sample: int) -> Column:
    lacking = F.transform(F.filter(own, lambda x: x["got"] < x["ref"]), lambda x: F.struct((x["ref"] - x["got"]).alias("d"), x["token"].alias("t")))
    return F.transform(F.slice(F.sort_array(lacking, asc=False), 1, sample), lambda x: x["t"])


def missing(pairs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, missing_sample): the tokens most missing, one row for each doc_id."""
    return _by_id(pairs).select("doc_id", _most_missing(F.col("own"), sample).alias("missing_sample"))


def deficits(pairs: DataFrame) -> DataFrame:
    """(doc_id, token, ref, got) for the tokens of the reference; pairs has doc_id, reference, markdown."""
    found = _by_id(pairs)
    # Outer, then filtered: else the planner tests for empty arrays first, and makes each one twice.
    return found.select("doc_id", F.inline_outer("own")).filter("ref > 0")


def compare(pairs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each of pairs: coverage, numeric coverage, token counts, status, the tokens most missing.

    Rows that share a doc_id get the figures of all of them but md_tokens.
    """
    produced = lambda df: df.withColumn("md_tokens", F.size(words(T.strip_markdown_noise(F.col("markdown")))).cast("long"))
    alone, shared = apart(pairs, ("doc_id",))
    found = produced(_own(alone)).select("doc_id", "md_tokens", "own")
    if shared is not None:
        found = found.unionByName(produced(shared).select("doc_id", "md_tokens").join(_summed(shared), "doc_id", "left"))
    numbers = F.filter("own", lambda x: x["token"].rlike(r"\p{Nd}"))
    total = lambda own, n: F.when(F.size(own) > 0, F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + n(x)))
    ref, least = lambda x: x["ref"], lambda x: F.least(x["ref"], x["got"])
    both = found.select(
        "doc_id", "md_tokens", F.coalesce(total(F.col("own"), ref), F.lit(0)).alias("ref_tokens"), total(F.col("own"), least).alias("matched"),
        T.let(numbers, lambda own: total(own, ref)).alias("num_ref"), T.let(numbers, lambda own: total(own, least)).alias("num_matched"),
        _most_missing(F.col("own"), sample).alias("missing_sample"),
    )
    both = both.withColumn("measurable", F.col("ref_tokens") > 0).withColumn("coverage", F.round(F.col("matched") / F.col("ref_tokens"), DIGITS))
    both = both.withColumn("numeric_coverage", F.round(F.col("num_matched") / F.col("num_ref"), DIGITS)).withColumn("missing_tokens", F.col("ref_tokens") - F.coalesce("matched", F.lit(0)))
    return both.withColumn("status", status(F.col("coverage"), F.col("numeric_coverage"))).select(
        "doc_id", "measurable", "status", "coverage", "numeric_coverage", "ref_tokens", "md_tokens", "missing_tokens", F.coalesce("missing_sample", F.array().cast("array<string>")).alias("missing_sample")
    )


def status(coverage: Column, numeric: Column) -> Column:
    whole = F.when(coverage >= COVERAGE_OK, "ok").when(coverage >= COVERAGE_WARN, "warn").otherwise("fail")
    return F.when(coverage.isNull(), "no-reference").when((whole == "ok") & (numeric < COVERAGE_WARN), "warn").otherwise(whole)


def final_status(state: Column, md_tokens: Column, engine_read: Column) -> Column:
    """no-reference becomes unread under a few tokens, only-ocr otherwise if an engine read the file."""
    return F.when((state == "no-reference") & (md_tokens < FEW_TOKENS), "unread").when((state == "no-reference") & engine_read, "only-ocr").otherwise(state)


def structure(markdown: Column) -> Column:
    """2 x headings + 5 x tables + list items."""
    return reduce(add, (F.regexp_count(markdown, F.lit(p)) * n for p, n in STRUCTURE.items()))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Of each doc_id's attempts (engine, markdown, coverage, measurable) the best: usable, structured, covered, long."""
    usable = F.when(F.col("measurable"), F.col("coverage") >= USABLE).otherwise(F.col("markdown").rlike(r"\S"))
    rank = Window.partitionBy("doc_id").orderBy(usable.cast("int").desc(), structure(F.col("markdown")).desc(), F.coalesce("coverage", F.lit(0.0)).desc(), F.length("markdown").desc(), "engine")
    return attempts.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")


def good_enough(state: Column, usable: Column, structured: Column, engine: Column, unresolved: Column) -> Column:
    resolved = F.coalesce(F.size(unresolved) == 0, F.lit(False))
    return (state == "ok") & usable & (structured > 0) & (engine.startswith("layout") | (engine == "hybrid") | resolved)


def judged(reference: str, markdown: str) -> dict:
    """The verdict on one conversion, where it is made: status, coverage, usable, structured."""
    count = lambda s: Counter(t.lower() for t in T._TOKEN_PY.findall(s))
    want, got = count(reference), count(re.sub(T.MARKDOWN_NOISE, " ", markdown))

    def share(wanted: Counter) -> float | None:
        return round((wanted & got).total() / wanted.total(), DIGITS) if wanted else None

    coverage, numeric = share(want), share(Counter({t: n for t, n in want.items() if any(c.isdecimal() for c in t)}))
    if coverage is None:
        state = "no-reference"
    elif coverage < COVERAGE_OK:
        state = "warn" if coverage >= COVERAGE_WARN else "fail"
    else:
        state = "warn" if numeric is not None and numeric < COVERAGE_WARN else "ok"
    usable = bool(markdown.strip()) if coverage is None else coverage >= USABLE
    return {"status": state, "coverage": coverage, "usable": usable, "structured": sum(n * len(re.findall(p, markdown)) for p, n in STRUCTURE.items())}


def recovered(reference: str, markdown: str, ratio: float = LINE_RATIO) -> tuple[list[str], list[str]]:
    """Lines of the reference that supply missing tokens, in order, and the tokens still missing, sorted."""
    tokens = lambda s: Counter(t.lower() for t in T._TOKEN_PY.findall(s))
    short = tokens(reference) - tokens(re.sub(T.MARKDOWN_NOISE, " ", markdown))
    lines = []
    for line in map(str.strip, reference.splitlines()):
        own = tokens(line) if short and line else Counter()
        if own and (own & short).total() >= ratio * own.total():
            lines.append(line)
            short -= own
    return lines, sorted(short.elements())


def recovery(pairs: DataFrame) -> DataFrame:
    """(doc_id, lines, fragments): order-dependent within one document, so in batches of whole rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *recovered(r or "", m or "")) for i, r, m in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["doc_id", "lines", "fragments"])

    return pairs.select("doc_id", "reference", "markdown").mapInPandas(run, "doc_id long, lines array<string>, fragments array<string>")
