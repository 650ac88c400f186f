"""Quality rules: counts within a document, and line frequency across the documents of a host.

Built-in functions only. The counts come from arrays inside each row. The
cross-document rule hashes normalised lines (lower case, white space
collapsed, digits as 0), counts the distinct documents of a host (its distinct
texts, so copies of one document count once) that hold each line, removes
lines above the limit, and rejects a document when too few words are left.

The limit is a number of documents, LINE_DOCS, so it doesn't grow with a host.

Lines are staged once as narrow rows (host, document, line), counted
with pre-aggregation, and the frequent (host, line) pairs are joined to them
again: broadcast if their bytes are few, shuffled if not, where the engine
splits hot pairs. What comes back to the documents is a row for each distinct
(host, text) that holds a frequent line.

Rows: null text counts as empty (no words, so the base rules reject it). A
null host is a host of its own. Repeated rows each get the same verdict, and so
do rows equal in id alone, each for its own text. An empty table gives an empty
result. Other columns are carried, whatever their names; `judge` adds
`quality`, in place of a column so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, private, sized_broadcast
from .native import WORD_START, let, lines, total, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is above the limit if more distinct texts of the host hold it.
LINE_DOCS = 30
#: A document is depleted if a smaller share of its words is left, or fewer than MIN_WORDS.
KEEP_SHARE = 0.3


def repeated_words(ws: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of `size` words that occur twice or more; ws is an array of words."""

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        starts = let(by_hash, lambda s: F.sort_array(F.array_compact(F.transform(s, lambda e, j: F.when(same(s, e, j - 1) | same(s, e, j + 1), e["i"])))))
        return let(starts, lambda p: total(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))))

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    windows = let(ws, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))
    return F.when(F.size(ws) < size, F.lit(0).cast("long")).otherwise(let(windows, of_hashes))


def base_counts(text: Column) -> Column:
    """Struct of the counts within one text."""

    def counts(ws: Column) -> Column:
        worded = F.filter(lines(text), lambda line: line.rlike(WORD_START))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(worded, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
        )

    return let(words(text), counts)


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def line_key(line: Column) -> Column:
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "), "[0-9]", "0"))
    return F.xxhash64(tidy)


def keyed_lines(text: Column) -> Column:
    """array<struct<key, words>> of the lines that have a word."""
    worded = F.filter(lines(text), lambda line: line.rlike(WORD_START))
    return F.transform(worded, lambda line: F.struct(line_key(line).alias("key"), F.size(words(line)).alias("words")))


def frequent_lines(docs: DataFrame, text_col: str, host_col: str, line_docs: int, stage: Staging) -> DataFrame:
    """(host, doc, frequent): for each distinct text of a host with lines above the limit, its MD5 and their keys."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = docs.select(F.col(f"`{host_col}`").alias("host"), text.alias("text"), F.md5(text).alias("doc"))
    keys = F.array_distinct(F.transform(F.filter(lines(F.col("text")), lambda line: line.rlike(WORD_START)), line_key))
    held = stage(named.select("host", "doc", F.explode(keys).alias("key")), "lines")
    per_line = held.distinct().groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") > line_docs)
    above = stage(per_line.select(F.col("host").alias("of_host"), F.col("key").alias("of_key")), "frequent-lines")
    hits = held.join(sized_broadcast(above), F.col("host").eqNullSafe(F.col("of_host")) & (F.col("key") == F.col("of_key")))
    return hits.groupBy("host", "doc").agg(F.collect_set("key").alias("frequent"))


def _verdict(text: Column, gone: Column, keep_share: float) -> Column:
    """The counts and verdicts of a row; gone holds the keys of its lines above the limit (null: none)."""
    left = total(F.transform(F.filter(keyed_lines(text), lambda e: ~F.array_contains(gone, e["key"])), lambda e: e["words"]))
    left = F.when(gone.isNotNull(), left)

    def verdict(c: Column) -> Column:
        failed = base_failed(c)
        depleted = let(left, lambda n: F.coalesce((n < MIN_WORDS) | (n < keep_share * c["n_words"]), F.lit(False)))
        return F.struct(*[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))

    return let(base_counts(text), verdict)


def _with_frequent(docs: DataFrame, text_col: str, host_col: str, line_docs: int, gone: str) -> DataFrame:
    """docs with a column more: the keys of the row's lines above the limit, or null."""
    of_host, of_doc = private(docs.withColumn(gone, F.lit(None)), "of_host", "of_doc")
    stage = Staging()
    marks = frequent_lines(docs, text_col, host_col, line_docs, stage).toDF(of_host, of_doc, gone)
    marks = stage(marks, "frequent-of-texts")
    stage.drop(marks)
    same = F.col(f"`{host_col}`").eqNullSafe(F.col(of_host)) & (F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col(of_doc))
    return docs.join(sized_broadcast(marks), same, "left").drop(of_host, of_doc)


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """docs with one more column, `quality`: counts, base_failed and kept."""
    (gone,) = private(docs, "gone")
    found = _with_frequent(docs, text_col, host_col, line_docs, gone)
    verdict = _verdict(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(gone), keep_share)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "quality"], verdict.alias("quality"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: the id, the counts and the verdicts."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(plain).select("doc_id", *[F.col(f"quality.{k}") for k in names])


def filtered(docs: DataFrame, text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The kept rows with docs' own columns; lines above the limit are taken out of their texts."""
    (gone,) = private(docs, "gone")
    text = F.col(f"`{text_col}`")
    found = _with_frequent(docs, text_col, host_col, line_docs, gone)
    kept = found.filter(_verdict(F.coalesce(text, F.lit("")), F.col(gone), keep_share)["kept"])
    rest = F.array_join(F.filter(lines(text), lambda line: ~(line.rlike(WORD_START) & F.array_contains(F.col(gone), line_key(line)))), "\n")
    return kept.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(rest)).drop(gone)
