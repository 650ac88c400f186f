"""Conversion of a folder of files: read, convert, verify, recover, compact, report."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compact, planning, verify
from ..session import stored
from ..sources import readers


def annex(lines: Column, fragments: Column) -> Column:
    """What a conversion lost, as the reference has it; empty if it lost nothing."""
    part = lambda title, body: F.concat(F.lit(f"\n\n---\n\n## {title}\n\n```text\n"), body, F.lit("\n```\n"))
    kept = F.when(F.size(lines) > 0, part("Recovered lines", F.array_join(lines, "\n"))).otherwise("")
    return F.concat(kept, F.when(F.size(fragments) > 0, part("Recovered words", F.array_join(fragments, " "))).otherwise(""))


def convert_folder(
    spark: SparkSession, folder: str, only: str = "*", previous: DataFrame | None = None, extractors=readers.EXTRACTORS, converters=readers.CONVERTERS, limit: int | None = None
) -> DataFrame:
    """Records: doc_id, path, rel, kind, digest, target, markdown, engine, attempts, coverage, status, recovered_lines, compacted, error, ok and others.

    only: a glob of file names in any case; limit: the first files by path. previous: (digest) of files that need no
    conversion. One bad file is one row with an error. The verdict is on the text with what was recovered; the
    conversions are stored in the shared folder, so that each engine runs once.
    """
    files = readers.read_files(spark, folder, only, limit).withColumn("digest", F.sha2("content", 256))
    if previous is not None:
        files = files.join(previous.select("digest"), "digest", "left_anti")
    made = stored(spark, ("converted", uuid.uuid4().hex), lambda: readers.converted(files.select("path", "content"), extractors, converters).withColumn("doc_id", F.xxhash64("path")))
    named = planning.targets(made.withColumn("rel", readers.relative(spark, folder)), "rel")
    rest = verify.recovery(named.select("doc_id", "reference", "markdown"))
    whole = F.concat("markdown", annex(F.col("lines"), F.col("fragments")))
    # A failed conversion has nothing to be completed.
    mended = named.join(rest, "doc_id").withColumn("whole", F.when(F.col("error").isNull() & (F.col("reference") != ""), whole).otherwise(F.col("markdown")))
    checked = verify.compare(mended.select("doc_id", "reference", F.col("whole").alias("markdown")))
    records = mended.join(checked, "doc_id").join(files.select("path", "digest", "size"), "path")
    state = F.when(F.col("error").isNotNull(), "error").otherwise(verify.final_status(F.col("status"), F.col("md_tokens"), F.col("engine").startswith("layout")))
    tight = records.withColumn("status", state).withColumn("_c", compact.compact(F.col("whole")))
    failed = F.transform(F.filter("attempts", lambda a: a["error"].isNotNull()), lambda a: a["engine"])
    return tight.select(
        "doc_id", "path", "rel", "kind", "digest", "size", "target", F.col("_c.text").alias("markdown"), "sidecar", "pages", "engine", "attempts", failed.alias("failed_engines"),
        F.regexp_count("markdown", F.lit(r"(?m)^\s*\|")).cast("long").alias("table_rows"), "measurable", "coverage", "numeric_coverage", "ref_tokens", "missing_tokens", "missing_sample", "status",
        F.when(F.col("error").isNull(), F.size("lines")).otherwise(0).alias("recovered_lines"), F.col("_c.compacted").alias("compacted"), "error", (F.col("error").isNull() & F.col("status").isin("ok", "only-ocr")).alias("ok"),
    )


def front_matter(fields: dict[str, str]) -> Column:
    """A header of fields (name to column), values quoted."""
    lines = [F.concat(F.lit(f"{k}: "), T.escape_yaml(F.col(c))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array(*lines), "\n"), F.lit("\n---\n\n"))
