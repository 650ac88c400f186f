"""Converted documents as a tree of Markdown files, with an index, a manifest, results and progress.

Documents are written by the tasks that hold them, each file whole or not at all, so that a task that runs again
only writes the same again. Reports come as rows of lines in order; the driver writes them one by one.
The target is a folder that driver and executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import planning
from .convert import front_matter

INDEX, MANIFEST, RESULTS, PROGRESS, SIDECARS = "00_INDEX.md", "_manifest.json", "results.txt", "_progress", "_structure"
WORDS = {"ok": "conforming", "warn": "to review", "fail": "incomplete", "only-ocr": "recognised only", "unread": "unreadable", "no-reference": "not measurable", "error": "failed"}


def shown_status(status: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, status), status)


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def documents(records: DataFrame) -> DataFrame:
    """(target, text, digest, sidecar): each document that was read, with a header and a title."""
    shown = records.filter("engine != 'none'").select(
        "target", "markdown", "digest", "sidecar", _name(F.col("rel")).alias("source"), T.to_pseudopath(F.col("rel")).alias("pseudopath"), F.col("kind").alias("format"),
        F.coalesce(F.col("pages").cast("string"), F.lit("")).alias("pages"), "status", "engine", F.col("size").cast("string").alias("bytes"), T.percent(F.col("coverage")).alias("fidelity"),
        F.col("recovered_lines").cast("string").alias("recovered"),
    )
    head = front_matter({
        "source": "source", "source_pseudopath": "pseudopath", "source_format": "format", "pages": "pages", "verification_status": "status", "engine": "engine", "bytes": "bytes", "digest": "digest",
        "fidelity": "fidelity", "recovered_lines": "recovered",
    })
    title = F.regexp_replace("source", r"\.[A-Za-z0-9]+$", "")
    return shown.select("target", F.concat(head, F.lit("# "), title, F.lit("\n\n"), F.trim("markdown", F.lit("\n")), F.lit("\n")).alias("text"), "digest", "sidecar")


def _put(root: Path, relative: str, text: str) -> int:
    """The file's bytes; it appears under its name only when it is whole."""
    file = (root / relative).resolve()
    if not file.is_relative_to(root.resolve()):
        raise ValueError(f"{relative} lies outside the target folder")
    file.parent.mkdir(parents=True, exist_ok=True)
    part = file.with_name(f".{uuid.uuid4().hex}.part")
    data = text.encode("utf-8")
    part.write_bytes(data)
    os.replace(part, file)
    return len(data)


def write_files(made: DataFrame, target: str) -> DataFrame:
    """(target, bytes, sidecar_error) of rows (target, text, digest, sidecar), written when the result is read.

    Each batch notes its finished units in the progress folder; a sidecar that can't be written is an error in its row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = Path(target)
        (root / PROGRESS).mkdir(parents=True, exist_ok=True)
        with open(root / PROGRESS / f"{uuid.uuid4().hex}.jsonl", "a", encoding="utf-8") as log:
            for pdf in batches:
                rows = []
                for name, text, digest, sidecar in pdf.itertuples(index=False):
                    size, error = _put(root, name, text), None
                    try:
                        if sidecar is not None:
                            _put(root, f"{SIDECARS}/{name.removesuffix('.md')}.json", sidecar)
                    except OSError as e:
                        error = f"sidecar: {e}"
                    log.write(json.dumps({"target": name, "digest": digest}) + "\n")
                    log.flush()
                    os.fsync(log.fileno())
                    rows.append((name, size, error))
                yield pd.DataFrame(rows, columns=["target", "bytes", "sidecar_error"])

    return made.select("target", "text", "digest", "sidecar").mapInPandas(run, "target string, bytes long, sidecar_error string")


def finished(spark: SparkSession, target: str) -> DataFrame:
    """(target, digest) of the units that an interrupted run has written; a line that was cut short doesn't count."""
    schema = "target string, digest string"
    if not (Path(target) / PROGRESS).is_dir():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{target}/{PROGRESS}").filter("digest IS NOT NULL").distinct()


def index_lines(records: DataFrame) -> DataFrame:
    """(section, a, b, line): the index's rows of documents by folder and name, of sources, and of those to look at."""
    source, folder = T.to_pseudopath(F.col("rel")), _folder(F.col("target"))
    link = F.concat(F.lit("["), T.escape_cell(_name(F.col("target"))), F.lit("]("), T.relative_link(F.lit("."), F.col("target")), F.lit(")"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    status, fidelity = shown_status(F.col("status")), T.percent(F.col("coverage"))
    listed = F.lower(_name(F.col("rel")))
    rows = records.select(F.lit(1).alias("section"), F.when(folder == ".", "").otherwise(F.lower(folder)).alias("a"), listed.alias("b"), row(link, _folder(F.col("rel")), T.escape_cell(_name(F.col("rel"))), "kind", T.file_size(F.col("size")), fidelity, status, "engine").alias("line"))
    sources = records.select(F.lit(2), F.lower(source), F.lit(""), row(T.escape_cell(source), T.escape_cell(T.to_pseudopath(F.col("target")))))
    why = F.concat_ws("; ", F.when(F.col("recovered_lines") > 0, F.concat(F.col("recovered_lines").cast("string"), F.lit(" lines recovered"))), F.when(F.size("missing_sample") > 0, F.concat(F.lit("missing: "), F.array_join(F.slice("missing_sample", 1, 6), ", "))), F.substring("error", 1, 120))
    share = F.format_string("%.6f", F.coalesce("coverage", F.lit(0.0)))
    attention = records.filter("NOT ok").select(F.lit(3), share, listed, row(T.escape_cell(T.to_pseudopath(F.col("target"))), status, fidelity, T.escape_cell(why)))
    return rows.union(sources).union(attention)


def results_lines(records: DataFrame) -> DataFrame:
    """(section, a, b, line): documents to look at by coverage, then the conforming ones by path."""
    source = T.to_pseudopath(F.col("rel"))
    share = F.format_string("%.6f", F.coalesce("coverage", F.lit(0.0)))
    line = F.concat(F.lpad(T.percent(F.col("coverage")), 8, " "), F.lit("  "), F.rpad(shown_status(F.col("status")), 16, " "), F.rpad("engine", 12, " "), source, F.coalesce(F.concat(F.lit("  "), F.substring("error", 1, 160)), F.lit("")))
    bad = records.filter("NOT ok").select(F.lit(1).alias("section"), share.alias("a"), source.alias("b"), line.alias("line"))
    return bad.union(records.filter("ok").select(F.lit(2), F.lower(source), F.lit(""), line))


def document_indexes(chapters: DataFrame) -> DataFrame:
    """(target, text): the index of each document that was split.

    chapters: target (of the document), source, chapter, title, chapter_target, first_page, last_page, ok, status,
    coverage, ref_tokens, missing_tokens. The document's coverage is weighted by tokens.
    """
    parts = chapters.withColumn("pages", F.col("last_page") - F.col("first_page") + 1)
    total = planning.chapter_rollup(parts, "target")
    link = F.concat(F.lit("["), T.escape_cell(F.col("title")), F.lit("]("), T.relative_link(_folder(F.col("target")), F.col("chapter_target")), F.lit(")"))
    pages = F.concat(F.col("first_page").cast("string"), F.lit("-"), F.col("last_page").cast("string"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("chapter").cast("string"), link, pages, T.percent(F.col("coverage")), shown_status(F.col("status"))), F.lit(" |"))
    rows = parts.groupBy("target").agg(F.first("source").alias("source"), F.transform(F.sort_array(F.collect_list(F.struct("chapter", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    head = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n\nPages: "), F.col("pages").cast("string"), F.lit(". Chapters: "), F.col("chapters").cast("string"), F.lit(", conforming: "), F.col("conforming").cast("string"),
        F.lit(". Fidelity: "), T.percent(F.col("coverage")), F.lit(". Status: "), shown_status(F.col("status")), F.lit(".\n\n| # | Chapter | Pages | Fidelity | Status |\n|---|---|---|---|---|\n"),
    )
    return total.join(rows, "target").select("target", F.concat(head, F.array_join("rows", "\n"), F.lit("\n")).alias("text"))


def _lines(rows: DataFrame, titles: dict[int, str]) -> Iterator[str]:
    """A report's lines; they pass the driver a partition at a time."""
    open_ = 0
    for r in rows.orderBy("section", "a", "b", "line").toLocalIterator(prefetchPartitions=True):
        if r["section"] != open_:
            open_ = r["section"]
            yield titles[open_]
        yield r["line"]


def _write(file: Path, lines: Iterator[str]) -> None:
    part = file.with_name(f".{uuid.uuid4().hex}.part")
    with open(part, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines)
    os.replace(part, file)


TITLES = {
    1: "\n## Documents\n\n| Document | Folder | Source | Format | Size | Fidelity | Status | Engine |\n|---|---|---|---|---|---|---|---|",
    2: "\n## Sources\n\n| Source | Markdown |\n|---|---|",
    3: "\n## To look at\n\n| Document | Status | Fidelity | Why |\n|---|---|---|---|",
    4: "\n## Not converted\n",
}


def write_reports(records: DataFrame, target: str, skipped: DataFrame | None = None) -> dict:
    """The index, the manifest and the results of a run; gives the manifest's summary. skipped: (rel) of other files."""
    root = Path(target)
    root.mkdir(parents=True, exist_ok=True)
    totals = planning.manifest(records).first().asDict() | planning.engine_counters(records).first().asDict()  # one row each
    left = skipped.select(F.lit(4).alias("section"), F.lower("rel").alias("a"), F.lit("").alias("b"), F.concat(F.lit("- "), T.to_pseudopath(F.col("rel"))).alias("line")) if skipped is not None else None
    summary = [f"Documents: {totals['documents']}", f"Conforming: {totals['converted_ok']}", f"Not measurable: {totals['unverifiable']}", f"With findings: {totals['with_findings']}", f"Tokens not recovered: {totals['tokens_not_recovered']} of {totals['reference_tokens']}"]
    engines = [f"Documents with failed engines: {totals['with_failed_engines']} ({', '.join(totals['engines'] or []) or 'none'})", f"Table rows kept: {totals['table_rows']} in {totals['with_tables']} documents"]

    def index() -> Iterator[str]:
        yield "# Converted documents\n\n" + "  \n".join(summary)
        yield from _lines(index_lines(records) if left is None else index_lines(records).union(left), TITLES)

    def results() -> Iterator[str]:
        yield "\n".join([*summary, *engines])
        yield from _lines(results_lines(records), {1: "\nTo look at\n", 2: "\nConforming\n"})

    def manifest() -> Iterator[str]:
        yield '{"summary": ' + json.dumps(totals, default=str) + ', "documents": ['
        columns = [c for c in records.columns if c not in ("markdown", "sidecar", "path")]
        rows = records.orderBy("rel").select(F.to_json(F.struct(*columns)).alias("line")).toLocalIterator(prefetchPartitions=True)
        for k, r in enumerate(rows):
            yield ("," if k else "") + r["line"]
        yield "]}"

    for name, lines in ((INDEX, index()), (RESULTS, results()), (MANIFEST, manifest())):
        _write(root / name, lines)
    return totals


def write_tree(records: DataFrame, target: str, skipped: DataFrame | None = None) -> dict:
    """Documents, sidecars and reports; the progress goes when all of them are written."""
    done = write_files(documents(records), target).agg(F.count("*").alias("written"), F.sum("bytes").alias("bytes"), F.count("sidecar_error").alias("sidecar_errors")).first()
    totals = write_reports(records, target, skipped) | done.asDict()
    shutil.rmtree(Path(target) / PROGRESS, ignore_errors=True)
    return totals
