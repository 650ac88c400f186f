"""Planning and reporting: jobs, collisions, incremental work, chapters, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Pages.
SPLIT_FROM, TARGET, BLOCK = 60, 30, 25
LEVEL_MEAN = TARGET * 1.6
# Fixed value: a page with fewer characters than this has no text.
BARE_PAGE = 20
# Formats by extension.
FORMATS = {
    "pdf": "pdf", "docx": "docx", "docm": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "pptx": "pptx", "pptm": "pptx",
    "epub": "epub", "txt": "text", "md": "text", "csv": "text", "html": "html", "htm": "html",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def format_of(path: Column) -> Column:
    """The format by extension; null if it isn't supported."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.element_at(known, extension(path))


def targets(jobs: DataFrame, path_col: str = "path") -> DataFrame:
    """jobs with target: the path with .md; colliding ones (by composed, case-folded target) keep their extension in the name."""
    stem, ext = F.regexp_replace(path_col, r"\.[A-Za-z0-9]+$", ""), extension(F.col(path_col))
    plain = jobs.withColumn("target", F.concat(stem, F.lit(".md")))
    n = F.count("*").over(Window.partitionBy(F.lower(T.composed(F.col("target")))))
    return plain.withColumn("collides", n > 1).withColumn("target", F.when(F.col("collides") & (ext != ""), F.concat(stem, F.lit("__"), ext, F.lit(".md"))).otherwise(F.col("target")))


def latest(records: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """Of each key's records the first by order."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def pending(jobs: DataFrame, done: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(to do, reused): jobs without and with a conforming record of the same keys."""
    return jobs.join(done, list(keys), "left_anti"), jobs.join(done, list(keys), "left_semi")


def lane(kind: Column, pages: Column, characters: Column, images: Column) -> Column:
    scanned = (kind == "pdf") & (characters < 60 * pages)
    return F.when((kind == "pdf") & (pages <= 2) & (images > 0), "cpu").when(scanned, "gpu").otherwise("cpu")


def estimated_cost(pages: Column, size: Column) -> Column:
    return F.coalesce(pages.cast("double"), size / 100_000)


def by_cost(jobs: DataFrame, *ties: str) -> DataFrame:
    """jobs in the order in which they run: cheap ones first."""
    return jobs.orderBy("cost", *ties)


def block_chapters(docs: DataFrame, pages: Column, block: int = BLOCK, least: int = SPLIT_FROM) -> DataFrame:
    """(doc_id, chapter, first_page, last_page): fixed ranges for documents of `least` pages or more."""
    long = docs.select("doc_id", pages.alias("pages")).filter(F.col("pages") >= least)
    starts = long.select("doc_id", "pages", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long"), F.lit(block).cast("long"))).alias("k", "first_page"))
    return starts.select("doc_id", (F.col("k") + 1).alias("chapter"), "first_page", F.least(F.col("first_page") + block - 1, F.col("pages")).alias("last_page"))


def toc_chapters(outline: DataFrame) -> DataFrame:
    """Chapters of outline(doc_id, pages, level, title, page, entry).

    The first level whose entries span LEVEL_MEAN pages on average at most, else the deepest one with entries;
    pages before the first entry are a chapter of their own; an entry on its successor's page gives way.
    """
    valid = outline.filter("page BETWEEN 1 AND pages")
    levels = valid.groupBy("doc_id", "pages", "level").agg(F.count("*").alias("entries"))
    fits = F.col("pages") / F.col("entries") <= LEVEL_MEAN
    chosen = levels.groupBy("doc_id").agg(F.coalesce(F.min(F.when(fits, F.col("level"))), F.max("level")).alias("level"))
    own = Window.partitionBy("doc_id").orderBy("page", "entry")
    picked = valid.join(chosen, ["doc_id", "level"]).withColumn("last_page", F.coalesce(F.lead("page").over(own) - 1, F.col("pages")))
    first = picked.groupBy("doc_id").agg(F.min("page").alias("page")).filter("page > 1")
    before = first.select("doc_id", F.lit("Front matter").alias("title"), F.lit(1).cast("long").alias("first_page"), (F.col("page") - 1).alias("last_page"), F.lit(-1).cast("long").alias("entry"))
    after = picked.filter("last_page >= page").select("doc_id", F.trim("title").alias("title"), F.col("page").alias("first_page"), "last_page", "entry")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_page", "entry"))
    return after.unionByName(before).withColumn("chapter", number).drop("entry")


def refined_chapters(chapters: DataFrame, target: int = TARGET) -> DataFrame:
    """Chapters of more than two targets are cut into parts of one target, titled (cont. n)."""
    size = F.col("last_page") - F.col("first_page") + 1
    step = F.when(size > 2 * target, F.lit(target)).otherwise(size).cast("long")
    cut = chapters.select("doc_id", "chapter", "title", "last_page", step.alias("step"), F.posexplode(F.sequence(F.col("first_page").cast("long"), F.col("last_page").cast("long"), step)).alias("part", "from"))
    title = F.when(F.col("part") == 0, F.col("title")).otherwise(F.concat("title", F.lit(" (cont. "), (F.col("part") + 1).cast("string"), F.lit(")")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("from"))
    return cut.select("doc_id", number.alias("chapter"), title.alias("title"), F.col("from").alias("first_page"), F.least(F.col("from") + F.col("step") - 1, F.col("last_page")).alias("last_page"))


def slug(index: Column, title: Column, first: Column, last: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|\r\n\t]+', " "), r"\s+", " "))
    clean = F.rtrim(F.substring(clean, 1, 70))
    name = F.when(clean == "", F.concat(F.lit("Paginas "), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(clean)
    return F.concat(F.lpad(index.cast("string"), 2, "0"), F.lit(" - "), name)


def manifest(records: DataFrame, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Totals of records(ok, status, measurable, coverage, ref_tokens, missing_tokens), for the collection or by columns.

    Each document is ok, unverifiable (there was nothing to measure against) or has findings.
    """
    blind = ~F.col("ok") & F.col("status").isin("no-reference", "unread")
    ref, missing = F.sum(F.when(F.col("measurable"), F.col("ref_tokens"))), F.sum(F.when(F.col("measurable"), F.col("missing_tokens")))
    found = (records.groupBy(*by) if by else records.groupBy()).agg(
        F.count("*").alias("documents"), F.count_if("ok").alias("converted_ok"), F.count_if(blind).alias("unverifiable"),
        F.coalesce(ref, F.lit(0)).alias("reference_tokens"), F.coalesce(missing, F.lit(0)).alias("tokens_not_recovered"),
        F.round(F.avg(F.when(F.col("measurable"), F.col("coverage"))), digits).alias("mean_coverage"),
    )
    share = F.when(F.col("reference_tokens") > 0, F.round((F.col("reference_tokens") - F.col("tokens_not_recovered")) / F.col("reference_tokens"), digits))
    return found.withColumn("with_findings", F.col("documents") - F.col("converted_ok") - F.col("unverifiable")).withColumn("global_token_coverage", share)


def chapter_rollup(chapters: DataFrame, parent: str, digits: int = 6) -> DataFrame:
    """Per parent: coverage weighted by tokens (never a mean of percentages), pages, conforming chapters, status."""
    found = chapters.groupBy(parent).agg(
        F.count("*").alias("chapters"), F.sum("pages").alias("pages"), F.count_if("ok").alias("conforming"), F.sum("ref_tokens").alias("ref_tokens"), F.sum("missing_tokens").alias("missing_tokens")
    )
    share = F.when(F.col("ref_tokens") > 0, F.round((F.col("ref_tokens") - F.col("missing_tokens")) / F.col("ref_tokens"), digits))
    state = F.when(F.col("ref_tokens") == 0, "no-reference").when(F.col("conforming") == F.col("chapters"), "ok").otherwise("warn")
    return found.withColumn("coverage", share).withColumn("status", state)


def engine_counters(records: DataFrame) -> DataFrame:
    """One row: documents with failed engines, the engines' names, table rows kept and documents that have any."""
    return records.agg(
        F.count_if(F.size("failed_engines") > 0).alias("with_failed_engines"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("failed_engines")))).alias("engines"),
        F.coalesce(F.sum("table_rows"), F.lit(0)).alias("table_rows"), F.count_if(F.col("table_rows") > 0).alias("with_tables"),
    )


def is_drawing(kind: Column, pages: Column, images: Column) -> Column:
    return F.coalesce((kind == "pdf") & (pages > 0) & (pages <= 2) & (images > 0), F.lit(False))


def engine_order(kind: Column, needs_ocr: Column, drawing: Column) -> Column:
    """The engines to try, cheapest first; texts and drawings have one, files without text begin with recognition."""
    names = lambda *engines: F.array(*[F.lit(e) for e in engines])
    return (
        F.when(kind.isin("text", "html") | drawing, names("native"))
        .when(needs_ocr, names("layout-ocr", "native"))
        .when(kind == "pdf", names("native", "hybrid", "layout"))
        .otherwise(names("native", "layout"))
    )


def page_ranges(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """The page rows (doc_id, page, ...) of each chapter, with its number."""
    inside = (F.col("page") >= F.col("first_page")) & (F.col("page") <= F.col("last_page"))
    return pages.join(chapters.select("doc_id", "chapter", "first_page", "last_page"), "doc_id").filter(inside).drop("first_page", "last_page")


def page_summary(pages: DataFrame, blank: int = BARE_PAGE) -> DataFrame:
    """(doc_id, pages, pages_without_text, needs_ocr, images, text) from (doc_id, page, text, images)."""
    bare = F.length(F.regexp_replace("text", r"\s", "")) < blank
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(bare).alias("pages_without_text"), (F.count_if(bare) > 0).alias("needs_ocr"), F.sum("images").alias("images"), text.alias("text"))
