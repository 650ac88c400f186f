"""Page geometry: rules, slots, cells, words and lines, as gaps and islands and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in points and shares.
TOLERANCE = 3.0
LINE_TOLERANCE, PARAGRAPH_GAP = 2.0, 14.0
MIN_OCCUPANCY, MAX_CELLS, MIN_BOUNDS = 0.5, 400, 3
CAPTION = r"(?im)^\s*(?:tab(?:le|la|elle|ella)|tabelle|quadro)\s*[\d.]+\s*[.:—-]"


def islands(df: DataFrame, keys: tuple[str, ...], order: list[Column], opens: Column, name: str = "island") -> DataFrame:
    """df with the number of the island each row is in; opens: true where a row starts one (also the first row)."""
    own = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(own) == 1
    flagged = df.withColumn("_opens", (first | F.coalesce(opens, F.lit(True))).cast("long"))
    return flagged.withColumn(name, F.sum("_opens").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def cluster(values: DataFrame, keys: tuple[str, ...], value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, island, n, centre): values no further apart than the tolerance are one, at their mean."""
    own = Window.partitionBy(*keys).orderBy(value)
    found = islands(values, keys, [F.col(value)], F.col(value) - F.lag(value).over(own) > tolerance)
    return found.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.avg(value).alias("centre"))


def slots(bounds: DataFrame, keys: tuple[str, ...], bound: str) -> DataFrame:
    """(keys, slot, low, high, last): the intervals between sorted bounds."""
    own = Window.partitionBy(*keys).orderBy(bound)
    high = F.lead(bound).over(own)
    found = bounds.select(*keys, (F.row_number().over(own) - 1).alias("slot"), F.col(bound).alias("low"), high.alias("high"), F.lead(bound, 2).over(own).isNull().alias("last"))
    return found.filter("high IS NOT NULL")


def slot_of(value: Column, low: Column, high: Column, last: Column) -> Column:
    """Whether value lies in [low, high); the far edge belongs to the last interval."""
    return (value >= low) & ((value < high) | (last & (value == high)))


def bucketed_slot_join(points: DataFrame, intervals: DataFrame, value: str, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Range join as an equi join on buckets of the given width: each interval is copied to the buckets it meets."""
    bucket = lambda c: F.floor(c / width).cast("long")
    left = points.withColumn("_bucket", bucket(F.col(value)))
    right = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    return left.join(right, [*keys, "_bucket"]).filter(slot_of(F.col(value), F.col("low"), F.col("high"), F.col("last"))).drop("_bucket")


def words(chars: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Runs of characters between blanks, with their boxes; chars has idx, ch and left, bottom, right, top."""
    own = Window.partitionBy(*keys).orderBy("idx")
    solid = islands(chars.withColumn("_blank", F.col("ch").rlike(r"^\s*$")), keys, [F.col("idx")], F.col("_blank") | F.lag("_blank").over(own), "word").filter("NOT _blank")
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "ch"))), lambda x: x["ch"]), "")
    return solid.groupBy(*keys, "word").agg(spelled.alias("text"), F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"))


def paragraphs(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), line: float = LINE_TOLERANCE, gap: float = PARAGRAPH_GAP) -> DataFrame:
    """(keys, paragraph, text): text blocks (text, left, top) from the top down; near tops are a line, wide gaps part paragraphs."""
    order = [F.desc("top"), F.asc("left")]
    own = Window.partitionBy(*keys).orderBy(*order)
    drop = F.lag("top").over(own) - F.col("top")
    lines = islands(islands(blocks, keys, order, drop > line, "line"), keys, order, drop > gap, "paragraph")
    text = lambda c, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(c, "text"))), lambda x: x["text"]), sep)
    by_line = lines.groupBy(*keys, "paragraph", "line").agg(text("left", " ").alias("text"))
    return by_line.groupBy(*keys, "paragraph").agg(text("line", "\n").alias("text"))


def grid_cells(marks: DataFrame, rows: DataFrame, columns: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), order: str = "idx", text: str = "ch", between: str = "") -> DataFrame:
    """(keys, row, col, text): each character is in the cell that holds its centre; rows count from the top.

    One whose centre is beyond the grid's edge but whose box isn't belongs to the cell at that edge. Whole words are
    placed with order="word", text="text", between=" ", for grids whose bounds are only near the true ones.
    """
    edges = rows.groupBy(*keys).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1")).join(columns.groupBy(*keys).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1")), list(keys))
    centre = lambda near, far, low, high: F.least(F.greatest((F.col(near) + F.col(far)) / 2, F.col(low)), F.col(high))
    meets = (F.col("right") > F.col("_x0")) & (F.col("left") < F.col("_x1")) & (F.col("top") >= F.col("_y0")) & (F.col("bottom") <= F.col("_y1"))
    placed = marks.join(edges, list(keys)).filter(meets).withColumn("_x", centre("left", "right", "_x0", "_x1")).withColumn("_y", centre("bottom", "top", "_y0", "_y1"))
    r = slots(rows, keys, "y").toDF(*keys, "row", "low", "high", "last").withColumn("row", F.max("row").over(Window.partitionBy(*keys)) - F.col("row"))
    c = slots(columns, keys, "x").toDF(*keys, "col", "left_edge", "right_edge", "far")
    inside = placed.join(r, list(keys)).filter(slot_of(F.col("_y"), F.col("low"), F.col("high"), F.col("last"))).join(c, list(keys)).filter(slot_of(F.col("_x"), F.col("left_edge"), F.col("right_edge"), F.col("far")))
    spelled = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), between))
    return inside.groupBy(*keys, "row", "col").agg(spelled.alias("text"))


def accepted_grids(cells: DataFrame, bounds: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Grids of enough bounds, not too many cells, half of them filled; bounds has keys, n_rows and n_columns of intervals."""
    filled = cells.filter("text != ''").groupBy(*keys).agg(F.count("*").alias("filled"))
    total = F.col("n_rows") * F.col("n_columns")
    fits = (F.col("n_rows") + 1 >= MIN_BOUNDS) & (F.col("n_columns") + 1 >= MIN_BOUNDS) & (total <= MAX_CELLS)
    return bounds.join(filled, list(keys)).filter(fits & (F.col("filled") >= MIN_OCCUPANCY * total))


def table_markdown(cells: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, markdown) of cells (keys, row, col, text, n_columns), rows and columns from 0; the first row is the head."""
    by_row = cells.groupBy(*keys, "n_columns", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_columns").cast("long") - 1), lambda c: F.coalesce(F.try_element_at("cells", c.cast("int")), F.lit("")))
    row = F.concat(F.lit("| "), F.array_join(every, " | "), F.lit(" |"))
    rows = by_row.groupBy(*keys, "n_columns").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", row.alias("line")))), lambda x: x["line"]).alias("rows"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("n_columns").cast("int")))
    return rows.select(*keys, F.array_join(F.concat(F.slice("rows", 1, 1), F.array(rule), F.slice("rows", 2, F.size("rows"))), "\n").alias("markdown"))


def announces_table(text: Column) -> Column:
    return text.rlike(CAPTION)


# Fixed values for tables that only horizontal rules bound.
RESOLUTION, NARROWEST, BODY_SHARE, MAX_SPLITS, BAND_SHARE, BAND_FILLED = 2.0, 5.0, 0.8, 10, 0.03, 0.4


def bands(rules: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, low, high): the band between a page's outer horizontal rules; rules has y and the page's height."""
    found = rules.groupBy(*keys).agg(F.min("y").alias("low"), F.max("y").alias("high"), F.max("height").alias("height"), F.count("*").alias("n"))
    return found.filter((F.col("n") > 1) & (F.col("high") - F.col("low") >= BAND_SHARE * F.col("height"))).select(*keys, "low", "high")


def corridors(lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, split): the middles of vertical gaps that a tenth of the lines cross at most; lines has left, bottom, right, top, width."""
    slot = lambda c: F.floor(c / RESOLUTION).cast("long")
    page = lines.groupBy(*keys).agg(
        F.floor(F.count("*") / 10).alias("allowed"), F.min("left").alias("first"), F.max("right").alias("last"), F.max("width").alias("width"),
        F.greatest(F.lit(NARROWEST), BODY_SHARE * F.percentile(F.col("top") - F.col("bottom"), 0.5)).alias("least"),
    )
    every = page.select(*keys, "allowed", "first", "last", "least", F.explode(F.sequence(F.lit(0).cast("long"), slot(F.col("width")))).alias("slot"))
    taken = lines.select(*keys, F.explode(F.sequence(slot(F.col("left")), slot(F.col("right")))).alias("slot")).groupBy(*keys, "slot").agg(F.count("*").alias("n"))
    open_ = every.join(taken, [*keys, "slot"], "left").filter(F.coalesce("n", F.lit(0)) <= F.col("allowed"))
    own = Window.partitionBy(*keys).orderBy("slot")
    runs = islands(open_, keys, [F.col("slot")], F.col("slot") - F.lag("slot").over(own) > 1, "run")
    gaps = runs.groupBy(*keys, "run", "first", "last", "least").agg(F.min("slot").alias("a"), (F.max("slot") + 1).alias("b"))
    split = (F.col("a") + F.col("b")) / 2 * RESOLUTION
    fits = ((F.col("b") - F.col("a")) * RESOLUTION >= F.col("least")) & (split > F.col("first")) & (split < F.col("last"))
    return gaps.filter(fits).select(*keys, split.alias("split"))


def band_tables(words_: DataFrame, lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, markdown): tables whose columns are read from where text is absent.

    words_ has text, left, right, top and line (from the top down). A page with a word across a column boundary is
    prose, and so is one with too few rows, columns or filled cells.
    """
    splits = corridors(lines, keys).groupBy(*keys).agg(F.sort_array(F.collect_list("split")).alias("splits")).filter(F.size("splits") <= MAX_SPLITS)
    at = lambda x: F.size(F.filter("splits", lambda s: s <= F.col(x)))
    placed = words_.join(splits, list(keys)).withColumn("col", at("left")).withColumn("crosses", at("left") != at("right"))
    whole = placed.groupBy(*keys).agg(F.max("crosses").alias("crosses"), F.countDistinct("line").alias("rows"), F.countDistinct("line", "col").alias("filled"), F.max(F.size("splits")).alias("n"))
    good = whole.filter(~F.col("crosses") & (F.col("rows") > 1) & (F.col("filled") >= BAND_FILLED * F.col("rows") * (F.col("n") + 1))).select(*keys, "n")
    if "word" in words_.columns:
        # A line whose cells don't give its letters in the order of reading was no row of a table.
        spelled = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "")
        whole_lines = placed.groupBy(*keys, "line").agg((spelled("left") == spelled("word")).alias("same")).groupBy(*keys).agg(F.bool_and("same").alias("same"))
        good = good.join(whole_lines.filter("same").select(*keys), list(keys), "left_semi")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ")
    cells = placed.join(good, list(keys)).groupBy(*keys, "n", "line", "col").agg(text.alias("text"))
    return table_markdown(cells.select(*keys, F.col("line").alias("row"), F.col("col").cast("int").alias("col"), "text", (F.col("n") + 1).alias("n_columns")), keys)


# How far a captioned table may reach beyond its rules, in shares of the page; how many rules look like
# a table's; the share of a page's text from which a table stands for the page.
ABOVE, BELOW, RULES, DOMINATES = 0.05, 0.35, 3, 0.6


def lines_in(words_: DataFrame, ranges: DataFrame, keys: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """The words (keys, ...) whose middles lie in ranges (by, low, high), with the number of their line from the top.

    A word opens a line if three quarters of it are below all words before it.
    """
    middle = (F.col("bottom") + F.col("top")) / 2
    inside = words_.join(ranges, list(keys)).filter((middle >= F.col("low")) & (middle <= F.col("high"))).drop("low", "high")
    order = [F.desc("top"), F.asc("left")]
    lowest = F.min("bottom").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return islands(inside, by, order, F.col("top") - (F.col("top") - F.col("bottom")) / 4 <= lowest, "line")


def runs_of(words_: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, left, bottom, right, top): words of a line that stand closer than the narrowest gap between columns."""
    own = Window.partitionBy(*by, "line").orderBy("left")
    joined = islands(words_, (*by, "line"), [F.col("left")], F.col("left") - F.lag("right").over(own) >= NARROWEST, "run")
    return joined.groupBy(*by, "line", "run").agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top")).drop("line", "run")


def find_tables(chars: DataFrame, horizontals: DataFrame, verticals: DataFrame, pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, way, markdown): one table a page, by the surest way that gives one.

    chars: keys, idx, ch, left, bottom, right, top; horizontals: keys, y; verticals: keys, x; pages: keys, width,
    height, announced. The ways: a whole grid of rules; the band between the outer horizontal rules; and, on a page with
    a caption, the text around its rules, though it were one. A page without any has no row.
    """
    on = list(keys)
    rows, columns = cluster(horizontals, keys, "y").select(*keys, F.col("centre").alias("y")), cluster(verticals, keys, "x").select(*keys, F.col("centre").alias("x"))
    count = lambda df, name: df.groupBy(*keys).agg((F.count("*") - 1).alias(name))
    bounds = count(rows, "n_rows").join(count(columns, "n_columns"), on).filter((F.col("n_rows") + 1 >= MIN_BOUNDS) & (F.col("n_columns") + 1 >= MIN_BOUNDS))
    ruled = lambda df: df.join(bounds, on, "left_semi")
    cells = grid_cells(ruled(chars), ruled(rows), ruled(columns), keys)
    grids = accepted_grids(cells, bounds, keys).select(*keys, "n_rows", "n_columns")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    frame = grids.select(*keys, "n_rows", "n_columns", upto("n_rows").alias("row")).select(*keys, "n_columns", "row", upto("n_columns").alias("col"))
    every = frame.join(cells, [*on, "row", "col"], "left").select(*keys, "n_columns", "row", F.col("col").cast("int").alias("col"), F.coalesce("text", F.lit("")).alias("text"))
    drawn = table_markdown(every, keys).withColumnRenamed("markdown", "drawn")

    # Both ranges come from one aggregate of the page's rules.
    sized = rows.join(pages.select(*keys, "height", "announced"), on)
    outer = sized.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("height").alias("h"), F.count("*").alias("n"), F.bool_or("announced").alias("announced"))
    band = F.when((F.col("n") > 1) & (F.col("y1") - F.col("y0") >= BAND_SHARE * F.col("h")), F.struct(F.lit("band").alias("way"), F.col("y0").alias("low"), F.col("y1").alias("high")))
    around = F.when(F.col("announced"), F.struct(F.lit("caption").alias("way"), F.greatest(F.lit(0.0), F.col("y0") - BELOW * F.col("h")).alias("low"), (F.col("y1") + ABOVE * F.col("h")).alias("high")))
    ranges = outer.select(*keys, F.explode(F.filter(F.array(band, around), lambda x: x.isNotNull())).alias("r")).select(*keys, "r.way", "r.low", "r.high")
    by = (*keys, "way")
    spoken = lines_in(words(chars.join(ranges.select(*keys).distinct(), on, "left_semi"), keys), ranges, keys, by)
    runs = runs_of(spoken, by).join(pages.select(*keys, "width"), on)
    read = band_tables(spoken, runs, by).groupBy(*keys).agg(F.min(F.struct("way", "markdown")).alias("t"))  # band comes before caption
    return drawn.join(read, on, "full_outer").select(*keys, F.when(F.col("drawn").isNotNull(), "grid").otherwise(F.col("t.way")).alias("way"), F.coalesce("drawn", "t.markdown").alias("markdown"))


def page_texts(pages: DataFrame, paragraphs_: DataFrame, tables: DataFrame, horizontals: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, text, has_table, unresolved) of pages (keys, announced), their paragraphs (keys, paragraph, text) and tables.

    A table of DOMINATES of the page's prose or more stands for it, a smaller one follows it. A page that is
    announced or ruled as a table's and gave none is unresolved.
    """
    on = list(keys)
    prose = paragraphs_.filter("text != ''").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]).alias("prose"), F.sum(F.length("text")).alias("written"))
    rules = cluster(horizontals, keys, "y").groupBy(*keys).agg(F.count("*").alias("rules"))
    whole = pages.select(*keys, "announced").join(prose, on, "left").join(tables.select(*keys, "markdown"), on, "left").join(rules, on, "left")
    prose_, table = F.coalesce("prose", F.array().cast("array<string>")), F.col("markdown")
    small = F.length(table) < DOMINATES * F.coalesce("written", F.lit(0))
    text = F.when(table.isNull(), prose_).when(small, F.concat(prose_, F.array(table))).otherwise(F.array(table))
    unresolved = table.isNull() & (F.coalesce("announced", F.lit(False)) | (F.coalesce("rules", F.lit(0)) >= RULES))
    return whole.select(*keys, F.array_join(text, "\n\n").alias("text"), table.isNotNull().alias("has_table"), unresolved.alias("unresolved"))


def document_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown, tables, unresolved): the page texts in order under page marks; unresolved pages by number."""
    marked = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n\n"), F.col("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", marked.alias("text")))), lambda x: x["text"])
    return pages.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("markdown"), F.count_if("has_table").alias("tables"), F.sort_array(F.collect_list(F.when(F.col("unresolved"), F.col("page")))).alias("unresolved"))
