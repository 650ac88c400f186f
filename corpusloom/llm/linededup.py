"""Line dedup by content-defined chunks of line units. Built-in functions only.

Units. A text is cut after each line feed and, since one line may hold a whole
page, after each sentence's end; a unit keeps the characters that end it, so
the units of a text joined are the text.

Chunks. Each unit is hashed, and a rolling hash takes in two unit hashes: that
of a unit and of the one before it. A boundary follows a unit if its rolling
hash is under a limit (three of four are), so it depends on two units alone,
and nothing that is inserted, removed or changed elsewhere moves it. A chunk
reaches from the two units of one boundary to the next boundary, so a passage
holds a whole chunk as soon as two boundaries fall into it, whatever stands
around it.

A chunk of two units or more, and of MIN_CHARS characters, that occurs again
anywhere (a later document, or later in the same one) is removed there; the
first occurrence, by (doc_id, text, place), stays. Equal hashes only select:
chunks are grouped by their bytes. Neighbouring chunks share two units, so
what is removed is the union of the removed chunks, and every removed unit
still stands somewhere earlier.

Passes: (1) hashes only: which chunk hashes occur twice or more; (2) the texts
of those chunks, whose first occurrence is found by grouping; (3) removal. A
chunk that very many documents hold is pre-aggregated before the shuffle and
is joined by its place, which is unique, so no key is hot.

Rows: null text stays null. Rows equal in id and text are one document; rows
equal in id alone are two, the order between them is that of their texts'
hashes. Rows with a null id are never changed and never a first occurrence. A
document may become empty. An empty table gives an empty result. All other
columns are carried along, whatever their names; n_lines, n_units and
n_removed are added at the end by `deduplicate`, in place of columns so named,
and not by `thinned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, private, sized_broadcast
from .native import let, lines

#: A unit: up to a line feed or the end of a sentence, which belong to it.
UNIT = r"(?s).*?(?:\n|[.!?] |。|\z)"
ENDS = ("\n", ". ", "! ", "? ", "。")
MARK = "\x01"
#: Characters of the shortest chunk that may be removed.
MIN_CHARS = 32
#: Of 16 rolling hashes so many end a chunk.
ENDING = 12


def units(text: Column) -> Column:
    """array<string> of a text's units. UNIT defines them; a text without the mark is cut by plain replacement, which is faster."""
    marked = text
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    cut = F.when(F.contains(text, F.lit(MARK)), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))).otherwise(F.split(marked, MARK))
    return F.array_remove(cut, "")


def chunks(us: Column) -> Column:
    """array<struct<start, size>> of the chunks of two units or more of a text's units, in order; start counts from 0."""
    n = F.size(us)
    digits = F.transform(us, lambda u: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(u), 1, 1)) - 1)

    def bounded(d: Column) -> Column:
        inner = F.filter(F.sequence(F.lit(1), n - 2), lambda i: F.pmod(5 * F.get(d, i - 1) + F.get(d, i), F.lit(16)) < ENDING)
        spans = lambda e: F.zip_with(F.concat(F.array(F.lit(0)), F.transform(e, lambda i: i - 1)), F.concat(e, F.array(n - 1)), lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("size")))
        return let(inner, spans)

    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("size")))
    return F.when(n < 2, F.slice(whole, 1, 0)).when(n == 2, whole).otherwise(let(digits, bounded))


def _hashed(text: Column, bodies: bool) -> Column:
    """array<struct<chunk, size, hash>> of a text's chunks, with their body if asked for. The hash is that of the hashes of its units."""

    def of_units(us: Column) -> Column:
        own = lambda h, c: F.xxhash64(F.slice(h, c["start"] + 1, c["size"]))
        body = lambda c: [F.array_join(F.slice(us, c["start"] + 1, c["size"]), "").alias("body")] if bodies else []
        found = lambda h: F.transform(chunks(us), lambda c: F.struct(c["start"].alias("chunk"), c["size"].alias("size"), own(h, c).alias("hash"), *body(c)))
        return let(F.transform(us, lambda u: F.xxhash64(u)), found)

    return let(units(text), of_units)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stage: Staging | None = None) -> DataFrame:
    """(doc_id, of_text, chunk, size): the chunks to remove, by document, the hash of its text, and place."""
    stage = stage or Staging()
    named = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = named.select("doc_id", "text", F.xxhash64("text").alias("of_text"))
    # Rows equal in id and text are one document; they are told apart from repeats below, by place.
    hashes = named.select(F.explode(F.transform(_hashed(F.col("text"), False), lambda c: c["hash"])).alias("hash"))
    again = stage(hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "again")
    found = named.select("doc_id", "of_text", F.explode(_hashed(F.col("text"), True)).alias("c")).select("doc_id", "of_text", "c.*").filter(F.length("body") >= MIN_CHARS)
    seen = stage(found.join(sized_broadcast(again), "hash"), "seen")
    first = seen.groupBy("hash", "body").agg(F.min(F.struct("doc_id", "of_text", "chunk", "size")).alias("first")).select("first.*")
    first = stage(first, "first")
    return seen.select("doc_id", "of_text", "chunk", "size").distinct().join(sized_broadcast(first), ["doc_id", "of_text", "chunk", "size"], "left_anti")


def _remaining(us: Column, gone: Column) -> Column:
    """Struct of what is left of units without the chunks of gone, (start, size) in order, and of its number of units."""

    def kept(ranges: Column) -> Column:
        n = F.size(us)
        ends = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["chunk"] + r["size"]))
        starts = F.concat(F.transform(ranges, lambda r: r["chunk"]), F.array(n))
        spans = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return let(F.filter(spans, lambda s: s["b"] > s["a"]), joined)

    def joined(spans: Column) -> Column:
        feed = lambda u: F.endswith(F.coalesce(u, F.lit("\n")), F.lit("\n"))
        # A removed end of a line leaves its line feed, so that two lines don't become one.
        split = lambda s, i: F.when((i > 0) & feed(F.get(us, s["a"] - 1)) & ~feed(F.get(us, F.get(spans, i - 1)["b"] - 1)), "\n").otherwise("")
        texts = F.transform(spans, lambda s, i: F.concat(split(s, i), F.array_join(F.slice(us, s["a"] + 1, s["b"] - s["a"]), "")))
        count = F.aggregate(spans, F.lit(0), lambda t, s: t + s["b"] - s["a"])
        return F.struct(F.regexp_replace(F.array_join(texts, ""), r"[ \n]+\z", "").alias("text"), count.cast("long").alias("n"))

    return let(F.sort_array(gone), kept)


def _marked(docs: DataFrame, id_col: str, text_col: str, gone: str) -> DataFrame:
    """docs with a column more: the chunks to remove, or null."""
    of_id, of_text = private(docs.withColumn(gone, F.lit(None)), "of_id", "of_text")
    stage = Staging()
    marks = repeats(docs, id_col, text_col, stage).groupBy("doc_id", "of_text").agg(F.sort_array(F.collect_set(F.struct("chunk", "size"))).alias(gone))
    marks = stage(marks.withColumnsRenamed({"doc_id": of_id, "of_text": of_text}), "marks")
    stage.drop(marks)
    same = (F.col(f"`{id_col}`") == F.col(of_id)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(of_text))
    return docs.join(sized_broadcast(marks), same, "left").drop(of_id, of_text)


def thinned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with their own columns, with repeated chunks taken out of the text."""
    (gone,) = private(docs, "gone")
    text = F.col(f"`{text_col}`")
    left = F.when(F.col(gone).isNull(), text).otherwise(let(units(text), lambda us: _remaining(us, F.col(gone)))["text"])
    return _marked(docs, id_col, text_col, gone).withColumn(text_col, left).drop(gone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """thinned(docs) with n_lines, n_units and n_removed (units) of each text."""
    gone, out = private(docs, "gone", "out")
    text = F.col(f"`{text_col}`")
    whole = lambda us: F.struct(F.array_join(us, "").alias("text"), F.size(us).cast("long").alias("n"))
    result = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_units"), F.lit(0).cast("long").alias("n_removed"))

    def counted(us: Column) -> Column:
        rest = F.when(F.col(gone).isNull(), whole(us)).otherwise(_remaining(us, F.col(gone)))
        return let(rest, lambda r: F.struct(r["text"].alias("text"), F.size(us).cast("long").alias("n_units"), (F.size(us) - r["n"]).cast("long").alias("n_removed")))

    found = _marked(docs, id_col, text_col, gone).withColumn(out, F.when(text.isNull(), result).otherwise(let(units(text), counted)))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines(text))).cast("long")
    added = {"n_lines": n_lines, "n_units": F.col(out)["n_units"], "n_removed": F.col(out)["n_removed"]}
    own = [F.col(out)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in added]
    return found.select(*own, *[c.alias(k) for k, c in added.items()])
