"""Markdown compaction that never loses a word.

A text is read once into a header, runs of table rows and runs of other lines,
and each is written in its shortest form: header fields that nobody reads go,
tables lose their alignment and the columns that no data row fills, picture
marks and surplus blank lines go. If the words of the result were not those of
the text, the text stays as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import pipes
from ..functions import text as T
from .verify import words

# The header fields that are kept, and the marks of pictures.
HEADER_FIELDS = ("source:", "source_pseudopath:", "source_format:", "pages:", "verification_status:", "chapter_title:")
PICTURE = re.compile(r"[ \t]*<!--\s*(?:image|imagen)\s*-->[ \t]*")

FENCE = "---"


def split_header(text: str) -> tuple[list[str], str]:
    """The lines of the front matter (none if it has no end) and the text after it, its closing fence included."""
    end = text.find(FENCE, len(FENCE)) if text.startswith(FENCE) else -1
    return (text[len(FENCE) : end].splitlines(), text[end:]) if end > 0 else ([], text)


def _table(rows: list[list[str]]) -> Iterator[str]:
    """A run of rows; a column is shown if a data row fills it, or if the table has no data at all."""
    ruled = [pipes.is_rule(r) for r in rows]
    columns = range(max(map(len, rows)))
    used = {c for row, rule in zip(rows, ruled) if not rule for c, cell in enumerate(row) if cell}
    partly = 0 < len(used) < len(columns)
    for row, rule in zip(rows, ruled):
        shown = [row[c] if c < len(row) else "" for c in columns if c in used] if partly else row
        yield pipes.write_rule(len(shown)) if rule else pipes.write_row(shown)


def _prose(lines: list[str]) -> Iterator[str]:
    for line in lines:
        if not PICTURE.fullmatch(line):
            yield line.rstrip(" \t")


def tightened(text: str) -> str:
    """The text in its shortest form, with one line feed at its end."""
    header, rest = split_header(text)
    kept = [line for line in header if line.lstrip().startswith(HEADER_FIELDS)]
    # A header without a field to keep stays whole.
    head = f"{FENCE}\n{chr(10).join(kept)}\n" if kept else text[: len(text) - len(rest)]
    out: list[str] = []
    rows = ((pipes.read_row(line), line) for line in rest.split("\n"))
    for in_table, run in groupby(rows, key=lambda r: r[0] is not None):
        out.extend(_table([cells for cells, _ in run]) if in_table else _prose([line for _, line in run]))
    return re.sub(r"\n{3,}", "\n\n", head + "\n".join(out)).rstrip("\n") + "\n"


@F.pandas_udf(StringType())
def _tightened(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else tightened(t))


def body(text: Column) -> Column:
    """The text after its front matter."""
    end = F.when(text.startswith(FENCE), F.locate(FENCE, text, 4)).otherwise(F.lit(0))
    return F.when(end > 0, F.substring(text, end + 3, F.length(text))).otherwise(text)


def compact(text: Column) -> Column:
    """struct<text, compacted>: the compact text, or the original if any word were missing from it."""
    # Equal sorted words mean that none is missing; compaction never adds any.
    bag = lambda t: F.sort_array(words(T.strip_markdown_noise(body(t))))
    pick = lambda c: F.when(bag(c) == bag(text), F.struct(c.alias("text"), F.lit(True).alias("compacted"))).otherwise(F.struct(text.alias("text"), F.lit(False).alias("compacted")))
    return F.element_at(F.transform(F.array(_tightened(text)), pick), 1)
