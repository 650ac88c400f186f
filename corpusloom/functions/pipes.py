"""Pipe tables of Markdown as lists of rows, read and written."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

#: Characters of a row that only rules columns.
_RULING = frozenset("-: \t")


def read_row(line: str) -> list[str] | None:
    """The trimmed cells of a line that is a table row, else None."""
    bare = line.strip()
    return [cell.strip() for cell in bare[1:-1].split("|")] if len(bare) > 1 and bare[0] == bare[-1] == "|" else None


def is_rule(cells: Sequence[str]) -> bool:
    return all(_RULING.issuperset(cell) for cell in cells)


def write_row(cells: Iterable[str]) -> str:
    return f"| {' | '.join(cells)} |"


def write_rule(columns: int) -> str:
    return f"|{'---|' * columns}"


def escaped(cell: str) -> str:
    return " ".join(cell.split()).replace("|", "\\|")


def write_table(rows: Sequence[Sequence[str]]) -> str:
    """A table whose first row is its head; short rows are filled, empty rows at the end go."""
    filled = max((k + 1 for k, row in enumerate(rows) if any(row)), default=0)
    columns = max((len(row) for row in rows[:filled]), default=0)
    lines = [write_row(escaped(row[c]) if c < len(row) else "" for c in range(columns)) for row in rows[:filled]]
    return "\n".join([*lines[:1], write_rule(columns), *lines[1:]]) if lines else ""
