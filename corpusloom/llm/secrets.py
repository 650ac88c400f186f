"""Secret scan with multipart credential linking.

Strong detectors (assign, access, hex) report every span they accept. Weak
detectors (ident, key, endpoint) match things that are common in harmless
text too, so a weak span is reported only when complementary parts of one
credential lie within the same scope, on other characters: an interval join,
per document, of the spans widened by `scope` code points on both sides. One
value is never its own complement.

All parts of a credential lie in one document, hence in one row: the interval
join is a sorted sweep inside the row's task and nothing is shuffled.

Rows: null text counts as empty (no spans, zero counts); repeated rows are
scanned independently; columns other than id and text are ignored, whatever
their names. Spans that start together are in the order of KINDS. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory

#: Code points around a span in which the other parts of its credential may stand.
SCOPE = 160

# The three strong kinds of the contract.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20

# Names may have a prefix before '_', as in environment files (DB_USER, AWS_SECRET_ACCESS_KEY).
IDENT = re.compile(r"""(?i:(?<![A-Za-z0-9])(?:user(?:_?name)?|login|account(?:_?name)?|client_?id|(?:access_?)?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", re.A)
WEAK_ASSIGN = re.compile(r"""(?i:(?<![A-Za-z0-9])(?:pwd|pass|passphrase|auth|bearer|credential|signature|private_?key|access_?key|account_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})""", re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+|(?i:(?<![A-Za-z0-9])(?:endpoint|host(?:name)?|server|bucket))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}""", re.A)

USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s/?#:@\"'<>]+):([^\s/?#@\"'<>]{3,})@")

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
RANK = {k: i for i, k in enumerate(KINDS)}

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], RANK[s[1]]))


def _random_looking(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


Span = tuple[int, str, int]


class _Parts:
    """Spans that can complete a credential; tells whether one of them stands within a margin of [start, end), apart from it."""

    def __init__(self, spans: list[Span]):
        self.starts = sorted(s for s, _, _ in spans)
        self.ends = sorted(e for _, _, e in spans)

    def beside(self, start: int, end: int, margin: int) -> bool:
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start - margin or after < len(self.starts) and self.starts[after] < end + margin


class _Cover:
    """Spans by start; tells whether any of them overlaps [start, end)."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((s, e) for s, _, e in spans)
        self.starts = [s for s, _ in ordered]
        self.reach = list(accumulate((e for _, e in ordered), max))

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def weak_spans(text: str) -> list[Span]:
    """Everything that could be a part of a credential. The user, password and rest of a URL are parts of their own."""
    weak: list[Span] = []
    if ":" in text or "=" in text:
        weak += [(m.start(), "ident", m.end()) for m in IDENT.finditer(text)]
        weak += [(m.start(), "key", m.end()) for m in WEAK_ASSIGN.finditer(text)]
        for m in ENDPOINT.finditer(text):
            owner = USERINFO.match(text, m.start(), m.end())
            if owner:
                weak += [(owner.start(1), "ident", owner.end(1)), (owner.start(2), "key", owner.end(2))]
            weak.append((owner.end() if owner else m.start(), "endpoint", m.end()))
    weak += [(m.start(), "key", m.end()) for m in RANDOM.finditer(text) if _random_looking(m[0])]
    return [w for w in weak if w[2] > w[0]]


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak spans whose complementary parts stand within the scope, on other characters than they do.

    ident needs a secret; key needs an identifier; endpoint needs one of each, and
    weak ones count there only if they are linked to each other. Strong spans
    serve as parts too: access is an identifier, assign and hex are secrets.
    """
    weak = weak_spans(text)
    if not weak:
        return []
    taken = _Cover(base)
    weak = [w for w in weak if w[1] == "endpoint" or not taken.overlaps(w[0], w[2])]
    strong = {"ident": [s for s in base if s[1] == "access"], "key": [s for s in base if s[1] in ("assign", "hex")]}
    parts = {kind: _Parts(own + [w for w in weak if w[1] == kind]) for kind, own in strong.items()}
    other = {"ident": "key", "key": "ident"}
    found = [w for w in weak if w[1] in other and parts[other[w[1]]].beside(w[0], w[2], scope)]
    linked = [_Parts(own + [w for w in found if w[1] == kind]) for kind, own in strong.items()]
    inner = [_Cover(own + [w for w in found if w[1] == kind]) for kind, own in strong.items()]

    def has_both(start: int, end: int) -> bool:
        # A URL may hold parts, as in its query.
        url = "://" in text[start:end]
        return all(p.beside(start, end, scope) or url and c.overlaps(start, end) for p, c in zip(linked, inner))

    return found + [w for w in weak if w[1] == "endpoint" and has_both(w[0], w[2])]


def find_spans(text: str, scope: int = SCOPE) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    base = base_spans(text)
    return base, sorted({*base, *linked_spans(text, base, scope)}, key=lambda s: (s[0], RANK[s[1]], s[2]))


def _written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(text: Column, scope: int = SCOPE) -> Column:
    """Struct of counts, digest and spans for one text column."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                base, every = find_spans(t or "", scope)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_written(base).encode()).hexdigest(), _written(every), [(k, s, e) for s, k, e in every]))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"])

    return run(text)


def redact(text: Column, mask: str = "[redacted]", scope: int = SCOPE) -> Column:
    """The text with every found span replaced by mask; overlapping spans become one. Null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else redacted(t, mask, scope) for t in batch], dtype=object)
        release_memory()

    return run(text)


def redacted(text: str, mask: str = "[redacted]", scope: int = SCOPE) -> str:
    out, done, open_to = [], 0, -1
    for start, _, end in find_spans(text, scope)[1]:
        if start >= open_to:
            if open_to >= 0:
                done = open_to
            out += [text[done:start], mask]
            open_to = end
        else:
            open_to = max(open_to, end)
    return "".join(out) + text[max(open_to, 0) :] if out else text


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: the id and the scan's columns."""
    found = docs.select(F.col(f"`{id_col}`"), scan(F.col(f"`{text_col}`"), scope).alias("found"))
    return found.select(f"`{id_col}`", "found.*")
