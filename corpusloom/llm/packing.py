"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Three passes. First, documents are tokenised and cut into pieces; the pieces
(ids left out, only lengths and checksums) are staged. Second, a plan is made
on the driver from the histogram of piece lengths alone, which has at most
`capacity` entries whatever the size of the corpus. Third, each piece gets its
rank among the pieces of its length and looks its place up in the plan.

Plan. A bin is filled greedily: the longest piece left that fits, again and
again. Then the bin's smallest piece is taken out if two unpacked pieces fit the
gap that this leaves more tightly; the pair that leaves the least gap is taken.
A finished pattern is repeated for as many bins as the histogram allows, so the
plan has a row for each length of each distinct pattern, not for each bin.

Ranks. Pieces of one length may be a third of all pieces, so each length is
dealt over shards; a piece's rank is its number in (length, shard) plus the
pieces of that length in the shards before.

Rows: a null or empty text is a document with no ids of its own, one piece that
holds only the end id. Repeated rows are packed like any others. An empty table
gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import OffsetTable, byte_characters
from .common import bounded_batches, release_memory, staged
from .pretokens import is_plain, plain_words

CAPACITY = 2048
#: Pieces of one length in one shard, on average, at most.
SHARD_ROWS = 1_000_000
MIN_SHARDS = 64
#: Chunks whose ids a worker keeps; later ones are encoded each time they occur.
CACHE_SIZE = 100_000
#: Characters of the texts that are split together.
GROUP_CHARS = 8_000_000


class WordIds:
    """Ids of whole texts by the library.

    No token of the vocabulary spans white space, so plain texts are split there,
    a group of texts at a time, and each distinct chunk is encoded once: its
    words go straight to the library's model, or come from those that are kept.
    Other texts go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = {b: ord(c) for b, c in byte_characters().items()}
        self.packers = [struct.Struct(f"<{n}I") for n in range(64)]
        self.kept: dict[str, bytes] = {}
        self.known, self.known_ids = pa.array([], pa.large_string()), OffsetTable([], "<u4")

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.model.tokenize(shown)]
        return self.packers[len(ids)].pack(*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def _part(self, word: str) -> bytes:
        found = self.kept.get(word)
        if found is None:
            found = self._word(word)
            if len(self.kept) < CACHE_SIZE // 4 and len(word) <= 64:
                self.kept[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        return self._word(chunk) if chunk.isalpha() else b"".join([self._part(w) for w in plain_words(chunk)])

    def _ids_of(self, chunks: pa.Array) -> OffsetTable:
        """The ids of distinct chunks: looked up among the known ones, else encoded; the first new ones become known."""
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(at.is_null())
        encoded = OffsetTable([self._chunk(c) for c in new.to_numpy(zero_copy_only=False).tolist()], "<u4")
        row = at.fill_null(-1).to_numpy().astype(np.int64)
        row[row < 0] = len(self.known) + np.arange(len(new))
        size = np.concatenate([self.known_ids.size, encoded.size])
        start = np.concatenate([self.known_ids.start, encoded.start + len(self.known_ids.blob)])
        every = OffsetTable.of(start, size, np.concatenate([self.known_ids.blob, encoded.blob]))
        if room := CACHE_SIZE - len(self.known):
            self.known = pa.concat_arrays([self.known, new[:room]])
            n = len(self.known)
            self.known_ids = OffsetTable.of(start[:n], size[:n], every.blob[: int(start[n - 1] + size[n - 1])] if n else every.blob[:0])
        return OffsetTable.of(start[row], size[row], every.blob)

    def _plain(self, texts: list[str]) -> list[bytes]:
        lower = pa.array([t.lower() for t in texts], pa.large_string())
        # A lone sign between a letter and white space is a match of its own; apart, it leaves fewer distinct chunks.
        chunks = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, r"(\pL)([.,])(\s)", r"\1 \2\3"))
        coded = chunks.values.dictionary_encode()
        table = self._ids_of(coded.dictionary)
        which = coded.indices.to_numpy()
        ends = 4 * np.concatenate([[0], np.cumsum(table.size[which])])[chunks.offsets.to_numpy()]
        whole = b"".join(table.gather(which))
        return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        group: list[str] = []
        turns: list[bytes | None] = []
        size = 0

        def flush() -> Iterator[bytes]:
            plain = iter(self._plain(group) if group else ())
            for t in turns:
                yield next(plain) if t is None else t

        for text in texts:
            if is_plain(text) and not any(s in text for s in self.special):
                group.append(text)
                turns.append(None)
            else:
                turns.append(self._library(text))
            size += len(text)
            if size > GROUP_CHARS:
                yield from flush()
                group, turns, size = [], [], 0
        yield from flush()


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def cut(text: Column, path: str, capacity: int = CAPACITY, end_id: int = 0) -> Column:
    """The pieces of a text's ids and end id: all of `capacity` ids, but the last, which may be shorter."""

    @F.pandas_udf(PIECES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, end = _word_ids(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for raw in ids.encode_all([t or "" for t in batch]):
                raw += end
                parts = [raw[k : k + 4 * capacity] for k in range(0, len(raw), 4 * capacity)]
                out.append([(k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)])
            yield pd.Series(out, dtype=object)
        release_memory()

    return run.asNondeterministic()(text)  # else a filter inferred from the explode runs it a second time


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces a bin, first bin, offset), by length and rank; the number of bins."""
    left = dict(counts)
    sizes = sorted(left)
    rows, bins = [], 0

    def largest(room: int, used: dict[int, int], sizes: list[int]) -> int:
        k = bisect_right(sizes, room)
        while k and left[sizes[k - 1]] <= used.get(sizes[k - 1], 0):
            k -= 1
        return sizes[k - 1] if k else 0

    done = dict.fromkeys(sizes, 0)
    while sizes:
        used: dict[int, int] = {}
        gap = capacity
        while size := largest(gap, used, sizes):
            n = min(left[size] - used.get(size, 0), gap // size)
            used[size] = used.get(size, 0) + n
            gap -= n * size
        if gap:
            small = min(used)
            used[small] -= 1
            room, best = gap + small, (small, (small,))
            for a in sizes[: bisect_right(sizes, room - 1)]:
                if left[a] <= used.get(a, 0) or a == small and left[a] <= used.get(a, 0) + 1:
                    continue
                used[a] = used.get(a, 0) + 1
                b = largest(min(room - a, a), used, sizes)
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, (a, b))
                    if a + b == room:
                        break
            for size in best[1]:
                used[size] = used.get(size, 0) + 1
        used = {s: n for s, n in used.items() if n}
        times = min(left[s] // n for s, n in used.items())
        offset = 0
        for size in sorted(used, reverse=True):
            rows.append((size, done[size], used[size], bins, offset))
            offset += size * used[size]
            done[size] += used[size] * times
            left[size] -= used[size] * times
        bins += times
        sizes = [s for s in sizes if left[s]]
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bounded_batches(docs.sparkSession)
    cut_docs = docs.select(F.col(id_col).alias("doc_id"), cut(F.col(text_col), path, capacity, end_id).alias("pieces"))
    return cut_docs.select("doc_id", F.inline("pieces"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and place; every piece of every document is placed."""
    pieces = staged(pieces_of(docs, path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    shards = max(MIN_SHARDS, sum(counts.values()) // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).alias("shard")
    dealt = pieces.withColumn("shard", shard)
    per_shard = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    before = per_shard.select("length", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("number", number).join(before, ["length", "shard"])
    rows, _ = plan(counts, capacity)
    place = _place(F.col("length"), F.col("number") + F.col("before"), rows)
    placed = ranked.withColumn("place", place)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def _place(length: Column, rank: Column, rows: np.ndarray) -> Column:

    @F.pandas_udf("sequence_id long, offset long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for size, k in batches:
            size, k = size.to_numpy(np.int64), k.to_numpy(np.int64)
            # Rows are by (length, first rank); the last one not beyond the piece holds its place.
            low = np.searchsorted(rows[:, 0], size, "left")
            high = np.searchsorted(rows[:, 0], size, "right")
            at = _last_not_after(rows[:, 1], low, high, k)
            row = rows[at]
            inside = k - row[:, 1]
            yield pd.DataFrame({"sequence_id": row[:, 3] + inside // row[:, 2], "offset": row[:, 4] + inside % row[:, 2] * size})

    return run(length, rank)


def _last_not_after(first: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each i the last position in [low, high) whose `first` is at most k; a binary search over all i at once."""
    low, high = low.copy(), high - 1
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        up = open_ & (first[np.minimum(mid, len(first) - 1)] <= k)
        low = np.where(up, mid, low)
        high = np.where(open_ & ~up, mid - 1, high)
    return low
