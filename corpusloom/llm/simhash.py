"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are 64 bits; two link if at most `BUDGET` bits differ. Links are
found among distinct fingerprints only, so exact and bitwise copies cost one
row. Two fingerprints within three bits agree on one of four 16-bit blocks at
least, so each fingerprint goes to four shards, rotated to put that block
first. In a shard the sorted fingerprints are a binary trie: pairs of nodes
are traversed together, level by level, with the differing bits so far; a pair
is dropped when the bits exceed the budget. Each shard returns a spanning
forest of its links, not all pairs, and the forests are joined by components().
A shard that holds more than HOT fingerprints of one block value is dealt out:
each pair of its subtrees, some bits down, is a task.

Rows: a text without words (null or blank) has fingerprint zero, which links
like any other. A null doc_id gets its fingerprint and its component, but never
names one (component_id is null if there is no other). Repeated rows share a
component; rows equal in id alone each have their own text's. An empty table
gives an empty result. near_duplicates ignores other columns, deduplicate
carries them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, private, release_memory, sized_broadcast
from .components import Forest, components

BUDGET, BLOCKS, SHINGLE, SEED = 3, 4, 3, 42
#: Node pairs held at once in a traversal; more are worked off in parts.
FRONTIER = 1 << 20
#: A node pair with so few member pairs is compared directly.
SMALL = 32
#: Pairs compared at once; their links are folded into the forest before the next ones are made.
PART = 1 << 21
#: Fingerprints of a block value that one task takes; more are dealt out by the pairs of their subtrees.
HOT = 1 << 18

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < size:
        hashes = [digest(join(words), seed)]
    else:
        hashes = [digest(s, seed) for s in map(join, zip(*(words[k:] for k in range(size))))]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((raw + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    over = (2 * counts > len(hashes)).astype(np.uint8).ravel()
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint as a long (the same 64 bits, signed)."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))
        release_memory()

    return run(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def close_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int = BUDGET, across: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the index pairs of at most `budget` differing bits within each [start, end) of values, or, if across gives (start, end, bits), between the two.

    values: sorted distinct uint64 in each range; members of a range agree on the first `depth` bits, and
    those of the two ranges of a pair in all but `bits` of them. A part holds about PART pairs at most.
    """
    other_starts, other_ends, bits = across or (starts, ends, np.zeros(len(starts), np.int64))
    stack = [(depth, starts, ends, other_starts, other_ends, bits)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        own = alo == blo
        pairs = np.where(own, (ahi - alo) * (ahi - alo - 1) // 2, (ahi - alo) * (bhi - blo))
        direct = (pairs > 0) & ((pairs <= SMALL) | (depth == 64))
        at = np.flatnonzero(direct)
        for k in range(0, len(at), PART // SMALL):
            part = at[k : k + PART // SMALL]
            a, b = _members(alo[part], ahi[part], blo[part], bhi[part])
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            yield a[near], b[near]
        going = (pairs > 0) & ~direct
        if not going.any():
            continue
        alo, ahi, blo, bhi, err, own = (x[going] for x in (alo, ahi, blo, bhi, err, own))
        if depth not in ones:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        amid, bmid = ahi - (ones[depth][ahi] - ones[depth][alo]), bhi - (ones[depth][bhi] - ones[depth][blo])
        children = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), (amid[~own], ahi[~own], blo[~own], bmid[~own], err[~own] + 1)]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*children))
        keep = (err <= budget) & (ahi > alo) & (bhi > blo)
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        for k in range(0, len(alo), FRONTIER):
            stack.append((depth + 1, *(x[k : k + FRONTIER] for x in (alo, ahi, blo, bhi, err))))


def _members(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the node pairs; of a node with itself, each pair once."""
    width, counts = bhi - blo, (ahi - alo) * (bhi - blo)
    which = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    a, b = alo[which] + inside // width[which], blo[which] + inside % width[which]
    once = (alo[which] != blo[which]) | (a < b)
    return a[once], b[once]


def _rotated(fp: Column, block: int) -> Column:
    bits = 64 // BLOCKS * block
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits)) if block else fp


def _home(value: np.ndarray, block: np.ndarray, bits: int) -> np.ndarray:
    """Rotated fingerprints as they were, signed."""
    turn = (block * bits).astype(np.uint64)
    return np.where(turn > 0, (value >> turn) | (value << ((np.uint64(64) - turn) % np.uint64(64))), value).view(np.int64)


def _forest(value: np.ndarray, block: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], bits: int) -> pd.DataFrame:
    forest = Forest(len(value))
    for a, b in pairs:
        forest.tie(a, b)
    tied = np.flatnonzero(forest.root != np.arange(len(value)))
    home = _home(value, block, bits)
    return pd.DataFrame({"a": home[forest.root[tied]], "b": home[tied]})


def shard_links(rows: Iterator[pd.DataFrame], bits: int = 64 // BLOCKS) -> Iterator[pd.DataFrame]:
    """Spanning links (a, b as fingerprints) in each block value of rows sorted by (block, rotated)."""

    def solve(parts: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        block, value = (np.concatenate(x) for x in zip(*parts))
        head = np.r_[True, (block[1:] != block[:-1]) | (value[1:] >> np.uint64(64 - bits) != value[:-1] >> np.uint64(64 - bits))]
        starts = np.flatnonzero(head)
        ends = np.r_[starts[1:], len(value)]
        more = ends - starts > 1
        return _forest(value, block, close_pairs(value, starts[more], ends[more], bits), bits)

    rest: list[tuple[np.ndarray, np.ndarray]] = []
    for pdf in rows:
        block, value = pdf["block"].to_numpy(np.int64), pdf["rotated"].to_numpy(np.int64).view(np.uint64)
        top = value >> np.uint64(64 - bits)
        last = (block == block[-1]) & (top == top[-1])  # may go on in the next batch
        cut = int(np.argmax(last))
        if rest and (cut or rest[-1][0][-1] != block[-1] or rest[-1][1][-1] >> np.uint64(64 - bits) != top[-1]):
            yield solve([*rest, (block[:cut], value[:cut])])
            rest = []
        elif cut:
            yield solve([(block[:cut], value[:cut])])
        rest.append((block[cut:], value[cut:]))
    if rest:
        yield solve(rest)


def subtree_links(pdf: pd.DataFrame, depth: int, bits: int = 64 // BLOCKS) -> pd.DataFrame:
    """Spanning links of one pair of subtrees of a hot block value: rows of block, rotated, sub, low and high."""
    pdf = pdf.sort_values("rotated", key=lambda x: x.astype(np.int64).to_numpy().view(np.uint64), ignore_index=True)
    value, block = pdf["rotated"].to_numpy(np.int64).view(np.uint64), pdf["block"].to_numpy(np.int64)
    sub, low, high = pdf["sub"].to_numpy(np.int64), int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    if low == high:
        return _forest(value, block, close_pairs(value, np.array([0]), np.array([len(value)]), depth), bits)
    middle = int(np.searchsorted(sub, high))  # rotated order is that of the subtrees
    apart = np.array([(low ^ high).bit_count()])
    pairs = close_pairs(value, np.array([0]), np.array([middle]), depth, across=(np.array([middle]), np.array([len(value)]), apart))
    return _forest(value, block, pairs, bits)


#: Bits by which a hot block value is cut into subtrees.
CUT = 6


def fingerprint_links(distinct: DataFrame, stage: Staging | None = None, hot: int = HOT) -> DataFrame:
    """Spanning links among the distinct fingerprints in column fp."""
    stage = stage or Staging()
    bits = 64 // BLOCKS
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _rotated(F.col("fp"), k).alias("rotated")) for k in range(BLOCKS)])).alias("s")
    dealt = distinct.select(sides).select("s.block", "s.rotated").withColumn("top", F.shiftrightunsigned("rotated", 64 - bits))
    # Unsigned order: the top bits first, then the rest, which isn't negative once they are equal or falls in two runs.
    low = F.col("rotated").bitwiseXOR(F.lit(-(1 << 63)))
    sizes = dealt.groupBy("block", "top").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("block", "top")
    large = stage(sizes, "hot-blocks")  # at most rows / HOT of them
    links = lambda rows: rows.repartition("block", "top").sortWithinPartitions("block", "top", low).select("block", "rotated").mapInPandas(shard_links, "a long, b long")
    if large.isEmpty():
        return links(dealt)
    large = sized_broadcast(large)
    cut = dealt.join(large, ["block", "top"], "left_semi").withColumn("sub", F.shiftrightunsigned("rotated", 64 - bits - CUT).bitwiseAND(F.lit((1 << CUT) - 1)))
    # A subtree meets those that differ in BUDGET bits at most; each pair of subtrees is a task of its own.
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << CUT) if m.bit_count() <= BUDGET])
    cut = cut.withColumn("other", F.explode(F.transform(masks, lambda m: F.col("sub").bitwiseXOR(m))))
    cut = cut.withColumn("low", F.least("sub", "other")).withColumn("high", F.greatest("sub", "other"))
    found = cut.groupBy("block", "top", "low", "high").applyInPandas(lambda pdf: subtree_links(pdf, bits + CUT), "a long, b long")
    return links(dealt.join(large, ["block", "top"], "left_anti")).union(found)


def _grouped(docs: DataFrame, id_col: str, text_col: str, stage: Staging) -> DataFrame:
    """(doc_id, of_text, fp, root, component_id) of each row: root is one fingerprint of its group, of_text a hash of its text."""
    text = F.col(f"`{text_col}`")
    prints = stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("of_text"), fingerprints(text).alias("fp")), "prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    tied = stage(components(fingerprint_links(distinct, stage)).join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "first_id"), "tied")
    named = tied.join(tied.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "root", "component_id")
    of_print = distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    of_print = stage(of_print, "of-print")
    return prints.join(of_print, "fp").select("doc_id", "of_text", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id (smallest id reachable over links)."""
    return _grouped(docs, id_col, text_col, Staging()).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the first by id, then by a hash of the text. Rows with a null id stay.

    Rows equal in id and text are one document, of which one row stays; rows
    equal in id alone are judged each by its own group.
    """
    stage = Staging()
    found = _grouped(docs, id_col, text_col, stage).filter("doc_id IS NOT NULL").groupBy("doc_id", "of_text", "root").agg(F.count("*").alias("n"))
    found = stage(found, "found")
    first = stage(found.groupBy("root").agg(F.min(F.struct("doc_id", "of_text")).alias("first")).select("first.*"), "kept-of-groups")
    of_id, of_text = private(docs, "of_id", "of_text")
    gone = stage(found.join(first, ["doc_id", "of_text"], "left_anti").select(F.col("doc_id").alias(of_id), F.col("of_text").alias(of_text)), "gone")
    again = stage(found.filter("n > 1").join(first, ["doc_id", "of_text"], "left_semi").select(F.col("doc_id").alias(of_id), F.col("of_text").alias(of_text)), "repeated-rows")
    stage.drop(gone, again)
    same = (F.col(f"`{id_col}`") == F.col(of_id)) & F.xxhash64(F.col(f"`{text_col}`")).eqNullSafe(F.col(of_text))
    kept = docs.join(sized_broadcast(gone), same, "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(sized_broadcast(again), same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(sized_broadcast(again), same, "left_anti").unionByName(once)
