"""Near-duplicate vectors by randomised-rotation binary codes.

Codes. A vector is normalised and rotated at random; the signs of the rotated
components are its binary code, and the inner product of the rotated vector
with its code is stored beside it as the correction factor. For a rotated query
q and a code c with factor f, <q, c> / f is an unbiased estimate of the cosine,
and sqrt((1 - f^2) / f^2 / (D - 1)) scales its error. A pair whose estimate plus
`EPSILON` such errors stays under the threshold is dropped. The query is kept as
bytes, rounded at random so that the estimate stays unbiased. Most pairs don't
reach the estimate: the bits in which two codes differ are binomial around
D * angle / pi, and a pair with `FAR` deviations more than the threshold's angle
allows is dropped by one popcount.

Candidates. Pairs are compared inside buckets of `tables` hash tables; a bucket
is given by `bits` signs of further random rotations. A pair at the threshold
shares a bucket of one table with probability (1 - angle / pi) ^ bits, and the
number of tables follows from the wanted recall; it grows slower than the
sixth root of the input. First only codes travel, and each bucket tells which
of its rows have a candidate there; then the vectors of those rows alone travel
to their buckets, where the pairs left by the estimate are computed again in
double precision. A pair that meets in several tables counts in the first only.
A bucket with many rows is cut into blocks, and each pair of blocks is a task of
its own, so there is no cap and no large task. Equal vectors are compared once
and weighted by their number.

A task returns, for each row, its number of links and the smallest row of its
local component, never pairs; components() joins those.

Rows: vectors that are null, zero or hold null or non-finite components, and
rows with a null id, link with nothing and stay on their own. Vectors of
different length never link. Repeated rows, and rows that share an id, count as
further equal vectors or as vectors of their own; a component is named by the
smallest id of its rows. A cosine of exactly the threshold links. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, sized_broadcast
from .components import Forest, components

THRESHOLD = 0.95
RECALL = 0.985
EPSILON = 3.0
FAR = 4.0
BUCKET_ROWS = 2048
#: Rows of a block, where codes are compared and where vectors are; rows compared at once with a block.
CODE_BLOCK, BLOCK, TILE = 8192, 2048, 256
SEED = 20240229


def layout(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for a number of rows: buckets of about BUCKET_ROWS, tables as the recall at the threshold needs."""
    bits = max(3, round(math.log2(max(2, rows) / BUCKET_ROWS)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


@lru_cache(maxsize=256)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix, with unique signs."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_rows(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hash_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """rows x tables: the signs of `bits` components of rotations 1, 2, ... in turn."""
    dim = x.shape[1]
    need = bits * tables
    signs = np.concatenate([x @ rotation(dim, 1 + k) > 0 for k in range(-(-need // dim))], axis=1)[:, :need]
    return signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes and correction factors of unit rows."""
    turned = x @ rotation(x.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])


def query_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotated unit rows in steps of 1/127 of their largest component, rounded at random, and the steps."""
    turned = x @ rotation(x.shape[1], 0)
    step = np.abs(turned).max(axis=1) / 127
    draw = np.random.default_rng([SEED, len(x)]).random(turned.shape)
    return np.clip(np.floor(turned / step[:, None] + draw), -127, 127).astype(np.int8), step


def _encoded(vector: Column, bits: int, tables: int) -> Column:
    @F.pandas_udf("keys array<long>, code binary, factor double, query binary, step double")
    def run(vectors: pd.Series) -> pd.DataFrame:
        n = len(vectors)
        keys, code, query = (np.empty(n, object) for _ in range(3))
        factor, step = np.zeros(n), np.zeros(n)
        sizes = vectors.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = unit_rows(list(vectors.iloc[at]))
            codes, factor[at] = encode(x)
            queries, step[at] = query_bytes(x)
            for out, found in ((keys, hash_keys(x, bits, tables)), (code, map(bytes, codes)), (query, map(bytes, queries))):
                for i, one in zip(at, found):
                    out[i] = one
        return pd.DataFrame({"keys": keys, "code": code, "factor": factor, "query": query, "step": step})

    return run(vector)


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Codes:
    """Codes, factors and queries of some rows as arrays."""

    def __init__(self, pdf: pd.DataFrame):
        code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
        self.query = np.frombuffer(b"".join(pdf["query"]), np.int8).reshape(len(pdf), -1)
        self.dim = self.query.shape[1]
        self.signs = np.unpackbits(code, axis=1, count=self.dim)
        self.words = np.pad(code, ((0, 0), (0, -code.shape[1] % 8))).view(np.uint64)
        self.factor, self.step = pdf["factor"].to_numpy(float), pdf["step"].to_numpy(float)


def candidates(codes: Codes, a: np.ndarray, b: np.ndarray, threshold: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the row pairs, of a and of b, that the codes don't rule out. Of two equal sides each pair comes once; wanted picks pairs before they are estimated."""
    dim, own = codes.dim, a is b
    chance = math.acos(threshold) / math.pi
    most = dim * chance + FAR * math.sqrt(dim * chance * (1 - chance)) + 1
    least = threshold - EPSILON * np.sqrt(np.maximum(0.0, 1 - codes.factor**2) / codes.factor**2 / max(1, dim - 1)) - 1e-5
    for k in range(0, len(a), TILE):
        rows = a[k : k + TILE]
        apart = sum(np.bitwise_count(codes.words[rows, None, w] ^ codes.words[None, b, w]).astype(np.uint16) for w in range(codes.words.shape[1]))
        i, j = np.nonzero(apart <= most)
        if own:
            i, j = i[j > i + k], j[j > i + k]
        i, j = rows[i], b[j]
        if wanted is not None:
            pick = wanted(i, j)
            i, j = i[pick], j[pick]
        near = [np.zeros(0, bool)]
        for p in range(0, len(i), 1 << 16):
            q, c = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
            product = 2.0 * np.einsum("ij,ij->i", codes.query[q], codes.signs[c], dtype=np.float32) - codes.query[q].sum(axis=1, dtype=np.float32)
            rounding = EPSILON * codes.step[q] / 2
            near.append(codes.step[q] * product / (math.sqrt(dim) * codes.factor[c]) >= least[c] - rounding)
        near = np.concatenate(near)
        yield i[near], j[near]


def links(pdf: pd.DataFrame, a: np.ndarray, b: np.ndarray, table: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the row pairs with cosine at or over the threshold that meet first in this table."""
    unit, keys = unit_rows(list(pdf["vector"])), np.stack(list(pdf["keys"]))

    def first_here(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.all(keys[i, :table] != keys[j, :table], axis=1)

    for i, j in candidates(Codes(pdf), a, b, threshold, first_here if table else None):
        near = [np.einsum("ij,ij->i", unit[i[p : p + (1 << 16)]], unit[j[p : p + (1 << 16)]]) >= threshold for p in range(0, len(i), 1 << 16)]
        near = np.concatenate(near or [np.zeros(0, bool)])
        yield i[near], j[near]


def _sides(pdf: pd.DataFrame, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    chunk = pdf["chunk"].to_numpy()
    a = np.flatnonzero(chunk == low)
    return a, a if low == high else np.flatnonzero(chunk == high)


def _with_candidates(threshold: float):
    """The rows of a bucket's pair of blocks that have a candidate there."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(pdf), bool)
        if len(pdf) > 1:
            a, b = _sides(pdf, int(key[3]), int(key[4]))
            for i, j in candidates(Codes(pdf), a, b, threshold, lambda i, j: ~(found[i] & found[j])):
                found[i] = found[j] = True
        return pdf.loc[found, ["t", "key", "rep"]]

    return run


def _linked(threshold: float):
    """For the rows of a bucket's pair of blocks: the number of links there and the smallest row of the local component."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rep, weight = pdf["rep"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        order = np.argsort(rep, kind="stable")
        pdf, rep, weight = pdf.iloc[order], rep[order], weight[order]
        n, forest = np.zeros(len(pdf), np.int64), Forest(len(pdf))
        if len(pdf) > 1:
            for i, j in links(pdf, *_sides(pdf, int(key[3]), int(key[4])), int(key[0]), threshold):
                np.add.at(n, i, weight[j])
                np.add.at(n, j, weight[i])
                forest.tie(i, j)
        at = np.flatnonzero(n)
        return pd.DataFrame({"rep": rep[at], "n": n[at], "root": rep[forest.root[at]]})

    return run


def _blocked(rows: DataFrame, block: int, stage: Staging) -> DataFrame:
    """rows of (t, key, dim, rep, ...) with low and high: each goes to every pair of its bucket's blocks that it belongs to."""
    sizes = rows.groupBy("t", "key", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    large = stage(sizes.select("t", "key", "dim", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "large-buckets")
    cut = rows.join(sized_broadcast(large), ["t", "key", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cut.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("blocks", "other")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    stage = Staging()
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    good = F.col("vec_id").isNotNull() & _usable(F.col("vector"))
    equal = rows.filter(good).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # Rows that share an id may have different vectors, so a vector's own number stands for it.
    distinct = stage(equal.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    bits, tables = layout(distinct.count(), threshold, recall)
    coded = stage(distinct.withColumn("e", _encoded(F.col("vector"), bits, tables)).select("rep", "copies", "vector", "e.*"), "coded-vectors")
    bucket = ("t", "key", "dim", "low", "high")
    codes = coded.select("rep", "code", "factor", "query", "step", F.octet_length("query").alias("dim"), F.posexplode("keys").alias("t", "key"))
    met = _blocked(codes, CODE_BLOCK, stage).groupBy(*bucket).applyInPandas(_with_candidates(threshold), "t int, key long, rep long")
    met = stage(met.distinct(), "rows-with-candidates")
    full = met.join(coded.withColumn("dim", F.size("vector")), "rep")
    found = stage(_blocked(full, BLOCK, stage).groupBy(*bucket).applyInPandas(_linked(threshold), "rep long, n long, root long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select("root", "rep"), "root", "rep").select(F.col("node").alias("rep"), "root")
    summary = distinct.join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    summary = stage(summary.select("vector", "first", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "vector-roots")
    names = summary.groupBy("root").agg(F.min("first").alias("component"))
    summary = stage(summary.join(names, "root").select(F.col("vector").alias("of"), "n", "component"), "vector-summary")
    stage.drop(summary)
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    joined = rows.filter(good).join(summary, F.col("vector") == F.col("of"))
    joined = joined.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    return joined.unionByName(alone)
