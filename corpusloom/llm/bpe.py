"""Byte-level BPE: a backtracking encoder that is exact and linear, and a table decoder.

Encoder. Greedy merging gives the one token sequence in which every adjacent
pair is compatible, that is, would come out unchanged if the pair's bytes were
merged alone. One pass of an Aho-Corasick automaton (over reversed tokens)
gives the longest token that starts at each byte. The encoder takes the longest
token at its position; if it isn't compatible with the token before it, the next
shorter prefix token is tried, and if none is left the encoder steps back over
the last token and marks the position as dead, so no position is tried twice.

Decoder. All token byte strings lie in one blob; an offset table gives each
id's slice, and a whole id array is gathered at once.

Rows: null text counts as empty (no tokens; both digests are those of the empty
string); repeated rows are encoded independently; whole texts are encoded,
whatever their length; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pretokens import byte_level

#: Pre-tokens whose ids a worker keeps; later ones are encoded each time they occur.
CACHE_SIZE = 400_000
_NEVER = 1 << 60


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class OffsetTable:
    """Strings of items (bytes, or numbers of a given type) by id; gathers the concatenation for an array of ids."""

    def __init__(self, strings: list[bytes], dtype: str = "u1"):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings)) // np.dtype(dtype).itemsize
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(strings), dtype)

    @classmethod
    def of(cls, start: np.ndarray, size: np.ndarray, blob: np.ndarray) -> OffsetTable:
        made = cls.__new__(cls)
        made.start, made.size, made.blob = start, size, blob
        return made

    def gather(self, ids: np.ndarray, step: int = 1 << 18) -> Iterator[bytes]:
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            size = self.size[part]
            ends = np.cumsum(size)
            index = np.repeat(self.start[part] - ends + size, size)
            index += np.arange(len(index))
            yield self.blob[index].tobytes()


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_characters().items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_names = re.compile("|".join(map(re.escape, sorted(self.special))))
        as_bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(as_bytes) + 1
        strings = [as_bytes.get(i, b"") for i in range(size)]
        self.bytes_of = OffsetTable(strings)
        self.decimal_of = OffsetTable([b"%d," % i for i in range(size)])
        self.length = [len(s) for s in strings]
        self.rank, self.left, self.right, self.merged = [-1] * size, [-1] * size, [-1] * size, {}
        for k, (a, b) in enumerate(map(tuple, spec["model"]["merges"])):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = k
            self.rank[whole], self.left[whole], self.right[whole] = k, *pair
        # Only tokens that merging can reach take part.
        usable = {s.decode("latin-1"): i for i, s in enumerate(strings) if i not in self.special.values() and self._reachable(i)}
        self.shorter = [-1] * size
        for s, i in usable.items():
            self.shorter[i] = next((usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in usable), -1)
        self.matcher = ahocorasick.Automaton()
        for s, i in usable.items():
            self.matcher.add_word(s[::-1], i)
        self.matcher.make_automaton()
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b alone gives a, b again; known pairs come from the table."""
        known = self.compatible_pairs.get((a, b))
        if known is None:
            known = self._stays_apart(a, b, _NEVER)
            if len(self.compatible_pairs) < CACHE_SIZE:
                self.compatible_pairs[a, b] = known
        return known

    def _stays_apart(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of rank under `before` crosses the border of a and b."""
        # Merges are undone, latest first; of equal ones the right one is later.
        # Between two undone merges, the tokens at the border must have no earlier merge of their own.
        rank = self.rank
        while True:
            if self.merged.get((a, b), _NEVER) < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if self.rank[token] < 0:
            return self.length[token] == 1
        a, b = self.left[token], self.right[token]
        return self._stays_apart(a, b, self.rank[token]) and self._reachable(a) and self._reachable(b)

    def longest_matches(self, text: str) -> list[int]:
        """The longest token that starts at each byte; text holds bytes as Latin-1 characters."""
        n, found = len(text), [-1] * len(text)
        length = self.length
        for end, token in self.matcher.iter(text[::-1]):
            at = n - 1 - end
            if found[at] < 0 or length[token] > length[found[at]]:
                found[at] = token
        return found

    def encode_bytes(self, raw: bytes) -> list[int]:
        text = raw.decode("latin-1")
        longest, out = self.longest_matches(text), []
        dead = bytearray(len(text) + 1)
        at, token = 0, longest[0] if text else -1
        while at < len(text):
            end = at + self.length[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < len(text):
                    token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
        return out

    def piece(self, pretoken: str) -> bytes:
        """The ids of a pre-token as little-endian 32-bit numbers."""
        found = self.cache.get(pretoken)
        if found is None:
            found = np.array(self.encode_bytes(pretoken.encode()), "<u4").tobytes()
            if len(self.cache) < CACHE_SIZE and len(pretoken) <= 64:
                self.cache[pretoken] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        parts, get, piece = [], self.cache.get, self.piece
        for chunk, special in self._split_special(text):
            parts += [get(w) or piece(w) for w in byte_level(chunk)]
            if special is not None:
                parts.append(np.array([special], "<u4").tobytes())
        return np.frombuffer(b"".join(parts), "<u4")

    def _split_special(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Chunks of ordinary text, each with the id of the special token after it."""
        at = 0
        for m in self.special_names.finditer(text) if self.special else ():
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.bytes_of.gather(ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(bpe: ByteBPE, text: str) -> tuple[int, str, str]:
    ids = bpe.encode(text)
    written = hashlib.sha256()
    last = b""
    for part in bpe.decimal_of.gather(ids):
        written.update(last)
        last = part
    written.update(last[:-1])
    return len(ids), written.hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


def token_digests(text: Column, path: str) -> Column:
    @F.pandas_udf(DIGESTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            yield pd.DataFrame([digests(bpe, t or "") for t in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encode_column(text: Column, path: str) -> Column:
    """array<int> of token ids; null text gives an empty array."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for batch in batches:
            yield pd.Series([bpe.encode(t or "").astype(np.int32) for t in batch], dtype=object)

    return run(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of an array<int> of token ids; null gives null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for batch in batches:
            yield pd.Series([None if x is None else bpe.decode(np.asarray(x, np.int64)) for x in batch], dtype=object)

    return run(ids)


def roundtrip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, token count, digest of the ids, digest of the decoded text."""
    return docs.select(F.col(id_col), token_digests(F.col(text_col), path).alias("d")).select(id_col, "d.*")
