"""Encoding texts into unit vectors with a pluggable encoder, in batches of bounded cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import reusable

# A batch's rows times its longest text, and its rows.
BUDGET, MAX_ROWS = 24_000, 1024
# Prefixes that some models want, by role.
PREFIXES = {"e5": {"query": "query: ", "passage": "passage: "}}

Encoder = Callable[[Sequence[str]], np.ndarray]


def batches(lengths: Sequence[int], budget: int = BUDGET, most: int = MAX_ROWS) -> Iterator[list[int]]:
    """Indices, shortest texts first, in batches whose cost stays within the budget; a longer text goes alone."""
    batch: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if batch and ((len(batch) + 1) * lengths[i] > budget or len(batch) == most):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def encoded(texts: Sequence[str], encoder: Encoder, role: str = "passage", model: str = "") -> np.ndarray:
    """Unit vectors in the order of the texts."""
    prefix = next((p[role] for name, p in PREFIXES.items() if name in model.lower()), "")
    rows: list[np.ndarray | None] = [None] * len(texts)
    for batch in batches([len(t) for t in texts]):
        for i, v in zip(batch, np.asarray(encoder([prefix + texts[i] for i in batch]), np.float32)):
            rows[i] = v / max(float(np.linalg.norm(v)), 1e-12)
    return np.stack(rows) if rows else np.zeros((0, 0), np.float32)


def encode_passages(passages: DataFrame, make_encoder: Callable[[], Encoder], model: str = "") -> DataFrame:
    """passages with vector; make_encoder is called once in each Python worker's task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for pdf in parts:
            yield pdf.assign(vector=list(encoded(list(pdf["text"]), encoder, "passage", model)))

    ids = passages.select("passage_id", "text", F.sha2("text", 256).alias("digest"))
    return ids.mapInPandas(run, "passage_id long, text string, digest string, vector array<float>")


def encode_incrementally(passages: DataFrame, old: DataFrame | None, make_encoder: Callable[[], Encoder], model: str = "", old_model: str = "") -> DataFrame:
    """(passage_id, digest, vector): vectors of equal texts are taken from old if the model is the same."""
    new = passages.select("passage_id", "text", F.sha2("text", 256).alias("digest"))
    if old is None or model != old_model:
        return encode_passages(new, make_encoder, model).drop("text")
    kept, rest = reusable(new, old)
    return kept.select("passage_id", "digest", "vector").unionByName(encode_passages(rest, make_encoder, model).drop("text"))
