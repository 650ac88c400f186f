"""Language identification by a string kernel.

Kernel: blended spectrum of presence. A text is the set of its character
n-grams, n from 1 to `NGRAM`, over letters (lower case) and word borders,
hashed to `BUCKETS` cells; k(s, t) = |s and t| / sqrt(|s| |t|).

Classifier: Nystroem features from `landmarks` texts, then one ridge
regression per language (one versus rest, targets -1 and 1). For scoring both
fold into one matrix, so a batch of texts takes two matrix products: presence
by landmark presence, then kernel values by coefficients.

The fit reads a bounded sample: at most `PER_LANGUAGE` labelled rows of each
language, `SAMPLE` rows of the `LANGUAGES` most frequent ones, and `LANDMARKS`
landmarks (one a language, if those are more), drawn by a hash of the id.
Executors turn the sampled texts into n-gram sets and kernel values; the driver
gets the landmarks' sets and one row of kernel values for each sampled text, never
a text. Scoring reads every whole text.

Rows: a null text or one without letters is `und` with score 0. Repeated rows
are scored alike; of languages with equal margins the first by name is taken.
Null labels are never learned from. A training set without labels gives `und`
everywhere; an empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

NGRAM = 4
BUCKETS = 1 << 17
PER_LANGUAGE = 250
LANDMARKS = 64
LANGUAGES = 512
SAMPLE = 20_000
RIDGE = 1e-3
BATCH = 256
UNKNOWN = "und"
_BORDER = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(text: str, flags: np.ndarray) -> bool:
    """Set flags[cell] for each n-gram of the whole text; False if it has no letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return False
    border = ~letter
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of other characters one stays, as the border
    symbols = np.where(border, np.uint32(_BORDER), points)[keep]
    symbols = np.r_[np.uint32(_BORDER), symbols] if symbols[0] != _BORDER else symbols
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    mixed = symbols * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    for n in range(NGRAM):
        if n:
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + symbols[n:] * np.uint32(0x9E3779B1) + np.uint32(n)
        if not len(mixed):
            break
        flags[((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> shift] = True
    return True


def presence_rows(texts: list[str], cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its flags (of `cells`, or all), the size of its n-gram set and whether it has letters."""
    flags = np.zeros(BUCKETS, bool)
    rows = np.zeros((len(texts), BUCKETS if cells is None else len(cells)), bool)
    sizes, known = np.ones(len(texts)), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        flags[:] = False
        if text and presence(text, flags):
            known[i] = True
            sizes[i] = np.count_nonzero(flags)
            rows[i] = flags if cells is None else flags[cells]
    return rows, sizes, known


@dataclass(frozen=True)
class Model:
    languages: list[str]
    cells: np.ndarray  # the cells that any landmark has
    landmarks: np.ndarray  # float32, cells x landmarks, columns scaled by 1 / sqrt(size)
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def kernel(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (rows.astype(np.float32) @ self.landmarks).astype(np.float64) / np.sqrt(sizes)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for k in range(0, len(texts), BATCH):
            rows, sizes, known = presence_rows([t or "" for t in texts[k : k + BATCH]], self.cells)
            margin = self.kernel(rows, sizes) @ self.weights + self.bias
            best = margin.argmax(axis=1)
            value = np.clip((margin[np.arange(len(best)), best] + 1) / 2, 0.0, 1.0)
            names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            scores += [float(v) if ok else 0.0 for v, ok in zip(value, known)]
        return names, scores


def landmark_model(languages: list[str], sets: list[np.ndarray]) -> Model:
    """A model with landmarks, given by their cells, and no weights yet."""
    cells = np.unique(np.concatenate(sets))
    scaled = np.zeros((len(cells), len(sets)), np.float32)
    for k, own in enumerate(sets):
        scaled[np.searchsorted(cells, own), k] = 1 / np.sqrt(len(own))
    return Model(languages, cells, scaled, np.zeros((len(sets), len(languages))), np.zeros(len(languages)))


def solve(shell: Model, kernel: np.ndarray, labels: list[str], between: np.ndarray, ridge: float = RIDGE) -> Model:
    """Ridge regressions on the Nystroem features of kernel (rows by landmarks); between: the landmarks' own kernel."""
    value, vector = np.linalg.eigh(between)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    features = kernel @ root
    names, which, counts = np.unique(np.array(labels, dtype=object), return_inverse=True, return_counts=True)
    target = np.where(names[which][:, None] == np.array(shell.languages, dtype=object)[None, :], 1.0, -1.0)
    weight = (1.0 / counts)[which]  # each language weighs the same, however many rows it has
    weight /= weight.sum()
    middle, target_middle = weight @ features, weight @ target
    centred = features - middle
    gram = centred.T @ (centred * weight[:, None]) + ridge * np.eye(centred.shape[1])
    solved = np.linalg.solve(gram, (centred * weight[:, None]).T @ (target - target_middle))
    return Model(shell.languages, shell.cells, shell.landmarks, root @ solved, target_middle - middle @ solved)


def _cells(text: Column) -> Column:
    """array<int> of the text's n-gram cells, in order."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = np.zeros(BUCKETS, bool)
        for batch in batches:
            out = []
            for text in batch:
                flags[:] = False
                presence(text, flags)
                out.append(np.flatnonzero(flags).astype(np.int32))
            yield pd.Series(out, dtype=object)

    return run(text)


def _against(shell: Model):
    def run(cells: pd.Series) -> pd.Series:
        rows = np.zeros((len(cells), len(shell.cells)), bool)
        for i, own in enumerate(cells):
            rows[i] = np.isin(shell.cells, own, assume_unique=True)
        return pd.Series(list(shell.kernel(rows, cells.map(len).to_numpy(float))), dtype=object)

    return F.pandas_udf(run, "array<double>")


def training_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> DataFrame | None:
    """(lang, n, cells): at most per_language rows of each language, drawn by a hash of id; the counts thin the table first."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    labelled = labelled.filter(lang.isNotNull() & text.rlike(r"\p{L}")).select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("draw")).alias("draw"))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    each = min(per_language, max(1, SAMPLE // len(counts)))
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, 3.0 * each / n))]), F.col("lang"))
    thin = labelled.filter(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    drawn = thin.withColumn("n", first).filter(F.col("n") <= each)
    return staged(drawn.select("lang", "n", _cells(F.col("text")).alias("cells")).filter(F.size("cells") > 0), "language-sample")


def fit(sample: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of a sample's rows (lang, n, cells); landmarks are the first rows of each language in turn."""
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    chosen = sample.orderBy("n", "lang").limit(max(landmarks, len(languages))).collect()
    shell = landmark_model(languages, [np.array(r["cells"], np.int64) for r in chosen])
    rows = sample.select("lang", _against(shell)(F.col("cells")).alias("k")).orderBy("lang", "n").collect()
    own = np.zeros((len(chosen), len(shell.cells)), bool)
    for k, r in enumerate(chosen):
        own[k, np.searchsorted(shell.cells, r["cells"])] = True
    between = shell.kernel(own, np.array([float(len(r["cells"])) for r in chosen]))
    return solve(shell, np.array([r["k"] for r in rows]), [r["lang"] for r in rows], between, ridge)


def identify(text: Column, model: Model | None) -> Column:
    """Struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = model.predict(list(batch)) if model else ([UNKNOWN] * len(batch), [0.0] * len(batch))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on rows that are not held out, predict every row: doc_id, held_out, lang_pred, score. A null id isn't held out."""
    held = F.coalesce(held_out(id_col), F.lit(False))
    sample = training_sample(docs.filter(~held), id_col, text_col, lang_col, per_language)
    model = fit(sample) if sample is not None else None
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"), identify(F.col(f"`{text_col}`"), model).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")
