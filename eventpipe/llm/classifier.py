"""Quality classifier: a regularised quadratic discriminant over document statistics (operator 7).

Each text gives ``FEATURES``: counts and shares, taken through a logarithm or a
square root so that the classes look more like normal densities. Every class has
its own mean and covariance; a covariance is shrunk towards the pooled one
(``SHRINKAGE``) and has ``RIDGE`` added to its diagonal (on standardised features),
so it stays invertible when a class is small or a feature is constant in it.
A score is the posterior of label 1: the difference of the two Mahalanobis log
densities with the log of the class sizes, through the logistic function. The
Cholesky factor of each covariance is computed once, when the model is fitted.

Fitting uses all training rows, not a sample: each task adds up the first and
second moments of its rows, and only those sums (two small matrices) reach the
driver.

Defined results: a null or empty text has the statistics of an empty text and is
scored like any other; labels other than 0 and 1, null labels and null ids do
not train; a document with several labels trains once for each. If only one
class has training rows, every score is that class's label; without any, 0.5
(so nothing is rejected). Repeated rows each give a row, other columns pass
through (one named like the score gives way to it; ``keep`` adds none), and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, texts_of
from .statistics import IS_DIGIT, IS_PUNCTUATION, IS_UPPER, Texts, byte_class
from .text import slices

FEATURES = (
    "log_words", "log_word_length", "log_symbols", "root_upper", "root_digits", "log_punctuation", "root_repeated",
    "root_duplicate_lines", "log_line_words", "distinct_share", "root_accented", "log_exclamations",
)
SHRINKAGE, RIDGE = 0.05, 0.01
BLOCK_BYTES = 2 << 20
_EXCLAMATION, _LEADS = byte_class(b"!"), byte_class(range(0xC0, 0x100))


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    t = Texts(column)
    words, chars = np.maximum(t.n_words, 1), np.maximum(t.word_chars(), 1)
    lines, again = t.lines()
    lines = np.maximum(lines, 1)
    per_100 = lambda members: np.log1p(100 * t.count_bytes(members) / words)
    share = lambda members: np.sqrt(np.minimum(t.count_bytes(members) / chars, 1))
    return np.stack(
        [
            np.log1p(t.n_words), np.log1p(chars / words), np.log1p(100 * t.symbols() / words), share(IS_UPPER), share(IS_DIGIT),
            per_100(IS_PUNCTUATION), np.sqrt(t.repeated_words() / words), np.sqrt(again / lines), np.log1p(words / lines),
            t.distinct_words() / words, share(_LEADS), per_100(_EXCLAMATION),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Model:
    """``log_odds`` of label 1: a constant, or from two class densities with their cached factors."""

    constant: float | None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple = ()
    factors: tuple = ()  # inverse Cholesky factors, so that a score is one product
    offsets: tuple = ()  # log class size minus the log determinant of the factor

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.center) / self.scale
        density = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def model_of(moments: dict[int, np.ndarray], shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """From each class's sum of [1, x] [1, x]^T."""
    seen = [k for k in (0, 1) if k in moments and moments[k][0, 0] > 0]
    if len(seen) < 2:
        return Model({(): 0.0, (0,): -np.inf, (1,): np.inf}[tuple(seen)])
    total = moments[0] + moments[1]
    n = total[0, 0]
    center = total[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / n - center**2, 1e-9))
    means, spreads = [], []
    for k in (0, 1):
        size, mean = moments[k][0, 0], moments[k][0, 1:] / moments[k][0, 0]
        spreads.append((moments[k][1:, 1:] / size - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - center) / scale)
    pooled = sum(moments[k][0, 0] / n * spreads[k] for k in (0, 1))
    factors, offsets = [], []
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - shrinkage) * spreads[k] + shrinkage * pooled + ridge * np.eye(len(center)))
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(moments[k][0, 0] / n) - np.log(np.diag(lower)).sum())
    return Model(None, center, scale, tuple(means), tuple(factors), tuple(offsets))


def held_out(doc_id: Column) -> Column:
    """The third of the ids that never trains."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of all labelled documents that are not held out."""
    ready(docs)
    width = len(FEATURES) + 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                x = pa.FixedSizeListArray.from_arrays(pa.array(features(part.column(1)).ravel()), len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), x.cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width))
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy().reshape(-1, len(FEATURES))
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                y = batch["label"].to_numpy()
                for k in (0, 1):
                    sums[k] += x[y == k].T @ x[y == k]
        place = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(sums.ravel())], names=["place", "total"])

    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = texts_of(docs, id_col, text_col).where(~held_out(F.col("doc_id"))).mapInArrow(measure, "doc_id long, x array<double>").join(known, "doc_id")
    sums = rows.select("label", "x").mapInArrow(add_up, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    found = np.zeros(2 * width * width)
    for r in sums.collect():  # 2 x 13 x 13 numbers at any size of the input
        found[r["place"]] = r["total"]
    return model_of(dict(enumerate(found.reshape(2, width, width))))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each row's text (0 to 1, higher: label 1 is likelier)."""
    ready(docs)
    own = [f for f in docs.schema.fields if f.name.lower() != score_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, BLOCK_BYTES):
                scores = model.score(features(part[text_col]))
                yield part.select([f.name for f in own]).append_column(score_col, pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, T.StructType([*own, T.StructField(score_col, T.DoubleType())]))


def keep(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose score is at least ``least``, with exactly their own columns."""
    ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, BLOCK_BYTES):
                yield part.filter(pa.array(model.score(features(part[text_col])) >= least))

    return docs.mapInArrow(run, docs.schema)
