"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

One vector of hashed-text weights is shared by all grades and ordered thresholds cut its score:
P(grade > k) = sigmoid(score - threshold_k). Fitted on a bounded sample on the driver, applied to every
row in Arrow batches. A null or empty text has no features and gets the grade of score 0; repeated rows
get equal results; an empty table gives an empty table; columns of the input that are named like an
output are replaced. Without any labelled row the model is flat: score 0 and thresholds of one class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqfold.llm import labelled, linear
from seqfold.llm import tokens as T


@dataclass
class OrdinalModel:
    linear: linear.Linear
    thresholds: np.ndarray

    def score(self, texts: list) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in T.chunks(texts):
            out.append(self.linear.score(*linear.features(texts[lo:hi]), hi - lo))
        return np.concatenate(out)

    def tails(self, texts: list) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each text; they fall from left to right."""
        return linear.sigmoid(self.score(texts)[:, None] - self.thresholds[None, :])


def fit_texts(texts: list, grades: np.ndarray, n_grades: int) -> OrdinalModel:
    return OrdinalModel(*linear.fit_ordinal(linear.matrix(texts), np.asarray(grades, int), n_grades))


def fit(docs: DataFrame, labels: DataFrame, limit: int = labelled.SAMPLE_ROWS) -> OrdinalModel:
    """Grades from labels: 0 poor (quality 0), 1 sound but toxic, 2 sound and clean."""
    rows = labelled.sample(docs, labels, limit)
    if not rows:
        return OrdinalModel(linear.Linear(np.zeros(0, np.uint64), np.zeros(0)), np.zeros(2))
    grades, texts = np.array([0 if r.quality == 0 else 1 if r.toxic else 2 for r in rows]), [r.text for r in rows]
    del rows
    x = linear.matrix(texts)
    del texts  # the driver holds the matrix alone
    return OrdinalModel(*linear.fit_ordinal(x, grades, 3))


def grade(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail (P(grade >= k), k = 1...) and keep: the top grade's tail is least or more."""

    @F.arrow_udf("array<double>")
    def tails(text: pa.Array) -> pa.Array:
        p = model.tails(text.to_pylist())
        return pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], p.ravel())

    return docs.withColumn("tail", tails(F.col(text_col))).withColumns({
        "expected_grade": F.aggregate("tail", F.lit(0.0), lambda a, x: a + x),
        "keep": F.element_at("tail", -1) >= least,
    })
