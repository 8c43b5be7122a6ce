"""Toxicity: a classifier chain. Each category's linear model also sees the earlier categories' log-odds.

In training those are out-of-fold predictions, so that a later model learns from what it will see later. The category that
decides stands last, so a decision comes through the whole chain.
Fitted on a bounded sample on the driver, applied to every row in Arrow batches. A null or empty text has
no features and gets the models' intercepts; repeated rows get equal results; an empty table gives an
empty table; input columns named like an output are replaced. A category with one class is a constant.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqfold.llm import labelled, linear
from seqfold.llm import tokens as T
from seqfold.llm.storage import unused

FOLDS = 3
REJECT_AT = 0.35
#: Name of each category, in the order of the chain, and whether labels (quality, toxic) put a document in it.
CATEGORIES = (
    ("unfit", lambda quality, toxic: toxic == 1 or quality == 0),
    ("toxic_prose", lambda quality, toxic: toxic == 1 and quality == 1),
    ("toxic", lambda quality, toxic: toxic == 1),
)


@dataclass
class Chain:
    names: list[str]
    models: list[linear.Linear]

    def probabilities(self, texts: list) -> np.ndarray:
        """A row for each text, a column for each category."""
        out = [np.zeros((0, len(self.names)))]
        for lo, hi in T.chunks(texts):
            row, key, val = linear.features(texts[lo:hi])
            seen = np.zeros((hi - lo, 0))
            for m in self.models:
                s = np.clip(m.score(row, key, val, hi - lo, seen), -12, 12)
                seen = np.column_stack([seen, s])
            out.append(linear.sigmoid(seen))
        return np.concatenate(out)


def fit_texts(texts: list, marks: np.ndarray, names: list[str], folds: int = FOLDS) -> Chain:
    """marks: 0/1, a column for each category. Row i belongs to fold i % folds."""
    return fit_matrix(linear.matrix(texts), marks, names, folds)


def fit_matrix(x: linear.Sparse, marks: np.ndarray, names: list[str], folds: int = FOLDS) -> Chain:
    fold = np.arange(x.n) % folds
    seen, models = np.zeros((x.n, 0)), []
    for k in range(len(names)):
        y, ahead = marks[:, k], np.zeros(x.n)
        if k + 1 < len(names):
            for f in range(folds):
                m = linear.fit_logistic(x, y, fold != f, seen)
                s = linear.scores(m, x) + m.bias + seen @ m.extra
                ahead = np.where(fold == f, s, ahead)
        models.append(linear.fit_logistic(x, y, None, seen))
        seen = np.column_stack([seen, np.clip(ahead, -12, 12)])
    return Chain(list(names), models)


def fit(docs: DataFrame, labels: DataFrame, limit: int = labelled.SAMPLE_ROWS) -> Chain:
    rows, names = labelled.sample(docs, labels, limit), [n for n, _ in CATEGORIES]
    if not rows:
        nothing = linear.Linear(np.zeros(0, np.uint64), np.zeros(0), -20.0)
        return Chain(names, [nothing] * len(names))
    marks, texts = np.array([[int(f(r.quality, r.toxic)) for _, f in CATEGORIES] for r in rows]), [r.text for r in rows]
    del rows
    x = linear.matrix(texts)
    del texts  # the driver holds the matrix alone
    return fit_matrix(x, marks, names)


def score(docs: DataFrame, chain: Chain, text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """docs with p_<category> for each category and rejected: the last category's probability, which rests on those before it, is reject_at or more."""

    @F.arrow_udf("array<double>")
    def chained(text: pa.Array) -> pa.Array:
        p = chain.probabilities(text.to_pylist())
        return pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], p.ravel())

    (all_p,) = unused(docs, "chain")
    scored = docs.withColumn(all_p, chained(F.col(text_col)))
    scored = scored.withColumns({f"p_{n}": F.col(all_p)[k] for k, n in enumerate(chain.names)})
    return scored.withColumn("rejected", F.col(all_p)[len(chain.names) - 1] >= reject_at).drop(all_p)
