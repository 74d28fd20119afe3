"""Quality classifier by positive-unlabelled learning.

A linear model minimises the non-negative unbiased risk (Kiryo et al. 2017) of trusted positives and unlabelled texts; the
share of positives among the unlabelled is estimated beforehand by the best bin of scores (Garg et al. 2021).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import quoted
from folioscope.llm.features import Linear, Sample, bounded, collect_sample, fit

#: Texts of each sort that the model is fitted on, about; of more, a hash draws these.
MOST_POSITIVE, MOST_UNLABELLED = 5000, 8000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from held-out scores of both.

    Above any score, the unlabelled's share is at least the prior times the positives' share. The cut with the smallest
    upper confidence bound of that ratio gives the estimate.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit_nnpu(sample: Sample, prior: float, rounds: int = 200) -> Linear:
    """sample's labels: 1 positive, 0 unlabelled. Logistic loss; where a part's estimate of the negatives' risk goes below
    zero, the step goes back up it."""

    def slope(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        g, is_p = values[:, 0], sample.label[rows] == 1
        n_p, n_u = max(1, is_p.sum()), max(1, (~is_p).sum())
        up = _sigmoid(g)  # the gradient of log(1 + exp(g)), the loss of calling g positive
        soft = np.logaddexp(0, g)
        negative = soft[~is_p].sum() / n_u - prior * soft[is_p].sum() / n_p
        of_negative = np.where(is_p, -prior / n_p * up, up / n_u)
        of_positive = np.where(is_p, prior / n_p * (up - 1), 0.0)
        return (-of_negative if negative < 0 else of_positive + of_negative)[:, None]

    return fit(Linear.zero(1, sample), sample, slope, rounds)


def fit_quality(positives: DataFrame, unlabelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[Linear, float]:
    """(model, prior). Both tables carry ids, by whose hash a larger table is sampled, and texts."""
    key, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").alias("text")
    chosen = bounded(positives, most_positive, key).select(F.lit(1).alias("label"), text).unionByName(bounded(unlabelled, most_unlabelled, key).select(F.lit(0).alias("label"), text))
    sample = collect_sample(chosen)
    half = np.arange(len(sample)) % 2 == 0  # rows come sorted, so this is an even split of both sorts
    draft = fit_nnpu(sample.part(half), 0.5, 100)
    scores, label = draft.of(sample.part(~half))[:, 0], sample.label[~half]
    prior = estimate_prior(scores[label == 1], scores[label == 0])
    return fit_nnpu(sample, prior), prior


def _score(model: Linear, at: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = [float(_sigmoid(model.one(text.as_py()))[0]) for text in part.column(at)]
            yield pa.RecordBatch.from_arrays([*part.columns[:at], *part.columns[at + 1 :], pa.array(scores, pa.float64())], schema=schema)

    return run


def score_quality(docs: DataFrame, model: Linear, keep: list[str] | None = None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The kept columns of docs (all by default) and score_col, 0 to 1: how likely the text is of the positives' sort.

    Only the text is looked at. Null and empty texts get the score of a text without words. Repeated rows get the same
    score; a column of the name score_col is replaced. An empty table gives no rows. One pass without a shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() != score_col.lower()]
    # By numbers, since names with dots cannot go through mapInArrow.
    rows = docs.select(*[c.alias(f"c{k}") for k, c in enumerate(quoted(names))], *[c.alias("judged") for c in quoted([text_col])])
    out = rows.drop("judged").withColumn("scored", F.lit(0.0).cast("double"))
    schema = to_arrow_schema(out.schema)
    return rows.mapInArrow(_score(model, len(names), schema), out.schema).toDF(*names, score_col)
