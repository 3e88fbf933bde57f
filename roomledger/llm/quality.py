"""Quality classifier (operator 2): regularised quadratic discriminant.

Each document's whole text gives transformed statistics (log rates, square
roots of shares).  Class means and covariances are sums over *all* labelled
training rows, taken by one partial aggregate; only two rows of moments reach
the driver, whatever the size of the corpus.  Each class covariance is shrunk
towards the pooled covariance and by a ridge, then factored once (Cholesky);
the factors travel with the scorer.  A score is the logistic of the
difference of the two log densities (half Mahalanobis distance and log
determinant) plus the log prior odds.

Cases: null or empty text has zero counts and is scored like any other; an
empty table scores nothing; if one class has fewer than two labelled rows all
scores are 0.5; repeated rows are scored each; ids labelled both ways are not
learned from; very long texts are counted whole; rows without an id are scored
but not learned from.  Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stats
from .staging import staged


def transformed() -> dict[str, Column]:
    """The transformed statistics, as Spark expressions over the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    rate = lambda c, of: F.log1p(F.lit(100.0) * F.col(c) / of)
    share = lambda c, of: F.sqrt(F.col(c) / of)
    return {
        "length": F.log1p("n_words"), "word_length": F.col("word_chars") / words, "symbols": rate("n_symbols", words),
        "dup_lines": share("n_dup_lines", lines), "repeats": share("n_repeat_words", words), "capitals": rate("n_upper", chars),
        "marks": rate("n_marks", words), "digits": rate("n_digits", words),
        "variety": F.log(F.col("n_distinct_words") + F.lit(1.0)) / F.log(F.col("n_words") + F.lit(2.0)),
        "long_words": share("n_long_words", words), "stutter": share("n_repeat_next", words),
        "commas": rate("n_commas", words), "stops": rate("n_stops", words), "line_length": F.log1p(words / lines),
        "bars": rate("n_bars", words)}


@dataclass
class Discriminant:
    """Fitted classes: mean, inverse Cholesky factor of the shrunk covariance,
    log prior minus half log determinant; all in units of the pooled standard
    deviations."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.centre) / self.scale).T
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            solved = np.einsum("ij,jn->in", factor, z - mean[:, None])
            density.append(offset - 0.5 * np.einsum("in,in->n", solved, solved))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def fit(rows: DataFrame, names: list[str], label: str = "label", shrinkage: float = 0.1,
        ridge: float = 0.05) -> Discriminant | None:
    """Moments of every labelled row in one aggregate; None if a class has
    fewer than two rows."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(c).alias(f"s{i}") for i, c in enumerate(names)]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]
    moments = {r[label]: r for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(*sums).collect()}
    if len(moments) < 2 or min(r["n"] for r in moments.values()) < 2:
        return None
    d = len(names)
    n, first, second = [], [], []
    for k in (0, 1):
        n.append(float(moments[k]["n"]))
        first.append(np.array([moments[k][f"s{i}"] for i in range(d)], float))
        product = np.zeros((d, d))
        for i, j in pairs:
            product[i, j] = product[j, i] = moments[k][f"p{i}_{j}"]
        second.append(product)
    total = sum(n)
    centre = sum(first) / total
    pooled = sum(second) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    pooled = pooled / np.outer(scale, scale)
    means, factors, offsets = [], [], []
    for k in (0, 1):
        mean = first[k] / n[k]
        own = (second[k] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
        shrunk = (1 - shrinkage) * own + shrinkage * pooled + ridge * np.eye(d)
        factor = np.linalg.cholesky((shrunk + shrunk.T) / 2)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(factor))
        offsets.append(float(np.log(n[k] / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(centre, scale, means, factors, offsets)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   shrinkage: float = 0.1, ridge: float = 0.05) -> DataFrame:
    """Per row of ``docs``: id, held_out (crc32 of the id as text leaves no
    remainder modulo ``folds``; a null id is not held out), score, predicted.
    Learns only from labelled rows that are not held out."""
    names = transformed()
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    table = stats.count_table(docs, id_col, text_col).select("id", held_out.alias("held_out"), *(e.alias(k) for k, e in names.items()))
    table = staged(table, "quality-stats")
    known = stats.agreed_labels(labels, id_col, label_col)
    model = fit(table.where(~F.col("held_out")).join(known, "id"), list(names), shrinkage=shrinkage, ridge=ridge)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
                        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    columns = list(names)

    def score(batches):
        for batch in batches:
            if model is None:
                values = np.full(batch.num_rows, 0.5)
            else:
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
                values = model.score(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(values), pa.array((values >= threshold).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"])

    return table.mapInArrow(score, out)
