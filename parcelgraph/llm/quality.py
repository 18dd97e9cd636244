"""A document quality classifier: regularised quadratic discriminant analysis.

Each document becomes a short vector of transformed statistics of its text (shares of symbols,
capitals, repeated words and lines, and so on). Each class has a mean and a covariance that is
shrunk towards a multiple of the identity; a score is the difference of the two classes' log
densities plus the log prior odds, squashed to 0..1. The Cholesky factor of each covariance is
computed once and kept in the model, so a Mahalanobis distance is one triangular product.

Fitting sums counts, vectors and outer products over all labelled rows, in one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import util

STATISTICS = ("chars", "word_length", "capitals", "digits", "symbols", "marks", "bars", "repeats", "variety", "lines", "line_copies", "common_word")

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*<>=+^~@_\\{}[]/"
_MARKS = b"!?"
_BARS = b"|"


def statistics(text: str) -> list[float]:
    """The values of :data:`STATISTICS` for one text; all finite, also for an empty one."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    count = lambda chars: n - len(raw.translate(None, chars))
    words = raw.split()
    w = len(words)
    upper, lower = count(_UPPER), count(_LOWER)
    lines = raw.split(b"\n")
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    share = lambda a, b: (a + 0.0) / (b + 1.0)
    root = lambda x: x**0.5
    return [
        np.log1p(n).item(),
        np.log1p(share(n, w)).item(),
        root(share(upper, upper + lower)),
        root(share(count(_DIGITS), n)),
        root(share(count(_SYMBOLS), n)),
        root(share(count(_MARKS), n)),
        root(share(count(_BARS), n)),
        root(share(sum(map(eq, words, words[1:])), w)),
        np.log1p(w).item() - np.log1p(len(tally)).item(),
        np.log1p(share(len(lines), w) * 100).item(),
        root(share(len(lines) - len(set(lines)), len(lines))),
        root(share(max(tally.values(), default=0), w)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """id, the ``keep`` columns and x (array of double, see :data:`STATISTICS`) for every row.

    A null text is an empty one.
    """
    schema = T.StructType([util.field(docs, id_col), *(util.field(docs, c) for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py() or "") for t in batch.column(0)]
            held = [batch.column(k + 1).cast(arrow.field(k).type) for k in range(1 + len(keep))]
            yield pa.RecordBatch.from_arrays([*held, pa.array(x, arrow.field("x").type)], schema=arrow)

    return docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col), *keep).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log prior odds of both classes."""

    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_odds: float

    @staticmethod
    def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float) -> Discriminant | None:
        """From counts (2), sums (2, d) and sums of outer products (2, d, d) of classes 0 and 1."""
        if (n < 2).any():
            return None
        means, inverse, log_det = [], [], []
        for k in (0, 1):
            mean = sums[k] / n[k]
            cov = products[k] / n[k] - np.outer(mean, mean)
            d = len(mean)
            # shrink on the scale of each statistic, pooled over both classes
            scale = np.sqrt(np.maximum((np.diagonal(products, axis1=1, axis2=2).sum(0) / n.sum()) - (sums.sum(0) / n.sum()) ** 2, 1e-8))
            unit = cov / np.outer(scale, scale)
            unit = (1 - shrinkage) * (unit + unit.T) / 2 + shrinkage * max(np.trace(unit) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(unit)
            means.append(mean)
            inverse.append(np.linalg.solve(factor, np.diag(1 / scale)))
            log_det.append(np.log(np.diagonal(factor)).sum())
        return Discriminant(np.array(means), np.array(inverse), np.array(log_det), float(np.log(n[1] / n[0])))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of ``x``."""
        log = [-0.5 * (((x - self.means[k]) @ self.inverse[k].T) ** 2).sum(1) - self.log_det[k] for k in (0, 1)]
        odds = np.clip(log[1] - log[0] + self.log_odds, -500, 500)
        return 1 / (1 + np.exp(-odds))


def fit(stats: DataFrame, label: Column, shrinkage: float = 0.02) -> Discriminant | None:
    """Fit on all rows of ``stats`` (from :func:`document_statistics`) where ``label`` is 0 or 1.

    None where a class has fewer than two rows.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = stats.select(label.cast("int").alias("y"), "x").where(F.col("y").isin(0, 1))
    x = [F.col("x")[i] for i in range(d)]
    found = rows.groupBy("y").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs)).collect()
    n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in found:
        n[r.y] = r.n
        sums[r.y] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[r.y, i, j] = products[r.y, j, i] = r[f"p{i}_{j}"]
    return Discriminant.fit(n, sums, products, shrinkage)


def apply(docs: DataFrame, model: Discriminant | None, keep: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """``keep`` columns and score for every row of ``docs``, in one pass; 0.5 everywhere without a
    model. A null text is an empty one."""
    schema = T.StructType([*(util.field(docs, c) for c in keep), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch.column(0)]).reshape(-1, len(STATISTICS))
            score = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).cast(arrow.field(k).type) for k in range(len(keep))), pa.array(score)], schema=arrow)

    return docs.select(F.col(text_col).cast("string").alias("_text"), *keep).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, train: Column, shrinkage: float, fit_rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Discriminant | None:
    """The discriminant of the rows of ``docs`` that ``labels`` marks 0 or 1 and ``train`` allows.

    At most about ``fit_rows`` labels are learnt from: beyond that, those whose id's hash is below
    the matching share. They are few enough to be broadcast to the documents.
    """
    known = labels.where(train).where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).alias("_y"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 20)) < (fit_rows << 20) // n)
    chosen = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(known), id_col)
    return fit(document_statistics(chosen, id_col, text_col, keep=["_y"]), F.col("_y"), shrinkage)


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, shrinkage: float = 0.02, fit_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id and score (0 to 1, higher: label 1 likelier) for every row of ``docs``.

    ``labels`` has ids and a label of 0 or 1; only rows for which ``train`` (a condition on the id
    column) holds are learnt from, about ``fit_rows`` of them at most, and nothing but the text
    enters a score. Rows with other or null labels are not learnt from, ids labelled twice count
    twice. Null texts are empty ones, repeated rows and null ids are scored each, an empty table
    gives no rows, and with fewer than two examples of a class every score is 0.5. Other columns
    are not read. Texts are read whole.
    """
    model = learn(docs, labels, train, shrinkage, fit_rows, id_col, text_col, label_col)
    return apply(docs, model, [id_col], text_col)
