"""A toxicity classifier that does not hold the mention of a group against a text.

A text is the set of its words and of their beginnings (a stem shows in words that were never seen
whole), each with how often and how densely it stands there. Which of these say anything is counted
over the labelled documents, in one aggregation; the telling ones become the features of a logistic
regression. To it belongs a counterfactual penalty:
in each labelled text that names a group of people, the name is swapped for those of the other
groups of its kind, and the squared change of the score is added to the loss. What separates a text
from its counterfactual is nothing but the name, so the names lose their weight, however often toxic
texts of the sample use one of them, and the words around them have to explain the label.

Learning uses a bounded sample of the labelled rows (``fit_rows``); scoring is one pass over all
texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import util

#: Names of groups of people, by kind; those of a line can stand for one another in a sentence.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("girls", "boys"),
    ("female", "male"),
    ("lesbian", "gay", "bisexual", "straight"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("musulman", "chrétien", "juif"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("musulmán", "cristiano", "judío"),
)

_WORD = re.compile(r"[^\W_]+")
#: Lengths of the beginnings that are features beside whole words.
_SHORT, _LONG = 3, 7
#: Counts that a task holds before it starts anew.
_HELD = 500_000


def words_of(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


def word_keys(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:k] + "*" for k in range(_SHORT, min(_LONG, len(word)) + 1))]


#: A key is a feature by itself, and once more for each of these that holds of its count and of the
#: number of words.
LEVELS = (
    ("", lambda n, words: True),
    (" 2", lambda n, words: n >= 2),
    (" 3", lambda n, words: n >= 3),
    (" 1%", lambda n, words: 100 * n >= words),
    (" 3%", lambda n, words: 100 * n >= 3 * words and n >= 2),
)


def features_of(words: Counter[str]) -> set[str]:
    counts: Counter[str] = Counter()
    for w, n in words.items():
        for key in word_keys(w):
            counts[key] += n
    total = words.total()
    return {key + level for key, n in counts.items() for level, holds in LEVELS if holds(n, total)}


def counterfactuals(words: Counter[str], groups: Sequence[Sequence[str]]) -> list[Counter[str]]:
    """``words`` with all names of groups swapped: once for each way to turn the lists around."""
    named = {w: g for g in groups if len(g) > 1 for w in g if w in words}
    out = []
    for k in range(1, max(map(len, named.values()), default=1)):
        swapped = Counter({w: n for w, n in words.items() if w not in named})
        for w, g in named.items():
            swapped[g[(g.index(w) + (k - 1) % (len(g) - 1) + 1) % len(g)]] += words[w]
        out.append(swapped)
    return out


class _Numbered:
    """Finds the numbers of a text's features among those known."""

    def __init__(self, features: Iterable[str]):
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for number, f in enumerate(features):
            key, sign, rest = f.partition(" ")
            self.levels.setdefault(key, []).append((number, [n for n, _ in LEVELS].index(sign + rest)))
        self.stems = {key[:-1]: key for key in self.levels if key[-1] == "*"}
        self.roots = {stem[:_SHORT] for stem in self.stems}
        self.lengths = sorted({len(stem) for stem in self.stems})

    def __call__(self, words: Counter[str]) -> list[int]:
        counts = {w: words[w] for w in words.keys() & self.levels.keys()}
        for w, n in words.items():
            if w[:_SHORT] in self.roots:
                for k in self.lengths:
                    key = self.stems.get(w[:k]) if k <= len(w) else None
                    if key is not None:
                        counts[key] = counts.get(key, 0) + n
        total = words.total()
        return sorted(number for key, n in counts.items() for number, level in self.levels[key] if LEVELS[level][1](n, total))


@dataclass(frozen=True)
class Linear:
    """Weights of features and an intercept."""

    weights: dict[str, float]
    intercept: float

    def scorer(self):
        """A function from a text to its probability; it remembers the features of words."""
        numbers, value = _Numbered(self.weights), list(self.weights.values())

        def score(text: str) -> float:
            at = min(max(self.intercept + sum(value[k] for k in numbers(words_of(text))), -500.0), 500.0)
            return float(1 / (1 + np.exp(-at)))

        return score


class _Rows:
    """Sparse rows of ones: products with a vector of weights, and back."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], self.width)


def minimise(x: _Rows, y: np.ndarray, weight: np.ndarray, pairs: tuple[_Rows, _Rows], ridge: float, fairness: float) -> np.ndarray:
    """Weights and intercept (last) with the least loss, by Newton's method with conjugate gradients.

    Mean log loss of the rows by ``weight``, half ``ridge`` times the squared weights, and half
    ``fairness`` times the mean squared difference of the scores of each of ``pairs``.
    """
    d, total = x.width, weight.sum()
    a, b = pairs
    gap = lambda w: a.times(w) - b.times(w)
    spread = lambda r: a.back(r) - b.back(r)
    fair = fairness / max(a.n, 1)

    def loss(w: np.ndarray) -> float:
        z = x.times(w[:d]) + w[d]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / total + 0.5 * ridge * (w[:d] ** 2).sum() + 0.5 * fair * (gap(w[:d]) ** 2).sum())

    w = np.zeros(d + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x.times(w[:d]) + w[d])))
        r = weight * (p - y) / total
        grad = np.append(x.back(r) + ridge * w[:d] + fair * spread(gap(w[:d])), r.sum())
        if np.abs(grad).max() < 1e-7:
            break
        h = weight * p * (1 - p) / total

        def curve(v, h=h):
            u = h * (x.times(v[:d]) + v[d])
            return np.append(x.back(u) + ridge * v[:d] + fair * spread(gap(v[:d])), u.sum() + 1e-9 * v[d])

        step, left = np.zeros(d + 1), -grad
        way, norm = left.copy(), float(left @ left)
        for _ in range(100):
            bent = curve(way)
            size = norm / float(way @ bent)
            step += size * way
            left = left - size * bent
            after = float(left @ left)
            if after <= 1e-4 * float(grad @ grad):
                break
            way, norm = left + after / norm * way, after
        at, size, before = float(grad @ step), 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > before + 1e-4 * size * at:
            size /= 2
        w = w + size * step
    return w


def _feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n0, n1: how many rows (_text, _y) of each class have it."""
    schema = "feature string, n0 long, n1 long"
    arrow = pa.schema([("feature", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])

    def out(counts):
        keys = list(set(counts[0]) | set(counts[1]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], schema=arrow)

    def run(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[y].update(features_of(words_of(text.as_py() or "")))
                if len(counts[0]) + len(counts[1]) > _HELD:
                    yield out(counts)
                    counts = (Counter(), Counter())
        yield out(counts)

    return rows.select("_text", "_y").mapInArrow(run, schema).groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def telling_features(counts: DataFrame, n0: int, n1: int, least_gain: float, most: int) -> list[str]:
    """The features by which the classes differ: twice the log likelihood gained by knowing them is
    ``least_gain`` at least; of those the ``most`` strongest."""
    total = float(n0 + n1)
    with_it = F.col("n0") + F.col("n1")

    def cell(seen, margin, share):
        return F.when(seen > 0, seen * F.log(seen / (margin * F.lit(share)))).otherwise(0.0)

    out = total - with_it
    gain = 2 * (cell(F.col("n0"), with_it, n0 / total) + cell(F.col("n1"), with_it, n1 / total) + cell(n0 - F.col("n0"), out, n0 / total) + cell(n1 - F.col("n1"), out, n1 / total))
    told = counts.select("feature", gain.alias("gain")).where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "feature").limit(most)
    return sorted(r.feature for r in told.collect())


def learn(docs: DataFrame, labels: DataFrame, train: Column, *, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, fairness: float = 10.0, ridge: float = 3e-4, fit_rows: int = 20_000, least_gain: float = 12.0, most_features: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Linear | None:
    """The classifier of the rows of ``docs`` that ``labels`` marks 0 or 1 and ``train`` allows.

    About ``fit_rows`` labels are learnt from at most: beyond that, those whose id's hash is below
    the matching share. They are few enough to be broadcast to the documents. Texts that repeat
    count once. None where a class is missing.
    """
    known = labels.where(train).where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("_y"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("toxic")), F.lit(1 << 20)) < (fit_rows << 20) // n)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text")).join(F.broadcast(known), id_col).select("_text", "_y")
    rows = util.materialize(rows.dropDuplicates(["_text", "_y"]), "toxicity-rows")
    sizes = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        util.drop_table(rows)
        return None
    features = telling_features(_feature_counts(rows), sizes[0], sizes[1], least_gain, most_features)
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("pair", T.BooleanType()), T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("other", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        numbers = _Numbered(features)
        for batch in batches:
            out = []
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = words_of(t.as_py())
                own = numbers(words)
                out.append((y, False, own, []))
                out += [(y, True, own, numbers(swapped)) for swapped in counterfactuals(words, groups)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    # numbers of features of at most fit_rows rows (and their counterfactuals)
    table = rows.select("_text", "_y").mapInArrow(run, schema).toArrow()
    util.drop_table(rows)
    pair = table["pair"].to_numpy(zero_copy_only=False)
    lists = lambda t, c: [np.asarray(v.values, np.int64) for v in t[c]]
    plain, pairs = table.filter(pa.array(~pair)), table.filter(pa.array(pair))
    y = plain["y"].to_numpy().astype(float)
    width = len(features)
    # the rarer class weighs more, half the way to even on a log scale
    weight = np.where(y == 1, (sizes[0] / sizes[1]) ** 0.5, 1.0)
    w = minimise(_Rows(lists(plain, "x"), width), y, weight, (_Rows(lists(pairs, "x"), width), _Rows(lists(pairs, "other"), width)), ridge, fairness)
    return Linear({f: float(v) for f, v in zip(features, w, strict=False)}, float(w[width]))


def apply(docs: DataFrame, model: Linear | None, keep: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """``keep`` columns and score for every row of ``docs``, in one pass; 0.5 everywhere without a
    model. A null text is an empty one."""
    schema = T.StructType([*(util.field(docs, c) for c in keep), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    # most_features weights at most
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = shared.value.scorer() if shared.value is not None else lambda text: 0.5
        for batch in batches:
            scores = [score(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).cast(arrow.field(k).type) for k in range(len(keep))), pa.array(scores, pa.float64())], schema=arrow)

    return docs.select(F.col(text_col).cast("string").alias("_text"), *keep).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **learning) -> DataFrame:
    """id and score (0 to 1, higher: label 1 likelier) for every row of ``docs``.

    ``labels`` has ids and a label of 0 or 1; only rows for which ``train`` (a condition on the id
    column) holds are learnt from, and nothing but the text enters a score. Rows with other or null
    labels or a null id are not learnt from; of texts that repeat with the same label one is. Null
    texts are empty ones, repeated rows and null ids are scored each, an empty table gives no rows,
    and without an example of each class every score is 0.5. Other columns are not read. Texts are
    read whole. ``learning``: see :func:`learn`.
    """
    model = learn(docs, labels, train, id_col=id_col, text_col=text_col, label_col=label_col, **learning)
    return apply(docs, model, [id_col], text_col)
