"""A text quality classifier from trusted positives and unlabelled text.

Learning from positives and unlabelled rows: documents labelled good are the
positives, all other text is unlabelled, and no row labelled bad is ever looked
at. The classifier minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with the sigmoid loss. The class prior is estimated first: a plain classifier
of positives against unlabelled rows scores every row, and of all thresholds
the one is taken that bounds ``share of unlabelled / share of positives`` above
it most tightly; that bound is the prior.

Spark describes every whole text by a few figures of its shape, one pass over
the texts, and stores them. The fit uses at most ``fitted_rows`` positives and as
many unlabelled rows (a documented bound, drawn by a hash); the histograms for
the prior and the scores cover all rows.

Rows held out (their id's crc32 leaves 1 when divided by 3) give no labels and
no unlabelled rows. A null id has no label and is not held out. An id whose
labels disagree is no trusted positive. Null and empty texts have the figures
of a text without words and are scored by them; repeated rows are scored
alike. Without any trusted positive nothing is known: every score is 0.5. An
empty table gives an empty result. Labels, ids and other columns do not enter
a score.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.llm.common import stored
from folioscale.llm.words import words_of

#: At most so many positives, and so many unlabelled rows, are fitted.
FITTED_ROWS = 8192
BINS = 512
STEPS = 600

FIGURES = (
    "log_words",
    "word_length",
    "distinct_words",
    "repeats",
    "word_entropy",
    "commonest_word",
    "upper_words",
    "upper_letters",
    "digits",
    "symbols",
    "marks_per_word",
    "exclamations",
    "symbol_ends",
    "lone_symbols",
    "sentence_ends",
    "repeated_lines",
)

_LETTER, _UPPER, _DIGIT, _MARK, _EXCLAMATION, _STOP, _SPACE, _SYMBOL = (1 << n for n in range(8))
_MARKS, _EXCLAMATIONS, _STOPS = ".,;:!?'\"()-", "!?", ".!?"


@functools.cache
def _kinds() -> np.ndarray:
    """What each character is, as bits; the last entry serves all beyond U+FFFF."""

    def kind(sign: str) -> int:
        bits = _LETTER * sign.isalpha() | _UPPER * sign.isupper() | _DIGIT * sign.isdigit() | _SPACE * sign.isspace()
        bits |= _MARK * (sign in _MARKS) | _EXCLAMATION * (sign in _EXCLAMATIONS) | _STOP * (sign in _STOPS)
        return bits or _SYMBOL

    return np.array([kind(chr(code)) for code in range(1 << 16)], np.uint8)


def figures_of(text: str | None) -> list[float]:
    """The shape of a whole text, in the order of ``FIGURES``."""
    words = words_of(text)
    if not words:
        return [0.0] * len(FIGURES)
    n, chars = len(words), sum(map(len, words))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.append(_kinds()[np.minimum(codes, 0xFFFF)], np.uint8(_SPACE))
    ending = kinds[:-1][(kinds[1:] & _SPACE) > 0]  # what stands before a space or the end

    def share(bit: int, among: np.ndarray, whole: int) -> float:
        return np.count_nonzero(among & bit) / max(whole, 1)

    counts = np.fromiter(Counter(words).values(), np.float64)
    parts = counts / n
    lines = [line for line in (line.strip() for line in text.split("\n")) if line]
    return [
        math.log1p(n),
        chars / n,
        len(counts) / n**0.75,
        sum(map(str.__eq__, words, words[1:])) / n,
        -float(parts @ np.log(parts)) / math.log(n + 1),
        float(parts.max()),
        sum(map(str.isupper, words)) / n,
        share(_UPPER, kinds, np.count_nonzero(kinds & _LETTER)),
        share(_DIGIT, kinds, chars),
        share(_SYMBOL, kinds, chars),
        share(_MARK, kinds, n),
        share(_EXCLAMATION, kinds, n),
        share(_SYMBOL, ending, n),
        sum(not word[0].isalnum() and not any(map(str.isalnum, word)) for word in words) / n,
        share(_STOP, ending, n),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]


def held_out(doc_id: Column) -> Column:
    drawn = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1
    return F.coalesce(drawn, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, row, held_out, figures`` of every row; ``row`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures = pa.array([figures_of(text) for text in batch.column("text").to_pylist()], pa.list_(pa.float32()))
            columns = [batch.column("doc_id"), batch.column("row"), figures]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "figures"])

    rows = docs.select(
        F.col("`doc_id`").alias("doc_id"),
        F.col("`text`").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row bigint, figures array<float>"
    return rows.mapInArrow(run, ddl).withColumn("held_out", held_out(F.col("doc_id")))


def trusted_positives(labels: DataFrame) -> DataFrame:
    """Ids, once each, that are labelled good, by every label they have, and are not held out."""
    open_labels = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return open_labels.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")


def drawn(rows: DataFrame, most: int, seed: int) -> np.ndarray:
    """The figures of at most ``most`` rows, the first by a hash."""
    order = F.xxhash64("doc_id", "row", F.lit(seed))
    taken = rows.orderBy(order, "row").select("figures").limit(most).toArrow().column("figures")
    return np.array(taken.to_pylist(), np.float64).reshape(-1, len(FIGURES))


@dataclass(frozen=True)
class Scorer:
    """A linear score of standardised figures."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    offset: float

    def standardised(self, figures: np.ndarray) -> np.ndarray:
        return np.clip((figures - self.middle) / self.spread, -6, 6)

    def margins(self, figures: np.ndarray) -> np.ndarray:
        return self.standardised(figures) @ self.weights + self.offset

    def scores(self, figures: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margins(figures))


def _sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, pull, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4):
    """Adam on a linear margin; ``pull`` gives the risk's derivative by each margin."""
    weights = np.zeros(positive.shape[1] + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    p, u = (np.hstack([part, np.ones((len(part), 1))]) for part in (positive, unlabelled))
    for step in range(1, steps + 1):
        by_p, by_u = pull(p @ weights, u @ weights)
        gradient = p.T @ by_p + u.T @ by_u
        gradient[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def fit_domain(positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
    """Positives against unlabelled rows, by logistic loss."""
    middle = unlabelled.mean(0)
    spread = unlabelled.std(0) + 1e-6
    scale = Scorer(middle, spread, np.zeros(0), 0.0).standardised

    def pull(p, u):
        return -_sigmoid(-p) / len(p), _sigmoid(u) / len(u)

    weights = _descend(scale(positive), scale(unlabelled), pull)
    return Scorer(middle, spread, weights[:-1], float(weights[-1]))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, start: Scorer) -> Scorer:
    """Minimise the non-negative risk; where its negative part falls below
    zero, the step leads back up instead."""

    def slope(margins):
        value = _sigmoid(margins)
        return value * (1 - value)  # of the sigmoid loss for "not good"

    def pull(p, u):
        negative = _sigmoid(u).mean() - prior * _sigmoid(p).mean()
        by_p, by_u = -prior * slope(p) / len(p), slope(u) / len(u)
        if negative < 0:
            return -by_p, -by_u
        return by_p - prior * slope(p) / len(p), by_u

    scale = start.standardised
    weights = _descend(scale(positive), scale(unlabelled), pull)
    return Scorer(start.middle, start.spread, weights[:-1], float(weights[-1]))


def scored(rows: DataFrame, scorer: Scorer) -> Column:
    @F.pandas_udf("double")
    def score(figures: pd.Series) -> pd.Series:
        return pd.Series(scorer.scores(np.stack(figures.to_numpy()).astype(np.float64)))

    return score(rows["figures"])


def histogram(rows: DataFrame, scorer: Scorer) -> np.ndarray:
    """How many rows score in each of ``BINS`` equal parts of 0 to 1."""
    part = F.least(F.floor(scored(rows, scorer) * BINS), F.lit(BINS - 1)).cast("int")
    counts = np.zeros(BINS)
    for row in rows.groupBy(part.alias("part")).count().collect():  # at most BINS rows
        counts[row["part"]] = row["count"]
    return counts


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among unlabelled rows, from both histograms:
    the least upper bound that any threshold gives, at that confidence."""
    n_p, n_u = positives.sum(), unlabelled.sum()
    above_p = positives[::-1].cumsum()[::-1] / n_p
    above_u = unlabelled[::-1].cumsum()[::-1] / n_u
    doubt = math.sqrt(math.log(4 / confidence) / (2 * n_u)) + math.sqrt(math.log(4 / confidence) / (2 * n_p))
    usable = above_p > 0
    bounds = (above_u[usable] + (1 + slack) * doubt) / above_p[usable]
    best = bounds.argmin()
    return float(np.clip(above_u[usable][best] / above_p[usable][best], 0.01, 0.99))


@dataclass(frozen=True)
class Learnt:
    scorer: Scorer | None
    prior: float | None


def learn(rows: DataFrame, labels: DataFrame, fitted_rows: int = FITTED_ROWS) -> Learnt:
    """Fit on stored rows (``described``) and the positives among the labels."""
    unlabelled = rows.where(~F.col("held_out"))
    positives = unlabelled.join(trusted_positives(labels), "doc_id")
    p = drawn(positives, fitted_rows, 1)
    if not len(p):
        return Learnt(None, None)
    u = drawn(unlabelled, fitted_rows, 2)
    domain = fit_domain(p, u)
    prior = estimated_prior(histogram(positives, domain), histogram(unlabelled, domain))
    return Learnt(fit_risk(p, u, prior, domain), prior)


def classify(docs: DataFrame, labels: DataFrame, fitted_rows: int = FITTED_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    rows = stored(described(docs), "figures", "zstd")
    scorer = learn(rows, labels, fitted_rows).scorer
    score = F.lit(0.5) if scorer is None else scored(rows, scorer)
    result = rows.select("doc_id", "held_out", score.alias("score"))
    return result.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
