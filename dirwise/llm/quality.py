"""Quality of documents from a linear-chain conditional random field over their lines.

Every line is good or bad. Its features describe its characters and words and those
of the lines before and after it; the chain adds a weight for every change or stay
from one line to the next. Forward-backward gives each line's probability of being
good, and the mean of these, weighted by line length, is the document's score.

The field is fitted on a sample of labelled documents of at most ``SAMPLE_DOCS``
documents with at most ``SAMPLE_LINES`` lines and ``SAMPLE_CHARS`` characters each, whose lines all take the
document's label; scoring covers every line of every document. Nothing but text is
an input of a score.

Defined results: null text counts as empty; an empty text is one empty line and has
a score; rows without an id or label are scored but not learnt from; of repeated
labels the smallest counts; with no or one kind of label the score is the share of
good labels (0.5 without any); other columns are kept, columns named ``score`` or
``predicted`` are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirwise.llm.common import slices, text_or_empty

SAMPLE_DOCS = 4000
SAMPLE_LINES = 400
SAMPLE_CHARS = 50_000
#: Thresholds at which every measure of a line gets a weight of its own.
STEPS = (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
ROUNDS, RATE, RIDGE = 250, 0.1, 1e-3

STOPS = b".,"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in STOPS)
DIGITS, CAPITALS, GAPS = b"0123456789", bytes(range(65, 91)), b" \t"
ENDS = re.compile(r"[.!?…:;\"')\]]\s*$")
MEASURES = 15


def line_measures(line: str) -> tuple[float, ...]:
    """Shares and sizes from 0 to 1 that describe one line."""
    raw, words = line.encode("utf-8", "replace"), line.split()
    n, k = len(raw) or 1, len(words) or 1
    left = lambda chars: (n - len(raw.translate(None, chars))) / n if raw else 0.0
    return (
        left(MARKS), left(STOPS) * 4, left(DIGITS), left(CAPITALS), left(GAPS), len(set(words)) / k if words else 0.0,
        sum(map(str.__eq__, words, words[1:])) / k, min(1.0, len(line) / k / 20), min(1.0, max(map(len, words), default=0) / 60),
        sum(len(w) < 4 for w in words) / k, min(1.0, np.log1p(len(words)) / 8), float(not words), float(len(words) == 1), float(bool(ENDS.search(line))), float(line[:1].isupper()),
    )


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines, each text's number of lines, and each line's length."""
    split = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in split], np.int64)
    own = np.array([line_measures(line) for x in split for line in x], np.float32).reshape(-1, MEASURES)
    size = np.array([max(1, len(line)) for x in split for line in x], np.float64)
    first = np.zeros(len(own), bool)
    first[counts.cumsum() - counts] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = -1, -1  # no such line
    same = (np.abs(before - own).max(axis=1) == 0).astype(np.float32)[:, None]
    steps = (own[:, :, None] > np.array(STEPS, np.float32)).reshape(len(own), -1)
    return np.hstack([np.ones((len(own), 1), np.float32), own, steps, before, after, same], dtype=np.float32), counts, size


class Chains:
    """Chains of several lengths, walked together step by step: longest first, so that the live ones lie in front."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        self.sizes = counts[self.order]
        self.start = (counts.cumsum() - counts)[self.order]
        self.live = [int(np.searchsorted(-self.sizes, -t, side="left")) for t in range(int(counts.max(initial=0)))]

    def marginals(self, unary: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of good per line, expected moves (2 x 2), log of the normalisers' product."""
        forward, total = np.zeros((len(unary), 2)), 0.0
        for t, n in enumerate(self.live):
            at = self.start[:n] + t
            score = np.zeros((n, 2))
            score[:, 1] = unary[at]
            if t:
                score += np.logaddexp(forward[at - 1, :1] + move[0], forward[at - 1, 1:] + move[1])
            forward[at] = score
        backward, moves = np.zeros((len(unary), 2)), np.zeros((2, 2))
        ends = self.start + self.sizes - 1
        norm = np.logaddexp(forward[ends, 0], forward[ends, 1])
        total = float(norm.sum())
        for t in range(len(self.live) - 1, 0, -1):
            n = self.live[t]
            at = self.start[:n] + t
            ahead = backward[at] + np.stack([np.zeros(n), unary[at]], axis=1)
            backward[at - 1] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            moves += np.exp(forward[at - 1][:, :, None] + move + ahead[:, None, :] - norm[:n, None, None]).sum(axis=0)
        whole = np.empty(len(unary))
        for t, n in enumerate(self.live):
            whole[self.start[:n] + t] = norm[:n]
        return np.exp(forward[:, 1] + backward[:, 1] - whole), moves, total


@dataclass
class Field:
    weights: np.ndarray
    move: np.ndarray
    share: float | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.share is not None or not texts:
            return np.full(len(texts), self.share or 0.0)
        x, counts, size = features(texts)
        good = Chains(counts).marginals((x @ self.weights).astype(np.float64), self.move)[0]
        first = counts.cumsum() - counts
        return np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 0, 1)


def fit_field(texts: list[str], labels: list[int], rounds: int = ROUNDS) -> Field:
    """Fit by gradient steps (Adam) on the likelihood of the line labels."""
    if len(set(labels)) < 2:
        return Field(np.zeros(0), np.zeros((2, 2)), labels[0] if labels else 0.5)
    x, counts, _ = features(texts)
    y = np.repeat(np.array(labels), counts)
    chains, first = Chains(counts), np.zeros(len(y), bool)
    first[counts.cumsum() - counts] = True
    seen = np.zeros((2, 2))
    np.add.at(seen, (np.roll(y, 1)[~first], y[~first]), 1)
    value = np.zeros(x.shape[1] + 4)
    mean, spread = np.zeros_like(value), np.zeros_like(value)
    each = 1 / len(labels)
    for i in range(1, rounds + 1):
        good, moves, _ = chains.marginals((x @ value[:-4].astype(np.float32)).astype(np.float64), value[-4:].reshape(2, 2))
        grad = np.r_[(y - good).astype(np.float32) @ x, (seen - moves).ravel()] * each - RIDGE * value
        mean, spread = 0.9 * mean + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        value = value + RATE * (mean / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.99**i)) + 1e-8)
    return Field(value[:-4].astype(np.float32), value[-4:].reshape(2, 2))


def held_out(id_col: str = "doc_id"):
    """Documents never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    """Fit on the bounded sample whose ids come first in a fixed hash order."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("known_id")).agg(F.min(label).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).where((F.length("text") <= SAMPLE_CHARS) & (F.size(F.split("text", "\n", -1)) <= sample_lines))
    chosen = F.broadcast(known.orderBy(F.xxhash64("known_id"), "known_id").limit(2 * sample_docs))  # at most 8,000 pairs of numbers
    rows = texts.join(chosen, F.col("id") == F.col("known_id")).orderBy(F.xxhash64("id"), "id", "text").limit(sample_docs).select("text", "y").collect()
    return fit_field([r["text"] for r in rows], [r["y"] for r in rows])


def scored(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher is better) and predicted (1 from 0.5 on)."""
    rows = docs.drop("score", "predicted")
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names, at = rows.columns, rows.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            score = field.scores([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, schema)
