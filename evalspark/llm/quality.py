"""Quality scores from random Fourier features of document statistics.

Statistics of a text (shares of kinds of bytes, word and line lengths, repetition) are
standardised and mapped by random cosines whose inner products approximate a Gaussian kernel.
Ridge regression on the labels needs only sums over rows: each partition adds up its part of
the normal equations, Spark adds the parts, and the driver solves for a fixed number of weights.
Scores of labelled rows that the regression has not seen are counted in bins and made
monotone by pooling adjacent violators; the result is the share of good documents at a score.

All labelled rows outside the held-out part are used.  A null or empty text has the statistics of
an empty one and is scored like any other.  Rows are scored one by one, so repeated rows and
ids score alike, and a null id is never learned from.  Without labels every score is 1: nothing is
known against any document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import store
from evalspark.llm.sums import held_out, summed
from evalspark.llm.tokens import slabs
from evalspark.llm.words import words_of

FEATURES, RIDGE, BINS, SEED = 256, 1e-3, 1000, 20240607
LOW, HIGH = -0.5, 1.5  # raw scores outside count in the first and last bin

_KINDS = (
    range(ord("a"), ord("z") + 1), range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), (9, 11, 12, 13, 32),
    (10,), range(128, 256), b".", b",", b"!?", b"|", b"*&%$#@^~", b"<>{}[]\\/=_", b";:'\"()-", range(0, 9),
)
N_STATISTICS = len(_KINDS) + 14


def statistics(texts: list[str]) -> np.ndarray:
    """One row of numbers for each text."""
    words = words_of(pa.array(texts, pa.string()))
    hashes, sizes = words.hashes(), (words.ends - words.starts).astype(float)
    kinds = np.zeros((256, len(_KINDS)))
    for k, members in enumerate(_KINDS):
        kinds[list(members), k] = 1
    heads = words.data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    tails = words.data[words.ends - 1] if len(words.starts) else np.zeros(0, np.uint8)
    upper = np.isin(heads, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
    marked = ~((tails >= 128) | np.isin(tails & 0xDF, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)))
    out = np.zeros((len(texts), N_STATISTICS))
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        a, b = words.first[i], words.first[i + 1]
        if not len(data):
            continue
        counts = np.bincount(data, minlength=256)
        share = counts[counts > 0] / len(data)
        out[i, : len(_KINDS)] = counts @ kinds / len(data)
        lines = np.diff(np.flatnonzero(np.concatenate([[True], data == 10, [True]])))
        rest = [np.log1p(len(data)), -(share * np.log2(share)).sum(), np.log1p(len(lines)), np.log1p(lines.mean()), np.log1p(lines.std())]
        if b > a:
            own, size, n = hashes[a:b], sizes[a:b], b - a
            _, times = np.unique(own, return_counts=True)
            pairs = np.unique(own[:-1] * np.uint64(3) + own[1:])
            rest += [
                np.log1p(n), size.mean(), size.std(), len(times) / n, times.max() / n, len(pairs) / max(n - 1, 1),
                (own[1:] == own[:-1]).mean() if n > 1 else 0.0, upper[a:b].mean(), marked[a:b].mean(),
            ]
        out[i, len(_KINDS) : len(_KINDS) + len(rest)] = rest
    return out


def measured(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slabs(batch.column(1)):
                rows = statistics(texts)
                bounds = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * N_STATISTICS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(bounds, pa.array(rows.ravel()))],
                    ["doc_id", "statistics"],
                )

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, statistics array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    levels: np.ndarray  # calibrated score at each bin

    def mapped(self, rows: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        rng = np.random.default_rng(SEED)
        slope = rng.normal(size=(N_STATISTICS, FEATURES)) / np.sqrt(N_STATISTICS)
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ slope + shift), np.ones(len(rows))])

    def bins(self, rows: np.ndarray) -> np.ndarray:
        at = (self.mapped(rows) @ self.weights - LOW) / (HIGH - LOW) * BINS
        return np.clip(np.nan_to_num(at), 0, BINS - 1).astype(int)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.levels[self.bins(rows)] if len(self.levels) else np.ones(len(rows))


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising shares closest to good / total: adjacent violators are pooled; empty bins lie between their neighbours."""
    pools: list[list[float]] = []  # good, total, bins
    at = np.flatnonzero(total)
    for g, n in zip(good[at], total[at], strict=True):
        pools.append([g, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], top, strict=True)]
    shares = np.repeat([g / n for g, n, _ in pools], [int(k) for *_, k in pools])
    return np.interp(np.arange(len(total)), at, shares)


def _known(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    """doc_id and label of the rows to learn from."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    return known.where("label is not null").where(~held_out("doc_id"))


def fit(statistics: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> Model:
    """Learns from all labelled rows that are not held out; a quarter of all rows calibrates."""
    rows = statistics.join(_known(labels, label, doc_id), "doc_id")
    rows = store.written(rows.withColumn("calibrates", F.crc32(F.col("doc_id").cast("string")) % 4 == 3), "labelled")
    learned, n = rows.where("not calibrates").select("statistics", "label"), N_STATISTICS

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])

    total = summed(learned, 1 + 2 * n, moments)
    none = Model(np.zeros(n), np.ones(n), np.zeros(FEATURES + 1), np.zeros(0))
    if not total[0]:
        return none
    mean = total[1 : n + 1] / total[0]
    scale = np.sqrt(np.maximum(total[n + 1 :] / total[0] - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), none.weights, none.levels)
    upper = np.triu_indices(FEATURES + 1)

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.mapped(_matrix(batch.column(0))), np.asarray(batch.column(1))
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    sums = summed(learned, len(upper[0]) + FEATURES + 1, normal)
    gram = np.zeros((FEATURES + 1, FEATURES + 1))
    gram[upper] = sums[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    weights = np.linalg.solve(gram + RIDGE * total[0] / FEATURES * np.eye(FEATURES + 1), sums[len(upper[0]) :])
    model = Model(model.mean, model.scale, weights, none.levels)

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        at = model.bins(_matrix(batch.column(0)))
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, np.asarray(batch.column(1)), BINS)])

    seen = summed(rows.where("calibrates").select("statistics", "label"), 2 * BINS, counted)
    if not seen.any():
        seen = summed(learned, 2 * BINS, counted)
    return Model(model.mean, model.scale, weights, np.clip(isotonic(seen[BINS:], seen[:BINS]), 0, 1))


def scored(statistics: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row of statistics."""
    shared = statistics.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return statistics.select("doc_id", "statistics").mapInArrow(run, "doc_id long, score double")


def classify(df: DataFrame, labels: DataFrame, threshold: float = 0.7, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every row of ``df``."""
    statistics = store.written(measured(df, text, doc_id), "statistics")
    return scored(statistics, fit(statistics, labels, label, doc_id)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.7, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df``, as they are, whose score is ``threshold`` or more.

    Rows that are held out are not measured before the fit; each row is measured once more to be judged.
    Texts are not shuffled: their statistics meet the labels.
    """
    model = fit(measured(df.where(~held_out(doc_id)), text, doc_id), labels, label, doc_id)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [shared.value.score(statistics(texts)) >= threshold for _, texts in slabs(batch.column(at))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return df.mapInArrow(run, df.schema)
