"""Language of a text by the nearest of several centroids per language.

A text is a vector of hashed 2- and 3-grams of its lower-cased letters, weighted by TF-IDF and
scaled to length 1.  Each language gets a few centroids by spherical k-means, so dialects,
registers and noise get their own; a text takes the language of the most similar centroid, and is
marked as rejected where it lies farther from it than almost all texts that made the centroid.

Document frequencies count every text to learn from; centroids are fitted on at most about
``SAMPLE`` texts a language, chosen by a hash of the id.  A null text, or one without a letter,
is ``und`` with score 0; so is every text if nothing could be learned.  Rows are judged one by one;
a null id is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.sums import held_out, summed
from evalspark.llm.tokens import slabs
from evalspark.llm.words import text_bytes

SIZE, SAMPLE, CENTROIDS, ROUNDS = 2048, 1500, 4, 12
TEMPERATURE, FARTHEST = 0.05, 0.001  # of the score; share of a centroid's own texts beyond its reach

UNKNOWN = "und"

_LETTER = np.zeros(256, np.uint32)
_LETTER[np.r_[97:123, 128:256]] = np.r_[97:123, 128:256]


def ngrams(texts: pa.Array) -> np.ndarray:
    """How often each hashed 2- or 3-gram occurs: a row for each text."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    out = np.zeros((len(texts), SIZE), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for begin in range(a, b, 1 << 20):
            x = _LETTER[data[max(begin - 2, a) : min(begin + (1 << 20), b)]]
            two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
            three = two[:-1] * np.uint32(0x27D4EB2F) + x[2:] * np.uint32(0xC2B2AE3D)
            grams = np.concatenate([two, three])
            out[i] += np.bincount((grams ^ (grams >> np.uint32(15))) % SIZE, minlength=SIZE)
    return out


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray  # least similarity that is not rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.idf
        return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each row of counts."""
        near = self.vectors(counts) @ self.centroids.T
        names = sorted(set(self.languages))
        best = np.stack([near[:, [n == name for n in self.languages]].max(axis=1) for name in names], axis=1)
        top = best.argmax(axis=1)
        odds = np.exp((best - best.max(axis=1, keepdims=True)) / TEMPERATURE)
        own = near.argmax(axis=1)
        similarity = near.max(axis=1)
        rejected = similarity < self.reach[own]
        score = 1 / odds.sum(axis=1) * np.where(rejected, similarity / np.maximum(self.reach[own], 1e-9), 1)
        return [names[k] for k in top], np.clip(score, 0, 1), rejected


def _clustered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors, and the similarity that all but a few of each one's vectors reach."""
    k = min(CENTROIDS, len(x))
    centers = x[:1]
    while len(centers) < k:  # the text farthest from all so far
        centers = np.concatenate([centers, x[[(x @ centers.T).max(axis=1).argmin()]]])
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(k)])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = x @ centers.T
    own = near.argmax(axis=1)
    reach = [np.quantile(near[own == c, c], FARTHEST) if (own == c).any() else 0.0 for c in range(k)]
    return centers, np.array(reach, float)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    known = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id"))

    def frequencies(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(SIZE + 1)
        for _, texts in slabs(batch.column(0)):
            total[:SIZE] += (ngrams(pa.array(texts)) > 0).sum(axis=0)
            total[SIZE] += len(texts)
        return total

    seen = summed(known.select("text"), SIZE + 1, frequencies)
    if not seen[SIZE]:
        return None
    idf = np.log((1 + seen[SIZE]) / (1 + seen[:SIZE])) + 1
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, SAMPLE / n))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    weights = Model([], idf, np.zeros((0, SIZE)), np.zeros(0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slabs(batch.column(0)):
                rows = weights.vectors(ngrams(pa.array(texts))).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, len(texts)), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "vector"]
                )

    def centroids(rows: pa.Table) -> pa.Table:
        cells = sorted(rows.column("vector").to_pylist())
        centers, reach = _clustered(np.frombuffer(b"".join(cells), "<f4").reshape(-1, SIZE))
        return pa.table({
            "lang": pa.array([rows.column("lang")[0].as_py()] * len(centers), pa.string()),
            "vector": pa.array([c.astype("<f4").tobytes() for c in centers], pa.binary()), "reach": reach,
        })

    fitted = chosen.select("text", "lang").mapInArrow(vectors, "lang string, vector binary")
    found = fitted.groupBy("lang").applyInArrow(centroids, "lang string, vector binary, reach double").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    return Model(
        [r["lang"] for r in found], idf, np.stack([np.frombuffer(r["vector"], "<f4") for r in found]),
        np.array([r["reach"] for r in found]),
    )


def identify(df: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few vectors a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slabs(batch.column(1)):
                column = pa.array(texts)
                lettered = np.asarray(pc.match_substring_regex(column, r"\p{L}"))
                names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if shared.value is not None:
                    names, scores, rejected = shared.value.predict(ngrams(column))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([n if ok else UNKNOWN for n, ok in zip(names, lettered, strict=True)]),
                        pa.array(np.where(lettered, scores, 0.0)), pa.array(rejected | ~lettered),
                    ],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    kinds = "doc_id long, lang_pred string, score double, rejected boolean"
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, kinds).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected"
    )
