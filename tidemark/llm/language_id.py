"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, trigram_counts, utf8

#: Places that trigrams are hashed to, clusters per language, and the bound of the labelled sample per language.
DIMS = 4096
CLUSTERS = 4
SAMPLE = 600
ROUNDS = 12
#: Share of a cluster's own sample that its rejection threshold leaves outside.
REJECTED = 0.005
UNKNOWN = "und"

# ASCII letters and every byte beyond ASCII stay; all else parts words
_LETTER = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def vectors(batch: pa.RecordBatch, column: int, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of a batch of lower-case texts; a text without trigrams gives zeros."""
    data, at = utf8(batch.column(column))
    x = np.log1p(trigram_counts(_LETTER[data], at, DIMS)) * idf
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in text_slices(batches):
        data, at = utf8(batch.column(0))
        total += (trigram_counts(_LETTER[data], at, DIMS) > 0).sum(axis=0)
        n += batch.num_rows
    places = np.append(np.arange(DIMS), -1)  # -1 counts documents
    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.append(total, n))], names=["place", "n"])


def spherical_clusters(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of the rows of x by k-means on cosine, started from mutually far rows, and each row's cosine."""
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        nearest = (x @ centres.T).max(axis=1)
        centres = np.vstack([centres, x[nearest.argmin()]])
    for _ in range(rounds):
        label = (x @ centres.T).argmax(axis=1)
        sums = np.vstack([x[label == j].sum(axis=0) if (label == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, x @ centres.T


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # the least cosine that a centroid accepts


def fit(labelled: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> LanguageModel:
    """Fit on rows (doc_id, text, lang).

    Document frequencies count every labelled text. The centroids come from about `sample` texts per
    language (never much more), drawn row by row with a fixed seed, so that repeated or missing ids and equal texts don't
    come all together; each language is clustered by one task.
    """
    texts = labelled.where("text is not null and lang is not null").select("doc_id", F.lower("text").alias("text"), "lang")
    counts = texts.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = {r["place"]: r["n"] for r in counts.collect()}
    df = np.array([found.get(i, 0) for i in range(DIMS)], np.float64)
    idf = (np.log((1 + found.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)

    sizes = texts.groupBy("lang").agg(F.count("*").alias("rows"))
    chosen = texts.withColumn("draw", F.rand(3)).join(F.broadcast(sizes), "lang").where(F.col("draw") < sample / F.col("rows")).select("lang", "text")

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        batch = pa.RecordBatch.from_pandas(group[["text"]])
        x = np.vstack([vectors(part, 0, idf) for part in text_slices([batch])])
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "low": []})
        centres, cosines = spherical_clusters(x, clusters)
        label, best = cosines.argmax(axis=1), cosines.max(axis=1)
        low = [float(np.quantile(best[label == j], REJECTED)) if (label == j).any() else 0.0 for j in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.astype("<f4").tobytes() for c in centres], "low": low})

    rows = chosen.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, low double").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    centroids = np.vstack([np.frombuffer(r["centroid"], "<f4") for r in rows]) if rows else np.zeros((0, DIMS), np.float32)
    return LanguageModel(idf, [r["lang"] for r in rows], centroids, np.array([r["low"] for r in rows]))


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected, centroid.

    score is the cosine with the nearest centroid of all. A text that is null or has no letter is `und`
    with score 0, and so is every text if nothing was learned. rejected marks texts farther from their
    centroid than nearly all it was made of; the nearest language is still given. Ties take the first
    language in order. Only the text is an input, read whole whatever its length; repeated and null doc ids keep a row
    each; columns of other names play no part; an empty table gives no row.
    """
    langs, width = np.array([*model.langs, UNKNOWN], dtype=object), len(model.langs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if width:
                cosines = vectors(batch, 1, model.idf) @ model.centroids.T
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
                far = score < model.limits[best]
            else:
                best, score, far = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
                letters = np.zeros(batch.num_rows, bool)
            best, score, far = np.where(letters, best, width), np.where(letters, score, 0.0), far | ~letters
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array(far), pa.array(best.astype(np.int32))],
                names=["doc_id", "lang_pred", "score", "rejected", "centroid"],
            )

    texts = documents.select("doc_id", F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, centroid int")


def label_documents(documents: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then label all: doc_id, held_out and identify()'s columns."""
    model = fit(documents.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = identify(documents, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "centroid")
