"""Quality classifier: heuristic labellers, a label model by EM, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import owners, text_slices, totals, trigram_counts, utf8, words

DIMS = 4096
#: Bound of the sample of documents that trains the scorer.
SAMPLE = 5000
THRESHOLD = 0.4
EM_ROUNDS = 200

_ASCII = [chr(b) if b < 128 else "\0" for b in range(256)]
_SYMBOL = np.array([c in "#$%&*|~^<>{}[]\\=_@" for c in _ASCII])
_UPPER = np.array([c.isupper() for c in _ASCII])
_LOWER = np.array([c.islower() for c in _ASCII])
_DIGIT = np.array([c.isdigit() for c in _ASCII])
_SHOUT = np.array([c in "!?" for c in _ASCII])
_STOP = np.array([c in ".!?" for c in _ASCII])

#: Of each measure: its name, the value up to which a labeller votes good, the value from which it votes
#: bad (it abstains between), the fewest words that it judges, and the kind of badness that it looks for.
LABELLERS = (
    ("symbols", 0.02, 0.08, 1, 0),
    ("capitals", 0.15, 0.5, 3, 1),
    ("shouting", 0.05, 0.3, 3, 1),
    ("digits", 0.2, 0.5, 1, 0),
    ("repeated_words", 0.5, 0.7, 30, 2),
    ("repeated_triples", 0.1, 0.3, 20, 2),
    ("stuttering", 0.05, 0.25, 6, 2),
    ("decorated_words", 0.05, 0.3, 1, 0),
    ("insult_share", 0.001, 0.008, 1, 3),
    ("insults", 0.0, 0.25, 1, 3),
    ("different_insults", 0.0, 0.25, 1, 3),
)
# Plain insults and words of abuse.
INSULTS = (
    "bastard bastards bitch clown creep cretin degenerate despicable disgusting dumb dumbass dumb filth filthy fool foolish garbage hateful "
    "idiot idiotic idiots imbecile jerk loser losers lowlife moron moronic morons parasite pathetic pig repulsive scum scumbag slut sucker "
    "stupid trash trashy ugly vermin vile whore worthless wretch "
    "abschaum arschloch bloedmann depp drecksack dumm dummkopf ekelhaft erbärmlich hurensohn idioten schwachkopf trottel versager wertlos widerlich "
    "abruti connard connasse crétin débile dégueulasse imbécile minable ordure salaud salope stupide "
    "asqueroso basura cabrón estúpido estúpida gilipollas idiota imbécil inútil miserable patético patética tonto"
).split()
KIND = np.array([x[4] for x in LABELLERS])


_INSULTS = np.unique(words(*utf8(pa.array(INSULTS)))[0])


def measures(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The measures of LABELLERS, a row a text, and the number of words; the texts keep their case. Insults are counted in eighths."""
    length = np.maximum(np.diff(at), 1)
    letters = np.maximum(totals(_LOWER[data], at) + totals(_UPPER[data], at), 1)
    hashes, first = words(np.where(_UPPER[data], data | 32, data), at, unspaced=False)
    n = np.diff(first)
    some = np.maximum(n, 1)
    owner = owners(first)

    def repeated(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        again = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
        return np.bincount(o[1:][again], minlength=len(at) - 1)

    stutter = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    whole = owner[:-2] == owner[2:]
    triples = (hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7))[whole]
    place = np.minimum(np.searchsorted(_INSULTS, hashes), len(_INSULTS) - 1)
    abuse = np.flatnonzero(_INSULTS[place] == hashes)
    count = np.bincount(owner[abuse], minlength=len(at) - 1)
    different = np.bincount(np.unique(owner[abuse] * len(_INSULTS) + place[abuse]) // len(_INSULTS), minlength=len(at) - 1)
    symbol = _SYMBOL[data]
    start = symbol.copy()
    start[1:] &= ~symbol[:-1]  # runs of symbols, about one for each word that wears one
    columns = (
        totals(symbol, at) / length,
        totals(_UPPER[data], at) / letters,
        totals(_SHOUT[data], at) / some,
        totals(_DIGIT[data], at) / length,
        repeated(hashes, owner) / some,
        repeated(triples, owner[:-2][whole]) / np.maximum(n - 2, 1),
        np.bincount(owner[1:][stutter], minlength=len(at) - 1) / some,
        totals(start, at) / some,
        count / some,
        count / 8,
        different / 8,
    )
    return np.column_stack(columns), n


def votes(values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 abstains; a text without words is bad to all labellers."""
    out = np.full(values.shape, -1, np.int8)
    for j, (_, good, bad, least, _) in enumerate(LABELLERS):
        judged = n_words >= least
        out[judged & (values[:, j] <= good), j] = 1
        out[judged & (values[:, j] >= bad), j] = 0
    out[n_words == 0] = 0
    return out


@dataclass(frozen=True)
class LabelModel:
    """Latent classes of documents: good first, then one for each kind of badness."""

    share: np.ndarray  # of each class
    good: np.ndarray  # labeller x class: the probability that it votes good when it votes

    def classes(self, v: np.ndarray) -> np.ndarray:
        """Probability of each class for documents with these votes."""
        log = np.log(self.share) + (v == 1) @ np.log(self.good) + (v == 0) @ np.log(1 - self.good)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        return self.classes(v)[:, 0]


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over the distinct vote patterns and how many documents have each.

    It starts from labellers that seldom blame a good document, mostly blame a bad one of their own kind and
    seldom one of another. Weak counts of the same shape keep the estimates off 0 and 1, and no labeller is
    thought to blame more than one good document in ten, which is what makes the first class the good one.
    """
    kinds = np.arange(KIND.max() + 1)
    start = np.column_stack([np.full(len(LABELLERS), 0.97), np.where(KIND[:, None] == kinds, 0.2, 0.85)])
    model = LabelModel(np.array([0.8, *np.full(len(kinds), 0.2 / len(kinds))]), start)
    weak = np.array([20.0, *np.full(len(kinds), 4.0)])
    for _ in range(rounds):
        weight = model.classes(patterns) * counts[:, None]
        yes, voted = (patterns == 1).T @ weight, (patterns >= 0).T @ weight
        good = np.clip((yes + start * weak) / (voted + weak), 0.01, 0.99)
        good[:, 0] = np.maximum(good[:, 0], 0.9)
        share = np.maximum(weight.sum(axis=0) + 1, 1e-6)
        model = LabelModel(share / share.sum(), good)
    return model


def hashed(data: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Features of the scorer: damped trigram counts, unit length, and the measures in eighths, both hashed."""
    x = np.log1p(trigram_counts(data, at, DIMS))
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x /= np.where(size > 0, size, 1)
    step = np.minimum(values * 8, 8).astype(np.uint64)
    place = (step * np.uint64(31) + np.arange(values.shape[1], dtype=np.uint64) * np.uint64(977)) * np.uint64(0x9E3779B97F4A7C55)
    place >>= np.uint64(64 - int(np.log2(DIMS)))
    np.add.at(x, (np.arange(len(x))[:, None], place.astype(np.int64)), np.float32(0.5))
    return x


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by full gradient steps with momentum, both classes weighing the same; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    share = np.clip(y.mean(), 0.01, 0.99)
    weigh = (y / share + (1 - y) / (1 - share)) / 2
    w, push = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype)
    y, weigh = y.astype(x.dtype), weigh.astype(x.dtype)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        push = np.float32(0.9) * push + x.T @ (weigh * (p - y)) / np.float32(len(x)) + np.float32(decay) * w
        w = w - np.float32(rate * 0.1) * push
    return w


def _rows(batches: Iterable[pa.RecordBatch], column: int):
    for batch in text_slices(batches):
        data, at = utf8(batch.column(column))
        values, n = measures(data, at)
        yield batch, data, at, values, votes(values, n)


def _patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, int] = {}
    for *_, v in _rows(batches, 0):
        found, counts = np.unique(v, axis=0, return_counts=True)
        for p, c in zip(found, counts, strict=True):
            seen[p.tobytes()] = seen.get(p.tobytes(), 0) + int(c)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])


@dataclass(frozen=True)
class Scorer:
    labels: LabelModel
    weights: np.ndarray

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, posterior and probability of abuse of each text."""
        values, n = measures(data, at)
        v = votes(values, n)
        p = 1 / (1 + np.exp(-np.clip(hashed(data, at, values) @ self.weights[:-1] + self.weights[-1], -30, 30)))
        classes = self.labels.classes(v)
        return np.where(n == 0, 0.0, p), classes[:, 0], classes[:, -1]


def fit(documents: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Every document's votes are counted by pattern, of which there are 3 to the number of labellers at most.

    EM over the counts gives each labeller's accuracy on good and on bad documents; no given label is used.
    The posteriors of about `sample` documents, drawn row by row with a fixed seed (so that repeated or missing ids and equal
    texts don't come all together), train the linear scorer.
    """
    texts = documents.select("doc_id", "text")
    counted = texts.select("text").mapInArrow(_patterns, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return Scorer(LabelModel(np.array([0.5, 0.5]), np.full((len(LABELLERS), 2), 0.5)), np.zeros(DIMS + 1))
    patterns = np.array([np.frombuffer(r["votes"], np.int8) for r in counted])
    counts = np.array([r["n"] for r in counted], np.float64)
    labels = fit_labels(patterns, counts)

    chosen = texts.withColumn("draw", F.rand(10)).where(F.col("draw") < min(1.0, sample / counts.sum())).select("doc_id", "text")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at, values, v in _rows(batches, 1):
            x = hashed(data, at, values).astype("<f2")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(labels.posterior(v))], names=["x", "y"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack([np.frombuffer(r, "<f2") for r in group["x"]]).astype(np.float32)
        return pd.DataFrame({"w": [train(x, group["y"].to_numpy()).astype("<f8").tobytes()]})

    rows = chosen.mapInArrow(features, "x binary, y double").withColumn("sample", F.lit(0))
    fitted = rows.groupBy("sample").applyInPandas(learn, "w binary").collect()
    return Scorer(labels, np.frombuffer(fitted[0]["w"], "<f8") if fitted else np.zeros(DIMS + 1))


def score(documents: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score, posterior, keep, by a scorer fitted on the same documents.

    A null or empty text, or one without a word, scores 0 and is not kept; a text of any length is measured whole. Rows
    of one doc_id and null doc ids are scored by their own text, so equal texts score the same. toxicity is the probability of the latent
    class of abuse. Columns of other names play no part. An empty table gives no row.
    """
    scorer = fit(documents, sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            p, posterior, toxic = scorer.score(*utf8(batch.column(1)))
            arrays = [batch.column(0), pa.array(p), pa.array(posterior), pa.array(p >= threshold), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "posterior", "keep", "toxicity"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, posterior double, keep boolean, toxicity double")


def keep_good(documents: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score() would keep, with all columns, filtered where they are read."""
    scorer, place = fit(documents, sample), documents.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            p, *_ = scorer.score(*utf8(batch.column(place)))
            yield batch.filter(pa.array(p >= threshold))

    return documents.mapInArrow(run, documents.schema)
