"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, the beginnings of its words (4 and 6 bytes, so
that inflected forms share what they learn), pairs of neighbouring words, and pairs that skip one
word, all hashed to ``2**BITS`` places.  FTRL-proximal keeps a learning rate per place, and its L1
term leaves most weights at exactly zero, so the model is a short table of places and weights
whose size is bounded by ``2**BITS`` and which is broadcast for scoring.

Bound: the classifier is fitted in one task on at most ``SAMPLE`` labelled rows (those of the
smallest hash of the id; their whole texts).  Places that at most two rows of the sample hold are
left out of the fit, as they say nothing of other rows.  Every row of the table is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenantry.llm.shared import held_out
from covenantry.llm.words import ALNUM, BASE, Words, _mix, distinct, hash_spans, spans

BITS = 20
SAMPLE = 16_000
EPOCHS = 4
RUN_BYTES = 1 << 20     # text hashed at once, which bounds a worker's arrays
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.5
PREFIXES = (4, 6)
THRESHOLD = 0.3


def feature_places(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text of the run, hashed place) of every feature occurrence."""
    words, doc = found.hashes(), found.doc_of_word()
    kinds, docs = [words], [doc]
    for n in PREFIXES:
        long = found.end - found.start > n
        kinds.append(hash_spans(found.data, found.start[long], found.start[long] + n) + np.uint64(n))
        docs.append(doc[long])
    for skip in (1, 2):
        if len(words) > skip:
            same = doc[:-skip] == doc[skip:]
            kinds.append(_mix(words[:-skip][same] * np.uint64(BASE) + words[skip:][same] + np.uint64(skip)))
            docs.append(doc[:-skip][same])
    place = np.concatenate([_mix(k + np.uint64(i)) for i, k in enumerate(kinds)]) >> np.uint64(64 - BITS)
    return np.concatenate(docs), place.astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss; a bias takes part without L1."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias = np.zeros(2)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def offset(self) -> float:
        return -self.bias[0] / ((BETA + np.sqrt(self.bias[1])) / ALPHA)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.offset()
        g = sigmoid(w.sum() + b) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w
        step = (np.sqrt(self.bias[1] + g * g) - np.sqrt(self.bias[1])) / ALPHA
        self.bias += (g - step * b, g * g)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``label, turn, text``: at most ``rows`` training rows.  A doc_id of several labels is toxic if one says so."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("label")))
    chosen = known.filter(~held_out("id", 4, 2)).select("id", "label", F.xxhash64("id").alias("turn"))
    chosen = chosen.orderBy("turn", "id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("label", "turn", "text")


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of all places and the bias, learnt in one task from the (bounded) sample in hashed order."""
    def features(batches):
        for batch in batches:
            for found in spans(batch.column(2), ALNUM, RUN_BYTES):
                doc, place = feature_places(found)
                n = found.rows.stop - found.rows.start
                pairs = distinct(doc << BITS | place)
                ends = np.searchsorted(pairs, np.arange(n + 1) << BITS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(found.rows.start, n), batch.column(1).slice(found.rows.start, n),
                     pa.ListArray.from_arrays(ends.astype(np.int32), (pairs & ((1 << BITS) - 1)).astype(np.int32))],
                    names=["label", "turn", "places"])

    def train(batches):
        rows = []
        for batch in batches:
            column = batch.column(2)
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
            flat, ends = flat.astype(np.int32), ends - ends[0]
            rows += [(label, flat[a:b]) for label, a, b in
                     zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        if not rows:
            return
        model = Ftrl(1 << BITS)
        often = np.zeros(1 << BITS, np.int32)
        for _, at in rows:
            often[at] += 1
        rows = [(label, at[often[at] > 2]) for label, at in rows]
        for _ in range(EPOCHS):
            for label, at in rows:
                model.learn(at, label)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()),
                                          pa.array(np.append(w[at], model.offset()), pa.float64())], names=["place", "weight"])

    places = sample.mapInArrow(features, "label int, turn long, places array<int>")
    learnt = places.repartition(1).sortWithinPartitions("turn", "label").mapInArrow(train, "place int, weight double")
    table = learnt.toArrow()
    place, weight = table["place"].to_numpy(), table["weight"].to_numpy()
    weights = np.zeros(1 << BITS, np.float32)
    weights[place[place >= 0]] = weight[place >= 0]
    bias = weight[place < 0]
    return weights, float(bias[0]) if len(bias) else -35.0


def batch_scores(text: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of each text of a batch."""
    out = [np.zeros(0)]
    for found in spans(text, ALNUM, RUN_BYTES):
        doc, place = feature_places(found)
        heavy = np.flatnonzero(weights[place])
        pairs = distinct(doc[heavy] << BITS | place[heavy])
        n = found.rows.stop - found.rows.start
        total = np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], minlength=n) + bias
        out.append(np.where(total <= -35, 0.0, sigmoid(total)))
    return np.concatenate(out)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels of rows whose crc32 of the id is 2 modulo 4 are never learnt.  Null and empty texts
    get the score of the bias alone; without any label every score is 0.  Repeated rows get
    equal scores.  A null id is not held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels)))

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(batch_scores(batch.column(1), *model.value))],
                                             names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold; no row is moved.

    Null and empty texts have the score of the bias alone, repeated rows and ids are judged row by row by
    their own texts, columns of any name stay, and an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels)))
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(batch.column(at), *model.value) < THRESHOLD))

    return docs.mapInArrow(work, docs.schema)
