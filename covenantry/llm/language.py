"""Language identification by nearest centroids of TF-IDF vectors, with rejection by distance.

A text is its runs of letters in lower case; its features are one, two and three consecutive
letters, where a gap counts as a letter at either end, hashed to ``PLACES`` places.  A vector holds
``log(1 + count) * idf`` and has length 1.  The sample of each language is split by spherical
k-means in ``CENTROIDS`` groups, so a language written in several ways has a centroid for each;
groups of less than ``SUPPORT`` of the sample, such as mislabelled rows form, are left out.  A text
gets the language of the centroid of largest cosine; it is rejected if it is farther from it than
``SPREADS`` standard deviations beyond the mean distance of that centroid's own rows.

Document frequencies count every row that may be learnt from; each task sends its sums once.  The
centroids are the classifier and are fitted on at most ``SAMPLE`` rows a language (whole texts, by
a hash of id and text), one task a language, which sees vectors only.  A model has at most
``CENTROIDS * PLACES`` numbers a language; tables of more than ``MAX_LANGUAGES`` languages, whose
model would exceed ``MODEL_BYTES``, are refused, so what is broadcast is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenantry.llm.shared import held_out, written

PLACES = 1 << 14
SAMPLE = 1000
CENTROIDS = 3
ROUNDS = 10
SUPPORT = 0.02
SPREADS = 4.0
MODEL_BYTES = 256 << 20
MAX_LANGUAGES = MODEL_BYTES // (4 * PLACES * CENTROIDS)
PIECE = 1 << 20
BATCH = 64
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers as a place."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(50)).astype(np.int64) % PLACES


def counts(text: str) -> np.ndarray | None:
    """Occurrences of each place, or None without a letter.  Long texts are counted piece by piece."""
    total, before = None, np.zeros(1, np.uint64)
    for k in range(0, len(text), PIECE):
        codes = np.frombuffer(text[k:k + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters()[codes], codes, 0).astype(np.uint64)
        codes = np.concatenate([before, codes, np.zeros(int(k + PIECE >= len(text)), np.uint64)])
        known, before = len(before), codes[-2:]
        gap = codes == 0
        keep = np.append(True, ~(gap[1:] & gap[:-1]))
        # letters that the piece before has counted only begin n-grams here
        fresh = np.arange(len(codes)) >= known
        codes, gap, fresh = codes[keep], gap[keep], fresh[keep]
        if gap.all():
            continue
        pair = codes[:-1] << np.uint64(21) | codes[1:]
        triple = pair[:-1] << np.uint64(21) | codes[2:]
        grams = np.concatenate([codes[fresh & ~gap], pair[fresh[1:]], triple[fresh[2:] & ~gap[1:-1]]])
        here = np.bincount(mixed(grams), minlength=PLACES)
        total = here if total is None else total + here
    return total


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of length 1 a text, zero without letters; and which texts have letters."""
    rows, have = np.zeros((len(texts), PLACES), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        found = counts(text or "")
        if found is not None:
            rows[i], have[i] = found, True
    np.log1p(rows, out=rows)
    rows *= idf
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    rows /= np.where(size > 0, size, 1)[:, None]
    return rows, have


def learnable(docs: DataFrame) -> DataFrame:
    """``lang, text, turn`` of the rows that may be learnt from."""
    rows = docs.filter(~held_out("doc_id", 4, 2)).filter("lang is not null and text is not null")
    return rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("turn"))


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """Weight of every place from the number of rows that hold it."""
    def work(batches):
        held, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found = counts(text.as_py())
                if found is not None:
                    held += found > 0
                    n += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(held[at], n), pa.int64())],
                                         names=["place", "rows"])

    sums = rows.select("text").mapInArrow(work, "place int, rows long").groupBy("place").agg(F.sum("rows").alias("rows")).toArrow()
    place, held = sums["place"].to_numpy(), sums["rows"].to_numpy()
    n, df = held[place < 0].sum(), np.zeros(PLACES, np.int64)
    df[place[place >= 0]] = held[place >= 0]
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def sample_of(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of each language, by hash; no more than about twice as many leave their place."""
    sizes = written(rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")), "language-sizes")
    if sizes.count() > MAX_LANGUAGES:
        raise ValueError("too many languages for a broadcast model: lower PLACES or CENTROIDS, or raise MODEL_BYTES")
    met = rows.join(F.broadcast(sizes), rows["lang"] == sizes["of"])
    met = met.filter(F.pmod("turn", F.lit(1 << 40)) * F.col("n") < F.lit(2 * limit) * F.lit(float(1 << 40)))
    order = Window.partitionBy("lang").orderBy("turn")
    return met.dropDuplicates(["lang", "turn"]).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit).select("lang", "text", "turn")


def cluster(rows: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the row nearest to the mean and then always the farthest: centroids, own cosine of each row."""
    centre = [int(np.argmax(rows @ rows.sum(0)))]
    near = rows @ rows[centre[0]]
    while len(centre) < k and near.min() < 1 - 1e-6:
        centre.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[centre[-1]])
    found = rows[centre]
    for _ in range(ROUNDS):
        own = np.argmax(rows @ found.T, axis=1)
        sums = np.stack([rows[own == i].sum(0) if (own == i).any() else found[i] for i in range(len(found))])
        found = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    held = np.bincount(np.argmax(rows @ found.T, axis=1), minlength=len(found))
    found = found[(held >= SUPPORT * len(rows)) | (held == held.max())]
    return found, rows @ found.T


@dataclass
class Model:
    langs: list[str]          # of each centroid, ascending
    centroids: np.ndarray     # one row each
    reach: np.ndarray         # distance beyond which a text is rejected
    idf: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Centroids of every language among the rows that are not held out; none where nothing can be learnt."""
    rows = learnable(docs)
    idf = inverse_frequencies(rows)

    def weigh(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), BATCH):
                found, have = vectors(texts[i:i + BATCH], idf)
                at, place = np.nonzero(found)
                ends = np.searchsorted(at, np.arange(len(found) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(found)).cast(pa.string()), batch.column(2).slice(i, len(found)),
                     pa.ListArray.from_arrays(ends, place.astype(np.int32)), pa.ListArray.from_arrays(ends, found[at, place])],
                    names=["lang", "turn", "places", "weights"]).filter(pa.array(have))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("turn")
        dense = np.zeros((table.num_rows, PLACES), np.float32)
        sizes = [len(x) for x in table["places"]]
        dense[np.repeat(np.arange(table.num_rows), sizes), table["places"].combine_chunks().flatten().to_numpy()] = (
            table["weights"].combine_chunks().flatten().to_numpy())
        found, cosines = cluster(dense)
        own, far = np.argmax(cosines, axis=1), 1 - cosines.max(axis=1)
        reach = [far[own == i].mean() + SPREADS * far[own == i].std() if (own == i).any() else 0.0 for i in range(len(found))]
        return pa.table({"lang": [table["lang"][0].as_py()] * len(found), "reach": pa.array(reach, pa.float64()),
                         "centroid": pa.array(list(found.astype(np.float32)), pa.list_(pa.float32()))})

    chosen = sample_of(rows, sample).mapInArrow(weigh, "lang string, turn long, places array<int>, weights array<float>")
    learnt = written(chosen.groupBy("lang").applyInArrow(learn, "lang string, reach double, centroid array<float>"), "centroids")
    # equal cosines go to the first language
    table = learnt.toArrow().sort_by([("lang", "ascending"), ("reach", "ascending")])
    return Model(table["lang"].to_pylist(), np.array(table["centroid"].to_pylist(), np.float32).reshape(-1, PLACES), table["reach"].to_numpy(), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: ``doc_id, nearest, lang, score, rejected``.

    ``nearest`` is the language of the nearest centroid and ``score`` its cosine.  ``lang`` is ``und``
    where the row is rejected.  Null, empty and letterless texts, and all texts under an empty model,
    are ``und`` in both, rejected, with score 0.  Repeated rows get equal results; no row is moved.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), BATCH):
                found, have = vectors(texts[i:i + BATCH], model.idf)
                if not model.langs:
                    have[:] = False
                cosines = found @ model.centroids.T if model.langs else np.zeros((len(found), 1))
                best = np.argmax(cosines, axis=1)
                score = np.where(have, np.clip(cosines[np.arange(len(found)), best], 0, 1), 0.0)
                near = [model.langs[b] if h else UNKNOWN for b, h in zip(best, have, strict=True)]
                out = np.array([not h or 1 - s > model.reach[b] for b, h, s in zip(best, have, score, strict=True)], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(found)).cast(pa.int64()), pa.array(near, pa.string()),
                     pa.array([UNKNOWN if r else x for x, r in zip(near, out, strict=True)], pa.string()),
                     pa.array(score.astype(np.float64)), pa.array(out)], names=["doc_id", "nearest", "lang", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, nearest string, lang string, score double, rejected boolean")


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``: the nearest language of every row, fitted on the rows not held out.

    ``lang``, ``source`` and ``doc_id`` are no inputs of a prediction.  A null id is not held out.
    """
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")
