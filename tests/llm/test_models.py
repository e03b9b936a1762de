"""Toxicity and language model: held-out behaviour, exact bases, gradients."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers

from covenantry.llm import attention, lm_score, toxicity
from tests.llm import brute

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def toxic_rows(n: int = 1200):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["grubling", "grublest", "Snark"]))
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(i, t, *brute.CLASHING) for i, t in rows], f"doc_id long, text string, {brute.CLASH}")
    marks = spark.createDataFrame([*labels, (0, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(i % 8 == 0, got[i].predicted) for i, _ in rows if got[i].held_out]
    assert np.mean([truth == bool(p) for truth, p in held]) > 0.97
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_labels_of_held_out_rows_are_never_learnt(spark):
    rows, labels = toxic_rows(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())
              for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_of_awkward_rows(spark):
    docs, rows = brute.awkward(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, none).collect()
    assert len(got) == len(rows) and all(r.score == 0 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(100 + i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.score(docs, some).filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(brute.empty(spark), some).count() == 0


def base_of(rows):
    """The contract's figures of each row by counting."""
    words = [(i, [*brute.words(t, brute.NON_SPACE), None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = collections.Counter(w for (_, ws), h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            for (i, ws), h in zip(words, held, strict=True)]


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "KNOWN", 20)  # most words are joined, not broadcast
    monkeypatch.setattr(lm_score, "STEPS", 20)
    rng = random.Random(9)
    docs, rows = brute.awkward(spark)
    more = [(i, " ".join(rng.choice(["the", "of", "Water", "stone,", f"n{rng.randrange(90)}"]) for _ in range(rng.randint(0, 40))))
            for i in range(60)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
           for r in lm_score.score(docs, BYTES).collect()]
    assert sorted(map(str, got)) == sorted(str((*w[:5], round(w[5], 6))) for w in base_of(rows + more))


def test_scores_do_not_depend_on_the_broadcast_words(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "STEPS", 20)
    rng = random.Random(5)
    rows = [(i, " ".join(f"n{int(rng.paretovariate(0.5)) % 200}" for _ in range(rng.randint(0, 40)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for known in (20, 200_000):
        monkeypatch.setattr(lm_score, "KNOWN", known)
        found.append(dict(lm_score.score(docs, BYTES).select("doc_id", "score").collect()))
    assert len(found[0]) == len(rows) and found[0].keys() == found[1].keys()
    assert all(abs(found[0][i] - found[1][i]) < 1e-6 for i in found[0])


def test_scores_of_nothing(spark):
    assert lm_score.score(brute.empty(spark), BYTES).count() == 0


def small_counts(size: int = 60):
    rng = np.random.default_rng(1)
    ids = np.append(rng.integers(1, 50, size), 5.0)
    opening = np.append(np.arange(size) % 2 == 0, True)
    n = attention.CLASSES
    counts = attention.Counts(ids, opening, np.zeros((n, n)), np.zeros(n), np.zeros(n))
    of = counts.class_of()
    counts.firsts[of[opening]] = ids[opening]
    counts.lasts[of] = ids
    counts.pairs[np.ix_(of, of[~opening])] = rng.integers(0, 9, (size + 1, int((~opening).sum())))
    coarse = np.where(counts.opens(), np.arange(n) % attention.OPENING, attention.OPENING + np.arange(n) % 32)
    return counts, counts.vocabulary(coarse), coarse


def test_next_id_is_a_distribution_and_each_is_scored_once():
    counts, known, coarse = small_counts()
    model = attention.Attention(5)
    model.coarse = coarse
    end = known.end
    prefix = np.array([0, 1, 4, 7] * 9)
    total = 0.0
    for i in range(end):
        ids = np.append(prefix, i)
        value, begins = attention.log_probabilities(ids, np.array([0, len(ids)]), model, known)
        assert len(value) == len(ids) + 1
        total += math.exp(value[len(prefix)])
    closing, begins = attention.log_probabilities(prefix, np.array([0, len(prefix)]), model, known)
    assert 0.99 < total + math.exp(closing[-1]) < 1 + 1e-4 and begins[-1] <= 0  # classes without ids hold the rest
    # a text's values do not depend on its neighbours
    both, _ = attention.log_probabilities(np.append(prefix, prefix), np.array([0, 36, 36, 72]), model, known)
    assert np.allclose(both[:37], closing, atol=1e-4) and np.allclose(both[38:], closing, atol=1e-4)


def test_gradients():
    counts, known, coarse = small_counts()
    model = attention.Attention(5)
    rng = np.random.default_rng(3)
    bounds = np.array([0, 30, 35])
    x, y, _, opens = attention.blocks(rng.integers(0, 60, 35), bounds, known.end)
    own = np.where(x < 0, attention.CLASSES, known.class_of[x])
    window = attention.windows(own, opens)
    goal = np.where(y < 0, -1, coarse[known.class_of[y]])
    for name in model.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    _, grad = model.step(own, window, goal, known)
    for name in model.NAMES:
        value = getattr(model, name)
        at = np.unravel_index(np.argmax(np.abs(grad[name])), value.shape)
        losses = []
        for step in (1e-3, -2e-3):
            value[at] += step
            losses.append(model.step(own, window, goal, known)[0])
        value[at] += 1e-3
        assert abs((losses[0] - losses[1]) / 2e-3 - grad[name][at]) < 2e-2 * abs(grad[name][at]) + 1e-4, name
    losses = attention.Attention(5).train(own, window, goal, known, 60, batch=8)
    assert np.mean(losses[-10:]) < np.mean(losses[:10])
