"""Language, spelling variants and the Merkle manifest, against brute force and held-out rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from covenantry.llm import language, merkle, spelling
from tests.llm import brute

# --- language ---------------------------------------------------------------------------------

SYLLABLES = {"aa": ["ka", "ro", "mi", "su"], "bb": ["xen", "thor", "wig", "plu"], "cc": ["ñez", "ció", "ada", "los"]}


def language_rows(n: int = 240):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        kinds = SYLLABLES[lang]
        if lang == "bb" and i % 2:  # the same language in another alphabet
            kinds = ["жук", "рок", "дым"]
        text = " ".join("".join(rng.choice(kinds) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 40)))
        rows.append((i, text, None if i % 17 == 3 else lang))
    return rows


def test_language_of_held_out_rows(spark):
    rows = language_rows()
    docs = spark.createDataFrame([(i, t, lang, 0.5, "no") for i, t, lang in rows], "doc_id long, text string, lang string, score double, nearest string")
    got = {r.doc_id: r for r in language.predict(docs).collect()}
    truth = [("aa", "bb", "cc")[i % 3] for i in range(len(rows))]
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    assert all(got[i].lang_pred == truth[i] for i in got)


def test_language_learns_only_from_open_rows(spark):
    rows = language_rows(120)
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    got = [sorted((r.doc_id, r.lang_pred, r.score) for r in language.predict(
        spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()) for x in (rows, turned)]
    assert got[0] == got[1]


def test_language_of_awkward_rows(spark):
    docs, rows = brute.awkward(spark)
    docs = docs.withColumn("lang", F.lit("xx"))
    got = language.predict(docs).collect()
    have = sum(any(c.isalpha() for c in t or "") for _, t in rows)
    assert len(got) == len(rows) and sum(r.lang_pred == "xx" for r in got) == have
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got if r.lang_pred != "xx")
    none = language.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == len(rows) and {r.lang_pred for r in none} == {"und"}
    assert language.predict(brute.empty(spark).withColumn("lang", F.lit("xx"))).count() == 0


def test_far_texts_are_rejected(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = language.fit(docs, sample=50)
    far = spark.createDataFrame([(1, "漢字仮名交じり文 書体 文字"), language_rows(300)[240][:2]], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(far, model).collect()}
    assert got[1].rejected and got[1].lang == "und" and got[1].nearest != "und"
    assert not got[240].rejected and got[240].lang == "aa"
    # each alphabet of the second language has a centroid of its own
    assert model.langs.count("bb") > 1


def test_features_do_not_depend_on_the_piece(monkeypatch):
    text = "Ab  c1dé f. " * 40 + "x"
    want = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = [0, *map(ord, word), 0]
        want.update((c,) for c in padded[1:-1])
        want.update(zip(padded, padded[1:], strict=False))
        want.update(zip(padded, padded[1:], padded[2:], strict=False))
    places = np.zeros(language.PLACES, np.int64)
    for gram, n in want.items():
        code = 0
        for c in gram:
            code = code << 21 | c
        places[language.mixed(np.array([code], np.uint64))] += n
    for piece in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(language, "PIECE", piece)
        assert (language.counts(text) == places).all()
    assert language.counts(" 12 ") is None


def test_rows_learnt_from_are_bounded(spark):
    rows = [(i, f"abc{i % 7}", "xx") for i in range(900)] + [(i, f"def {i}", "yy") for i in range(900, 940)] + [(next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2), "same", "zz")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = collections.Counter(r.lang for r in language.sample_of(language.learnable(docs), 20).collect())
    assert max(sizes.values()) <= 20 and sizes["xx"] > 5 and sizes["zz"] == 1


# --- spelling variants ------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def spelling_rows(docs, min_length, min_count, dominance):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        count[w] = len(others)
        form[w] = best if best is not None and n[best] >= dominance * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n}


def spelling_texts(seed: int):
    rng = random.Random(seed)
    base = ["aaab", "aab", "abab", "ébéb", "baña", "banana", "abcabc", "Ba×a", "zz"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = list(rng.choice(base[:2 + i % 8]))
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[k:k + (kind > 0)] = [] if kind == 2 else [rng.choice("abzéñ")]
            words.append("".join(w))
        rows.append((i, rng.choice([" ", "-", "漢", "1"]).join(words)))
    return rows


@pytest.mark.parametrize(("min_length", "min_count", "dominance"), [(1, 1, 2), (2, 2, 3), (4, 2, 10)])
def test_spelling_variants(spark, min_length, min_count, dominance):
    docs, rows = brute.awkward(spark)
    more = spelling_texts(min_length)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = spelling.variants(docs, min_length, min_count, dominance).collect()
    want = spelling_rows(rows + more, min_length, min_count, dominance)
    assert len(got) == len(want)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(r.root != r.form and r.form for r in got) or dominance == 10


def test_spelling_of_very_long_words_and_of_nothing(spark):
    docs, _ = brute.awkward(spark)
    got = {r.word: r.n for r in spelling.variants(docs, 7, 1).collect()}
    assert 30000 in {len(w) for w in got} or 29999 in {len(w) for w in got}
    assert spelling.variants(brute.empty(spark)).count() == 0


def test_ranges_are_cut_at_no_batch(spark):
    import pyarrow as pa

    words = [("banana", 5), ("banan", 3), ("bananb", 9), ("banane", 9), ("bbanana", 2), ("cat", 1)]
    rows = sorted(((r.prefix, r.last, r.n) for r in spelling.rotations(spark.createDataFrame(words, "word string, n long")).collect()))

    def batches(size):
        for k in range(0, len(rows), size):
            yield pa.RecordBatch.from_pylist([dict(zip(("prefix", "last", "n"), r, strict=True)) for r in rows[k:k + size]])

    whole = sorted(map(str, (r for b in spelling.scan(batches(1000)) for r in b.to_pylist())))
    assert whole and all(sorted(map(str, (r for b in spelling.scan(batches(k)) for r in b.to_pylist()))) == whole for k in (1, 2, 3, 5))


# --- Merkle manifest --------------------------------------------------------------------------


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(nodes):
    """The root of the nodes and the siblings of each, level by level, as (before, after)."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, k in enumerate(at):
            first = k - k % 3
            paths[i].append((level[first:k], level[k + 1:first + 3]))
        level = [h(*level[k:k + 3]) for k in range(0, len(level), 3)]
        at = [k // 3 for k in at]
    return level[0], paths


def manifest_rows(rows):
    sources = collections.defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in order:
        held = sorted(((r[0] is not None, r[0] or 0, leaf_of(r), r) for r in sources[s]), key=lambda x: x[:3])
        below[s] = held, tree([x[2] for x in held])
    root, crowns = tree([below[s][1][0] for s in order])
    out = []
    for s, crown in zip(order, crowns, strict=True):
        held, (subroot, paths) = below[s]
        for (_, _, leaf, row), path in zip(held, paths, strict=True):
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf_of([*row[:4], text])
            for before, after in path + crown:
                folded = h(*before, folded, *after)
            out.append((row[0], leaf, subroot, root, h(*[x for b, a in path + crown for x in b + a]), folded, folded == root))
    return out


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_manifest(spark, stride):
    rng = random.Random(stride)
    rows = [(i, rng.choice(["big"] * 6 + ["a", "", "é", None]), rng.choice(["en", None]), i if i % 5 else None,
             rng.choice([f"line {i}\nnext", "no feed", "", None, "\n"])) for i in range(220)]
    rows += [(7, "lone", "en", 1, "x\ny"), (3, "big", "en", 1, "again"), (None, "big", None, None, None), rows[0], rows[0],
             (900, "aa", "en", 3, "z" * 50000 + "\n")]
    rows += [(1000 + i, f"source {i}", "en", 1, "t") for i in range(12)]
    docs = spark.createDataFrame([(*r, "x", 7, "t") for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, leaf string, size long, tree string")
    got = merkle.verify(docs, stride).collect()
    want = manifest_rows(rows)
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert any(r.verified for r in got) and any(not r.verified for r in got)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 27, 28])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", None, None, "a\nb") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.verify(docs).collect())) == sorted(manifest_rows(rows)) if n else merkle.verify(docs).count() == 0
