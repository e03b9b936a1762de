"""Exact groups, Jaccard components and decontamination, against brute force."""

import random
import re

import numpy as np

from covenantry.llm import decontaminate, jaccard_join, radix_dedup
from tests.llm import brute


def test_exact_groups(spark, monkeypatch):
    monkeypatch.setattr(radix_dedup, "FIRST_DIGIT", 8)
    monkeypatch.setattr(radix_dedup, "DIGIT_GROWTH", 4)
    long = "z" * 5000
    docs, rows = brute.awkward(spark, brute.AWKWARD + [long, long + "a", long + "b", "z " * 2500 + " "])
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i if i is not None else -1, i))
    want = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:2])
        for k, m in enumerate(members):
            want.append((m[2], members[0][2], len(members), k == 0, brute.sha(norm)))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in radix_dedup.exact_groups(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert radix_dedup.exact_groups(brute.empty(spark)).count() == 0


def test_one_row_of_each_exact_group_stays(spark):
    docs, rows = brute.awkward(spark)
    stay = radix_dedup.one_of_each(docs)
    assert stay.columns == docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in stay.collect()]
    assert len(norm) == len(set(norm)) and set(norm) == {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows}


def near_rows(seed: int) -> list:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    base, rows = [rng.choice(words) for _ in range(60)], []
    for k in range(60):  # a dense group
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((k, " ".join(text)))
    chain = [rng.choice(words) for _ in range(40)]
    for k in range(60, 110):  # a chain that drifts away
        chain[rng.randrange(40)] = rng.choice(words)
        rows.append((k, "  ".join(chain).upper()))
    return rows


def test_jaccard_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    docs, rows = brute.awkward(spark, brute.AWKWARD + ["a b c", "a b"])
    more = near_rows(1)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = rows + more
    want = brute.near_components([r for r in rows if r[0] is not None], 4, 85)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert sorted(r.n_shingles for r in got) == sorted(len(brute.shingles(t, 4)) for _, t in rows)


def test_a_row_without_an_id_takes_no_links_away(spark):
    """The first of equal texts has no id; those behind it keep their links."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (2, text), (5, text.replace("w7 ", "v7 "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {None: None, 2: 2, 5: 2}


def test_near_copies_go_row_by_row(spark):
    """Rows that repeat an id are judged by their own texts; rows without an id or words stay."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(7, a), (9, a.replace("a7 ", "v7 ")), (9, b), (9, b.upper()), (9, ""), (9, None), (None, a), (11, b.replace("b7 ", "v7 ")), (12, "alone")]
    docs = spark.createDataFrame([(i, t, *brute.CLASHING) for i, t in rows], f"doc_id long, text string, {brute.CLASH}")
    stay = jaccard_join.one_of_each(docs, shingle=5, share=80)
    assert stay.columns == docs.columns
    got = sorted(map(str, ((r.doc_id, (r.text or "").lower(), r.text is None) for r in stay.collect())))
    assert got == sorted(map(str, [(7, a, False), (9, b, False), (9, "", False), (9, "", True), (None, a, False), (12, "alone", False)]))
    none = jaccard_join.one_of_each(brute.empty(spark), shingle=5, share=80)
    assert none.columns == docs.columns and none.count() == 0


def test_jaccard_of_nothing(spark):
    assert jaccard_join.near_duplicates(brute.empty(spark)).count() == 0


def test_search_finds_every_overlap():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.choice(400, 60, replace=False)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.choice(400, rng.integers(0, 12))])).astype(np.uint64)
            for _ in range(80)]
    index = jaccard_join.TOccurrence(sets, 80)
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert set(index.search(a, np.zeros(80, bool)).tolist()) == want and i in want


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "only Three words"),
         (10, "x"), (3, None), (4, "..."), (5, "one two three four five six seven eight nine ten eleven twelve thirteen"),
         (6, "the the the the the the the the the the the the the the the")]


def check_contamination(spark):
    tail = "one TWO three four five six seven, eight nine ten eleven twelve thirteen fourteen"
    texts = brute.AWKWARD + [tail, "pad " * 300 + tail, "pad " * 50 + "only three words", "the " * 40, "x", "only three", tail + " " + tail]
    docs, rows = brute.awkward(spark, texts)
    items = spark.createDataFrame([(i, t, 1, "s") for i, t in ITEMS], "item_id long, text string, n long, window string")
    want = [(i, n, hit, len(of), brute.sha(",".join(of)), hit > 0 and 20 * hit >= n)
            for i, n, hit, of in brute.contamination(rows, ITEMS)]
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in decontaminate.contamination(docs, items).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    clean = decontaminate.without_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)


def test_contamination(spark):
    check_contamination(spark)


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    check_contamination(spark)


def test_contamination_of_nothing(spark):
    docs, rows = brute.awkward(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs, none).collect()
    assert len(got) == len(rows) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(brute.empty(spark), items).count() == 0


def test_only_hashes_that_may_be_shared_are_moved(spark):
    rng = np.random.default_rng(5)
    own, common = rng.integers(-2**63, 2**63 - 1, (40, 50)), rng.integers(-2**63, 2**63 - 1, 30)
    rows = spark.createDataFrame([(k + 1, 50, [*own[k].tolist(), *common.tolist()] if k % 2 else own[k].tolist()) for k in range(40)] + [(99, 0, [])],
                                 "class long, n long, sample array<long>")
    shared = spark.createDataFrame([(t, 20) for t in common.tolist()], "of long, df long")
    got = [tuple(r) for r in jaccard_join._perhaps_shared(rows, shared).collect()]
    want = {(k + 1, 50, t) for k in range(1, 40, 2) for t in common.tolist()}
    assert want <= set(got) and len(got) < len(want) + 20
