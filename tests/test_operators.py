"""Operators on small frames against brute force and pinned values."""

import datetime as dt
import json
import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from covenantry.functions.similarity import best_window
from covenantry.functions.text import normalize_text
from covenantry.operators import (
    anchoring as A, containment as C, contradictions as K, dedup as D, entities as E, evaluation as V, integrity as I, listing as L,
    mutations as M, notices as N, pages as P, rollups as R, scoring as S,
)
from tests.test_similarity import every_window, plain_greedy, words

T0 = dt.datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# --- anchoring ----------------------------------------------------------------------

PAGES = [
    (1, 1, "The Supplier shall bring every pallet before noon. Lessor must sign each amendment by hand.", "pdf_text"),
    (1, 2, "Payment is due within thirty days of the invoice date and carries interest thereafter.", "ocr"),
    (1, 3, "The Supplier shall bring every pallet before noon. Nothing else is written here at all.", "pdf_text"),
    (2, 1, "A different document repeats: payment is due within thirty days.", "pdf_text"),
]
QUOTES = {
    1: "Supplier  shall bring every pallet",
    2: "Lessor must sign each amendment by hand. This sentence was never on any of the pages here.",
    3: "Payment is due within thirty dayz of the invoice date and carries intrest thereafter.",
    4: "Something wholly unrelated to the text, about penguins and the south pole.",
    5: "   ",
    6: "NOTE: nothing REMEDY: carries interest thereafter",
    7: "Supplier shall bring every pallet",
}


def page_frame(spark):
    return spark.createDataFrame(PAGES, "document_id long, page_number int, normalized_text string, text_source string")


def quote_frame(spark, quotes=QUOTES):
    data = [(i, 1, "obligation", q, T0 + dt.timedelta(seconds=i), "needs_review") for i, q in quotes.items()]
    return spark.createDataFrame(data, "item_id long, document_id long, kind string, quote string, created_at timestamp, status string")


def test_cascade(spark):
    got = {r.item_id: r for r in A.anchor(quote_frame(spark), page_frame(spark)).collect()}
    assert {i: r.verification_method for i, r in got.items()} == {
        1: "exact", 2: "sentence", 3: "fuzzy", 4: None, 5: None, 6: None, 7: "exact"}
    assert (got[1].page_number, got[1].normalized_char_start) == (1, 4)
    assert got[2].matched_quote == "Lessor must sign each amendment by hand."
    page = PAGES[1][2]
    start, end, ratio = every_window(QUOTES[3], page, 0.85, 0.98)
    assert (got[3].page_number, got[3].normalized_char_start, got[3].normalized_char_end) == (2, start, end)
    assert got[3].fuzzy_similarity == pytest.approx(ratio) and got[3].matched_quote == page[start:end]
    assert got[3].source == "ocr"


def text_frames(spark, texts, pages):
    needles = C.distinct_needles(spark.createDataFrame(texts, "item_id long, document_id long, needle string"))
    return needles, spark.createDataFrame(pages, "document_id long, page_number int, page_text string, source string")


@pytest.mark.parametrize("limit", [-1, 60, 1 << 16])
def test_first_pages_equal_a_scan(spark, monkeypatch, limit):
    """By anchors, partly by anchors, and directly."""
    monkeypatch.setattr(C, "DIRECT_PAIRS", limit)
    rng = random.Random(21)
    pages = [(d, n, words(rng, rng.choice([1, 2, 3, 5, 60]), ("pay", "rent", "lot", "aa", "aaa", "日本", "é")), "ocr")
             for d in (1, 2, 3) for n in range(1, 4 + 3 * d)]
    texts = []
    for i in range(150):
        d, _, text, _ = rng.choice(pages)
        start = rng.randrange(len(text))
        cut = text[start:start + rng.choice([1, 2, 3, 4, 5, 9, 20, 60, 400])]
        texts.append((i, rng.choice([d, d, 1, 4]), rng.choice([cut, cut, cut + "x", cut.replace(" ", "  ", 1), cut[::-1]])))
    texts += [(200, 1, texts[0][2]), (201, 2, "  "), (202, 3, "pay  rent"), (203, 3, "a" * 5000)]
    (asked, needles), frame = text_frames(spark, texts, pages)
    found = C.first_pages(needles, frame)
    got = {r.item_id: (r.page_number, r.start_at) for r in asked.join(found, ["document_id", "needle_id"]).collect()}
    want = {}
    for i, d, needle in texts:
        for e, n, text, _ in pages:
            if e == d and needle in text:
                want[i] = (n, text.find(needle))
                break
    assert got == want and len(want) > 60


def test_no_document_is_hot_among_anchors(spark, monkeypatch):
    """A document with seven tenths of all texts and pages meets them by anchor, not in one place."""
    rng = random.Random(22)
    vocabulary = [f"w{i}" for i in range(900)]
    pages = [(1 if n < 700 else n, n, words(rng, 12, vocabulary), "ocr") for n in range(1000)]
    texts = [(i, d, text[2:-2]) for i, (d, _, text, _) in enumerate(pages)]
    (_, needles), frame = text_frames(spark, texts, pages)
    assert C._by_anchor(needles, frame).count() < 1.2 * len(texts)
    try_back = []
    for name, value in (("spark.sql.shuffle.partitions", "64"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        before = spark.conf.get(name)
        spark.conf.set(name, value)
        try_back.append((name, before))
    try:
        met = C._by_anchor(needles, frame)
        shares = met.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    finally:
        for name, before in try_back:
            spark.conf.set(name, before)
    # 64 tasks: no document, and no anchor, fills one of them
    assert shares[2] == 64 and shares[0] < 0.05 * shares[1]


def test_fuzzy_scan_over_pages_equals_ordered_scan(spark):
    rng = random.Random(3)
    pages, quotes = [], {}
    for n in range(1, 9):
        pages.append((1, n, words(rng, 40), "pdf_text"))
    for i in range(12):
        text = rng.choice(pages)[2]
        cut = list(text[5:5 + rng.randint(40, 120)])
        for _ in range(rng.randint(1, 12)):
            cut[rng.randrange(len(cut))] = "q"
        quotes[i] = "".join(cut)

    def ordered(quote):
        best, top = None, 0.0
        for _, n, text, _ in pages:
            found = every_window(quote, text, 0.0, 0.98)
            if found and found[2] > top:
                best, top = (n, *found), found[2]
            if top >= 0.98:
                break
        return best if top >= 0.85 else None

    frame = spark.createDataFrame(pages, "document_id long, page_number int, normalized_text string, text_source string")
    got = {r.item_id: (r.hit.page_number, r.hit.start_at, r.hit.end_at, r.hit.ratio)
           for r in A.anchor_fuzzy(quote_frame(spark, quotes), A.prepare_pages(frame)).collect()}

    def squeezed(q):
        return " ".join(q.split())

    want = {i: ordered(squeezed(q)) for i, q in quotes.items()}
    assert got == {i: w for i, w in want.items() if w}


def test_fuzzy_search_in_pieces_and_blocks_equals_ordered_scan(spark, monkeypatch):
    """Pieces of long pages, several blocks of quotes and packs of pages, against a scan of whole pages."""
    for name, value in (("LEAST_CLASS", 6), ("PACK_PAGES", 2), ("PACK_GROUP", 2), ("BLOCK_QUOTES", 3)):
        monkeypatch.setattr(A, name, value)
    rng = random.Random(13)
    pages = [(d, n, words(rng, rng.choice([3, 40, 300])), "ocr") for d in (1, 2) for n in range(1, 12)]
    asked = []
    for i in range(40):
        d, _, text, _ = rng.choice(pages)
        cut = list(text[rng.randrange(len(text)):][:rng.choice([10, 45, 90, 200, 500])]) or ["x"]
        for _ in range(rng.randint(0, len(cut) // 8)):
            cut[rng.randrange(len(cut))] = rng.choice("qz ")
        asked.append((i, d, " ".join("".join(cut).split())))
    asked = [q for q in asked if q[2]] + [(100, 3, "a document without pages"), (101, 1, " ")]
    frame = spark.createDataFrame(pages, "document_id long, page_number int, normalized_text string, text_source string")
    items = spark.createDataFrame(asked, "item_id long, document_id long, quote string")
    got = {r.item_id: (r.hit.page_number, r.hit.start_at, r.hit.end_at, r.hit.ratio, r.hit.quote)
           for r in A.anchor_fuzzy(items, A.prepare_pages(frame)).collect()}
    want = {}
    for i, d, quote in asked:
        top = 0.0
        for e, n, text, _ in pages:
            found = best_window(quote, text, 0.85, 0.98, None) if e == d and top < 0.98 and quote.strip() else None
            if found and found[2] > top:
                want[i], top = (n, *found, text[found[0]:found[1]]), found[2]
    assert got == want and len(want) > 20


def test_quotes_are_sought_on_long_pages(spark):
    rng = random.Random(8)
    quote = "Payment is due within thirty days of the invoice date and carries interest thereafter."
    page = f"{words(rng, 400)} {quote.replace('thirty', 'thlrty')} {words(rng, 400)}"
    frame = spark.createDataFrame([(1, 1, page, "pdf_text")], "document_id long, page_number int, normalized_text string, text_source string")
    asked = quote_frame(spark, {1: quote})

    def windows():
        for size in range(int(len(quote) * 0.8), int(len(quote) * 1.2) + 1, max(1, (int(len(quote) * 1.2) - int(len(quote) * 0.8)) // 10)):
            for start in range(0, len(page) - size + 1, max(1, size // 4)):
                yield SequenceMatcher(None, quote, page[start:start + size]).ratio(), start, start + size

    top = max(windows(), key=lambda w: w[0])
    found = A.anchor(asked, frame, threshold=0.6).first()
    assert (found.verification_method, found.normalized_char_start, found.normalized_char_end) == ("fuzzy", *top[1:])
    assert found.fuzzy_similarity == pytest.approx(top[0])
    assert A.anchor(asked, frame, threshold=0.6, likeness=0.3).first().verification_method is None


def test_evidence_key_goes_to_the_first_item(spark):
    verified, evidence = A.verify_items(quote_frame(spark), page_frame(spark))
    state = {r.item_id: (r.status, r.deduped) for r in verified.collect()}
    assert state[1] == ("needs_review", False) and state[7] == ("needs_review", True)
    assert state[4] == ("rejected", False)
    assert rows(evidence, "item_id") == [(1,), (2,), (3,)]
    stored = evidence.filter("item_id = 1")
    again, new = A.verify_items(quote_frame(spark, {9: QUOTES[1]}), page_frame(spark), existing=stored)
    assert new.count() == 0 and again.first().deduped


def test_cascade_does_not_depend_on_partitions(spark):
    one = A.anchor(quote_frame(spark).coalesce(1), page_frame(spark).coalesce(1))
    many = A.anchor(quote_frame(spark).repartition(8), page_frame(spark).repartition(8))
    assert rows(one.na.fill(-1).na.fill("")) == rows(many.na.fill(-1).na.fill(""))


# --- dedup ---------------------------------------------------------------------------

def test_dedupe_candidates_equals_plain(spark):
    rng = random.Random(11)
    data = []
    for doc in range(12):
        base = [words(rng, 7) for _ in range(4)]
        for i in range(rng.randint(1, 25)):
            due = rng.choice([None, dt.date(2024, 1, 1), dt.date(2024, 2, 1)])
            data.append((doc, i, rng.choice(base) + rng.choice(["", " now", "."]), due, rng.choice([None, 7, 8]),
                         rng.choice(["shall", "may"]), rng.choice(["none", "absolute"]), rng.choice([None, "r"])))
    df = spark.createDataFrame(data, "document_id long, n long, obligation_text string, due_date date, responsible_entity_id long, "
                                     "modality string, due_kind string, due_rule string")
    got = rows(D.dedupe_candidates(df, text="obligation_text", order="n", richness=D.obligation_richness()), "document_id", "n")
    want = []
    for doc in range(12):
        mine = [r for r in data if r[0] == doc]
        cand = []
        for _, n, text, due, party, modality, kind, rule in mine:
            rich = (2 if kind != "none" else 0) + (2 if due else 0) + (1 if rule else 0) + (1 if party is not None else 0) + (modality == "shall")
            cand.append((n, text.strip().lower(), (due and str(due), party and str(party)), rich))
        want += [(doc, n) for n in plain_greedy(cand)]
    assert got == sorted(want)


def near_quotes(rng, n):
    """Quotes that are edited, cut and joined forms of a few, in an alphabet that lets chance pairs be alike."""
    base = [words(rng, rng.choice([3, 8, 14])) for _ in range(5)]
    out = []
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, len(text) // 4)):
            text[rng.randrange(len(text))] = rng.choice("xyz ")
        text = "".join(text)
        out.append(rng.choice([text, text, text + " " + words(rng, 3), text[: max(8, len(text) * 2 // 3)], text.upper()]))
    return out


@pytest.mark.parametrize("small", [0, 40, 256])
def test_dedupe_in_blocks_equals_plain_greedy(spark, monkeypatch, small):
    monkeypatch.setattr(D, "BLOCK_QUOTES", 4)
    monkeypatch.setattr(D, "SMALL", small)
    rng = random.Random(31)
    data = [(d, i, q, rng.choice(["quality", "unknown_risk"]), rng.choice(["low", "high"]))
            for d, n in ((1, 70), (2, 30), (3, 1)) for i, q in enumerate(near_quotes(rng, n))]
    df = spark.createDataFrame(data, "document_id long, n long, quote string, risk_type string, severity string")
    got = rows(D.dedupe_candidates(df, text="quote", order="n", richness=D.risk_richness(), due_date=None, party=None), "document_id", "n")
    want = []
    for doc in (1, 2, 3):
        cand = [(n, " ".join(q.lower().split()), (None, None), (kind == "quality") + (grave == "high"))
                for d, n, q, kind, grave in data if d == doc and q.strip()]
        want += [(doc, n) for n in plain_greedy(cand)]
    assert got == sorted(want) and 20 < len(got) < len(data)


@pytest.mark.parametrize("small", [0, 256])
def test_novel_items_in_blocks_equal_a_scan(spark, monkeypatch, small):
    monkeypatch.setattr(D, "BLOCK_QUOTES", 4)
    monkeypatch.setattr(D, "SMALL", small)
    rng = random.Random(32)
    late = [(d, i, q) for d in (1, 2) for i, q in enumerate(near_quotes(rng, 50))]
    old = [(1, q) for q in near_quotes(rng, 6)] + [(1, late[3][2]), (3, "of another document")]
    want, like = [], D.Resemblance(D.CRITIC_SEQUENCE_FLOOR, None)
    for doc in (1, 2):
        taken = [" ".join(q.lower().split()) for d, q in old if d == doc]
        for d, n, q in late:
            text = " ".join(q.lower().split())
            if d == doc and text and not any(like.same(text, t) for t in taken):
                taken.append(text)
                want.append((doc, n))
    frames = (spark.createDataFrame(late, "document_id long, n long, quote string"), spark.createDataFrame(old, "document_id long, quote string"))
    assert rows(D.novel_items(*frames, text="quote", order="n"), "document_id", "n") == sorted(want) and len(want) > 10


def test_novel_items_are_compared_once_however_often_they_are_read(spark):
    late = spark.createDataFrame([(1, 1, "one quote"), (1, 2, "another text")], "document_id long, n long, quote string")
    new = D.novel_items(late, late.limit(0), text="quote", order="n")
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "resolve" not in plan
    assert rows(new, "n") == [(1,), (2,)]


def test_novel_items(spark):
    late = spark.createDataFrame([(1, 1, "The tenant pays rent monthly to the owner."), (1, 2, "the tenant pays rent monthly to the owner"),
                                  (1, 3, "Insurance must be kept in force."), (1, 4, "Insurance must be kept in force!"), (1, 5, " "),
                                  (2, 1, "The tenant pays rent monthly to the owner.")], "document_id long, n long, quote string")
    old = spark.createDataFrame([(1, "Tenant pays rent monthly to the owner.")], "document_id long, quote string")
    assert rows(D.novel_items(late, old, text="quote", order="n"), "document_id", "n") == [(1, 3), (2, 1)]


# --- entities ---------------------------------------------------------------------------

def test_suggest_entities_equals_brute_force(spark):
    rng = random.Random(4)
    names = ["Acme Builders LLC", "Northern Steel Inc", "City of Springfield", "Jon", "A", "Oak & Sons", "acme builders llc"]
    entities = [(i, i, n, [n + " Co"] if i % 2 else []) for i, n in enumerate(names)]
    needles = set()
    for n in names:
        for _ in range(12):
            text = list(n)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice("xyz ")
            needles.add("".join(text))
    needles |= {"Jo", "Jonn", "John", "B", "Acme"}

    def brute(name):
        best, found = 0.0, None
        for i, _, canonical, aliases in entities:
            for other in [canonical, *aliases]:
                ratio = SequenceMatcher(None, name.lower(), other.lower()).ratio()
                if ratio > best:
                    best, found = ratio, i
        return found if best >= 0.85 else None

    want = {n.lower(): brute(n) for n in needles if n.strip() and brute(n) is not None}
    known = spark.createDataFrame(entities, "entity_id long, entity_no long, canonical_name string, aliases array<string>")
    got = E.suggest_entities(spark.createDataFrame([(n,) for n in needles], "mentioned_name string"), known)
    assert {r.needle: r.entity_id for r in got.collect()} == want


# --- scoring -------------------------------------------------------------------------------

OB = ("obligation_id long, document_id long, obligation_type string, obligation_text string, modality string, responsible_entity_id long, "
      "due_kind string, due_date date, due_rule string, status string, system_confidence int, contradiction_flag boolean")
EV = "obligation_id long, source string, verification_method string, fuzzy_similarity double"


def score(spark, evidence, **changes):
    base = dict(obligation_id=1, document_id=1, obligation_type="payment", obligation_text="Tenant shall pay $500 within 10 days.",
                modality="shall", responsible_entity_id=3, due_kind="relative", due_date=None, due_rule="within 10 days",
                status="needs_review", system_confidence=0, contradiction_flag=False)
    base.update(changes)
    ob = spark.createDataFrame([tuple(base.values())], OB)
    docs = spark.createDataFrame([(1, "invoice")], "document_id long, doc_type string")
    out = S.score_obligations(ob, docs, spark.createDataFrame(evidence, EV)).first()
    parts = S.obligation_breakdown(ob, docs, spark.createDataFrame(evidence, EV)).agg(F.sum("delta")).first()[0]
    return out.system_confidence, out.status, parts


EXACT = [(1, "pdf_text", "exact", None)]


def test_scores(spark):
    assert score(spark, EXACT)[:2] == (100, "needs_review")
    assert score(spark, [(9, "pdf_text", "exact", None)])[:2] == (0, "rejected")
    assert score(spark, EXACT, status="rejected", system_confidence=44)[:2] == (44, "rejected")
    weak = score(spark, [(1, "ocr", "exact", None)], modality="may", responsible_entity_id=None, due_rule=" ", due_kind="none", contradiction_flag=True)
    assert weak[0] == max(0, weak[2]) and weak[2] == 55 + 10 + 5 - 25 - 15 - 30 - 10
    assert score(spark, EXACT, obligation_text="Tenant pays rent")[2] == 55 + 15 + 10 + 10 + 10 - 10
    sentence = score(spark, [(1, "pdf_text", "sentence", None)])[2]
    assert sentence == score(spark, EXACT)[2] - 10
    marks = [score(spark, [(1, "pdf_text", "fuzzy", s)])[2] - score(spark, EXACT)[2] for s in (1.0, 0.95, 0.9, 0.85, 0.5, 0.0)]
    assert marks == [int(-10 - 15 * (1.0 - min(max(s or 1.0, 0.85), 1.0)) / 0.15) for s in (1.0, 0.95, 0.9, 0.85, 0.5, 0.0)]
    assert marks[:4] == sorted(marks[:4], reverse=True)


def test_risk_with_ocr_and_contradiction(spark):
    risk = spark.createDataFrame([(1, 1, "Potential conflict", "needs_review", 0, True, False)],
                                 "risk_id long, document_id long, risk_text string, status string, system_confidence int, contradiction_flag boolean, has_external_reference boolean")
    ev = spark.createDataFrame([(1, "ocr", "exact", None)], EV).withColumnRenamed("obligation_id", "risk_id")
    out = S.score_risks(risk, ev).first()
    assert (out.system_confidence, out.status) == (15, "rejected")


def test_critic_and_rescore(spark):
    items = spark.createDataFrame([(i, "needs_review", None, None) for i in range(1, 6)], "id long, status string, llm_severity string, llm_quality_confidence int")
    said = spark.createDataFrame([(1, 1, "false", 69.0), (2, 1, "false", 70.0), (3, 1, '"no"', 99.0), (4, 1, "false", 180.0), (4, 2, "true", None), (9, 1, "false", 99.0)],
                                 "id long, answer_no int, valid string, confidence double").withColumn("reasoning", F.lit(" "))
    got = {r.id: (r.status, r.critic_valid, r.critic_confidence) for r in S.apply_critic(items, said, "id").collect()}
    assert got == {1: ("needs_review", False, 69), 2: ("rejected", False, 70), 3: ("needs_review", None, None),
                   4: ("rejected", True, None), 5: ("needs_review", None, None)}
    said = spark.createDataFrame([(1, 1, "HIGH", 29.9), (2, 1, "x", 30.0), (3, 1, "low", None), (4, 1, None, -5.0)],
                                 "id long, answer_no int, revised_severity string, quality_confidence double")
    got = {r.id: (r.status, r.llm_severity, r.llm_quality_confidence) for r in S.apply_rescore(items, said, "id").collect()}
    assert got == {1: ("rejected", "high", 29), 2: ("needs_review", None, 30), 3: ("needs_review", "low", None),
                   4: ("rejected", None, 0), 5: ("needs_review", None, None)}


# --- contradictions -------------------------------------------------------------------------

def test_contradictions(spark):
    data = []
    rng = random.Random(9)
    for i in range(1, 160):
        kind = rng.choice(["payment", "submission"])
        data.append((i, rng.randint(1, 12), kind, f"pay ${rng.choice(['5', '7', '5'])}" if rng.random() < .6 else "pay", rng.choice([None, 1, 2]),
                     rng.choice([None, dt.date(2024, 1, 1), dt.date(2024, 2, 1)]), rng.choice(["low", "high"]), rng.choice(["rejected", "needs_review"]), T0))
    df = spark.createDataFrame(data, "obligation_id long, document_id long, obligation_type string, obligation_text string, responsible_entity_id long, "
                                     "due_date date, severity string, status string, created_at timestamp").withColumn("contradiction_flag", F.lit(False))
    want = set()
    live = [r for r in data if r[7] != "rejected"]
    for i, a in enumerate(live):
        for b in live[i + 1:]:
            if a[1] != b[1] or a[2] != b[2]:
                continue
            amounts = [{r[3].split("$")[1]} if "$" in r[3] else set() for r in (a, b)]
            if (a[5] and b[5] and a[5] != b[5]) or (a[4] is not None and a[4] == b[4] and a[6] != b[6]) or (
                    a[2] == "payment" and amounts[0] and amounts[1] and amounts[0] != amounts[1]):
                want.add(tuple(sorted((a[0], b[0]), key=str)))
    pairs = K.contradiction_pairs(df)
    assert set(rows(pairs, "a_id", "b_id")) == want and want
    flagged = {r[0] for r in rows(K.flag_contradictions(df).filter("contradiction_flag"), "obligation_id")}
    assert flagged == {x for pair in want for x in pair}


def test_later_pair_gets_no_evidence(spark):
    pairs = spark.createDataFrame([(1, 10, 11, 10, 11), (1, 10, 12, 10, 12), (1, 11, 12, 11, 12)],
                                  "document_id long, a_id long, b_id long, first_id long, second_id long")
    pairs = pairs.withColumns({"first_at": F.lit(T0), "second_at": F.lit(T0)})
    ev = spark.createDataFrame([(o, o, 1, "q", f"h{o}", 1, 0, 1) for o in (10, 11, 12)],
                               "evidence_id long, obligation_id long, document_id long, quote string, quote_sha256 string, page_number int, "
                               "normalized_char_start int, normalized_char_end int")
    ev = ev.withColumns({"raw_char_start": F.lit(0), "raw_char_end": F.lit(1), "source": F.lit("pdf_text")})
    risks, links, proof = K.contradiction_outputs(pairs, ev)
    assert risks.count() == links.count() == 3
    owners = {r.quote_sha256: r.risk_id for r in proof.collect()}
    by_pair = {(r.a_id, r.b_id): r.risk_id for r in links.collect()}
    assert owners == {"h10": by_pair[10, 11], "h11": by_pair[10, 11], "h12": by_pair[10, 12]}
    assert by_pair[11, 12] not in owners.values()


# --- evaluation ------------------------------------------------------------------------------

@pytest.mark.parametrize("small", [0, 20, 256])
def test_match_items_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(V, "SMALL", small)
    from covenantry.functions.similarity import rouge_l_score
    rng = random.Random(21)
    truth, found = [], []
    for doc in range(8):
        base = [words(rng, 6) for _ in range(5)]
        truth += [(doc, i, rng.choice(base)) for i in range(rng.randint(0, 9))]
        found += [(doc, i, rng.choice(base) + rng.choice(["", " extra word"])) for i in range(rng.randint(0, 9))]
    want = []
    for doc in range(8):
        used = set()
        for _, gi, gq in [t for t in truth if t[0] == doc]:
            best, chosen = 0.5 - 1e-9, None
            for _, pi, pq in [f for f in found if f[0] == doc]:
                s = rouge_l_score(gq.split(), pq.split())
                if pi not in used and s > best:
                    best, chosen = s, pi
            if chosen is not None:
                used.add(chosen)
                want.append((doc, gi, chosen))
    kind = "document_id long, item_no long, quote string"
    got = V.match_items(spark.createDataFrame(truth, kind), spark.createDataFrame(found, kind))
    assert rows(got, "document_id", "gt_no", "pl_no") == sorted(want)


def test_digest_moves_texts_alone(spark):
    from covenantry.operators.context import context_digest
    pages = spark.createDataFrame([(1, 1, "- The first block says much here\n- the second one, it holds the quote\n- and (the third) is near to it too\n"
                                          "- the second one -- it holds the QUOTE")], "document_id long, page_number int, raw_text string")
    proof = spark.createDataFrame([(1, 1, 1, "holds\u3000 the quote"), (2, 1, 1, "is  nowhere"), (3, 1, 1, "third) is"), (4, 1, 1, "")],
                                  "evidence_id long, document_id long, page_number int, quote string")
    digest = context_digest(proof, pages)
    assert {r.evidence_id: r.bullets for r in digest.collect()} == {
        1: ["The first block says much here", "and (the third) is near to it too"], 2: [],
        3: ["the second one, it holds the quote", "the second one -- it holds the QUOTE"],
        4: ["the second one, it holds the quote"]}
    plan = digest._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window [" in line)
    assert "lower(" not in plan[plan.index(window):] and "array_distinct" not in plan[plan.index(window):]


def test_tokens_of_quotes_are_taken_once_a_side(spark):
    kind = "document_id long, item_no long, quote string"
    pairs = V.quote_pairs(spark.createDataFrame([(1, 1, "a b")], kind), spark.createDataFrame([(1, 1, "a c")], kind), 0.5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and plan.count("array_intersect") == 1


def test_severity_agreement(spark):
    pairs = spark.createDataFrame([(1, 1, "low", "low"), (1, 2, "high", "medium"), (1, 3, "critical", "low"), (1, 4, "odd", "low"), (2, 1, "low", "low")],
                                  "document_id long, pair_no long, gt_severity string, pl_severity string")
    got = {r.document_id: (r.pairs, r.exact_match_rate, r.adjacent_agreement_rate, r.spearman_rho) for r in V.severity_agreement(pairs, "document_id").collect()}
    # ranks: truth 1,2,3 - found 1,3,2 (ties by order)
    assert got[1] == (4, 0.25, 0.5, round(1 - 6 * 2 / 24, 3)) and got[2] == (1, 1.0, 1.0, None)


def test_metrics_without_denominator(spark):
    df = spark.createDataFrame([(0, 0, 3), (2, 1, 0)], "tp long, fp long, fn long")
    assert [(r.precision, r.recall, r.f1) for r in V.prf(df).collect()] == [(None, 0.0, None), (0.667, 1.0, 0.8)]


# --- pages -------------------------------------------------------------------------------------

def test_locate_spans(spark):
    pages = spark.createDataFrame([(1, 1, "aa bb aa cc aa")], "document_id long, page_number int, raw_text string")
    spans = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate([" aa", "aa ", "bb", "zz", "cc", "aa"])],
                                  "document_id long, page_number int, span_no int, span_text string")
    assert rows(P.locate_spans(spans, pages), "span_no", "char_start", "char_end") == [(0, 0, 2), (1, 6, 8), (2, 3, 5), (4, 9, 11), (5, 12, 14)]


def test_section_filter_bypass(spark):
    data = [(1, i, "non_agreement") for i in range(9)] + [(1, 9, None), (2, 0, "non_agreement"), (3, 0, "agreement_body"), (3, 1, "non_agreement")]
    df = spark.createDataFrame(data, "document_id long, n int, section_label string")
    got = P.section_filter(df).groupBy("document_id", "chunk_source").count()
    assert rows(got) == [(1, "all_chunks_fallback", 10), (2, "all_chunks_fallback", 1), (3, "filtered", 1)]
    assert P.section_filter(df, force_all=True).count() == len(data)


def test_gate_types(spark):
    docs = spark.createDataFrame([(i, "contract") for i in range(1, 5)], "document_id long, doc_type string")
    pages = spark.createDataFrame([(i, 1, "The tenant pays rent", "x") for i in range(1, 5)], "document_id long, page_number int, raw_text string, normalized_text string")
    pages = pages.withColumn("normalized_text", F.lit(""))
    said = spark.createDataFrame([(1, "Lease ", 0.9), (2, "rfi", 0.8), (3, "poem", 0.4)], "document_id long, proposed_type string, confidence double")
    got = rows(P.gate_types(docs, pages, said), "document_id", "doc_type", "doc_type_confidence", "domain")
    assert got == [(1, "lease", 0.9, "real_estate"), (2, "unknown", None, "general"), (3, "unknown", 0.4, "general"), (4, "contract", None, None)]


# --- mutations and lists --------------------------------------------------------------------------

def test_apply_reviews_in_order(spark):
    items = spark.createDataFrame([(1, "old", "low", "needs_review", None), (2, "old", "low", "confirmed", 5)],
                                  "obligation_id long, obligation_text string, severity string, status string, reviewer_confidence int")
    reviews = spark.createDataFrame([
        (1, 1, "edit_approve", 50, {"severity": "high", "status": "hacked"}, T0),
        (2, 1, "reject", None, {"severity": "critical"}, T0 + dt.timedelta(1)),
        (3, 1, "edit_approve", None, {"obligation_text": None}, T0 + dt.timedelta(2)),
    ], "review_id long, obligation_id long, decision string, reviewer_confidence int, field_edits map<string,string>, decided_at timestamp")
    got = rows(M.apply_reviews(items, reviews, "obligation_id"), "obligation_id", "obligation_text", "severity", "status", "reviewer_confidence")
    assert got == [(1, None, "high", "confirmed", 50), (2, "old", "low", "confirmed", 5)]


def test_merge_chains_and_cycles(spark):
    kind = "source_id long, target_id long"
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], kind)
    assert rows(M.resolve_merges(chain)) == sorted((i, 0) for i in range(1, 40))
    for bad in ([(1, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 1)]):
        with pytest.raises(ValueError):
            M.resolve_merges(spark.createDataFrame(bad, kind))


def test_merge_entities_aliases(spark):
    ents = spark.createDataFrame([(1, "B", ["x"]), (2, "A", ["y"]), (3, "C", None)], "entity_id long, canonical_name string, aliases array<string>")
    mentions = spark.createDataFrame([(1, 2, None), (2, None, 2), (3, 3, None)], "mention_id long, entity_id long, suggested_entity_id long")
    merged, moved = M.merge_entities(ents, mentions, spark.createDataFrame([(2, 1)], "source_id long, target_id long"))
    assert rows(merged.select("entity_id", F.array_join("aliases", ","))) == [(1, "A,B,x,y"), (3, None)]
    assert [r[1:] for r in rows(moved.na.fill(0))] == [(1, 0), (0, 1), (3, 0)]


def test_page_of(spark):
    df = spark.range(7).withColumn("created_at", F.lit(T0))
    items, info = L.page_of(df, F.col("id"), limit=3, cursor=3)
    assert [r.id for r in items.collect()] == [3, 4, 5] and info.first()[0] == "6"
    assert L.page_of(df, F.col("id"), limit=3, cursor=4)[1].first()[0] is None
    with pytest.raises(ValueError):
        L.page_of(df, F.col("id"), limit=201)


def test_scope_is_required(spark):
    with pytest.raises(ValueError):
        L.in_scope(spark.range(1), spark.range(1), spark.range(1), user_id=1, role="viewer")


def test_keep_latest_run_keeps_items_without_run(spark):
    runs = spark.createDataFrame([(1, 1, "s", T0), (2, 1, "s", T0 + dt.timedelta(1)), (3, 2, "other", T0)], "run_id long, document_id long, stage string, started_at timestamp")
    items = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, None), (4, 2, 9)], "id long, document_id long, extraction_run_id long")
    assert rows(R.keep_latest_run(items, runs, "s"), "id") == [(2,), (3,), (4,)]


def test_digest_buckets(spark):
    day = F.lit("2024-03-01").cast("date")
    data = [(0, "critical"), (7, "high"), (7, "low"), (8, "critical"), (14, "low"), (15, "critical"), (30, "low"), (31, "low"), (-1, "critical")]
    obligations = spark.createDataFrame([(i, 1, "t", dt.date(2024, 3, 1) + dt.timedelta(d), s, "confirmed") for i, (d, s) in enumerate(data)],
                                        "obligation_id long, document_id long, obligation_text string, due_date date, severity string, status string")
    users = spark.createDataFrame([(1, "a@b", True, True), (2, "c@d", True, False)], "user_id long, email string, is_active boolean, digest_enabled boolean")
    links = spark.createDataFrame([(1, 1), (2, 1)], "user_id long, asset_id long")
    docs = spark.createDataFrame([(1, 1)], "document_id long, asset_id long")
    assets = spark.createDataFrame([(1, "Tower")], "asset_id long, name string")
    digest = N.weekly_digest(N.digest_items(users, links, assets, docs, obligations, day)).collect()
    assert len(digest) == 1 and digest[0].subject == "2 critical obligations due this week"
    assert [[e.obligation_id for e in digest[0][b]] for b in N.BUCKETS] == [[0, 1], [2, 3, 4], [5, 6]]


def test_integrity_finds_each_violation(spark):
    pages = spark.createDataFrame([(1, 1, "hello world")], "document_id long, page_number int, normalized_text string")
    ev = spark.createDataFrame([(1, 1, 1, 0, 5, "hello"), (2, 1, 1, 6, 11, "earth")],
                               "evidence_id long, document_id long, page_number int, normalized_char_start int, normalized_char_end int, quote string")
    assert rows(I.misplaced_quotes(ev, pages)) == [("quote_offsets", "2")]
    pairs = spark.createDataFrame([(1, 2), (3, 3), (9, 10)], "a_id long, b_id long")
    assert rows(I.unordered_pairs(pairs)) == [("pair_order", "3"), ("pair_order", "9")]


def test_normalising_failed_pages_leaves_them(spark):
    texts = spark.createDataFrame([(1, 1, " a  b ", None), (1, 2, None, "broken")], "document_id long, page_number int, raw_text string, error string")
    got = rows(P.normalize_pages(P.page_rows(texts)), "page_number", "normalized_text", "processing_status", "processing_error")
    assert got == [(1, "a b", "processed", None), (2, "", "failed", "pdf_page_parse_failed: broken")]
    assert normalize_text is not None


def test_answers_are_recovered(spark):
    from covenantry.sources import answers as A
    good = {
        '[{"a": 1}, 3]': [{"a": 1}], '```json\n[{"a": 1}]\n```': [{"a": 1}], 'Sure: {"items": [{"a": "}"}]} done': [{"a": "}"}],
        '{"note": 1, "risks": [{"b": 2}], "entities": []}': [{"b": 2}], '{"results": 4, "items": [{"c": 3}]}': [{"c": 3}],
        'Output:\n```json\n[{"q": "[x]"}, "stray"]\n```\nThanks.': [{"q": "[x]"}], ' [] ': []}
    bad = {"no list": A.UNREADABLE, '{"a": 1}': A.NO_LIST, "3": A.NO_ARRAY, '"text"': A.NO_ARRAY, None: A.EMPTY, " ": A.EMPTY,
           "{bad json": A.UNREADABLE, 'x {"foo": [{"a": 1}]} y': A.NO_LIST}
    texts = [*good, *bad]
    df = A.load_answers(spark.createDataFrame(list(enumerate(texts)), "no long, raw string"))
    for r in df.collect():
        text = texts[r.no]
        if text in good:
            assert r.error is None and json.loads(r.rows_json) == good[text], text
        else:
            assert r.rows_json is None and r.error == bad[text], text


def test_answers_take_the_first_value_that_decodes(spark):
    from covenantry.sources import answers as A
    good = {
        '[see note] [{"a":1}]': [{"a": 1}], '[{"a":1,"a":2},{"b":1}]': [{"a": 2}, {"b": 1}],
        'As asked [1: {x}]: [{"a":"[","a":"}"}] and {"b": [2]}': [{"a": "}"}], '[2] before [{"a":1}]': [],
        '{oops {"items": [{"a": 1}]} [{"b": 2}]': [{"a": 1}]}
    texts = [*good, '[{"a":1}, {"b"']
    got = {r.no: r for r in A.load_answers(spark.createDataFrame(list(enumerate(texts)), "no long, raw string")).collect()}
    for i, text in enumerate(good):
        assert got[i].error is None and json.loads(got[i].rows_json) == good[text], text
    assert got[len(good)].error == A.NO_LIST  # as a decoder finds it: the list does not close, its first entry does


def test_answers_are_parsed_once_for_their_candidates(spark):
    from covenantry.sources.answers import load_answers, obligation_candidates
    raw = '[{"quote": "a"}, null, [{"quote": "b"}], "c", {"quote": "d", "e": [1.50, {"f": null}]}]'
    df = spark.createDataFrame([(1, raw), (2, "{}"), (3, None)], "document_id long, raw string").repartition(2)
    loaded = load_answers(df)
    assert [json.loads(r.rows_json) for r in loaded.filter("error is null").collect()] == [
        [{"quote": "a"}, {"quote": "d", "e": [1.50, {"f": None}]}]]
    found = obligation_candidates(loaded, "document_id")
    assert rows(found, "document_id", "entry_no", "obligation_text") == [(1, 0, "a"), (1, 1, "d")]
    # the one filter asks for a text; one for a list would stand below and parse each answer again
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("Generate"):]


def test_candidates_take_strings_only_as_due_fields(spark):
    from covenantry.sources.answers import load_answers, obligation_candidates
    raw = ('[{"quote": "a", "due_date": 20240101, "due_rule": 7}, {"quote": "b", "due_date": "2024-01-02", "due_rule": null},'
           ' {"quote": " ", "due_date": "2024-01-02"}, {"quote": "c", "modality": "WILL", "due_rule": " soon "}]')
    df = load_answers(spark.createDataFrame([(1, raw), (2, "[{'quote': 'x'}]")], "document_id long, raw string"))
    assert rows(df.filter("error is not null"), "document_id") == [(2,)]
    got = rows(obligation_candidates(df, "document_id"), "obligation_text", "due_kind", "due_date", "due_rule", "modality")
    assert got == [("a", "none", None, None, "unknown"), ("b", "absolute", dt.date(2024, 1, 2), None, "unknown"),
                   ("c", "relative", None, "soon", "unknown")]


def test_export_row_cap(spark):
    from covenantry.sources.exports import ExportTooLarge, check_row_cap
    assert check_row_cap(spark.range(9), 9).count() == 9
    with pytest.raises(ExportTooLarge):
        check_row_cap(spark.range(10), 9)


def test_repeated_changes_count_once(spark):
    from covenantry.operators import evaluation as E, mutations as M, pages as P
    from covenantry.sources import files as S
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)
    mentions = frame([(1, None, False, None)], "mention_id long, entity_id long, resolved boolean, resolved_by string")
    decisions = frame([(1, 5, "a", 1), (1, 6, "b", 2), (1, 9, "c", 3)], "mention_id long, entity_id long, resolved_by string, change_no int")
    entities = frame([(5,), (6,)], "entity_id long")
    assert rows(M.resolve_mentions(mentions, decisions, entities), "entity_id", "resolved_by") == [(6, "b")]
    users = frame([(1, "viewer", True, "UTC")], "user_id long, role string, digest_enabled boolean, digest_timezone string")
    changes = frame([(1, "admin", None, None, 1), (1, None, False, "Europe/Paris", 2), (1, "editor", None, "No/Where", 3)],
                    "user_id long, role string, digest_enabled boolean, digest_timezone string, change_no int")
    # an unknown time zone is refused, the role beside it is not
    assert rows(M.update_users(users, changes), "role", "digest_enabled", "digest_timezone") == [("editor", False, "Europe/Paris")]
    assert rows(M.refused_timezones(changes), "change_no") == [(3,)]
    assert [tuple(r) for r in M.role_audit(users, changes).select("record_id", "new_values").orderBy("new_values").collect()] == [
        (1, '{"role":"admin"}'), (1, '{"role":"editor"}')]
    asks = frame([(1, 1, 1)], "request_id long, ifc_model_id long, spec_document_id long")
    twice = frame([(1,), (1,)], "ifc_model_id long")
    assert S.check_requests(asks, twice, twice.withColumnRenamed("ifc_model_id", "document_id")).count() == 1
    items = frame([(1, "x", 5), (1, "y", 9)], "document_id long, quote string, page_hint int")
    specs = frame([(1, "5"), (1, "9-10"), (1, "5")], "document_id long, pages string")
    assert rows(E.curate(items, specs, has_page_hint=True), "page_hint", "removed_reason") == [(5, "page_range"), (9, "page_range")]
    texts = frame([(1, 1, None, "broken")], "document_id long, page_number int, raw_text string, error string")
    scans = frame([(1, "application/pdf", "parsed")], "document_id long, mime_type string, parse_status string")
    read = frame([(1, 1, "old", None, 1), (1, 1, "new", None, 2)], "document_id long, page_number int, ocr_text string, ocr_error string, answer_no int")
    assert rows(P.apply_ocr(P.page_rows(texts), scans, read), "raw_text") == [("new",)]


def test_caps_are_off_by_default(spark):
    from covenantry.sources.exports import check_row_cap
    from covenantry.sources.files import check_uploads
    assert check_row_cap(spark.range(60_000)).count() == 60_000
    big = spark.createDataFrame([("a.pdf", "application/pdf", 9, 9000)], "source_name string, mime_type string, size long, total_pages int")
    assert rows(check_uploads(big), "reason") == [(None,)] and rows(check_uploads(big, 500), "reason") != [(None,)]


def test_names_in_blocks_parted_by_single_letters_are_found(spark):
    from covenantry.operators.entities import suggest_entities
    rng = random.Random(3)
    letters, needles, known = "abcdefghijklmnopqrstuvwxyz", {"abxcdyefghi"}, {"abcdefzghi"}
    for m in range(2, 41):
        for _ in range(4):
            name = "".join(rng.sample(letters, min(m, 26))) + "".join(rng.choice(letters) for _ in range(max(0, m - 26)))
            known.add(name)
            for step in (3, 4, 5, 6, 8):
                other = list(name)
                for i in range(step - 1, m, step):
                    other[i] = rng.choice(["#", "", other[i] + "#"])
                needles.add("".join(other))
    listed = sorted(known)
    entities = spark.createDataFrame([(i, i, k, []) for i, k in enumerate(listed)],
                                     "entity_id long, entity_no long, canonical_name string, aliases array<string>")
    got = {r.needle: r.ratio for r in suggest_entities(spark.createDataFrame([(n,) for n in needles if n], "mentioned_name string"), entities).collect()}
    for needle in needles - {""}:
        best = max((SequenceMatcher(None, needle, k).ratio() for k in listed
                    if 2 * min(len(needle), len(k)) >= 0.85 * (len(needle) + len(k))), default=0)
        assert (needle in got) == (best >= 0.85), needle
        assert best < 0.85 or abs(got[needle] - best) < 1e-9


def test_late_first_uploads_survive(spark, tmp_path):
    from covenantry.streaming.uploads import distinct_uploads
    schema = "sha256 string, asset_id string, uploaded_at timestamp"
    start = dt.datetime(2024, 1, 1, 12)
    folder, batches = str(tmp_path / "in"), [[("a", "x", 0), ("b", "x", 0), ("a", "x", 1)], [("c", "x", -4), ("a", "x", -9), ("a", "y", -9)]]
    for batch in batches:
        spark.createDataFrame([(s, a, start + dt.timedelta(hours=h)) for s, a, h in batch], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        distinct_uploads(stream, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out/upload_keys")), "sha256", "asset_id") == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")]


def test_call_numbers_do_not_overflow(spark):
    from covenantry.plans.flow import _numbered
    assert rows(_numbered(spark.createDataFrame([(4000, 7)], "call_no int, entry_no int")), "candidate_no") == [(4_000_000_007,)]


def test_missed_spurious_and_removed(spark):
    from covenantry.operators import dedup as D, evaluation as V
    def items(*found):
        return spark.createDataFrame([(1, n, q) for n, q in found], "document_id long, item_no long, quote string")
    truth, found = items((1, "the tenant shall pay rent"), (2, "nothing alike here")), items((7, "the tenant shall pay rent"), (8, "other words"))
    rest = V.unmatched_items(truth, found, V.match_items(truth, found))
    assert rows(rest, "item_no", "outcome") == [(2, "missed"), (8, "spurious")]
    kept = items((1, "a"))
    assert rows(D.removed_counts(items((1, "a"), (2, "a"), (3, "b")), kept), "document_id", "candidates", "removed") == [(1, 3, 2)]


def test_large_documents_are_told_apart_without_moving_texts(spark, monkeypatch):
    from covenantry.operators import containment

    monkeypatch.setattr(containment, "DIRECT_PAIRS", 4)
    pages = A.prepare_pages(spark.createDataFrame(
        [(d, n, f"page {n} of document {d} tells of lot {n} and no more", "ocr") for d in (1, 2) for n in range(1, 3 if d == 1 else 6)],
        "document_id long, page_number int, normalized_text string, text_source string"))
    items = spark.createDataFrame(
        [(d * 10 + n, d, f"document {d} tells of lot {n} and") for d in (1, 2) for n in range(1, 3 if d == 1 else 6)],
        "item_id long, document_id long, quote string")
    found = A.anchor_exact(items, pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan  # a broadcast of the few, no shuffle of the texts
    assert {(r.item_id, r.hit.page_number) for r in found.collect()} == {(d * 10 + n, n) for d in (1, 2) for n in range(1, 3 if d == 1 else 6)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _hits(spark):
    made = "id as evidence_id, cast(id % 3 as string) as quote_sha256, id % 2 as document_id, 1 as page_number, 0 as normalized_char_start, 5 as normalized_char_end"
    return spark.range(12).selectExpr(*made.split(", "), "timestamp '2024-01-01' as created_at")


def test_owners_are_found_without_joining_back(spark):
    kept = A.first_owner(_hits(spark).withColumn("page_number", F.nullif(F.col("evidence_id"), F.lit(3)) * 0), "created_at", "evidence_id")
    assert "Join" not in _plan(kept)
    assert rows(kept, "evidence_id") == [(i,) for i in (0, 1, 2, 4, 5, 9)]


def test_contradictions_are_flagged_without_a_join(spark):
    df = spark.createDataFrame(
        [(1, 1, "payment", "pay $5", None, None, "low", "ok"), (2, 1, "payment", "pay $6", None, None, "low", "ok"),
         (3, 1, "payment", "pay $7", None, None, "low", "rejected"), (4, None, "payment", "pay $8", None, None, "low", "ok"),
         (5, None, "payment", "pay $9", None, None, "low", "ok"), (6, 2, "audit", "x", None, None, "low", "ok"), (7, 2, "audit", "x", None, None, "high", "ok"),
         (8, 3, "audit", "x", 4, None, "low", None), (9, 3, "audit", "x", 4, None, "high", "ok")],
        "obligation_id long, document_id long, obligation_type string, obligation_text string, responsible_entity_id long, due_date date, "
        "severity string, status string").withColumn("contradiction_flag", F.lit(None).cast("boolean"))
    flagged = K.flag_contradictions(df)
    assert "Join" not in _plan(flagged) and flagged.count() == 9
    assert rows(flagged.filter("contradiction_flag"), "obligation_id") == [(1,), (2,)]


def test_texts_of_scored_items_stay_where_they_are(spark):
    ob = spark.createDataFrame([(1, 1, "payment", "pay", "shall", None, "none", None, None, "ok", 0, False)], OB)
    docs, evidence = spark.createDataFrame([(1, "invoice")], "document_id long, doc_type string"), spark.createDataFrame(EXACT, EV)
    plan = _plan(S.score_obligations(ob.repartition(2, "document_id"), docs, evidence).select("document_id", "status"))
    met = next(line for line in plan.splitlines() if "Join" in line and "obligation_id" in line)
    below = plan[plan.index(met):].splitlines()[1]
    assert "Project" in below and "obligation_text" not in below.split("(((")[0]


def test_export_names_assets_before_items_meet_documents(spark):
    items = spark.sql("select 1 as obligation_id, 1 as document_id, 'text' as obligation_text")
    docs, assets = spark.sql("select 1 as document_id, 1 as asset_id, 'f' as source_name"), spark.sql("select 1 as asset_id, 'a' as name")
    proof = spark.sql("select 1 as obligation_id, 1 as evidence_id, now() as created_at, 'q' as quote, 1 as page_number, 0 as raw_char_start, 1 as raw_char_end")
    reviews, users = spark.sql("select 1 as obligation_id, 1 as review_id, now() as decided_at, 2 as reviewer_id"), spark.sql("select 2 as user_id, 'e' as email")
    df = L.resolve_export_rows(*(x.repartition(2) for x in (items, docs, assets, proof, reviews, users)), key="obligation_id")
    joins = [line for line in df._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in line]
    depth = {name: len(line) - len(line.lstrip(" :+-")) for line in joins for name in ("asset_id", "document_id") if name in line}
    assert depth["asset_id"] > depth["document_id"]
    assert rows(df, "asset_name", "evidence_quote", "reviewer_email") == [("a", "q", "e")]


def test_pages_are_sampled_before_they_are_normalised(spark):
    raw = ["\u00a0 \u2028", "a  \u2013 b", None, "", "c\ufb01", "d", "e"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(raw)], "document_id long, page_number int, raw_text string")
    sample = R.sample_pages(pages, 3)
    assert rows(sample, "page_number", "sample_text") == [(1, "a - b"), (4, "cfi"), (5, "d")]
    assert rows(R.sample_pages(pages.withColumn("normalized_text", normalize_text("raw_text")), 3), "page_number", "sample_text") == rows(
        sample, "page_number", "sample_text")
    # the filter that picks pages knows nothing of normalised text
    assert _plan(sample).count("ArrowEvalPython") == 1


def test_blank_pages_are_left_off_after_they_are_stored(spark):
    pages = spark.createDataFrame([(1, 1, " a\u0301  b ", "pdf_text"), (1, 2, " \u2028", "pdf_text")],
                                  "document_id long, page_number int, raw_text string, text_source string")
    ready = A.prepare_pages(pages.withColumn("normalized_text", normalize_text("raw_text")))
    assert rows(ready, "page_number", "page_text") == [(1, "\u00e1 b")]


def test_stored_tables_go_when_a_step_is_done(spark):
    from covenantry.session import FILE_CLEANUP, ensure_checkpoint_dir, passing_tables, written

    with passing_tables(spark):
        first = written(spark.range(5))
        last = written(first.filter("id > 2"), lasting=True)
    assert sorted(r.id for r in last.collect()) == [3, 4] and spark.conf.get(FILE_CLEANUP) == "true"
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {d for d in os.listdir(top) if d.startswith("written-")}
    items = spark.createDataFrame([(1, 1, "rent is due"), (2, 1, "rent is due"), (3, 1, "nothing of it")], "item_id long, document_id long, quote string")
    pages = spark.createDataFrame([(1, 1, "the rent is due on time", "ocr")], "document_id long, page_number int, normalized_text string, text_source string")
    hits = {r.item_id: r.verification_method for r in A.anchor(items, pages).collect()}
    assert hits == {1: "exact", 2: "exact", 3: None}
    assert len({d for d in os.listdir(top) if d.startswith("written-")} - before) == 3
