"""Chat templates, licences, personal data and the pipeline."""

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline
from covenantry.llm import chat, licenses, pii
from covenantry.llm.chat_template import If, Literal, Show, Template, TemplateError
from tests.llm import brute

PARTS = ["\\", "<|im_end|>", "<|im_start|>", "\n", "n", "a", "<", "[INST]", "<|im_end|>\n", "</s>", "|im_end|>", "é"]


def test_formatting_is_reversible():
    rng, template = random.Random(3), Template(chat.TEMPLATE, chat.FILTERS)
    for _ in range(3000):
        turns = [{"role": rng.choice(["user", "assistant", "a\nb", "\\n", "<|im_end|>\n", ""]),
                  "text": "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8)))} for _ in range(rng.randint(0, 4))]
        pieces = list(template.pieces(iter(turns)))
        if rng.random() < 0.5:
            pieces = [(c, inside) for text, inside in pieces for c in text]
        assert list(chat.read_back(pieces)) == [
            (m["role"], m["text"], m["text"] if m["role"] == "assistant" else "") for m in turns]


def test_template_language():
    folded = Template("{% if 'a' + 'b' == 'ab' %}x{{ 'y' | up }}{% else %}z{% endif %}w{% if false %}q{% endif %}", {"up": str.upper})
    assert folded.tree == (Show(Literal("xYw")),)
    text = Template("{% for m in messages %}{% if loop.first %}<{% elif not (m.a == 'x' and true) %}|{% else %}-{% endif %}{{ m.a }}{% endfor %}")
    assert text.render([{"a": "p"}, {"a": "q"}, {"a": "x"}]) == "<p|q-x"
    assert isinstance(Template("{% if x %}a{% endif %}").tree[0], If)
    for wrong in ("{% for %}", "{% if a %}", "{{ a( }}", "{{ 'a' | nothing }}", "{% endfor %}", "{% import os %}", "{{ }}"):
        with pytest.raises(TemplateError):
            Template(wrong)
    with pytest.raises(TemplateError):
        Template("{{ x.__class__ }}").render([], x="text")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "assistant", "<|im_end|>\n"), (None, 0, "user", "x"),
            (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 0, "assistant", "y" * 50000)]
    given = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, piece int, in_loss boolean")
    got = {r.conv_id: r for r in chat.read_digests(chat.format_pieces(chat.with_check_conversation(given))).collect()}
    marks = "</s>[INST] ok [/INST]"
    talks = collections.defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", marks), (-1, 1, "assistant", marks)]:
        talks[conv].append((turn, role or "", text or ""))
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
        assert r.formatted_chars == len(Template(chat.TEMPLATE, chat.FILTERS).render({"role": a, "text": b} for _, a, b in turns))
    none = given.limit(0)
    assert chat.read_digests(chat.format_pieces(none)).count() == 0


def test_automaton_knows_every_run():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(3)]
        runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        machine = licenses.SuffixAutomaton(texts)
        query = [rng.randrange(4) for _ in range(25)]
        for place, (state, length) in enumerate(machine.statistics(query)):
            want = max((n for n in range(place + 2) if n == 0 or tuple(query[place + 1 - n:place + 1]) in runs))
            assert length == want
            run = query[place + 1 - length:place + 1]
            ends = {(k, e) for k, t in enumerate(texts) for e in range(len(t)) if length and t[e + 1 - length:e + 1] == run and e + 1 >= length}
            assert set(machine.ends[state]) == ends or not length


def test_licences(spark):
    mit = licenses.TEMPLATES[1][1]
    half = " ".join(mit.split()[:40])
    texts = brute.AWKWARD + ["the MIT License and the apache\nLICENSE, general public license", mit, "word " * 50 + mit.replace("copies", "COPIES"),
                             half, "mit. License mit license", "licensed under cc by-nc 4.0", "mit", "license"]
    docs, rows = brute.awkward(spark, texts)
    got = licenses.scan(docs).collect()
    want = []
    for i, t in rows:
        found, hits = brute.words(t), []
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            hits += [(k, label) for k in range(len(found) - len(p) + 1) if found[k:k + len(p)] == p]
        places = [k for k, _ in hits]
        want.append((i, len(found), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    of = {r.doc_id: r for r in got}
    first = 100 + len(brute.AWKWARD)
    assert "mit" in of[first + 1].labels and of[first + 1].score == 1.0 and "mit" in of[first + 2].labels
    assert of[first + 3].labels == "" and 0.2 < of[first + 3].score < 0.8 and of[first + 5].labels == "cc-by-nc"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(brute.empty(spark)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    parts = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(p - 9 if p > 9 else p for p in parts) % 10 == 0


def base_spans(text: str) -> list:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (
                    kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))) or (
                    kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(8)
    parts = ["a@b.com", "+x@c.org", ".", "1.2.3.4", "300.1.1.1", " ", "4111 1111 1111 1111", "4111111111111112", "-", "+1 (555) 123-4567", "+12", "é", "🙂",
             "9", "00.", "mail", "@", "%", "5555-5555-5555-4444", "call (030) 123 4567", "name (at) host (dot) com"]
    texts = brute.AWKWARD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(250)]
    texts += ["a" * 40000, "1" * 40000, "1." * 20000, "+1" + " " * 30000, "a@" * 9000]
    docs, rows = brute.awkward(spark, texts)
    got = pii.find(docs).collect()
    want = []
    for i, t in rows:
        found = base_spans(t or "")
        want.append((i, *(sum(f[3] == k for f in found) for k in PATTERNS), brute.sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in found))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got)
    for r in got:
        n = r.n_email + r.n_ip + r.n_card + r.n_phone
        assert len([s for s in r.spans.split(",") if s]) >= n
    assert pii.find(brute.empty(spark)).count() == 0


def test_reliabilities_separate_good_from_bad_labelers():
    rng, counts = random.Random(2), collections.Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth else -1) if rng.random() < good else rng.choice([-1, 0, 1]) for good in (0.9, 0.7, 0.6, 0.0))
        counts[votes] += 1
    found = pii.reliabilities([{"kind": "k", "n": n, **dict(zip(pii.VOTES, v, strict=True))} for v, n in counts.items()])
    assert found["k", 1, 1, 1, -1] > 0.95 and found["k", -1, -1, -1, 1] < 0.05


def test_pipeline_stages(spark, tmp_path):
    """Every stage against brute force on its own input."""
    from tokenizers import Tokenizer
    import public_tokenizers

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    item = " ".join(rng.choice(words) for _ in range(20))
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(30)]
        if i % 6 == 0:
            text.insert(rng.randrange(30), "grubling")
        rows.append((i, " ".join(text)))
    rows += [(400, rows[1][1]), (401, rows[1][1] + " "), (402, rows[2][1] + " w1"), (403, "w9 " + item), (404, None), (405, "")]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, folder = held.columns, str(tmp_path)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = [(r.doc_id, r.text) for r in held.collect()]
        stage(spark, held, folder).write.parquet(f"{tmp_path}/stage{k}")
        held = spark.read.parquet(f"{tmp_path}/stage{k}")
        left = {r.doc_id for r in held.collect()}
        assert k == 4 or held.columns == columns
        if name == "toxicity":
            assert not {i for i, t in given if "grubling" in (t or "")} & left
            assert len(left) > 0.97 * sum("grubling" not in (t or "") for _, t in given)
        elif name == "exact dedup":
            best = {}
            for i, t in given:
                key = re.sub(r"\s", "", t or "")
                best[key] = min(best.get(key, (0, 10**9)), (-len(t or ""), i))
            assert left == {i for _, i in best.values()}
        elif name == "n-gram jaccard join":
            assert left == set(brute.near_components(given, 5, 80).values())
        elif name == "benchmark decontamination":
            items = [(1, item)]
            assert left == {i for i, n, hit, _ in brute.contamination(given, items) if not (hit and 20 * hit >= n)} and 403 not in left
        else:
            assert {r.doc_id: r.ids for r in held.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in given}
            assert hashlib
