"""Plain reference versions of the operators, and a frame of awkward rows."""

from __future__ import annotations

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
# Columns of other tables whose names the operators use inside.
CLASH = "n long, class long, score double, start long, kind string, copy long, token long, words string, row long, `group` string"
CLASHING = (7, 7, 0.5, 7, "kind", 7, 7, "words", 7, "group")

AWKWARD = ["", None, " ", "\n\t \x0b", "a", "A", "é", "日本語 テキスト", "🙂🙂 x", "don't 'tis it's ''s 'll", "x " * 3000, "y" * 30000,
           "<|endoftext|> a<|endoftext|>", "1.2.3.4 a@b.com +1 (555) 123-4567", "released under the MIT License", "\x00\x1c a\x85b",
           "same words here again", "same words here again", "same  words here again ", "Idiot idiot IDIOT"]


def awkward(spark, texts=AWKWARD, first=100):
    """Rows with clashing extra columns, a repeated id, a repeated row and a null id."""
    rows = [(first + i, t) for i, t in enumerate(texts)]
    rows += [(first, "another text of the first id"), rows[-1], (None, "a text without an id")]
    return spark.createDataFrame([(i, t, *CLASHING) for i, t in rows], f"doc_id long, text string, {CLASH}"), rows


def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASH}")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None, pattern=ALNUM) -> list[str]:
    return pattern.findall((text or "").translate(LOWER))


def shingles(text: str | None, size: int) -> set:
    found = words(text, NON_SPACE)
    if len(found) >= size:
        return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)}
    return {tuple(found)} if found else set()


def near_components(rows, size: int, share: int) -> dict:
    """Smallest reachable id of each id, by all pairs that share a shingle."""
    sets = collections.defaultdict(list)
    for i, text in rows:
        sets[i].append(shingles(text, size))
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= share * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}


def contamination(rows, items, window: int = 13):
    """(id, n_words, n_hit, items) of each row."""
    wanted = collections.defaultdict(set)
    for item, text in items:
        found = words(text)
        for i in range(max(len(found) - window, 0) + 1 if found else 0):
            wanted[tuple(found[i:i + window])].add(str(item))
    out = []
    for i, text in rows:
        found, hit, of = words(text), set(), set()
        for size in {len(w) for w in wanted}:
            for k in range(len(found) - size + 1):
                if (key := tuple(found[k:k + size])) in wanted:
                    hit |= set(range(k, k + size))
                    of |= wanted[key]
        out.append((i, len(found), len(hit), sorted(of)))
    return out
