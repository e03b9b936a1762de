"""Licence scan with a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template.  A text is streamed through it, which
gives for each word the longest run ending there that some template contains (the matching
statistics).  Runs that cannot be lengthened and have at least ``MIN_MATCH`` words are chained
per template, ascending in text and template with gaps of at most ``MAX_GAP`` words; the share
of a template that its best chain covers is its score, and from ``COVERED`` on it gives a label.

Words are found and hashed by numpy; only places whose neighbouring words stand so in a
template reach the automaton, which leaves its result as it is: no run of ``MIN_MATCH`` words
lies elsewhere.  Texts are independent, so memory is bounded by an Arrow batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from covenantry.llm.license_texts import PHRASES, TEMPLATES
from covenantry.llm.words import ALNUM, Words, spans

MIN_MATCH = 3
MAX_GAP = 16
COVERED = 0.8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton; ``ends[state]`` lists (template, end place) of its runs."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, symbol in enumerate(sequence):
                state = self._extend(state, symbol)
                self.ends[state].append((number, place))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends[0] = []

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A state for the shorter runs of ``target`` that are reached from ``state``."""
        clone = self._new(self.length[state] + 1)
        self.next[clone] = dict(self.next[target])
        self.link[clone], self.link[target] = self.link[target], clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        target = self.next[last].get(symbol)
        if target is not None:  # an earlier template has this run
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        state, above = self._new(self.length[last] + 1), last
        while above >= 0 and symbol not in self.next[above]:
            self.next[above][symbol] = state
            above = self.link[above]
        if above >= 0:
            target = self.next[above][symbol]
            fits = self.length[target] == self.length[above] + 1
            self.link[state] = target if fits else self._split(above, symbol, target)
        return state

    def statistics(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest known run that ends at each symbol."""
        out, state, length = [], 0, 0
        for s in symbols:
            while state and s not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if s in self.next[state]:
                state, length = self.next[state][s], length + 1
            else:
                length = 0
            out.append((state, length))
        return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> None:
        words = [WORD.findall(text.lower()) for _, text in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(w) for w in words]
        vocabulary = sorted({w for text in words for w in text})
        ids = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = SuffixAutomaton([[ids[w] for w in text] for text in words])
        hashes = _hashes(vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.id_of = hashes[order], order
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.pairs = np.zeros((len(ids), len(ids)), bool)
        for text in words:
            for a, b in zip(text[:-1], text[1:], strict=True):
                self.pairs[ids[a], ids[b]] = True
        self.phrases = [(_hashes(p.split()), p.split(), label) for p, label in phrases]

    def base(self, found: Words, hashes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, str]]:
        """(text, place, label) of every phrase whose words stand consecutively in one text."""
        out = []
        for wanted, words, label in self.phrases:
            at = np.flatnonzero(hashes == wanted[-1]) - (len(words) - 1)
            at = at[at >= 0]
            for k in range(len(words) - 1):
                at = at[hashes[at + k] == wanted[k]]
            at = at[doc[at] == doc[at + len(words) - 1]]
            out += [(int(doc[i]), int(i - found.first[doc[i]]), label) for i in at
                    if all(found.text(i + k) == w for k, w in enumerate(words))]
        return out

    def matches(self, found: Words, hashes: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], list]:
        """Longest runs per (text, template): (text place, template place, words)."""
        near = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        known = self.hashes[at] == hashes[near]
        near, symbol = near[known], self.id_of[at[known]]
        step = (near[1:] == near[:-1] + 1) & (doc[near[1:]] == doc[near[:-1]]) & self.pairs[symbol[:-1], symbol[1:]]
        edge = np.diff(np.concatenate([[False], step, [False]]).astype(np.int8))
        out: dict[tuple[int, int], list] = {}
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a + 1 < MIN_MATCH:
                continue
            run = self.automaton.statistics(symbol[a:b + 1].tolist())
            text = int(doc[near[a]])
            start = int(near[a] - found.first[text])
            for k, (state, length) in enumerate(run):
                if length < MIN_MATCH or (k + 1 < len(run) and run[k + 1][1] > length):
                    continue
                for template, end in self.automaton.ends[state]:
                    out.setdefault((text, template), []).append((start + k - length + 1, end - length + 1, length))
        return out

    def chain(self, runs: list[tuple[int, int, int]], size: int) -> tuple[float, int, int]:
        """Best chain of a template's runs: covered share, first word, word behind the last."""
        runs = sorted(runs)
        best: list[tuple[int, int]] = []  # words covered up to each run, first word of its chain
        top, low = (0, 0, 0), 0
        for i, (x, y, n) in enumerate(runs):
            while x - runs[low][0] > MAX_GAP + size:
                low += 1
            covered, first = n, x
            for j in range(low, i):
                u, v, m = runs[j]
                skip = max(0, u + m - x, v + m - y)  # words both runs share count once
                if u < x and v < y and skip < n and x - (u + m) <= MAX_GAP and best[j][0] + n - skip > covered:
                    covered, first = best[j][0] + n - skip, best[j][1]
            best.append((covered, first))
            top = max(top, (covered, -first, x + n))
        return min(1.0, top[0] / size), -top[1], top[2]


def _hashes(words: list[str]) -> np.ndarray:
    parts = [found.hashes() for found in spans(pa.array(words), ALNUM)]
    return np.concatenate(parts)


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


SCAN = """doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,
score double, spans array<struct<label string, first_word long, end_word long, covered double>>"""


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: base phrases, labels, score and the covered template spans.

    Null and empty texts have no words, empty label strings, a null first and last word, score 0
    and no spans.  Repeated ids give repeated rows; other columns are not read.
    """
    def work(batches):
        scan_ = scanner()
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for found in spans(batch.column(1), ALNUM):
                hashes, doc = found.hashes(), found.doc_of_word()
                n = found.rows.stop - found.rows.start
                base: list[list] = [[] for _ in range(n)]
                for text, place, label in scan_.base(found, hashes, doc):
                    base[text].append((place, label))
                covered: list[list] = [[] for _ in range(n)]
                for (text, template), matched in scan_.matches(found, hashes, doc).items():
                    share, first, end = scan_.chain(matched, scan_.sizes[template])
                    covered[text].append({"label": scan_.labels[template], "first_word": first, "end_word": end,
                                          "covered": share})
                rows = []
                for own, chains in zip(base, covered, strict=True):
                    named = {label for _, label in own}
                    more = {c["label"] for c in chains if c["covered"] >= COVERED}
                    rows.append((len(own), min((p for p, _ in own), default=None), max((p for p, _ in own), default=None),
                                 ",".join(sorted(named)), ",".join(sorted(named | more)),
                                 max((c["covered"] for c in chains), default=0.0),
                                 sorted(chains, key=lambda c: (c["first_word"], c["label"]))))
                cols = list(zip(*rows, strict=True))
                span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()),
                                  ("covered", pa.float64())])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(found.rows.start, n), "n_words": pa.array(np.diff(found.first), pa.int64()),
                    "n_base": pa.array(cols[0], pa.int64()), "first_word": pa.array(cols[1], pa.int64()),
                    "last_word": pa.array(cols[2], pa.int64()), "base_labels": pa.array(cols[3], pa.string()),
                    "labels": pa.array(cols[4], pa.string()), "score": pa.array(cols[5], pa.float64()),
                    "spans": pa.array(cols[6], pa.list_(span))})

    return docs.select(id_col, text_col).mapInArrow(work, SCAN)
