"""The Arrow UDFs: sequence similarity, ROUGE-L, fuzzy windows, section splits.

Each is a small helper fed by a native prefilter; Spark partitions the work.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

TOKEN = re.compile(r"[a-z0-9]+")

WINDOW = (
    T.StructType().add("start_at", "integer").add("end_at", "integer").add("ratio", "double")
)
SLICES = T.ArrayType(
    T.StructType().add("char_start", "integer").add("char_end", "integer")
    .add("split_reason", "string")
)


# --- longest common subsequence ------------------------------------------------

def lcs_length(a, b) -> int:
    """LCS length of two sequences, one machine word row per symbol of ``b``.

    Bit-parallel: bit i of ``row`` is 0 where the LCS grows at a[i].  What both begin and end with is
    part of some longest one and is counted at once.
    """
    least = min(len(a), len(b))
    head = 0
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    common, a, b = head + tail, a[head:len(a) - tail], b[head:len(b) - tail]
    if not a or not b:
        return common
    at: dict = {}
    for i, symbol in enumerate(a):
        at[symbol] = at.get(symbol, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for symbol in b:
        hit = row & at.get(symbol, 0)
        row = ((row + hit) | (row - hit)) & full
    return common + len(a) - row.bit_count()


def places(a: str) -> dict[str, int]:
    """Of each symbol a number whose bit i tells whether it stands at a[i]."""
    at: dict[str, int] = defaultdict(int)
    bit = 1
    for symbol in a:
        at[symbol] |= bit
        bit <<= 1
    return at


# How many symbols are taken between two looks at what can still be reached.
LOOK = 32


def lcs_reaches(m: int, at: dict[str, int], b: str, least: int) -> bool:
    """Whether the LCS of ``b`` and the ``m`` symbols placed by ``at`` has ``least`` symbols.

    It leaves out at most m - least of them, so its part in the first k symbols of ``b`` lies in the first
    k + m - least; where that part and all the rest of ``b`` are too few, no more is looked at.
    """
    n, row = len(b), (1 << m) - 1
    for k in range(0, n, LOOK):
        for hit in map(at.get, b[k:k + LOOK], repeat(0)):
            hit &= row
            row = (row + hit) | (row - hit)
        done = min(k + LOOK, n)
        reach = max(min(done + m - least, m), 0)
        if reach - (row & ((1 << reach) - 1)).bit_count() + n - done < least:
            return False
    return m - (row & ((1 << m) - 1)).bit_count() >= least


LANE_CHARS = 1 << 16


def lcs_lengths(a: str, texts: list[str]) -> np.ndarray:
    """LCS length of ``a`` with every text: the texts are lanes of one row, parted by a bit that takes up the carry."""
    out, first, held = [], 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > LANE_CHARS:
            out.append(_lanes(a, texts[first:k]))
            first, held = k, 0
        held += len(text) + 1
    if first < len(texts):
        out.append(_lanes(a, texts[first:]))
    return np.concatenate(out) if out else np.zeros(0, int)


def _lanes(a: str, texts: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size + 1)
    inner = np.ones(len(codes), bool)
    inner[end - 1] = False

    def number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    at = {symbol: number(codes == ord(symbol)) for symbol in set(a)}
    full = row = number(inner)
    for symbol in a:
        hit = row & at[symbol]
        if hit:
            row = ((row + hit) | (row - hit)) & full
    left = np.unpackbits(np.frombuffer(row.to_bytes(len(codes) // 8 + 1, "little"), np.uint8), bitorder="little")
    total = np.append(0, np.cumsum(left, dtype=np.int64))
    return size - (total[end] - total[end - size - 1])


def rouge_l_score(a: list[str], b: list[str]) -> float:
    common = lcs_length(a, b)
    if common == 0:
        return 0.0
    precision, recall = common / len(b), common / len(a)
    return 2 * precision * recall / (precision + recall)


def overlap_bound(a: Counter, b: Counter, la: int, lb: int) -> float:
    """Upper bound of ROUGE-L: the LCS cannot exceed the multiset overlap."""
    if la == 0 or lb == 0:
        return 0.0
    return 2.0 * sum((a & b).values()) / (la + lb)


def numbered(symbols) -> set[str]:
    """A multiset as a set: a symbol that came before is followed by how often.

    The symbols are words without blanks, or all of one length, so no two entries are taken for one.
    """
    seen: dict[str, int] = {}
    out = set()
    for symbol in symbols:
        n = seen.get(symbol, 0)
        seen[symbol] = n + 1
        out.add(f"{symbol} {n}" if n else symbol)
    return out


# --- sequence ratio --------------------------------------------------------------

def sequence_ratio(a: str, b: str) -> float:
    """SequenceMatcher's ratio.

    Where one text begins with the other, the first of its longest matches lies at equal places, as a match
    of unequal ones comes with one further to the left, and grows over all of the shorter text.
    """
    if a.startswith(b) or b.startswith(a):
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 1.0
    return SequenceMatcher(None, a, b).ratio()


def ratio_reaches(a: str, b: str, floor: float, at: dict[str, int] | None = None) -> bool:
    """sequence_ratio(a, b) >= floor, with two exact upper bounds tried first; ``at``: the places of ``a``, where known."""
    total = len(a) + len(b)
    if total == 0:
        return True
    if 2.0 * min(len(a), len(b)) / total < floor:
        return False
    if not lcs_reaches(len(a), places(a) if at is None else at, b, math.ceil(floor * total / 2 - 1e-9)):
        return False
    return sequence_ratio(a, b) >= floor


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([
        None if x is None or y is None else sequence_ratio(x, y) for x, y in zip(a, b)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """ROUGE-L F1 of two texts."""
    return pd.Series([
        rouge_l_score(TOKEN.findall((x or "").lower()), TOKEN.findall((y or "").lower()))
        for x, y in zip(a, b)
    ], dtype="float64")


# --- fuzzy windows -----------------------------------------------------------------

def best_window(
    quote: str, page: str, floor: float, stop: float, likeness: float | None = 0.3
) -> tuple[int, int, float] | None:
    """The window of the page most similar to the quote, or None below the floor.

    The scan takes window sizes of 80-120 % of the quote in about ten steps and
    moves by a quarter of the size; a later window must be strictly better, and
    one at ``stop`` or above ends the scan.  Windows whose LCS bound cannot beat
    the best so far are passed over, which cannot change the outcome.  ``likeness`` passes
    over the whole page as the original does; None reads every page.
    """
    m, n = len(quote), len(page)
    if not m or not n:
        return None
    shared = sum((Counter(quote) & Counter(page)).values())
    if likeness is not None and 2.0 * shared / (m + n) < likeness:
        return None
    floor = min(floor, stop)
    low, high = max(1, int(m * 0.8)), int(m * 1.2)
    if 2.0 * min(shared, high) / (m + min(max(shared, low), high)) < floor:
        return None  # no window size can reach the floor
    reach = min(lcs_length(quote, page), shared)
    best, best_ratio = None, 0.0
    for size in range(low, high + 1, max(1, (high - low) // 10)):
        bound = 2.0 * min(reach, size) / (m + size)
        if bound < floor or bound <= best_ratio:
            continue
        for start in range(0, n - size + 1, max(1, size // 4)):
            window = page[start:start + size]
            bound = 2.0 * lcs_length(quote, window) / (m + size)
            if bound < floor or bound <= best_ratio:
                continue
            ratio = sequence_ratio(quote, window)
            if ratio > best_ratio:
                best, best_ratio = (start, start + size, ratio), ratio
                if ratio >= stop:
                    return best
    return best if best_ratio >= floor else None


def fuzzy_window(quote: Column, page: Column, floor: float, stop: float, likeness: float | None = None) -> Column:
    @F.pandas_udf(WINDOW)
    def scan(quotes: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = [best_window(q or "", p or "", floor, stop, likeness) for q, p in zip(quotes, pages)]
        found = pd.DataFrame(
            [r or (None, None, None) for r in rows], columns=["start_at", "end_at", "ratio"]
        )
        return found.astype({"start_at": "Int32", "end_at": "Int32", "ratio": "float64"})

    return scan(quote, page)


# --- sections -----------------------------------------------------------------------

# What a numbered and an all-capitals heading look like.
NUMBERED_HEADING = re.compile(r"(?:^|\s)(\d+[\.)]\s+[A-Za-z][^\n]{1,120})")
CAPS_HEADING = re.compile(r"(?:^|\s)([A-Z][A-Z\s]{4,40})(?:\s|$)")
MIN_SECTION_GAP = 250


def heading_offsets(text: str, gap: int = MIN_SECTION_GAP) -> list[int]:
    """Starts of headings: those of the numbered ones, then those of the others, each kept if it
    lies ``gap`` characters behind the one that was kept last."""
    starts = (found.start(1) for kind in (NUMBERED_HEADING, CAPS_HEADING) for found in kind.finditer(text))
    last_kept = accumulate(starts, lambda last, at: at if last is None or at >= last + gap else last, initial=None)
    return sorted(set(last_kept) - {None})


def section_slices(text: str, limit: int) -> list[tuple[int, int, str]]:
    """(start, end, reason) for a text above the limit that may hold headings."""
    headings = heading_offsets(text)
    if not headings:
        cuts = [(s, min(s + limit, len(text)), "token_limit") for s in range(0, len(text), limit)]
    else:
        cuts, start = [], 0
        edges = [h for h in headings if h > 0]
        for edge in edges + [len(text)]:
            while edge - start > limit:
                cuts.append((start, start + limit, "token_limit"))
                start += limit
            if edge > start:
                cuts.append((start, edge, "section_split"))
                start = edge
    kept = [c for c in cuts if text[c[0]:c[1]].strip()]
    return kept or [(0, len(text), "token_limit")]


def split_sections(text: Column, limit: int) -> Column:
    @F.pandas_udf(SLICES)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [
            {"char_start": s, "char_end": e, "split_reason": r}
            for s, e, r in section_slices(t, limit)
        ])

    return cut(text)
