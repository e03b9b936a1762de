"""Byte-level BPE by a pair occurrence index.

A chunk of a partition is cut in pre-tokens; its distinct pre-tokens are laid out as one run of
symbols with links to both neighbours.  The index maps the rank of each adjacent pair to all its
positions.  Active ranks are applied in ascending order: all occurrences of a pair merge at
once, and only the pairs to the left and right of a merge are entered into their ranks' lists.
Stale positions are recognised when their rank's turn comes.  That equals merging word by word
because a pair that a merge creates always ranks behind it (checked when the file is loaded).

Texts are independent, so a lost task is simply run again; memory is bounded by the chunk.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from covenantry.llm.words import gather, hash_spans, runs, text_buffers

CHUNK_BYTES = 1 << 21
SEGMENT_BYTES = 1 << 20
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# The contractions of the byte-level pre-tokenizer's pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                out[a:b + 1] = kind
            else:  # a run over the gap of the surrogates
                out[[ord(c) for c in m[0]]] = kind
    return out


def pre_tokens(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the pre-tokens of UTF-8 ``data``; none crosses one of the sorted ``cuts``."""
    empty = np.zeros(0, np.int64)
    if not len(data):
        return empty, empty
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = code_point_classes()[points]
    n = len(points)
    fence = np.zeros(n + 1, bool)
    fence[np.searchsorted(lead, cuts)] = True
    fence[0] = fence[n] = True
    begin = fence.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    # The last white space before something else stands alone; a blank joins what follows.
    space = kind == SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~fence[1:n]
    blank = last & (points == 0x20)
    at = np.flatnonzero(last)
    begin[at] = True
    begin[np.flatnonzero(blank) + 1] = False
    # Contractions: an apostrophe that begins a token, is alone and meets one of the endings.
    quote = np.flatnonzero((points == 0x27) & begin[:n])
    quote = quote[quote + 1 < n]
    quote = quote[begin[quote + 1] & ~fence[quote + 1] & (kind[quote + 1] == LETTER)]
    for q in quote.tolist():
        for ending in CONTRACTIONS:
            stop = q + 1 + len(ending)
            if stop <= n and not fence[q + 2:stop].any() and all(
                    points[q + 1 + i] == ord(c) for i, c in enumerate(ending)):
                begin[q + 1] = False
                begin[stop] = True
                break
    starts = lead[np.flatnonzero(begin[:n])]
    return starts, np.append(starts[1:], len(data))


class Bpe:
    """A byte-level BPE vocabulary read from a file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        alphabet = self._alphabet()
        self.pieces = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in token)
        self.special = {}
        for t in spec["added_tokens"]:
            self.special[t["content"].encode()] = t["id"]
            self.pieces[t["id"]] = t["content"].encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges))
        born = np.full(self.size, -1)
        born[made] = rank
        if (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("a merge uses a token of a later merge; ascending ranks would not be exact")
        self.left, self.right, self.made = left, right, made
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], rank[order]
        self.lengths = np.array([len(p) for p in self.pieces])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.pieces), np.uint8)

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has no such merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of_key[at], -1)

    def merge(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, given as their bytes one behind the other; and how many ids each has."""
        n_words, total = len(lengths), int(lengths.sum())
        place = np.arange(total) + np.repeat(np.arange(n_words), lengths) + 1
        size = total + n_words + 1
        symbol = np.full(size, -1, np.int32)       # -1 between words, -2 where a symbol was merged away
        symbol[place] = self.of_byte[words]
        after = np.arange(1, size + 1, dtype=np.int32)
        before = np.arange(-1, size - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *edge.tolist(), len(rank)]
            for i, j, r in zip(bounds[:-1], bounds[1:], rank[bounds[:-1]].tolist(), strict=True):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        first = np.arange(size - 1, dtype=np.int32)
        enter(first, self.ranks(symbol[:-1], symbol[1:]))
        while active:
            rank = heapq.heappop(active)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            a, b, t = self.left[rank], self.right[rank], self.made[rank]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.append(True, at[1:] != at[:-1])]
                if a == b:
                    at = _alternate(at, after)
            if not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            symbol[at], symbol[gone] = t, -2
            after[at], before[behind] = behind, at
            ahead = before[at]
            enter(np.concatenate([ahead, at]),
                  self.ranks(np.concatenate([symbol[ahead], symbol[at]]),
                             np.concatenate([symbol[at], symbol[behind]])))
        word = np.cumsum(symbol == -1)[symbol >= 0] - 1
        return symbol[symbol >= 0], np.bincount(word, minlength=n_words)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.pool, self.offsets[ids], self.lengths[ids]).tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        """As the library decodes with its special tokens kept."""
        return self.decode(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per run of texts: number of texts, their ids one behind the other, offsets of each text."""
        data, offsets = text_buffers(column)
        for i, j in runs(offsets, CHUNK_BYTES):
            yield from self._chunk(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Where pre-tokens must end, and the bounds of special tokens that a text spells out."""
        raw, special = data.tobytes(), {}
        if any(s in raw for s in self.special):
            for m in regex.finditer(b"|".join(map(regex.escape, self.special)), raw):
                inside = np.searchsorted(offsets, m.start(), side="right")
                if m.end() <= offsets[inside]:
                    special[m.start()] = m.end()
        return np.unique(np.concatenate([offsets, [*special], [*special.values()]]).astype(np.int64)), special

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        starts, hashes, lengths, spelled, parts = [], [], [], [], list(runs(offsets, SEGMENT_BYTES))
        for i, j in parts:
            part = data[offsets[i]:offsets[j]]
            cuts, special = self._cuts(part, offsets[i:j + 1] - offsets[i])
            a, b = pre_tokens(part, cuts)
            if special:
                inside = np.zeros(len(a), bool)
                for s, e in special.items():
                    inside |= (a > s) & (a < e)
                a, b = a[~inside], np.append(a[~inside][1:], len(part))
            starts.append(a + offsets[i])
            lengths.append(b - a)
            hashes.append(hash_spans(part, a, b))
            spelled.append(np.isin(a, [*special]))
        start, length = np.concatenate(starts), np.concatenate(lengths)
        _, sample, word = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        ids, count = self.merge(gather(data, start[sample], length[sample]), length[sample])
        base = np.cumsum(count) - count
        spelled = np.concatenate(spelled)
        k = 0
        for (i, j), own in zip(parts, starts, strict=True):
            of, k = word[k:k + len(own)], k + len(own)
            n = count[of]
            out = gather(ids, base[of], n)
            marked = spelled[k - len(own):k]
            if marked.any():
                keep = np.split(out, np.cumsum(n)[:-1])
                for x in np.flatnonzero(marked):
                    keep[x] = np.array([self.special[data[own[x]:own[x] + length[k - len(own) + x]].tobytes()]])
                n = np.array([len(x) for x in keep])
                out = np.concatenate(keep)
            ends = np.concatenate([[0], np.cumsum(n)])
            bounds = ends[np.searchsorted(own, offsets[i:j + 1])]
            if not np.array_equal(gather(self.pool, self.offsets[out], self.lengths[out]),
                                  data[offsets[i]:offsets[j]]):
                raise ValueError("two pre-tokens share a 64-bit hash")
            yield j - i, out, bounds


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping pairs of one symbol, every second from the left of each run."""
    linked = np.append(False, after[at[:-1]] == at[1:])
    step = np.arange(len(at))
    head = np.maximum.accumulate(np.where(linked, 0, step))
    return at[(step - head) % 2 == 0]


@lru_cache(4)
def loaded(path: str) -> Bpe:
    return Bpe(path)


IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
DIGESTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of each row's whole text; null and empty texts have none.

    Each row gives one row, repeated ids included; other columns are not read.
    """
    def work(batches):
        codec = loaded(path)
        for batch in batches:
            done = 0
            for n, ids, bounds in codec.encode(batch.column(1)):
                yield pa.record_batch(
                    [batch.column(0).slice(done, n).cast(pa.int64()),
                     pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))], names=["doc_id", "ids"])
                done += n

    return docs.select(id_col, text_col).mapInArrow(work, IDS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; ids that are no valid UTF-8 give replacement characters."""
    def work(batches):
        codec = loaded(path)
        for batch in batches:
            texts = [codec.decode_text(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and digests of each text's ids and of the text decoded from them, without moving the ids."""
    def work(batches):
        codec = loaded(path)
        for batch in batches:
            done = 0
            for n, ids, bounds in codec.encode(batch.column(1)):
                words = ids.astype("<u4")
                sha, back = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    sha.append(hashlib.sha256(words[a:b].tobytes()).hexdigest())
                    text = codec.decode(ids[a:b])
                    back.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.record_batch(
                    [batch.column(0).slice(done, n).cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                     pa.array(sha, pa.string()), pa.array(back, pa.string())], names=DIGESTS.names)
                done += n

    return docs.select(id_col, text_col).mapInArrow(work, DIGESTS)
