"""Token ids in files of directly addressable codes.

An id is split in chunks of 8 bits, lowest first.  Level k holds the k-th chunks of all ids that
reach it; a bitmap beside it says which of them go on to level k + 1, and a rank directory holds
the number of set bits before each block of 512, so the place of an id on the next level is one
look-up and one popcount.  Any token is read without decoding its neighbours.

A file: magic, header (counts, levels, documents without an id), the documents' ids and first token
places, then for each level the chunks, bitmap and rank directory.  Files hold documents in ascending
order of id, those without one first, and follow each other in the order of their names.  A file is written under a
name of its own attempt, and the table of files, written by Spark, names those that count, so
a repeated task leaves no doubt and no half-written file is ever read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covenantry.llm.shared import new_path, written
from covenantry.llm.words import gather, hash_spans, runs, text_buffers, within

MAGIC = b"DACIDS02"
BLOCK = 512
FILE_TOKENS = 2 << 20
BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(doc_ids: np.ndarray, bounds: np.ndarray, ids: np.ndarray, nameless: int = 0) -> bytes:
    """A file of some documents; ``bounds`` are the token places at which they begin, and the end.

    The first ``nameless`` documents have no id; what stands in its place is not read.
    """
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(BIT_COUNT[bits].astype(np.uint64), np.arange(0, len(bits), BLOCK // 8)) \
            if len(bits) else np.zeros(0, np.uint64)
        levels.append(((rest & 0xFF).astype(np.uint8), bits, np.append(np.uint64(0), np.cumsum(blocks, dtype=np.uint64))))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = io.BytesIO()
    out.write(MAGIC)
    out.write(np.array([len(doc_ids), len(ids), len(levels), nameless, *(len(x[0]) for x in levels)], "<u8").tobytes())
    out.write(doc_ids.astype("<i8").tobytes())
    out.write(bounds.astype("<u8").tobytes())
    for chunks, bits, directory in levels:
        out.write(chunks.tobytes())
        out.write(bits.tobytes())
        out.write(directory.astype("<u8").tobytes())
    return out.getvalue()


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("no file of directly addressable codes")
        n_docs, self.n_tokens, n_levels, self.nameless = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        at = 40
        sizes = np.frombuffer(data, "<u8", n_levels, at).astype(np.int64).tolist()
        at += 8 * n_levels
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.bounds = np.frombuffer(data, "<u8", n_docs + 1, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs + 8
        self.levels = []
        for size in sizes:
            n_bits, n_blocks = -(-size // 8), -(-size // BLOCK)
            self.levels.append((np.frombuffer(data, np.uint8, size, at), np.frombuffer(data, np.uint8, n_bits, at + size),
                                np.frombuffer(data, "<u8", n_blocks + 1, at + size + n_bits)))
            at += size + n_bits + 8 * (n_blocks + 1)

    def rank(self, level: int, place: int) -> int:
        """Set bits of a level's bitmap before ``place``."""
        _, bits, directory = self.levels[level]
        block = place // BLOCK
        total = int(directory[block]) + int(BIT_COUNT[bits[block * BLOCK // 8:place // 8]].sum())
        if place % 8:
            total += int(BIT_COUNT[bits[place // 8] & ((1 << place % 8) - 1)])
        return total

    def token(self, place: int) -> int:
        """The id at one place of the file."""
        value = level = 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[place]) << 8 * level
            if not bits[place // 8] >> place % 8 & 1:
                return value
            place, level = self.rank(level, place), level + 1

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids of a range of places; only that range of each level is touched."""
        chunks, bits, _ = self.levels[0]
        out = chunks[start:end].astype(np.uint32)
        own, a, b = np.arange(end - start), start, end
        for level in range(len(self.levels) - 1):
            _, bits, _ = self.levels[level]
            flags = np.unpackbits(bits[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a].astype(bool)
            own = own[flags]
            a = self.rank(level, a)
            b = a + len(own)
            out[own] |= self.levels[level + 1][0][a:b].astype(np.uint32) << np.uint32(8 * (level + 1))
        return out

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.bounds[i]), int(self.bounds[i + 1]))


class PieceEncoder:
    """Ids of whole texts by the ``tokenizers`` library, which sees each distinct piece once.

    A text is cut at ASCII white space, and between an ASCII letter or digit and a full stop or
    comma: this vocabulary's pre-tokenizer drops white space and never forms a token across such
    a place, so the ids of the pieces are the ids of the text.  Pieces are told apart by a hash
    and then compared byte by byte.  Ids of earlier pieces are kept while they are fewer than
    ``KEPT_PIECES``.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = self.tokenizer.get_added_tokens_decoder()
        self.mark_id, mark = next((i, t.content) for i, t in special.items() if t.special and not t.normalized)
        self.mark, self.end_id = mark.encode(), end_id
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.base, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> None:
        """Enter new pieces; many go to the library at once, parted by a special token."""
        text = gather(data, start, length)
        ends = np.cumsum(length)
        raw = text.tobytes()
        pieces = [raw[a:b] for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
        alone = [i for i, x in enumerate(pieces) if self.mark in x] if self.mark in raw else []
        marked = {i: self.tokenizer.encode(pieces[i].decode(), add_special_tokens=False).ids for i in alone}
        joined = [self.mark.join(b"" if i in marked else pieces[i] for i in range(k, min(k + 500, len(pieces)))).decode()
                  for k in range(0, len(pieces), 500)]
        ids, counts = [], []
        for k in range(0, len(joined), 16):  # the library's results are large, so few are held at a time
            for found in self.tokenizer.encode_batch_fast(joined[k:k + 16], add_special_tokens=False):
                row = np.array(found.ids, np.uint32)
                cut = np.flatnonzero(row == self.mark_id)
                counts.append(np.diff(np.concatenate([[-1], cut, [len(row)]])) - 1)
                ids.append(row[row != self.mark_id])
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        if marked:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in marked.items():
                parts[i] = np.array(x, np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        base = np.cumsum(counts) - counts + len(self.pool)
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.base = np.concatenate([self.base, base])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.start = np.concatenate([self.start, ends - length + len(self.bytes)])[order]
        self.length = np.concatenate([self.length, length])[order]
        self.pool = np.concatenate([self.pool, ids])
        self.bytes = np.concatenate([self.bytes, text])

    def encode(self, column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per run of texts: their number, all ids (each text closed by the end id), and bounds."""
        data, offsets = text_buffers(column)
        for i, j in runs(offsets, limit):
            part, cut = lowered(data[offsets[i]:offsets[j]]), offsets[i:j + 1] - offsets[i]
            start, end = piece_bounds(part, cut)
            length = end - start
            hashes = hash_spans(part, start, end)
            distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            new = ~within(distinct, self.hashes)
            if len(self.hashes) + new.sum() > KEPT_PIECES:
                self._forget()
                new[:] = True
            if new.any():
                self._learn(part, start[sample[new]], length[sample[new]], distinct[new])
            entry = np.searchsorted(self.hashes, distinct)[inverse]
            if (self.length[entry] != length).any() or not np.array_equal(
                    gather(self.bytes, self.start[entry], length), gather(part, start, length)):
                raise ValueError("two pieces share a 64-bit hash")
            n = self.counts[entry]
            out = gather(self.pool, self.base[entry], n)
            ends = np.append(0, np.cumsum(n))[np.searchsorted(start, cut[1:])]
            yield j - i, np.insert(out, ends, self.end_id), np.append(0, ends + np.arange(1, j - i + 1))


KEPT_PIECES = 1_000_000


@lru_cache(1)
def loaded(path: str, end_id: int) -> PieceEncoder:
    """One encoder, and its known pieces, for all tasks of a worker."""
    return PieceEncoder(path, end_id)


WHITE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
ASCII_WORD = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])
STOP = np.isin(np.arange(256), [0x2C, 0x2E])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, as the vocabulary's normaliser would have it, so that fewer pieces differ.

    Not where a combining mark may follow, which is composed before case is lost, nor in a run
    that may spell a special token.
    """
    if b"<|" in data.tobytes():
        return data
    upper = (data >= 0x41) & (data <= 0x5A)
    upper[:-1] &= data[1:] < 0x80
    return np.where(upper, data | 0x20, data)


def piece_bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the pieces of texts that begin at ``cuts``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white, word, stop = WHITE[data], ASCII_WORD[data], STOP[data]
    border = np.zeros(n + 1, bool)
    border[cuts] = True
    border[1:n] |= (white[1:] != white[:-1]) | (word[1:] & stop[:-1]) | (stop[1:] & word[:-1])
    at = np.flatnonzero(border)
    keep = ~white[at[:-1]]
    return at[:-1][keep], at[1:][keep]


FILES = "part int, number int, file string, n_docs long, n_tokens long, first_doc long"


def write_ids(docs: DataFrame, path: str, end_id: int, out: str | None = None) -> tuple[str, DataFrame]:
    """Encode every text, append ``end_id``, and write files in ascending order of doc_id.

    Returns the folder and the table of its files with ``start``, the ids in all files before.
    Null text counts as empty.  Rows of equal doc_id follow each other by length and hash of
    their text; rows without one come first, in the same order.  Very long texts and columns of
    any other name change nothing; an empty table has no files.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "token-ids")

    def work(batches):
        from pyspark import TaskContext

        encoder, part, number = loaded(path, end_id), TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root)
        ids, docs_of, bounds, total, nameless = [], [], [np.zeros(1, np.int64)], 0, 0

        def flush():
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.dac"
            firsts = np.concatenate(docs_of)
            with store.open_output_stream(f"{root}/{name}") as stream:
                stream.write(pack(firsts, np.concatenate(bounds), np.concatenate(ids), nameless))
            return pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "file": name, "n_docs": len(firsts), "n_tokens": total,
                  "first_doc": None if nameless else int(firsts[0])}], schema=pa.schema([
                      ("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
                      ("n_tokens", pa.int64()), ("first_doc", pa.int64())]))

        for batch in batches:
            done = 0
            for n, tokens, ends in encoder.encode(batch.column(1)):
                named = batch.column(0).slice(done, n)
                docs_of.append(named.fill_null(0).to_numpy().astype(np.int64))
                nameless += named.null_count
                done += n
                ids.append(tokens)
                bounds.append(ends[1:] + total)
                total += len(tokens)
                if total >= FILE_TOKENS:
                    yield flush()
                    number += 1
                    ids, docs_of, bounds, total, nameless = [], [], [np.zeros(1, np.int64)], 0, 0
        if docs_of:
            yield flush()

    tie = (F.length("text"), F.xxhash64("text"))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", *tie))
    files = written(ordered.mapInArrow(work, FILES), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return out, starts


def read_ids(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document, read back from the files, one task per group of files."""
    return _read(files, folder, "doc_id long, start long, ids array<long>", lambda ids: pa.array(
        [x.tolist() for x in ids], pa.list_(pa.int64())), "ids")


def read_digests(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files."""
    return _read(files, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: pa.array(
        [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "ids_crc32", count=True)


def _read(files: DataFrame, folder: str, schema: str, derive, name: str, count: bool = False) -> DataFrame:
    def work(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{file}") as stream:
                    reader = Reader(stream.read())
                for i in range(0, len(reader.doc_ids), 2000):
                    some = range(i, min(i + 2000, len(reader.doc_ids)))
                    columns = {"doc_id": pa.array(reader.doc_ids[i:i + 2000], pa.int64(), mask=np.array(some) < reader.nameless),
                               "start": pa.array(reader.bounds[i:i + len(some)] + start, pa.int64())}
                    if count:
                        columns["n_tokens"] = pa.array(np.diff(reader.bounds[i:i + len(some) + 1]), pa.int64())
                    columns[name] = derive([reader.document(k) for k in some])
                    yield pa.RecordBatch.from_pydict(columns)

    n = files.count()
    tasks = max(1, min(n, max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 64)))
    spread = files.select("file", "start").repartition(tasks, "file")
    return spread.mapInArrow(work, schema)
