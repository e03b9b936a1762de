"""Formatting of conversations by a compiled template, and reading them back.

Turns are dealt by conversation and sorted; a partition is then one stream of turns.  Formatting
yields rows of pieces and reading consumes them, so neither holds more than one turn, however
long a conversation is.  (A digest over a conversation is sequential by nature: its pieces pass
one task in order, but are never gathered.)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from covenantry.llm.chat_template import Template

START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}" + START + "{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}")
_ESCAPE = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROLS)) + ")")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN_END = re.compile(r"\\.|" + re.escape(END + "\n"), re.S)


def escape(text: str) -> str:
    """Double each backslash and put one before each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] else "\\", text)


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS = {"escape": escape, "escape_line": escape_line}


def read_back(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn of a formatted conversation."""
    held, loss, at = "", [], 0
    for text, inside in pieces:
        if inside:
            loss.append((len(held), len(held) + len(text)))
        held += text
        while True:
            end, scan = None, at
            for m in _TURN_END.finditer(held, at):
                scan = m.end()
                if m[0][0] != "\\":
                    end = m
                    break
            # what has been looked through is not looked through again, but an end may be half there
            at = max(scan, at) if end is None else at
            if end is None:
                at = max(at, _whole(held, at))
                break
            head, _, body = held[:end.start()].partition("\n")
            if not head.startswith(START):
                raise ValueError("a turn does not begin with its marker")
            covered = "".join(held[a:b] for a, b in loss)
            yield unescape(head[len(START):]), unescape(body), unescape(covered)
            held, loss, at = held[end.end():], [], 0
    if held:
        raise ValueError("the last turn is not closed")


def _whole(held: str, at: int) -> int:
    """A place from which a later scan finds all it must: before a possible half of an end or escape."""
    tail = max(at, len(held) - len(END) - 1)
    slashes = len(held) - len(held.rstrip("\\"))
    return at if slashes or tail == at or held[at:tail].endswith("\\") else tail


def with_check_conversation(conversations: DataFrame) -> DataFrame:
    """The table with conversation -1, whose texts are nothing but control strings of another format."""
    spark = conversations.sparkSession
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)],
                                  "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


PIECES = "conv_id long, piece long, text string, in_loss boolean"


def format_pieces(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, piece, text, in_loss``: each conversation's formatted text in order.

    Rows are one turn each, ordered by turn, role and text; null roles and texts count as empty,
    a null conv_id is a conversation of its own.  Pieces of a conversation stand one behind the
    other in one partition.
    """
    def work(batches):
        compiled = Template(template, FILTERS)

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)

        def out():
            for conv, turns in groupby(rows(), key=lambda r: r[0]):
                messages = ({"role": role or "", "text": text or ""} for _, role, text in turns)
                for k, (text, inside) in enumerate(compiled.pieces(messages)):
                    yield conv, k, text, inside

        yield from _batches(out(), pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()),
                                              ("in_loss", pa.bool_())]))

    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return turns.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(work, PIECES)


READ = """conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"""


def read_digests(pieces: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, parsed from its formatted pieces alone."""
    def work(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)

        def out():
            for conv, parts in groupby(rows(), key=lambda r: r[0]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                total = n_turns = n_loss = 0

                def counted(parts=parts):
                    nonlocal total
                    for _, text, inside in parts:
                        total += len(text)
                        yield text, inside

                for role, text, covered in read_back(counted()):
                    n_turns += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    loss.update(covered.encode())
                    n_loss += len(covered)
                yield conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), total

        yield from _batches(out(), pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                              ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                                              ("formatted_chars", pa.int64())]))

    return pieces.mapInArrow(work, READ)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")
