"""Grouping of spelling variants by permuterm rotations.

A word is marked with a terminator, and of ``w$`` every rotation is taken.  What two words of edit
distance one have in common is then a prefix of two rotations: of a replacement at place p it is
``w[p+1:] $ w[:p]``, the rotation that ends with the replaced character without that character; of
an insertion it is a whole rotation of the shorter word, which the longer word's rotation goes on
by one character.  So every rotation stands once whole and once without its last character, both
are dealt out by that prefix, sorted by prefix and last character, and scanned: a run of equal
prefixes is one range of neighbours, the shorter word first.

No range is hot: its rows differ in their last character, so there are at most as many as the
alphabet has letters, and one more.  The scan hands on, per row and range, the number of
neighbours and the most frequent one, never the pairs; both add up per word.  Within a run of one
letter every deletion gives the same word, so only the first place of such a run counts for indels,
and no neighbour is counted twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenantry.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
DOMINANCE = 10
ALTERED = 31
MARK = "$"


def altered(run: Column, doc_id: Column) -> Column:
    """A run without one code point where ``ALTERED`` divides the crc32 of ``<doc_id>:<run>``; a null id alters nothing."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % ALTERED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def lexicon(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the words of all texts with at least so many code points and occurrences.

    Null texts have none; a row that repeats counts again.  Shorter runs are passed over in the text,
    as alteration never makes a run longer.  Counts are folded before they are shuffled.
    """
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    runs = docs.select("doc_id", F.explode(found).alias("run"))
    words = runs.select(altered(F.col("run"), F.col("doc_id")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, last, n``: every rotation of the marked words, whole (``last`` is empty) and without its last letter."""
    size, word = F.length("word"), F.col("word")

    def prefix(after: Column, before: Column) -> Column:
        return F.concat(F.substring(word, after + 1, size), F.lit(MARK), F.substring(word, F.lit(1), before))

    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(prefix(i, i).alias("prefix"), F.lit("").alias("last")))
    short = F.transform(F.sequence(F.lit(0), size - 1), lambda p: F.struct(
        prefix(p + 1, p).alias("prefix"), F.substring(word, p + 1, F.lit(1)).alias("last")))
    return words.filter(size > 0).select(F.explode(F.concat(whole, short)).alias("r"), "n").select("r.prefix", "r.last", "n")


NEAR = "word string, n_near long, near string, near_n long"


def words_of(rows: pa.Table) -> pa.Array:
    """The word behind a prefix ``suffix$beginning`` and its last letter."""
    both = pc.binary_join_element_wise(rows["prefix"], rows["last"], MARK)
    return pc.replace_substring_regex(both, r"^([^$]*)\$([^$]*)\$(.*)$", r"\2\3\1").combine_chunks()


def best_of(group: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``at`` ordered by group, then n from the largest, then place; and the first of each group among them."""
    order = at[np.lexsort((at, -n[at], group[at]))]
    first = np.flatnonzero(np.append(True, group[order[1:]] != group[order[:-1]])) if len(order) else order
    return order, first


def neighbours(rows: pa.Table, start: np.ndarray) -> pa.RecordBatch:
    """What the ranges that begin at ``start`` say of their words: rows of ``NEAR``."""
    size = np.diff(np.append(start, rows.num_rows))
    several = np.repeat(size > 1, size)
    group = np.repeat(np.arange(len(start)), size)[several]
    rows = rows.filter(pa.array(several))
    n, word = rows["n"].to_numpy(), words_of(rows)
    is_base = pc.equal(rows["last"], "").to_numpy(zero_copy_only=False)
    # deleting any letter of "aa" gives the same word: only the first counts
    first_of_run = pc.not_equal(pc.utf8_slice_codeunits(rows["prefix"], -1, 2**31 - 1), rows["last"]).to_numpy(zero_copy_only=False)
    of, how_many, near = [], [], []

    # replacements: of each member all the others, the best of which is the range's best or its second
    order, first = best_of(group, n, np.flatnonzero(~is_base))
    members = np.diff(np.append(first, len(order)))
    pick = np.flatnonzero(members > 1)
    top, second = order[first[pick]], order[first[pick] + 1]
    for_row, of_range = order[np.repeat(members > 1, members)], np.repeat(np.arange(len(pick)), members[pick])
    of.append(for_row)
    how_many.append(members[pick][of_range] - 1)
    near.append(np.where(for_row == top[of_range], second[of_range], top[of_range]))

    # indels: the shorter word and the members that are longer by one letter
    base = np.full(int(group[-1]) + 1 if len(group) else 0, -1)
    base[group[is_base]] = np.flatnonzero(is_base)
    longer = np.flatnonzero(~is_base & first_of_run)
    longer = longer[base[group[longer]] >= 0]
    of.append(longer)
    how_many.append(np.ones(len(longer), np.int64))
    near.append(base[group[longer]])
    order, first = best_of(group, n, longer)
    of.append(base[group[order[first]]])
    how_many.append(np.diff(np.append(first, len(order))))
    near.append(order[first])

    of, near = np.concatenate(of), np.concatenate(near)
    return pa.RecordBatch.from_arrays(
        [word.take(pa.array(of)), pa.array(np.concatenate(how_many), pa.int64()), word.take(pa.array(near)), pa.array(n[near], pa.int64())],
        names=["word", "n_near", "near", "near_n"])


def scan(batches):
    """Ranges of a sorted partition; the last range of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        prefix = rows["prefix"]
        change = pc.not_equal(prefix.slice(1), prefix.slice(0, rows.num_rows - 1)).to_numpy()
        start = np.append(0, np.flatnonzero(change) + 1)
        rest = rows.slice(int(start[-1]))
        yield neighbours(rows.slice(0, int(start[-1])), start[:-1])
    if rest is not None:
        yield neighbours(rest, np.zeros(1, np.int64))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, near, near_n``: each word's number of near words and the most frequent of them.

    Near is one inserted, deleted or replaced code point; of equally frequent words the first in
    code-point order is taken.  ``words`` holds distinct words of letters and their counts.
    """
    ordered = rotations(words).repartition("prefix").sortWithinPartitions("prefix", "last")
    said = ordered.mapInArrow(scan, NEAR)
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("near"),
                        F.lit(None).cast("long").alias("near_n"))
    both = none.unionByName(said.withColumn("n", F.lit(None).cast("long")))
    place = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("order"), "near"))
    found = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(place).alias("best"))
    return found.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms followed to the last, the length of the known way doubling each round.

    Counts grow ``DOMINANCE`` times with each step, so ways are as short as a logarithm and no way is a ring.
    """
    known = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = known.select(F.col("word").alias("via"), F.col("root").alias("further"))
        met = known.join(onward, known["root"] == onward["via"], "left")
        known = written(met.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if known.filter("moved").isEmpty():
            return known.drop("moved")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, dominance: int = DOMINANCE) -> DataFrame:
    """Per word ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent near word if it is ``dominance`` times as frequent as the word, else
    null; ``root`` is what the forms lead to, the word itself without one.  Without words the result is
    empty.  Only ``doc_id`` and ``text`` are read, texts whole; words of any length are rotated whole.
    """
    words = written(lexicon(docs.select("doc_id", "text"), min_length, min_count), "lexicon")
    near = near_words(words)
    is_form = F.coalesce(F.col("near_n") >= dominance * F.col("n"), F.lit(False))
    found = written(near.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "near-words")
    known = roots(found.filter("form is not null").select("word", "form")).withColumnRenamed("word", "of")
    met = found.join(known, found["word"] == known["of"], "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
