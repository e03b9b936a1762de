"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

A window of a benchmark item (13 words, or a whole shorter item) must occur in full, so of its
shingles, ordered by their rarity in all documents, the first is a prefix that no occurrence can
lack.  Only places of documents that hold such a shingle are joined; the place of the shingle in
its window gives the only possible start, which must leave room for the window on both sides
(positional and length bounds), and then the words are compared one by one.

The windows are broadcast only while their measured size is below ``BROADCAST_BYTES``; above it
the same join is shuffled, with the words around each place instead of the whole document.  A
document is one row throughout, and hits are gathered per document, so no key is hotter than a text is long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 13
SHINGLE = 3
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS, -1), "")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``window`` (its words), ``n`` and the sorted distinct ``items`` (ids as strings) that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    items = items.filter("size(words) > 0 and item is not null")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)))
    windows = items.select("item", "words", F.explode(starts).alias("at"))
    windows = windows.select("item", F.slice("words", F.col("at"), WINDOW).alias("window"))
    return windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("n", F.size("window"))


def shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from a 0-based place; its meaning is checked later, word by word."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def places(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every place of every document with its shingles of the given sizes."""
    found = docs.select("doc_id", "copy", "words", F.posexplode("words").alias("pos", "word"))
    kinds = [F.when(F.col("pos") + k <= F.size("words"), shingle(F.col("words"), F.col("pos"), k)) for k in sizes]
    token = kinds[0] if len(kinds) == 1 else F.explode(F.array(*kinds))
    return found.select("doc_id", "copy", "words", "pos", token.alias("token")).filter("token is not null")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, copy``.

    A word is hit inside any occurrence of a window; a row is contaminated when hits make up a
    twentieth of its words or more.  Null and empty texts have no words and no hits; items without
    words or id are passed over; rows that repeat an id are judged by their own text, of which
    ``copy`` is a hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("copy"), text.alias("text"))
    split = rows.select("doc_id", "copy", words_of(F.col("text")).alias("words"))
    windows = item_windows(benchmark)
    size, lengths = windows.agg(
        F.sum(F.octet_length(F.array_join("window", " ")) + 64 + 16 * F.size("items")),
        F.collect_set(F.least(F.col("n"), F.lit(SHINGLE)))).first()
    small = (size or 0) <= BROADCAST_BYTES
    lengths = sorted(lengths) or [SHINGLE]

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # rarity of the windows' shingles over all documents
    token = reduce(lambda rest, k: F.when(F.col("n") >= k, shingle(F.col("window"), F.col("at"), k)).otherwise(rest),
                   lengths, F.lit(None).cast("long"))
    last = F.col("n") - F.least(F.col("n"), F.lit(SHINGLE))
    shingles = windows.select("window", "n", "items", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    shingles = shingles.select("window", "n", "items", "at", token.alias("token"))
    counts = (places(split, lengths).select("token").join(sent(shingles.select("token").distinct()), "token", "left_semi")
              .groupBy("token").count())
    rarest = (shingles.join(counts, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
              .groupBy("window", "n", "items").agg(F.min(F.struct("count", "token", "at")).alias("first")))
    prefix = rarest.filter("first.count > 0").select("window", "n", "items", "first.token", "first.at")

    # places with a prefix shingle, bounds, and comparison
    there = places(split, lengths)
    if small:
        met = there.join(F.broadcast(prefix), "token").withColumn("start", F.col("pos") - F.col("at"))
        met = met.filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("words")))
        hits = met.filter(F.slice("words", F.col("start") + 1, F.col("n")) == F.col("window"))
    else:
        low = F.greatest(F.col("pos") - WINDOW, F.lit(0))
        there = there.select("doc_id", "copy", "pos", "token", low.alias("low"), F.size("words").alias("n_words"),
                             F.slice("words", low + 1, 2 * WINDOW + SHINGLE).alias("around"))
        met = there.join(prefix, "token").withColumn("start", F.col("pos") - F.col("at"))
        met = met.filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
        hits = met.filter(F.slice("around", F.col("start") - F.col("low") + 1, F.col("n")) == F.col("window"))
    hits = hits.select("doc_id", "copy", "start", (F.col("start") + F.col("n")).alias("end"), "items")

    # words covered by overlapping windows count once
    before = (Window.partitionBy("doc_id", "copy").orderBy("start", "end")
              .rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    found = (hits.withColumn("fresh", fresh).groupBy(F.col("doc_id").alias("id"), F.col("copy").alias("id_copy"))
             .agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    n_words = rows.select("doc_id", "copy", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("n_words"))
    joined = n_words.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("id_copy")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "copy")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated.

    Null and empty texts have no words and stay; rows that repeat an id, or have none, are judged by their own
    texts; an empty table stays empty.
    """
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("gone"), "copy").distinct()
    same = docs["doc_id"].eqNullSafe(bad["gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["copy"])
    return docs.join(bad, same, "left_anti")
