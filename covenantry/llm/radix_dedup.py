"""Exact de-duplication by distributed most-significant-digit radix partitioning.

The key of a text is its length in bytes followed by its bytes without white space.  Round by
round the rows of a group are split by the next digit, a run of successive bytes that gets
longer with each round.  A group that has one row, or whose text has ended, is settled; the
rest goes on.  Rows of one settled group agree in every byte, so no digest decides equality.

Skew: groups are counted by partial aggregates, and rows meet their group's single row in a
plain join, which adaptive execution splits, so a group of any size never meets in one task.
Only rows of open groups carry their text to the next round, in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenantry.llm.shared import written

WHITE = ("\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d")
FIRST_DIGIT = 64
DIGIT_GROWTH = 16


def without_white_space(text: Column) -> Column:
    """Delete every character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256`` (digest of the normalised text).

    Of equal texts the row with the most code points stays, then the smallest id (null ids
    first), then the first row.  Repeated rows are rows of their own, so exactly one of a group
    is kept.  An empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_code_points"),
        without_white_space(F.col(text_col)).alias("norm"),
    )
    size = F.octet_length("norm")
    todo = rows.select(
        "row", "doc_id", "n_code_points", F.lit(0).cast("long").alias("group"),
        F.concat(F.unhex(F.lpad(F.hex(size), 8, "0")), F.encode("norm", "UTF-8")).alias("rest"),
        F.sha2(F.col("norm"), 256).alias("text_sha256"))
    settled, digit = None, FIRST_DIGIT
    while True:
        parts = split(todo, digit)
        done = written(parts, "radix")
        last = done.filter("not open").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        settled = last if settled is None else settled.unionByName(last)
        todo = done.filter("open").select("row", "doc_id", "n_code_points", "group", "rest", "text_sha256")
        if todo.isEmpty():
            return settled
        digit *= DIGIT_GROWTH


def split(todo: DataFrame, digit: int) -> DataFrame:
    """One round: count each (group, digit), settle what is single or ended, pass on the others."""
    head = F.substring("rest", 1, digit)
    ended = F.octet_length("rest") <= digit
    order = F.struct((-F.col("n_code_points")).alias("n"), "doc_id", "row")
    groups = (todo.groupBy(F.col("group").alias("of"), head.alias("head"))
              .agg(F.count("*").alias("group_size"), F.min("row").alias("next"), F.max(ended).alias("ended"),
                   F.min_by(F.struct("doc_id", "row"), order).alias("keep"))
              .filter("group_size > 1"))
    # ``ended`` follows from the other keys; as a key of the join alone it makes both sides be dealt
    # for the join, whose hot groups adaptive execution can then split
    same = (todo["group"] == groups["of"]) & (head == groups["head"]) & (ended == groups["ended"])
    met = todo.join(groups, same, "left")
    single = F.col("group_size").isNull()
    is_open = ~single & ~F.col("ended")
    return met.select(
        "row", "doc_id", "n_code_points", F.col("next").alias("group"), is_open.alias("open"), "text_sha256",
        F.when(is_open, F.substring("rest", digit + 1, 2**31 - 1)).alias("rest"),
        F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep.row"))).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_groups`` keeps.

    Where an id repeats, rows of it may both stay and go; those few are told apart by their texts.
    """
    found = exact_groups(docs)
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    stay = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")
    ids = found.groupBy("doc_id").agg(F.min("kept").alias("all"), F.max("kept").alias("any"))
    mixed = ids.filter("any and not all").select(F.col("doc_id").alias("mixed"))
    if mixed.isEmpty():
        return stay
    kept = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.join(mixed, F.col("row.doc_id").eqNullSafe(F.col("mixed")), "left_semi")
    rows = rows.withColumn("sha", F.sha2(without_white_space(F.col("row.text")), 256))
    rows = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    longest = Window.partitionBy("row.doc_id", "sha").orderBy(F.desc(F.length("row.text")))
    rows = rows.withColumn("place", F.row_number().over(longest)).filter("place = 1").select("row.*")
    return stay.unionByName(rows)
