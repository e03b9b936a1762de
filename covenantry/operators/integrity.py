"""Rows that break a declared invariant (C14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def _violations(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("record_id"))


def out_of_range(items: DataFrame, key: str, *columns: str) -> DataFrame:
    present = [c for c in columns if c in items.columns]
    bad = reduce(lambda a, b: a | b, [~F.col(c).between(0, 100) for c in present])
    return _violations(items.filter(F.coalesce(bad, F.lit(False))), "confidence_range", key)


def duplicate_keys(df: DataFrame, rule: str, *columns: str) -> DataFrame:
    doubled = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return doubled.select(
        F.lit(rule).alias("rule"),
        F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).alias("record_id"))


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a_id").cast("string"), F.col("b_id").cast("string")
    return _violations(pairs.filter(a >= b), "pair_order", "a_id")


def misplaced_quotes(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence whose quote is not the page text at its offsets."""
    df = evidence.join(
        pages.select("document_id", "page_number", "normalized_text"),
        ["document_id", "page_number"], "left")
    start, end = F.col("normalized_char_start"), F.col("normalized_char_end")
    there = F.col("normalized_text").substr(start + 1, end - start) == F.col("quote")
    return _violations(df.filter(~F.coalesce(there, F.lit(False))), "quote_offsets", "evidence_id")


def without_evidence(items: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    live = items.filter(F.col("status") != "rejected")
    return _violations(live.join(evidence.select(key), key, "left_anti"), "no_evidence", key)


def unapproved(items: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Confirmed items without an approving review."""
    approving = reviews.filter(F.col("decision").isin("approve", "edit_approve")).select(key)
    confirmed = items.filter(F.col("status") == "confirmed")
    return _violations(confirmed.join(approving, key, "left_anti"), "no_approval", key)


def integrity_report(
    obligations: DataFrame, evidence: DataFrame, reviews: DataFrame,
    pairs: DataFrame | None = None, pages: DataFrame | None = None,
) -> DataFrame:
    parts = [
        out_of_range(obligations, "obligation_id", "system_confidence", "reviewer_confidence",
                     "llm_quality_confidence", "critic_confidence"),
        duplicate_keys(obligations, "duplicate_id", "obligation_id"),
        duplicate_keys(evidence, "duplicate_evidence", "quote_sha256", "document_id", "page_number",
                       "normalized_char_start", "normalized_char_end"),
        without_evidence(obligations, evidence, "obligation_id"),
        unapproved(obligations, reviews, "obligation_id"),
    ]
    if pairs is not None:
        parts.append(unordered_pairs(pairs))
    if pages is not None:
        parts.append(misplaced_quotes(evidence, pages))
    return reduce(DataFrame.unionByName, parts)
