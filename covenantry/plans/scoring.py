"""From verified items to the review backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from covenantry.operators.contradictions import flag_contradictions
from covenantry.operators.scoring import score_obligations


def review_backlog(
    assets: DataFrame, documents: DataFrame, obligations: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Per asset: obligations that need review or were rejected by their score."""
    scored = score_obligations(flag_contradictions(obligations), documents, evidence)
    per_document = scored.groupBy("document_id").agg(
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.sum("system_confidence").alias("points"))
    per_asset = documents.select("document_id", "asset_id").join(per_document, "document_id").groupBy(
        "asset_id").agg(F.sum("needs_review").alias("needs_review"), F.sum("rejected").alias("rejected"),
                        F.sum("points").alias("points"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("needs_review", "rejected", "points")}
    return assets.select("asset_id", "name").join(per_asset, "asset_id", "left").withColumns(zero)
