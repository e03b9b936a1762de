"""Filtered lists, sorting, paging, row scope and look-up joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from covenantry.schema import SEVERITY_RANK, STATUS_RANK, rank_of


def _matching(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the given parameters only, so that they reach the scan."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def in_asset(items: DataFrame, documents: DataFrame, asset_id) -> DataFrame:
    """Items of the documents of one asset."""
    scope = documents.filter(F.col("asset_id") == F.lit(asset_id)).select("document_id")
    return items.join(scope, "document_id", "left_semi")


def list_obligations(
    obligations: DataFrame, documents: DataFrame | None = None, *, status=None, severity=None,
    document_id=None, asset_id=None,
) -> DataFrame:
    rows = _matching(obligations, status=status, severity=severity, document_id=document_id)
    return rows if asset_id is None else in_asset(rows, documents, asset_id)


def list_risks(
    risks: DataFrame, documents: DataFrame | None = None, *, status=None, severity=None,
    risk_type=None, document_id=None, asset_id=None,
) -> DataFrame:
    rows = _matching(
        risks, status=status, severity=severity, risk_type=risk_type, document_id=document_id
    )
    return rows if asset_id is None else in_asset(rows, documents, asset_id)


def list_asset_documents(
    documents: DataFrame, asset_id=None, *, doc_type=None, parse_status=None
) -> DataFrame:
    return _matching(
        documents, asset_id=asset_id, doc_type=doc_type, parse_status=parse_status
    )


def visible_items(
    items: DataFrame, *, show_rejected: bool = False, domain: str | None = None
) -> DataFrame:
    if not show_rejected:
        items = items.filter(F.col("status") != "rejected")
    if domain is not None:
        items = items.filter(F.coalesce("domain", F.lit("general")) == domain)
    return items


def with_asset(items: DataFrame, documents: DataFrame, assets: DataFrame) -> DataFrame:
    """Inner joins item -> document -> asset."""
    docs = documents.select("document_id", "asset_id")
    names = assets.select("asset_id", F.col("name").alias("asset_name"))
    return items.join(docs, "document_id").join(names, "asset_id")


def visible_assets(assets: DataFrame, assignments: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, asset) rows of everybody who is not an admin.

    An admin sees the asset table as it is, so no rows are multiplied out for one.
    """
    others = users.filter(F.col("role") != "admin").select("user_id")
    granted = assignments.select("user_id", "asset_id").distinct()
    return granted.join(others, "user_id", "left_semi").join(
        assets.select("asset_id", "name"), "asset_id"
    )


def in_scope(
    items: DataFrame, documents: DataFrame, assignments: DataFrame, *, user_id, role: str,
    asset_id=None,
) -> DataFrame:
    """Row-level scope of one user: everything for an admin, else assigned assets only."""
    if role == "admin":
        return items if asset_id is None else in_asset(items, documents, asset_id)
    if asset_id is None:
        raise ValueError("asset_id is required for a non-admin list")
    mine = assignments.filter(F.col("user_id") == F.lit(user_id)).select("asset_id")
    docs = documents.filter(F.col("asset_id") == F.lit(asset_id))
    docs = docs.join(mine, "asset_id", "left_semi").select("document_id")
    return items.join(docs, "document_id", "left_semi")


def primary_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """Earliest evidence row per item by (created_at, evidence_id); one partial aggregate."""
    rest = [c for c in evidence.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct("created_at", "evidence_id")).alias("row")
    return evidence.groupBy(key).agg(first).select(key, "row.*")


def last_review(reviews: DataFrame, key: str) -> DataFrame:
    """Latest review per item by (decided_at, review_id)."""
    rest = [c for c in reviews.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct("decided_at", "review_id")).alias("row")
    return reviews.groupBy(key).agg(last).select(key, "row.*")


def resolve_export_rows(
    items: DataFrame, documents: DataFrame, assets: DataFrame, evidence: DataFrame,
    reviews: DataFrame, users: DataFrame, *, key: str,
) -> DataFrame:
    """Outer look-ups of one export row; what is missing stays NULL here.

    Documents learn their asset's name and reviews their reviewer's address before they meet items, and
    items meet documents first, so their long rows are moved by document and by key and no more.
    """
    docs = documents.select("document_id", "asset_id", F.col("source_name").alias("document_filename")).join(
        assets.select("asset_id", F.col("name").alias("asset_name")), "asset_id", "left")
    proof = primary_evidence(
        evidence.select(key, "evidence_id", "created_at", "quote", "page_number",
                        "raw_char_start", "raw_char_end"), key
    ).select(
        key, F.col("quote").alias("evidence_quote"),
        F.col("page_number").alias("evidence_page_number"),
        F.col("raw_char_start").alias("evidence_char_start"),
        F.col("raw_char_end").alias("evidence_char_end"),
    )
    last = last_review(reviews.select(key, "review_id", "decided_at", "reviewer_id"), key).select(
        key, F.col("decided_at").alias("last_reviewed_at"), "reviewer_id"
    )
    mails = users.select(
        F.col("user_id").alias("reviewer_id"), F.col("email").alias("reviewer_email")
    )
    last = last.join(mails, "reviewer_id", "left")
    return items.join(docs, "document_id", "left").join(proof, key, "left").join(last, key, "left")


# --- order and pages ---------------------------------------------------------------

def sorted_items(
    items: DataFrame, by: str = "severity", *, descending: bool = True, key: str = "obligation_id"
) -> DataFrame:
    order: dict[str, Column] = {
        "severity": rank_of("severity", SEVERITY_RANK),
        "status": rank_of("status", STATUS_RANK),
        "due_date": F.coalesce(F.date_format("due_date", "yyyy-MM-dd"), F.lit("")),
        "confidence": F.coalesce("llm_quality_confidence", "system_confidence"),
    }
    sort = order.get(by, F.col(by) if by not in order else None)
    return items.withColumn("sort_key", sort).orderBy(
        F.col("sort_key").desc() if descending else F.col("sort_key").asc(), F.col(key)
    )


def page_of(
    rows: DataFrame, *order: Column, limit: int = 50, cursor: int = 0, most: int = 200
) -> tuple[DataFrame, DataFrame]:
    """(items, info): one page and a one-row frame with next_cursor.

    The look-ahead row tells whether there is more, so nothing is counted.
    Ordering with a limit is a top-k in Spark: no full sort.
    """
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be within 1..{most}")
    if cursor < 0:
        raise ValueError("cursor must not be negative")
    window = rows.orderBy(*order).offset(cursor).limit(limit + 1)
    items = window.limit(limit)
    info = window.agg(
        F.when(F.count(F.lit(1)) > limit, F.lit(str(cursor + limit))).alias("next_cursor")
    )
    return items, info


def page_after(
    rows: DataFrame, *, created_before=None, key: str, key_after=None, limit: int = 50
) -> DataFrame:
    """Keyset variant for deep pages: a filter that is pushed down replaces the offset."""
    if created_before is not None:
        at, after = F.lit(created_before), F.lit(key_after)
        rows = rows.filter(
            (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col(key) > after))
        )
    return rows.orderBy(F.col("created_at").desc(), F.col(key)).limit(limit)


def first_pages(items: DataFrame, *, partition: str, key: str, size: int) -> DataFrame:
    """The newest ``size`` items of every group with their position (a top-k report)."""
    w = W.partitionBy(partition).orderBy(F.col("created_at").desc(), F.col(key))
    return items.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= size)


def entity_suggestions(mentions: DataFrame) -> DataFrame:
    """Open mentions that have a suggestion, newest first."""
    return mentions.filter(~F.col("resolved") & F.col("suggested_entity_id").isNotNull()).orderBy(
        F.col("created_at").desc(), F.col("mention_id")
    )


def notification_view(notifications: DataFrame, events: DataFrame) -> DataFrame:
    """Notifications with the payload of their event, if it still exists."""
    return notifications.join(events.select("event_id", "event_type", "payload"), "event_id", "left")


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") != "read").alias("unread"),
    )
