"""Notifications, digests and the inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from covenantry.operators.rollups import elevated_risks
from covenantry.schema import SEVERITY_RANK, rank_of

BUCKETS = ("critical_this_week", "due_next_14_days", "coming_up_30_days")


def recipients(documents: DataFrame, assignments: DataFrame) -> DataFrame:
    """(document_id, user_id): the uploader and everybody assigned to the asset."""
    uploaders = documents.select("document_id", F.col("uploaded_by").alias("user_id"))
    assigned = documents.select("document_id", "asset_id").join(
        assignments.select("asset_id", "user_id"), "asset_id").select("document_id", "user_id")
    return uploaders.unionByName(assigned).distinct()


def document_events(documents: DataFrame, risks: DataFrame) -> DataFrame:
    """processing_complete per document, risk_detected where a risk is high or critical."""
    elevated = elevated_risks(risks).filter(F.col("high_or_critical_count") > 0)
    done = documents.select(
        "document_id", F.lit("processing_complete").alias("event_type"),
        F.to_json(F.struct(
            F.col("document_id").cast("string").alias("document_id"),
            F.col("asset_id").cast("string").alias("asset_id"), "parse_status", "source_name"
        )).alias("payload"))
    alarm = documents.join(elevated, "document_id").select(
        "document_id", F.lit("risk_detected").alias("event_type"),
        F.to_json(F.struct(
            F.col("document_id").cast("string").alias("document_id"),
            F.col("asset_id").cast("string").alias("asset_id"), "high_or_critical_count"
        )).alias("payload"))
    both = done.unionByName(alarm)
    return both.withColumn("event_id", F.sha2(F.concat_ws(
        ":", F.col("document_id").cast("string"), "event_type"), 256))


def user_notifications(
    events: DataFrame, receivers: DataFrame, *, email_enabled: bool = False
) -> DataFrame:
    """One pending row per event, recipient and channel."""
    channels = ["in_app", "email"] if email_enabled else ["in_app"]
    return events.select("document_id", "event_id", "event_type").join(receivers, "document_id").select(
        "event_id", "event_type", "document_id", "user_id",
        F.explode(F.array(*map(F.lit, channels))).alias("channel"),
        F.lit("pending").alias("status"))


def emit_notifications(
    documents: DataFrame, assignments: DataFrame, risks: DataFrame, *, email_enabled: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(events, user notifications)."""
    events = document_events(documents, risks)
    rows = user_notifications(events, recipients(documents, assignments), email_enabled=email_enabled)
    return events, rows


def compliance_notices(reports: DataFrame) -> DataFrame:
    """One in-app notice to the requester of each finished report."""
    return reports.filter(F.col("status").isin("completed", "failed")).select(
        "report_id", F.col("created_by").alias("user_id"),
        F.lit("processing_complete").alias("event_type"), F.lit("in_app").alias("channel"),
        F.to_json(F.struct(
            F.col("report_id").cast("string").alias("report_id"), "status", "total", "failed"
        )).alias("payload"))


def digest_bucket(days: Column, severity: Column | str) -> Column:
    grave = (F.col(severity) if isinstance(severity, str) else severity).isin("critical", "high")
    return F.when((days <= 7) & grave, BUCKETS[0]).when(days <= 14, BUCKETS[1]).otherwise(BUCKETS[2])


def digest_items(
    users: DataFrame, assignments: DataFrame, assets: DataFrame, documents: DataFrame,
    obligations: DataFrame, today: Column, window_days: int = 30,
) -> DataFrame:
    """Obligations due within the window for every active user with the digest on.

    The date window is the most selective filter and reaches the scan of the
    obligations; what is left meets documents and assignments.
    """
    due = obligations.filter(
        F.col("due_date").between(today, F.date_add(today, window_days))
        & F.col("status").isin("confirmed", "needs_review")
    ).select("obligation_id", "document_id", "obligation_text", "due_date", "severity")
    readers = users.filter(
        F.col("is_active") & F.col("digest_enabled") & (F.coalesce("email", F.lit("")) != "")
    ).select("user_id", "email")
    names = assets.select("asset_id", F.col("name").alias("asset_name"))
    days = F.datediff("due_date", today)
    return (
        due.join(documents.select("document_id", "asset_id"), "document_id")
        .join(assignments.select("user_id", "asset_id").distinct(), "asset_id")
        .join(readers, "user_id").join(names, "asset_id", "left")
        .select(
            "user_id", "email", "obligation_id",
            F.coalesce("asset_name", F.lit("(unknown asset)")).alias("asset_name"),
            "obligation_text", "due_date", "severity", days.alias("days_left"),
            digest_bucket(days, "severity").alias("bucket"))
    )


def weekly_digest(items: DataFrame, product: str = "weekly digest") -> DataFrame:
    """One row per user with anything due: subject, counts and the ordered items per bucket.

    A digest is one message, so its items are one array; they are bounded by what falls
    due for a user within the window.
    """
    rank = rank_of("severity", SEVERITY_RANK)
    entry = F.struct("due_date", (-rank).alias("order"), "obligation_id", "asset_name",
                     "obligation_text", "severity")
    listed = {
        b: F.transform(
            F.sort_array(F.collect_list(F.when(F.col("bucket") == b, entry))),
            lambda e: e.dropFields("order"))
        for b in BUCKETS
    }
    total = F.count(F.lit(1))
    critical = F.count_if(F.col("bucket") == BUCKETS[0])
    subject = F.when(
        critical > 0, F.format_string("%d critical obligations due this week", critical)
    ).otherwise(F.format_string("Your " + product + " \u2014 %d obligations approaching", total))
    return items.groupBy("user_id", F.col("email").alias("recipient")).agg(
        total.alias("item_count"), critical.alias("critical_count"), subject.alias("subject"),
        *(c.alias(b) for b, c in listed.items()))


def approaching_deadlines(obligations: DataFrame, today: Column, days: tuple[int, ...] = (7, 1)) -> DataFrame:
    """Open obligations due in exactly the given numbers of days (specified, off by default)."""
    wanted = [F.date_add(today, d) for d in days]
    return obligations.filter(F.col("due_date").isin(*wanted) & (F.col("status") != "rejected")).select(
        "obligation_id", "document_id", "due_date", F.datediff("due_date", today).alias("days_left"))


def awaiting_review(obligations: DataFrame, documents: DataFrame) -> DataFrame:
    """Items awaiting review per asset."""
    waiting = obligations.filter(F.col("status") == "needs_review").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"))
    return waiting.join(documents.select("document_id", "asset_id"), "document_id").groupBy("asset_id").agg(
        F.sum("n").alias("awaiting_review"))
