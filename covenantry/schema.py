"""Closed string domains, ordered ranks and table schemas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The closed domains of the data model.
USER_ROLES = ("admin", "reviewer", "viewer")
DOCUMENT_TYPES = (
    "contract", "lease", "inspection_report", "rfi", "change_order", "invoice",
    "purchase_agreement", "title_commitment", "hoa_document", "disclosure_report",
    "insurance_policy", "loan_agreement", "deed_of_trust", "unknown",
)
PARSE_STATUSES = (
    "uploaded", "parsing", "ocr", "chunking", "classification", "extraction",
    "verification", "critic_review", "scoring", "rescoring", "complete",
    "partially_processed", "failed",
)
TEXT_SOURCES = ("pdf_text", "ocr")
PAGE_STATUSES = ("pending", "processed", "failed")
SPLIT_REASONS = ("full_page", "section_split", "token_limit")
STAGES = (
    "classification", "entity_extraction", "obligation_extraction",
    "risk_extraction", "critic_detection",
)
RUN_STATUSES = ("running", "completed", "failed", "superseded")
OBLIGATION_TYPES = ("compliance", "submission", "payment", "inspection", "notification", "other")
MODALITIES = ("must", "shall", "required", "should", "may", "unknown")
DUE_KINDS = ("absolute", "relative", "resolved_relative", "none")
SEVERITIES = ("low", "medium", "high", "critical")
REVIEW_STATUSES = ("needs_review", "confirmed", "rejected")
RISK_TYPES = (
    "financial", "schedule", "quality", "safety", "compliance", "contractual", "unknown_risk",
)
REVIEW_DECISIONS = ("approve", "reject", "edit_approve")
SECTION_LABELS = ("agreement_body", "non_agreement")
RESULT_STATUSES = ("pass", "fail", "warning", "not_applicable")

SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
# Order of review states in lists.
STATUS_RANK = {"rejected": 1, "confirmed": 2, "needs_review": 3}

# Stage -> percent shown while a document is under way.
STAGE_PROGRESS = {
    "uploaded": 5, "parsing": 20, "ocr": 30, "chunking": 45, "classification": 60,
    "extraction": 72, "verification": 84, "critic_review": 88, "scoring": 92,
    "rescoring": 96, "partially_processed": 100, "complete": 100, "failed": 100,
}
TERMINAL_STATUSES = ("complete", "partially_processed", "failed")

# Fields that a review may edit.
EDITABLE_OBLIGATION_FIELDS = (
    "obligation_text", "responsible_entity_id", "due_rule", "due_date",
    "trigger_date", "severity", "modality",
)
EDITABLE_RISK_FIELDS = ("risk_text", "risk_type", "severity")

# Export columns in their order.
OBLIGATION_EXPORT_COLUMNS = (
    "id", "asset_name", "document_filename", "obligation_type", "text", "severity",
    "system_confidence", "llm_quality_confidence", "status", "deadline",
    "evidence_quote", "evidence_page_number", "evidence_char_start",
    "evidence_char_end", "created_at", "last_reviewed_at", "reviewer_email",
)
RISK_EXPORT_COLUMNS = (
    "id", "asset_name", "document_filename", "risk_type", "text", "severity",
    "system_confidence", "llm_quality_confidence", "status",
    "evidence_quote", "evidence_page_number", "evidence_char_start",
    "evidence_char_end", "created_at", "last_reviewed_at", "reviewer_email",
)


def rank_of(col: Column | str, ranks: dict[str, int], default: int = 0) -> Column:
    """Ordinal of a closed-domain value, as a JVM-side CASE."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for value, rank in ranks.items():
        expr = F.when(c == value, rank) if expr is None else expr.when(c == value, rank)
    return expr.otherwise(default)


PAGE_SCHEMA = T.StructType([
    T.StructField("document_id", T.LongType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("normalized_text", T.StringType()),
    T.StructField("text_source", T.StringType()),
    T.StructField("text_sha256", T.StringType()),
    T.StructField("has_tables", T.BooleanType()),
    T.StructField("processing_status", T.StringType()),
    T.StructField("processing_error", T.StringType()),
])

OBLIGATION_ANSWER = T.ArrayType(T.StructType([
    T.StructField("quote", T.StringType()),
    T.StructField("obligation_type", T.StringType()),
    T.StructField("modality", T.StringType()),
    T.StructField("severity", T.StringType()),
    # Only strings count in these two, so their JSON type is kept.
    T.StructField("due_date", T.VariantType()),
    T.StructField("due_rule", T.VariantType()),
    T.StructField("responsible_party", T.StringType()),
]))

RISK_ANSWER = T.ArrayType(T.StructType([
    T.StructField("quote", T.StringType()),
    T.StructField("risk_text", T.StringType()),
    T.StructField("risk_type", T.StringType()),
    T.StructField("severity", T.StringType()),
]))

MENTION_ANSWER = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("entity_value", T.StringType()),
    T.StructField("page_number", T.StringType()),
]))

VERDICT_ANSWER = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    # Only true and false count, so its JSON type is kept.
    T.StructField("valid", T.VariantType()),
    T.StructField("confidence", T.VariantType()),
    T.StructField("reasoning", T.StringType()),
]))

RESCORE_ANSWER = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("revised_severity", T.StringType()),
    T.StructField("quality_confidence", T.VariantType()),
]))

COMPLIANCE_REPORT = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("ruleId", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("requirement", T.StringType()),
        T.StructField("elementExpressId", T.LongType()),
        T.StructField("elementType", T.StringType()),
        T.StructField("elementName", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("actualValue", T.StringType()),
        T.StructField("message", T.StringType()),
    ]))),
    T.StructField("summary", T.StructType([
        T.StructField("total", T.LongType()),
        T.StructField("passed", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("warnings", T.LongType()),
        T.StructField("notApplicable", T.LongType()),
    ])),
])
