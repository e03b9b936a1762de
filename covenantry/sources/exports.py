"""Row exports and ground-truth files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from covenantry.operators.listing import in_scope, list_obligations, list_risks, resolve_export_rows
from covenantry.schema import OBLIGATION_EXPORT_COLUMNS, RISK_EXPORT_COLUMNS


class ExportTooLarge(ValueError):
    pass


def _iso(name: str):
    """ISO date or date-time text; whole seconds carry no fraction."""
    return F.regexp_replace(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def export_rows(
    items: DataFrame, documents: DataFrame, assets: DataFrame, evidence: DataFrame,
    reviews: DataFrame, users: DataFrame, *, kind: str = "obligation",
) -> DataFrame:
    """All columns as text in their fixed order, empty where there is no value."""
    key = f"{kind}_id"
    df = resolve_export_rows(items, documents, assets, evidence, reviews, users, key=key)
    df = df.withColumns({
        "id": F.col(key), "text": F.col(f"{kind}_text"),
        "severity": F.coalesce("llm_severity", "severity"),
        "created_at": _iso("created_at") if dict(df.dtypes)["created_at"] != "date"
        else F.date_format("created_at", "yyyy-MM-dd"),
        "last_reviewed_at": _iso("last_reviewed_at"),
    })
    if kind == "obligation":
        df = df.withColumn("deadline", F.date_format("due_date", "yyyy-MM-dd"))
    columns = OBLIGATION_EXPORT_COLUMNS if kind == "obligation" else RISK_EXPORT_COLUMNS
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def check_row_cap(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Refuse, before anything is resolved, a list that is longer than an export may be."""
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise ExportTooLarge(f"Export exceeds {max_rows} rows; tighten filters")
    return rows


def export_list(
    items: DataFrame, documents: DataFrame, assets: DataFrame, evidence: DataFrame, reviews: DataFrame,
    users: DataFrame, assignments: DataFrame, *, user_id, role: str, kind: str = "obligation", asset_id=None,
    status=None, severity=None, risk_type=None, document_id=None, max_rows: int | None = None,
) -> DataFrame:
    """The export rows that a user may see and asks for: filters and scope first, so look-ups meet only what is left."""
    chosen = {"status": status, "severity": severity, "document_id": document_id}
    if kind == "risk":
        rows = list_risks(items, risk_type=risk_type, **chosen)
    else:
        rows = list_obligations(items, **chosen)
    rows = check_row_cap(in_scope(rows, documents, assignments, user_id=user_id, role=role, asset_id=asset_id), max_rows)
    return export_rows(rows, documents, assets, evidence, reviews, users, kind=kind)


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """One header per part file, CRLF line ends, doubled quotes, newest first."""
    ordered = rows.orderBy(*(F.col(c).desc() if c == "created_at" else F.col(c) for c in (order or ("created_at", "id"))))
    ordered.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option(
        "escape", '"').option("emptyValue", "").csv(path)


def client_rows(items: DataFrame, kind: str = "obligation") -> DataFrame:
    """The short list a client downloads: 7 columns for obligations, 6 for risks."""
    confidence = F.coalesce("llm_quality_confidence", "system_confidence").cast("string")
    columns = [
        F.col(f"{kind}_text").alias(kind.capitalize()), F.col(f"{kind}_type").alias("Type"),
        F.col("severity").alias("Severity"), F.col("llm_severity").alias("LLM Severity"),
        F.col("status").alias("Status"), confidence.alias("Confidence")]
    if kind == "obligation":
        columns.append(F.date_format("due_date", "yyyy-MM-dd").alias("Due Date"))
    rows = items.select(*columns)
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))


# --- ground truth ---------------------------------------------------------------------

_ITEM = T.StructType([
    T.StructField("quote", T.StringType()), T.StructField("obligation_type", T.StringType()),
    T.StructField("risk_type", T.StringType()), T.StructField("modality", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("page_hint", T.IntegerType()),
])
TRUTH_SCHEMA = T.StructType([
    T.StructField("document_id", T.LongType()),
    T.StructField("obligations", T.ArrayType(_ITEM)), T.StructField("risks", T.ArrayType(_ITEM)),
])


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, kind, item_no, fields) from one JSON document per file or per line."""
    docs = spark.read.schema(TRUTH_SCHEMA).json(path)
    parts = [
        docs.select("document_id", F.lit(kind).alias("kind"), F.posexplode(column).alias("item_no", "i"))
        .select("document_id", "kind", "item_no", "i.*")
        for kind, column in (("obligation", "obligations"), ("risk", "risks"))]
    return parts[0].unionByName(parts[1])


def write_ground_truth(items: DataFrame, path: str) -> None:
    """The inverse: one JSON document per line, items in order.

    Curation reads the saved original and writes elsewhere, so repeating it changes nothing.
    """
    entry = F.struct("item_no", *(c.name for c in _ITEM.fields))

    def listed(kind: str):
        picked = F.collect_list(F.when(F.col("kind") == kind, entry))
        return F.transform(F.sort_array(picked), lambda e: e.dropFields("item_no"))

    items.groupBy("document_id").agg(
        listed("obligation").alias("obligations"), listed("risk").alias("risks")
    ).write.mode("overwrite").json(path)
