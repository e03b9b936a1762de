"""Aggregations per asset, document and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from covenantry.functions.text import is_blank, normalize_text


def _zero(*names: str):
    return [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]


def _count(name: str):
    return F.count(F.lit(1)).alias(name)


def asset_rollup(
    assets: DataFrame, documents: DataFrame, obligations: DataFrame, risks: DataFrame
) -> DataFrame:
    """Counts per asset, zero where it has none, by name.

    Children are counted per document before they meet the documents, so no
    join fans out and a huge document is folded map-side first.
    """
    per_obligation = obligations.groupBy("document_id").agg(
        _count("obligation_count"),
        F.count_if(F.col("status") == "needs_review").alias("pending_review_count"),
    )
    per_risk = risks.groupBy("document_id").agg(_count("risk_count"))
    per_asset = (
        documents.select("document_id", "asset_id")
        .join(per_obligation, "document_id", "left").join(per_risk, "document_id", "left")
        .groupBy("asset_id").agg(
            _count("document_count"),
            F.sum("obligation_count").alias("obligation_count"),
            F.sum("risk_count").alias("risk_count"),
            F.sum("pending_review_count").alias("pending_review_count"),
        )
    )
    counts = ("document_count", "obligation_count", "risk_count", "pending_review_count")
    return (
        assets.select("asset_id", "name").join(per_asset, "asset_id", "left")
        .select("asset_id", "name", *_zero(*counts)).orderBy("name", "asset_id")
    )


def asset_detail(
    assets: DataFrame, documents: DataFrame, obligations: DataFrame, risks: DataFrame, asset_id
) -> DataFrame:
    mine = documents.filter(F.col("asset_id") == F.lit(asset_id))
    keys = mine.select("document_id")
    return asset_rollup(
        assets.filter(F.col("asset_id") == F.lit(asset_id)), mine,
        obligations.join(keys, "document_id", "left_semi"),
        risks.join(keys, "document_id", "left_semi"),
    )


def _tally(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Per key a JSON object {value: count}; folds twice, so groups hold domain values only."""
    return (
        df.groupBy(*keys, column).agg(_count("n"))
        .groupBy(*keys).agg(
            F.sum("n").alias(name + "_total"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct(F.coalesce(column, F.lit("None")), "n")))
            ).alias(name),
        )
    )


def weekly_metrics(
    documents: DataFrame, obligations: DataFrame, risks: DataFrame, *, asset_id=None,
    assets: DataFrame | None = None, admin_id=None,
) -> DataFrame:
    """Totals per asset with obligations by status and risks by severity.

    Restricted to one asset, or to the assets created by one admin.
    """
    docs = documents.select("document_id", "asset_id")
    if asset_id is not None:
        docs = docs.filter(F.col("asset_id") == F.lit(asset_id))
    elif admin_id is not None:
        owned = assets.filter(F.col("created_by") == F.lit(admin_id)).select("asset_id")
        docs = docs.join(owned, "asset_id", "left_semi")
    total = docs.groupBy("asset_id").agg(_count("documents_total"))
    by_status = _tally(docs.join(obligations, "document_id"), ["asset_id"], "status", "obligations")
    by_severity = _tally(docs.join(risks, "document_id"), ["asset_id"], "severity", "risks")
    empty = F.create_map().cast("map<string,bigint>")
    return (
        total.join(by_status, "asset_id", "left").join(by_severity, "asset_id", "left").select(
            "asset_id", "documents_total", *_zero("obligations_total", "risks_total"),
            F.coalesce("obligations", empty).alias("obligations_by_status"),
            F.coalesce("risks", empty).alias("risks_by_severity"),
        )
    )


def weekly_narrative(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "asset_id",
        F.format_string(
            "Processed %d documents with %d obligations and %d risks.",
            "documents_total", "obligations_total", "risks_total",
        ).alias("narrative"),
    )


def page_progress(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(
        F.count_if(F.col("processing_status") == "processed").alias("pages_processed"),
        F.count_if(F.col("processing_status") == "failed").alias("pages_failed"),
    )


def document_status(documents: DataFrame, pages: DataFrame) -> DataFrame:
    return documents.select("document_id", "parse_status", "total_pages").join(
        page_progress(pages), "document_id", "left"
    ).select("document_id", "parse_status", "total_pages", *_zero("pages_processed", "pages_failed"))


def final_status(documents: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """failed stays; any failed page or run -> partially_processed; else complete."""
    bad_pages = pages.filter(F.col("processing_status") == "failed").groupBy("document_id").agg(
        _count("failed_page_count")
    )
    bad_runs = runs.filter(F.col("status") == "failed").groupBy("document_id").agg(
        _count("failed_run_count")
    )
    counts = ("failed_page_count", "failed_run_count")
    df = documents.join(bad_pages, "document_id", "left").join(bad_runs, "document_id", "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    failed = F.col("parse_status") == "failed"
    trouble = (F.col("failed_page_count") > 0) | (F.col("failed_run_count") > 0)
    return df.withColumns({
        "final_status": F.when(failed, "failed").when(trouble, "partially_processed")
        .otherwise("complete"),
        **{c: F.when(failed, 0).otherwise(F.col(c)).cast("long") for c in counts},
    })


def run_status(calls: DataFrame) -> DataFrame:
    """Per run: completed on any success or no error, else failed with the first error.

    ``calls``: run_id, call_no, succeeded (count of results), error.
    """
    errors = F.count("error")
    successes = F.sum(F.coalesce("succeeded", F.lit(0)))
    failed = (successes == 0) & (errors > 0)
    first_error = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("call_no")))
    return calls.groupBy("run_id").agg(
        successes.cast("long").alias("success_count"), errors.alias("error_count"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.substring(first_error, 1, 1000)).alias("error"),
    )


def verify_breakdown(verified: DataFrame) -> DataFrame:
    """Per document and kind: how the quotes of the items were found."""
    method = F.col("verification_method")
    kept = ~F.col("deduped")
    return verified.groupBy("document_id", "kind").agg(
        _count("total"),
        *(F.count_if((method == m) & kept).alias(m) for m in ("exact", "sentence", "fuzzy")),
        F.count_if(method.isNull()).alias("rejected_quote_mismatch"),
        F.count_if(F.col("deduped")).alias("deduped"),
        F.count_if(F.col("has_external_reference")).alias("external_ref"),
    )


def score_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("document_id", "kind").agg(
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )


def page_diagnosis(pages: DataFrame) -> DataFrame:
    status, source = F.col("processing_status"), F.col("text_source")
    return pages.groupBy("document_id").agg(
        _count("pages"),
        *(F.count_if(status == s).alias("pages_" + s) for s in ("pending", "processed", "failed")),
        *(F.count_if(source == s).alias("from_" + s) for s in ("pdf_text", "ocr")),
        F.avg(F.length("raw_text")).alias("avg_raw_len"),
        F.avg(F.length("normalized_text")).alias("avg_normalized_len"),
    )


def chunk_diagnosis(chunks: DataFrame) -> DataFrame:
    label = F.col("section_label")
    return chunks.groupBy("document_id").agg(
        _count("chunks"), F.avg(F.length("text")).alias("avg_chunk_len"),
        F.count_if(label == "agreement_body").alias("agreement_body"),
        F.count_if(label == "non_agreement").alias("non_agreement"),
        F.count_if(label.isNull()).alias("unlabeled"),
    )


def diagnose_documents(
    documents: DataFrame, pages: DataFrame, chunks: DataFrame, obligations: DataFrame,
    risks: DataFrame,
) -> DataFrame:
    df = documents.select("document_id")
    for part in (
        page_diagnosis(pages), chunk_diagnosis(chunks),
        obligations.groupBy("document_id").agg(_count("obligations")),
        risks.groupBy("document_id").agg(_count("risks")),
    ):
        df = df.join(part, "document_id", "left")
    numbers = [c for c in df.columns if c != "document_id" and not c.startswith("avg_")]
    return df.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers})


def run_outputs(runs: DataFrame) -> DataFrame:
    """Numbers of outputs and errors held in the raw answer of each run."""
    def size_of(path: str):
        return F.coalesce(F.json_array_length(F.get_json_object("raw_llm_output", path)), F.lit(0))

    return runs.withColumns({"outputs": size_of("$.outputs"), "errors": size_of("$.errors")})


def documents_overview(documents: DataFrame, chunks: DataFrame, obligations: DataFrame) -> DataFrame:
    return (
        documents.join(chunks.groupBy("document_id").agg(_count("chunks")), "document_id", "left")
        .join(obligations.groupBy("document_id").agg(_count("obligations")), "document_id", "left")
        .select("document_id", "source_name", "parse_status", "total_pages", "uploaded_at",
                *_zero("chunks", "obligations"))
        .orderBy(F.col("uploaded_at").desc(), "document_id")
    )


def compliance_summary(results: DataFrame) -> DataFrame:
    status = F.col("status")
    return results.groupBy("report_id").agg(
        _count("total"),
        *(F.count_if(status == s).alias(n) for s, n in (
            ("pass", "passed"), ("fail", "failed"), ("warning", "warnings"),
            ("not_applicable", "not_applicable"))),
    )


def label_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id", "section_label").agg(_count("chunks"))


def evidence_pages(items: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Sorted distinct pages per item as text, 'none' where it has no evidence."""
    pages = (
        evidence.select(key, "page_number").distinct().groupBy(key)
        .agg(F.array_join(F.sort_array(F.collect_list("page_number")), ", ").alias("pages"))
    )
    return items.select(key).join(pages, key, "left").select(
        key, F.coalesce("pages", F.lit("none")).alias("evidence_pages")
    )


def elevated_risks(risks: DataFrame) -> DataFrame:
    return risks.groupBy("document_id").agg(
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_or_critical_count")
    )


# --- latest per group --------------------------------------------------------------

def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run per document and stage."""
    return runs.groupBy("document_id", "stage").agg(
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("latest_run_id")
    )


def keep_latest_run(items: DataFrame, runs: DataFrame, stage: str) -> DataFrame:
    """Drop items of older runs of the stage; items without a run always stay."""
    latest = latest_runs(runs.filter(F.col("stage") == stage)).drop("stage")
    run, last = F.col("extraction_run_id"), F.col("latest_run_id")
    return (
        items.join(latest, "document_id", "left")
        .filter(run.isNull() | last.isNull() | (run == last)).drop("latest_run_id")
    )


def active_prompt(prompts: DataFrame) -> DataFrame:
    """Highest active version per name and the number the next version would get."""
    return prompts.groupBy("prompt_name").agg(
        F.max(F.when(F.col("is_active"), F.col("version"))).alias("active_version"),
        (F.max("version") + 1).alias("next_version"),
    )


def recent_runs(runs: DataFrame, k: int = 12) -> DataFrame:
    w = W.partitionBy("document_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return runs.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= k)


def sample_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    """First n non-blank pages per document, normalised text preferred over raw.

    Pages without normalised text are normalised once they are chosen: blank text stays blank by it, and no other gets blank.
    """
    text, stored = F.col("raw_text"), "normalized_text" in pages.columns
    if stored:
        text = F.when(F.col("normalized_text") != "", F.col("normalized_text")).otherwise(text)
    rows = pages.withColumn("sample_text", text).filter(~is_blank("sample_text"))
    w = W.partitionBy("document_id").orderBy("page_number")
    first = rows.withColumn("sample_no", F.row_number().over(w)).filter(F.col("sample_no") <= n)
    return first if stored else first.withColumn("sample_text", normalize_text("sample_text"))


def snapshot_state(
    documents: DataFrame, obligations: DataFrame, risks: DataFrame, chunks: DataFrame,
    runs: DataFrame, k: int = 30,
) -> DataFrame:
    """Per document: counts by status and by label, and the last k runs."""
    last = recent_runs(runs, k).groupBy("document_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(
                "recency", "stage", "model_used", "status", "started_at", "completed_at"))),
            lambda r: r.dropFields("recency"),
        ).alias("extraction_runs")
    )
    df = documents.select("document_id", "source_name", "doc_type")
    for frame, column, name in (
        (obligations, "status", "obligations_by_status"),
        (risks, "status", "risks_by_status"),
        (chunks, "section_label", "chunk_section_labels"),
    ):
        df = df.join(
            _tally(frame, ["document_id"], column, name).drop(name + "_total"),
            "document_id", "left",
        )
    return df.join(last, "document_id", "left")
