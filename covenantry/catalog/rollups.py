"""Roll-ups per asset, document and run."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.operators import rollups as R
from covenantry.plans.scoring import review_backlog

_ROLLUP = """
select a.asset_id, a.name, coalesce(d.n, 0) as document_count, coalesce(o.n, 0) as obligation_count, coalesce(r.n, 0) as risk_count,
  coalesce(o.pending, 0)::bigint as pending_review_count from {assets} a
left join (select asset_id, count(*) as n from {docs} group by asset_id) d on d.asset_id = a.asset_id
left join (select asset_id, count(*) as n, sum(case when o.status = 'needs_review' then 1 else 0 end) as pending
           from {docs} d join {obligations} o on o.document_id = d.document_id group by asset_id) o on o.asset_id = a.asset_id
left join (select asset_id, count(*) as n from {docs} d join {risks} r on r.document_id = d.document_id group by asset_id) r on r.asset_id = a.asset_id"""


@query("E1_asset_rollup", _ROLLUP)
def asset_rollup(fx):
    return R.asset_rollup(fx.assets, fx.docs, fx.obligations, fx.risks)


@query("E2_asset_detail", _ROLLUP + " where a.asset_id = 7")
def asset_detail(fx):
    return R.asset_detail(fx.assets, fx.docs, fx.obligations, fx.risks, 7)


_METRICS = """
with t as (select asset_id, count(*) as documents_total from {docs} group by asset_id),
o as (select asset_id, count(*) as n, count(*) filter (where status = 'needs_review') as open, count(*) filter (where status = 'confirmed') as confirmed,
        count(*) filter (where status = 'rejected') as rejected from {docs} join {obligations} using (document_id) group by asset_id),
r as (select asset_id, count(*) as n, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'critical') as critical
      from {docs} join {risks} using (document_id) group by asset_id)"""


@query("E3_weekly_metrics", _METRICS + """
select t.asset_id, documents_total, coalesce(o.n, 0) as obligations_total, coalesce(r.n, 0) as risks_total, nullif(open, 0) as needs_review,
  nullif(confirmed, 0) as confirmed, nullif(rejected, 0) as rejected, nullif(high, 0) as high, nullif(critical, 0) as critical
from t left join o on o.asset_id = t.asset_id left join r on r.asset_id = t.asset_id""")
def weekly_metrics(fx):
    m = R.weekly_metrics(fx.docs, fx.obligations, fx.risks)
    return m.select(
        "asset_id", "documents_total", "obligations_total", "risks_total",
        *(F.try_element_at("obligations_by_status", F.lit(s)).alias(s) for s in ("needs_review", "confirmed", "rejected")),
        *(F.try_element_at("risks_by_severity", F.lit(s)).alias(s) for s in ("high", "critical")))


@query("E3_weekly_metrics_of_admin", _METRICS + """
select t.asset_id, documents_total, coalesce(o.n, 0) as obligations_total, coalesce(r.n, 0) as risks_total
from t left join o on o.asset_id = t.asset_id left join r on r.asset_id = t.asset_id
where t.asset_id in (select asset_id from {assets} where created_by = 5)""")
def weekly_metrics_admin(fx):
    return R.weekly_metrics(fx.docs, fx.obligations, fx.risks, assets=fx.assets, admin_id=5).drop(
        "obligations_by_status", "risks_by_severity")


@query("E4_weekly_narrative", _METRICS + """
select t.asset_id, 'Processed ' || documents_total || ' documents with ' || coalesce(o.n, 0) || ' obligations and ' || coalesce(r.n, 0)
  || ' risks.' as narrative from t left join o on o.asset_id = t.asset_id left join r on r.asset_id = t.asset_id""")
def narrative(fx):
    return R.weekly_narrative(R.weekly_metrics(fx.docs, fx.obligations, fx.risks))


@query("E5_document_status", """
select d.document_id, d.parse_status, d.total_pages, coalesce(p.done, 0) as pages_processed, coalesce(p.failed, 0) as pages_failed
from {docs} d left join (select document_id, count(*) filter (where processing_status = 'processed') as done,
  count(*) filter (where processing_status = 'failed') as failed from {pages_doc} group by document_id) p on p.document_id = d.document_id""")
def status(fx):
    return R.document_status(fx.docs, fx.pages_doc)


@query("E6_final_status", """
with p as (select document_id, count(*) as n from {pages_doc} where processing_status = 'failed' group by document_id),
r as (select document_id, count(*) as n from {runs} where status = 'failed' group by document_id),
d as (select document_id, case when asset_id % 10 = 0 then 'failed' else parse_status end as parse_status from {docs})
select d.document_id, case when parse_status = 'failed' then 'failed' when coalesce(p.n, 0) + coalesce(r.n, 0) > 0 then 'partially_processed'
    else 'complete' end as final_status,
  case when parse_status = 'failed' then 0 else coalesce(p.n, 0) end as failed_page_count,
  case when parse_status = 'failed' then 0 else coalesce(r.n, 0) end as failed_run_count
from d left join p on p.document_id = d.document_id left join r on r.document_id = d.document_id""")
def final(fx):
    docs = fx.docs.withColumn("parse_status", F.when(F.col("asset_id") % 10 == 0, "failed").otherwise(F.col("parse_status")))
    return R.final_status(docs, fx.pages_doc, fx.runs).select(
        "document_id", "final_status", "failed_page_count", "failed_run_count")


@query("E7_run_status", """
with c as (select user_id * 10 + event_id % 7 as run_id, event_id as call_no, case when event_type = 'view' then 1 else 0 end as succeeded,
             case when event_type in ('click', 'error') then 'timeout in call ' || event_id end as error from {events})
select run_id, sum(succeeded)::bigint as success_count, count(error) as error_count,
  case when sum(succeeded) = 0 and count(error) > 0 then 'failed' else 'completed' end as status,
  case when sum(succeeded) = 0 and count(error) > 0 then substr(arg_min(error, call_no) filter (where error is not null), 1, 1000) end as error
from c group by run_id""")
def runs(fx):
    kind = F.col("event_type")
    return R.run_status(fx.events.select(
        (F.col("user_id") * 10 + F.col("event_id") % 7).alias("run_id"), F.col("event_id").alias("call_no"),
        F.when(kind == "view", 1).otherwise(0).alias("succeeded"),
        F.when(kind.isin("click", "error"), F.concat(F.lit("timeout in call "), F.col("event_id").cast("string"))).alias("error")))


@query("E8_verify_breakdown", """
with o as (select o.document_id, e.verification_method, o.d >= 0.05 and e.evidence_id is not null as deduped,
             contains(lower(o.obligation_text), 'pursuant to') as ext
           from {obligations} o left join {evidence} e on e.obligation_id = o.obligation_id)
select document_id, 'obligation' as kind, count(*) as total, count(*) filter (where verification_method = 'exact' and not deduped) as exact,
  count(*) filter (where verification_method = 'sentence' and not deduped) as sentence,
  count(*) filter (where verification_method = 'fuzzy' and not deduped) as fuzzy,
  count(*) filter (where verification_method is null) as rejected_quote_mismatch, count(*) filter (where deduped) as deduped,
  count(*) filter (where ext) as external_ref from o group by document_id""")
def verify_breakdown(fx):
    from covenantry.functions.text import has_external_reference
    found = fx.evidence.select("obligation_id", "verification_method")
    items = fx.obligations.join(found, "obligation_id", "left").select(
        "document_id", F.lit("obligation").alias("kind"), "verification_method",
        ((F.col("d") >= 0.05) & F.col("verification_method").isNotNull()).alias("deduped"),
        has_external_reference("obligation_text").alias("has_external_reference"))
    return R.verify_breakdown(items)


@query("E9_score_counts", """
select document_id, 'obligation' as kind, count(*) filter (where status = 'needs_review') as needs_review,
  count(*) filter (where status = 'rejected') as rejected from {obligations} group by document_id
union all
select document_id, 'risk', count(*) filter (where status = 'needs_review'), count(*) filter (where status = 'rejected')
from {risks} group by document_id""")
def score_counts(fx):
    items = fx.obligations.select("document_id", F.lit("obligation").alias("kind"), "status").unionByName(
        fx.risks.select("document_id", F.lit("risk").alias("kind"), "status"))
    return R.score_counts(items)


@query("E10_diagnose_document", """
with p as (select document_id, count(*) as pages, count(*) filter (where processing_status = 'processed') as pages_processed,
             count(*) filter (where processing_status = 'failed') as pages_failed, avg(length(raw_text)) as avg_raw_len,
             avg(length(normalized_text)) as avg_normalized_len from {stripped_pages} group by document_id),
c as (select document_id, count(*) as chunks, avg(length(text)) as avg_chunk_len, count(*) filter (where section_label = 'agreement_body') as agreement_body,
        count(*) filter (where section_label = 'non_agreement') as non_agreement, count(*) filter (where section_label is null) as unlabeled
      from {stripped_labels} group by document_id),
o as (select document_id, count(*) as n from {obligations} group by document_id),
r as (select document_id, count(*) as n from {risks} group by document_id)
select d.document_id, coalesce(pages, 0) as pages, coalesce(pages_processed, 0) as pages_processed, coalesce(pages_failed, 0) as pages_failed,
  avg_raw_len, avg_normalized_len, coalesce(chunks, 0) as chunks, avg_chunk_len, coalesce(agreement_body, 0) as agreement_body,
  coalesce(non_agreement, 0) as non_agreement, coalesce(unlabeled, 0) as unlabeled, coalesce(o.n, 0) as obligations, coalesce(r.n, 0) as risks
from {docs} d left join p on p.document_id = d.document_id left join c on c.document_id = d.document_id
left join o on o.document_id = d.document_id left join r on r.document_id = d.document_id""")
def diagnose(fx):
    return R.diagnose_documents(fx.docs, fx.pages_doc, fx.labeled_chunks, fx.obligations, fx.risks).drop(
        "pages_pending", "from_pdf_text", "from_ocr")


@query("E10_run_outputs", """
select event_id as run_id, cast(event_id % 4 as int) as outputs, cast(case when event_type = 'error' then 1 else 0 end as int) as errors from {events}""")
def run_outputs(fx):
    listed = F.array_repeat(F.struct(F.col("event_type").alias("kind")), (F.col("event_id") % 4).cast("int"))
    errors = F.array_repeat(F.struct(F.col("props").alias("error")), F.when(F.col("event_type") == "error", 1).otherwise(0))
    raw = fx.events.select(
        F.col("event_id").alias("run_id"), F.to_json(F.struct(listed.alias("outputs"), errors.alias("errors"))).alias("raw_llm_output"))
    return R.run_outputs(raw).drop("raw_llm_output")


@query("E11_documents_overview", """
select d.document_id, d.source_name, d.parse_status, d.total_pages, d.uploaded_at, coalesce(c.n, 0) as chunks, coalesce(o.n, 0) as obligations
from {docs} d left join (select document_id, count(*) as n from {stripped_chunks} group by document_id) c on c.document_id = d.document_id
left join (select document_id, count(*) as n from {obligations} group by document_id) o on o.document_id = d.document_id""")
def overview(fx):
    return R.documents_overview(fx.docs, fx.chunks, fx.obligations)


@query("E12_compliance_summary", """
select l_orderkey as report_id, count(*) as total, count(*) filter (where l_returnflag = 'A') as passed, count(*) filter (where l_returnflag = 'R') as failed,
  count(*) filter (where l_returnflag = 'N' and l_linestatus = 'F') as not_applicable,
  count(*) filter (where l_returnflag = 'N' and l_linestatus <> 'F') as warnings from {lineitem} group by l_orderkey""")
def compliance(fx):
    flag = F.col("l_returnflag")
    results = fx.lineitem.select(
        F.col("l_orderkey").alias("report_id"),
        F.when(flag == "A", "pass").when(flag == "R", "fail").when(F.col("l_linestatus") == "F", "not_applicable")
        .otherwise("warning").alias("status"))
    return R.compliance_summary(results)


@query("E13_section_label_counts", """
select document_id, section_label, count(*) as chunks from {labeled_chunks} group by document_id, section_label""")
def label_counts(fx):
    return R.label_counts(fx.labeled_chunks)


@query("E14_evidence_pages", """
with r as (select r.risk_id, list_sort(list(distinct e.page_number)) as p from {risks} r
           join (select user_id as document_id, cast(event_id % 9 + 1 as int) as page_number from {events} where value >= 50) e
             on e.document_id = r.document_id where r.risk_type = 'safety' group by r.risk_id)
select r.risk_id, coalesce(array_to_string(p, ', '), 'none') as evidence_pages from {risks} r left join r x on x.risk_id = r.risk_id""")
def evidence_pages(fx):
    marks = fx.events.filter(F.col("value") >= 50).select(
        F.col("user_id").alias("document_id"), (F.col("event_id") % 9 + 1).cast("int").alias("page_number")).distinct()
    proof = fx.risks.filter(F.col("risk_type") == "safety").select("risk_id", "document_id").join(marks, "document_id")
    return R.evidence_pages(fx.risks, proof, "risk_id")


@query("E15_elevated_risks", """
select document_id, count(*) filter (where severity in ('high', 'critical')) as high_or_critical_count from {risks} group by document_id""")
def elevated(fx):
    return R.elevated_risks(fx.risks)


@query("flagship_review_backlog")
def backlog(fx):
    return review_backlog(fx.assets, fx.docs, fx.obligations, fx.evidence)
