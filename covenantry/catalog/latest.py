"""First, last and top-k per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.operators import listing as L, pages as P, rollups as R


@query("F1_primary_evidence", """
select obligation_id, evidence_id, page_number from (select *, row_number() over (partition by obligation_id order by created_at, evidence_id) as n
  from (select obligation_id, evidence_id, page_number, created_at from {evidence} union all
        select obligation_id, evidence_id + 1, page_number + 1, created_at from {evidence}) e) x where n = 1""")
def primary(fx):
    twice = fx.evidence.select("obligation_id", "evidence_id", "page_number", "created_at")
    more = twice.withColumns({"evidence_id": F.col("evidence_id") + 1, "page_number": F.col("page_number") + 1})
    return L.primary_evidence(twice.unionByName(more), "obligation_id").drop("created_at")


@query("F2_last_review", """
select obligation_id, review_id, decision, decided_at from (
  select *, row_number() over (partition by obligation_id order by decided_at desc, review_id desc) as n from {reviews}) x where n = 1""")
def last(fx):
    return L.last_review(fx.reviews, "obligation_id").select("obligation_id", "review_id", "decision", "decided_at")


@query("F3_latest_runs", """
select document_id, stage, arg_max(run_id, (started_at, run_id)) as latest_run_id from {runs} group by document_id, stage""")
def latest(fx):
    return R.latest_runs(fx.runs)


@query("F3_keep_latest_run", """
with l as (select document_id, arg_max(run_id, (started_at, run_id)) as run_id from {runs} where stage = 'risk_extraction' group by document_id)
select r.risk_id, r.document_id, r.extraction_run_id from {risks} r left join l on l.document_id = r.document_id
where r.extraction_run_id is null or l.run_id is null or r.extraction_run_id = l.run_id""")
def keep(fx):
    return R.keep_latest_run(fx.risks, fx.runs, "risk_extraction").select("risk_id", "document_id", "extraction_run_id")


@query("F4_active_prompt_version", """
select event_type || '_' || (user_id % 40) as prompt_name, max(case when value >= 20 then event_id end) as active_version, max(event_id) + 1 as next_version
from {events} group by 1""")
def prompts(fx):
    return R.active_prompt(fx.events.select(
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 40).cast("string")).alias("prompt_name"),
        F.col("event_id").alias("version"), (F.col("value") >= 20).alias("is_active")))


@query("F5_sample_pages", """
select document_id, page_number, cast(n as int) as sample_no from (
  select *, row_number() over (partition by document_id order by page_number) as n from {pages_line}
  where trim(case when normalized_text <> '' then normalized_text else raw_text end, e' \\t\\r\\n') <> '') x where n <= 3""")
def sample(fx):
    return R.sample_pages(fx.pages_line).select("document_id", "page_number", "sample_no")


@query("F6_recent_runs", """
select document_id, run_id, cast(n as int) as recency from (
  select *, row_number() over (partition by document_id order by started_at desc, run_id desc) as n from {runs}) x where n <= 12""")
def recent(fx):
    return R.recent_runs(fx.runs, 12).select("document_id", "run_id", "recency")


@query("F7_group_chunks", """
with n as (select *, (row_number() over (partition by document_id order by page_number) - 1) // 5 as g from {pages_line}
           where normalized_text <> '')
select document_id, cast(g as int) as group_no, min(page_number) as first_page, max(page_number) as last_page, count(*) as chunks,
  string_agg('--- Page ' || page_number || ' ---' || chr(10) || normalized_text, chr(10) || chr(10) order by page_number) as text
from n group by document_id, g""")
def groups(fx):
    lines = fx.pages_line.filter(F.col("normalized_text") != "").select(
        "document_id", "page_number", F.lit(0).alias("char_start"), F.col("normalized_text").alias("text"))
    return P.group_chunks(lines)


@query("F8_item_batches", """
select risk_id, cast((row_number() over (partition by document_id order by created_at, risk_id) - 1) // 30 as int) as batch_index from {risks}""")
def batches(fx):
    return P.item_batches(fx.risks, 30, "created_at", "risk_id").select("risk_id", "batch_index")


@query("F9_full_text", """
select document_id, sha256(string_agg(case when normalized_text <> '' then normalized_text else raw_text end, chr(10) || chr(10) order by page_number)) as digest
from {pages_line} group by document_id""")
def full_text(fx):
    return P.full_text(fx.pages_line).select("document_id", F.sha2("full_text", 256).alias("digest"))


@query("A12_snapshot_state", """
with o as (select document_id, count(*) filter (where status = 'needs_review') as open, count(*) filter (where status = 'rejected') as rejected
           from {obligations} group by document_id),
r as (select document_id, count(*) filter (where status = 'confirmed') as confirmed from {risks} group by document_id),
c as (select document_id, count(*) filter (where section_label is null) as unlabeled from {labeled_chunks} group by document_id),
u as (select document_id, least(count(*), 30) as runs from {runs} group by document_id)
select d.document_id, nullif(open, 0) as obligations_open, nullif(rejected, 0) as obligations_rejected, nullif(confirmed, 0) as risks_confirmed,
  nullif(unlabeled, 0) as chunks_unlabeled, cast(coalesce(runs, 0) as int) as runs
from {docs} d left join o on o.document_id = d.document_id left join r on r.document_id = d.document_id
left join c on c.document_id = d.document_id left join u on u.document_id = d.document_id""")
def snapshot(fx):
    s = R.snapshot_state(fx.docs, fx.obligations, fx.risks, fx.labeled_chunks, fx.runs)

    def pick(column, key, name):
        return F.try_element_at(column, F.lit(key)).alias(name)

    return s.select(
        "document_id", pick("obligations_by_status", "needs_review", "obligations_open"),
        pick("obligations_by_status", "rejected", "obligations_rejected"),
        pick("risks_by_status", "confirmed", "risks_confirmed"),
        pick("chunk_section_labels", "None", "chunks_unlabeled"),
        F.coalesce(F.size("extraction_runs"), F.lit(0)).alias("runs"))


@query("A13_page_view", """
with w as (select doc_id as document_id, cast(1 as int) as page_number, text from {documents})
select w.document_id, w.page_number, cast(count(s.page_number) as int) as spans,
  coalesce(string_agg(s.page_number || ':' || length(s.raw_text), ',' order by s.page_number), '') as listed
from w left join {pages_line} s on s.document_id = w.document_id and s.normalized_text <> '' group by w.document_id, w.page_number""")
def page_view(fx):
    spans = fx.pages_line.filter(F.col("normalized_text") != "").select(
        "document_id", F.lit(1).alias("page_number"), F.col("page_number").alias("char_start"),
        F.length("raw_text").alias("char_end"), F.col("raw_text").alias("span_text"))
    pages = fx.documents.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"))
    listed = F.transform("spans", lambda s: F.concat(s["char_start"].cast("string"), F.lit(":"), s["char_end"].cast("string")))
    return P.page_view(pages, spans).select(
        "document_id", "page_number", F.size("spans").alias("spans"), F.array_join(listed, ",").alias("listed"))
