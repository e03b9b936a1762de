"""Uploads, answers, reports and exports."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.operators import pages as P
from covenantry.sources import answers as A, exports as X, files as S
from covenantry.session import shared_folder


@query("A1_ingest_files")
def ingest_files(fx):
    """The given files themselves, hashed as bytes and checked as uploads."""
    files = S.hashed_files(fx.spark, fx.folder)
    loads = S.uploads_from_files(files, asset_id=1, uploaded_by=2, mime_type=F.lit("application/octet-stream"))
    return S.check_uploads(loads, 500).select("source_name", "size", "sha256", "kind", "reason")


@query("A1_check_uploads", """
select document_id, case when mime_type = 'text/csv' then 'other' when source_name like '%.pdf' then 'pdf' else 'text' end as kind,
  case when size = 0 then 'Empty upload' when mime_type = 'text/csv' then 'Only PDF or .txt uploads are supported'
    when source_name like '%.pdf' and total_pages > 40 then 'Page count ' || total_pages || ' exceeds limit 40' end as reason
from (select document_id, total_pages, case when asset_id % 3 = 0 then 'text/csv' when asset_id % 3 = 1 then 'application/octet-stream' else 'application/pdf' end as mime_type,
        case when asset_id % 3 = 0 then 'a.csv' when asset_id % 3 = 1 then 'a.bin' else 'a.pdf' end as source_name,
        case when document_id % 50 = 0 then 0 else 9 end as size from {docs}) x""")
def check_uploads(fx):
    n = F.col("asset_id") % 3
    loads = fx.docs.select(
        "document_id", "total_pages",
        F.when(n == 0, "text/csv").when(n == 1, "application/octet-stream").otherwise("application/pdf").alias("mime_type"),
        F.when(n == 0, "a.csv").when(n == 1, "a.bin").otherwise("A.PDF").alias("source_name"),
        F.when(F.col("document_id") % 50 == 0, 0).otherwise(9).alias("size"))
    return S.check_uploads(loads, 40).select("document_id", "kind", "reason")


def _uploads(fx):
    """Documents as uploads into the asset named by their source."""
    return fx.documents.select(
        F.col("doc_id").alias("upload_id"), F.col("source").alias("asset_id"), F.sha2("text", 256).alias("sha256"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_name"),
        F.lit("application/pdf").alias("mime_type"), F.col("n_chars").alias("size"), F.lit(1).alias("total_pages"),
        (F.col("doc_id") % 40).alias("request_id"), "lang")


def _stored(fx):
    """German documents are stored already."""
    return fx.documents.filter(F.col("lang") == "de").select(
        F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("asset_id"))


@query("A2_ingest_dedup", """
with u as (select *, row_number() over (partition by sha256(text), source order by doc_id) as n from {documents})
select doc_id as upload_id, source as asset_id from u where n = 1
  and not exists (select 1 from {documents} s where s.lang = 'de' and sha256(s.text) = sha256(u.text) and s.source = u.source)""")
def dedup(fx):
    return S.ingest_new(_uploads(fx), _stored(fx), "upload_id").select("upload_id", "asset_id")


@query("A3_ingest_bulk", """
with u as (select *, doc_id % 40 as request_id, min(doc_id) over (partition by sha256(text), source) as first_id,
             min(case when lang = 'de' then doc_id end) over (partition by sha256(text), source) as stored_id,
             count(*) over (partition by doc_id % 40) as files from {documents})
select request_id, doc_id as upload_id, case when files > 100 then 'Maximum 100 files per request' end as reason,
  case when files > 100 then 'failed' else 'succeeded' end as status,
  case when files <= 100 then coalesce(stored_id::varchar, 'new-' || first_id) end as document_id,
  files <= 100 and stored_id is null and first_id = doc_id as is_new from u""")
def bulk(fx):
    return S.ingest_bulk(_uploads(fx), _stored(fx), "upload_id", max_files=100).drop("source_name")


@query("A4_text_pages", r"""
with l as (select doc_id, text, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(x, e' \t\r\n') <> '') as lines from {documents})
select doc_id as document_id, cast(1 as int) as page_number, sha256(text) as text_sha256, 'pending' as processing_status,
  len(list_filter(lines, lambda x: contains(x, '|') or contains(x, chr(9)))) >= 2
  or len(list_filter(lines, lambda x: contains(x, '  ') and len(regexp_extract_all(x, '[^\s]+')) >= 3)) >= 3 as has_tables from l""")
def text_pages(fx):
    files = fx.documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw_text"))
    return P.text_pages(files).drop("raw_text", "text_source")


@query("A5_page_rows", """
select document_id, page_number, processing_status, is_scanned, length(raw_text) as size from {pages_doc}""")
def page_rows(fx):
    return P.page_rows(fx.page_texts).select(
        "document_id", "page_number",
        F.when(F.col("processing_status") == "pending", "processed").otherwise(F.col("processing_status")).alias("processing_status"),
        "is_scanned", F.length("raw_text").cast("bigint").alias("size"))


@query("A5_page_counts", """
select substr(source, 4) as document_id, count(*) as total_pages,
  greatest(count(*) filter (where is_scanned), count(*) filter (where processing_status = 'failed')) as scanned_page_count
from {pages_doc} p join {documents} d on d.doc_id = p.document_id group by 1""")
def page_counts(fx):
    texts = fx.page_texts.withColumns({
        "page_number": F.col("document_id"), "document_id": F.substring("source", 4, 9)})
    return P.page_counts(P.page_rows(texts))


@query("A6_apply_ocr", r"""
with p as (select t.document_id, t.page_number, case when error is null then raw_text else '' end as raw_text, error from {page_texts} t),
w as (select *, (length(trim(raw_text, e' \t\r\n')) < 200 or error is not null) as wanted, document_id % 3 <> 0 as pdf from p),
r as (select *, wanted and pdf as tried, wanted and pdf and document_id % 2 = 0 as got from w)
select document_id, page_number, case when got then 'text of ' || document_id else raw_text end as raw_text, case when got then 'ocr' else 'pdf_text' end as text_source,
  case when got then 'pending' when tried or error is not null then 'failed' else 'pending' end as processing_status,
  case when got then null when tried then 'ocr_failed: no luck' when error is not null then 'pdf_page_parse_failed: ' || error end as processing_error from r""")
def ocr(fx):
    pages = P.page_rows(fx.page_texts)
    docs = fx.documents.select(
        F.col("doc_id").alias("document_id"), F.lit("uploaded").alias("parse_status"),
        F.when(F.col("doc_id") % 3 == 0, "text/plain").otherwise("application/pdf").alias("mime_type"))
    good = F.col("doc_id") % 2 == 0
    results = fx.documents.select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"),
        F.when(good, F.concat(F.lit("text of "), F.col("doc_id").cast("string"))).alias("ocr_text"),
        F.when(~good, "no luck").alias("ocr_error"))
    return P.apply_ocr(pages, docs, results, min_chars=200)


def raw_answers(fx):
    """One answer per document over its obligations; some fenced, wrapped or damaged."""
    entry = F.to_json(F.struct(
        F.concat(F.lit(" "), F.col("obligation_text"), F.lit(" ")).alias("quote"),
        F.when(F.col("obligation_type") == "submission", " Delivery").otherwise(F.col("obligation_type")).alias("obligation_type"),
        F.upper("modality").alias("modality"), "severity", F.date_format("due_date", "yyyy-MM-dd").alias("due_date"),
        "due_rule", F.lit("Supplier").alias("responsible_party")))
    listed = F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("obligation_id", entry.alias("e")))), lambda x: x["e"]), ", ")
    body = F.concat(F.lit("["), listed, F.lit("]"))
    n, text = F.col("document_id") % 10, F.col("body")
    return fx.obligations.groupBy("document_id").agg(body.alias("body")).select(
        "document_id",
        F.when(n == 1, F.concat(F.lit("[see note] "), text))
        .when(n == 2, F.replace(text, F.lit('{"quote":'), F.lit('{"quote":"earlier","quote":')))
        .when(n == 3, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(n == 5, F.concat(F.lit("Here is the list: "), text, F.lit(" as asked")))
        .when(n == 7, F.concat(F.lit('{"note": 1, "items": '), text, F.lit("}")))
        .when(n == 9, "no list, sorry").otherwise(text).alias("raw"))


@query("A7_load_answers", """
select document_id, document_id % 10 <> 9 as readable, case when document_id % 10 <> 9 then cast(count(*) as int) end as entries
from {obligations} group by document_id""")
def load(fx):
    return A.load_answers(raw_answers(fx)).select(
        "document_id", F.col("error").isNull().alias("readable"), F.size(F.from_json("rows_json", "array<string>")).alias("entries"))


@query("C11_obligation_candidates", """
select document_id, obligation_id, obligation_type, obligation_text, modality, severity,
  case when due_date is not null then 'absolute' when due_rule is not null then 'relative' else 'none' end as due_kind, due_date, due_rule
from {obligations} where document_id % 10 <> 9""")
def candidates(fx):
    found = A.obligation_candidates(A.load_answers(raw_answers(fx)), "document_id")
    return found.withColumn("obligation_id", F.col("document_id") * 100 + F.col("entry_no") + 1).drop(
        "entry_no", "responsible_party")


@query("C12_risk_candidates", """
select risk_id, trim(risk_text) as risk_text, case when risk_type = 'quality' then 'unknown_risk' else risk_type end as risk_type, severity from {risks}""")
def risk_candidates(fx):
    kind = F.when(F.col("risk_type") == "quality", "beauty").otherwise(F.upper("risk_type"))
    text = F.when(F.col("risk_id") % 2 == 0, F.col("risk_text"))
    raw = fx.risks.select("risk_id", F.to_json(F.array(F.struct(
        F.coalesce(text, F.lit(" ")).alias("quote"), F.col("risk_text"), kind.alias("risk_type"), "severity"))).alias("raw"))
    return A.risk_candidates(A.load_answers(raw), "risk_id").drop("entry_no")


@query("C13_entity_mentions", """
select event_id, case when event_type = 'error' then 3 else cast(event_id % 5 as int) end as page_number, 'Firm ' || user_id as mentioned_name from {events}
where event_type <> 'view'""")
def mentions(fx):
    kind, firm = F.col("event_type"), F.concat(F.lit("Firm "), F.col("user_id").cast("string"))
    raw = fx.events.select("event_id", (F.col("event_id") % 5).cast("int").alias("page_number"), F.to_json(F.array(F.struct(
        F.when(kind == "click", firm).otherwise(" ").alias("name"), F.when(kind != "view", firm).alias("entity"),
        firm.alias("entity_value"), F.when(kind == "error", 3).alias("page_number")))).alias("raw"))
    return A.entity_mentions(A.load_answers(raw), "event_id", "page_number").drop("entry_no", "resolved")


def reports(fx):
    state = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "R", "fail").otherwise("maybe")
    entry = F.struct(
        F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("ruleId"), F.lit("4.2").alias("section"),
        F.col("l_partkey").alias("elementExpressId"), state.alias("status"),
        F.col("l_suppkey").cast("string").alias("actualValue"))
    body = F.to_json(F.struct(
        F.collect_list(entry).alias("results"), F.struct(
            F.count_if(F.col("l_returnflag") == "A").alias("passed"),
            F.when(F.count(F.lit(1)) > 4, F.lit(99)).alias("total")).alias("summary")))
    return fx.lineitem.groupBy(F.col("l_orderkey").alias("report_id")).agg(body.alias("raw"))


@query("A8_compliance_results", """
select l_orderkey as report_id, 'R' || l_linenumber as rule_id, l_partkey as element_express_id,
  case l_returnflag when 'A' then 'pass' when 'R' then 'fail' else 'warning' end as status, l_suppkey::varchar as actual_value, '' as message from {lineitem}""")
def results(fx):
    return A.compliance_results(reports(fx)).select(
        "report_id", "rule_id", "element_express_id", "status", "actual_value", "message")


@query("A8_compliance_counters", """
select l_orderkey as report_id, case when count(*) > 4 then 99 else count(*) end as total, count(*) filter (where l_returnflag = 'A') as passed,
  0::bigint as failed, 0::bigint as warnings, 0::bigint as not_applicable, 'completed' as status from {lineitem} group by l_orderkey""")
def counters(fx):
    return A.compliance_counters(reports(fx))


_EXPORT = """
select o.obligation_id::varchar as id, a.name as asset_name, d.source_name as document_filename, o.obligation_type, o.obligation_text as text,
  coalesce(o.llm_severity, o.severity) as severity, o.system_confidence::varchar as system_confidence,
  coalesce(o.llm_quality_confidence::varchar, '') as llm_quality_confidence, o.status, coalesce(o.due_date::varchar, '') as deadline,
  coalesce(e.quote, '') as evidence_quote, coalesce(e.page_number::varchar, '') as evidence_page_number,
  coalesce(e.raw_char_start::varchar, '') as evidence_char_start, coalesce(e.raw_char_end::varchar, '') as evidence_char_end,
  strftime(o.created_at, '%Y-%m-%dT%H:%M:%S') as created_at, coalesce(strftime(r.decided_at, '%Y-%m-%dT%H:%M:%S.%f'), '') as last_reviewed_at,
  coalesce(u.email, '') as reviewer_email
from {obligations} o join {docs} d on d.document_id = o.document_id join {assets} a on a.asset_id = d.asset_id
left join {evidence} e on e.obligation_id = o.obligation_id
left join (select *, row_number() over (partition by obligation_id order by decided_at desc, review_id desc) as n from {reviews}) r
  on r.obligation_id = o.obligation_id and r.n = 1
left join {users} u on u.user_id = r.reviewer_id"""


@query("A9_export_obligations", _EXPORT)
def export(fx):
    return X.export_rows(fx.obligations, fx.docs, fx.assets, fx.evidence, fx.reviews, fx.users)


@query("A9_export_list", "select * from (" + _EXPORT + """ where o.status = 'needs_review' and d.asset_id = 7
  and exists (select 1 from {assignments} s where s.user_id = 17 and s.asset_id = 7)) x union all select * from (""" + _EXPORT + """
  where o.severity = 'high' and d.asset_id = 3) y""")
def export_list(fx):
    """What a viewer sees of an assigned asset, and what an admin asks for."""
    tables = (fx.obligations, fx.docs, fx.assets, fx.evidence, fx.reviews, fx.users, fx.assignments)
    viewer = X.export_list(*tables, user_id=17, role="viewer", asset_id=7, status="needs_review")
    return viewer.unionByName(X.export_list(*tables, user_id=1, role="admin", asset_id=3, severity="high"))


@query("A9_export_risks", """
select r.risk_id::varchar as id, a.name as asset_name, d.source_name as document_filename, r.risk_type, r.risk_text as text,
  coalesce(r.llm_severity, r.severity) as severity, r.system_confidence::varchar as system_confidence,
  coalesce(r.llm_quality_confidence::varchar, '') as llm_quality_confidence, r.status,
  coalesce(e.quote, '') as evidence_quote, coalesce(e.page_number::varchar, '') as evidence_page_number,
  coalesce(e.raw_char_start::varchar, '') as evidence_char_start, coalesce(e.raw_char_end::varchar, '') as evidence_char_end,
  regexp_replace(strftime(r.created_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') as created_at, '' as last_reviewed_at, '' as reviewer_email
from {risks} r join {docs} d on d.document_id = r.document_id join {assets} a on a.asset_id = d.asset_id
left join {risk_evidence} e on e.risk_id = r.risk_id""")
def export_risks(fx):
    none = fx.reviews.filter(F.lit(False)).withColumnRenamed("obligation_id", "risk_id")
    return X.export_rows(fx.risks, fx.docs, fx.assets, fx.risk_evidence, none, fx.users, kind="risk")


@query("A9_csv_round_trip", """
select obligation_id::varchar as id, obligation_text as text, status from {obligations}""")
def round_trip(fx):
    """Rows written as CSV into the shared folder and read back."""
    path = f"{shared_folder(fx.spark)}/export-{os.urandom(6).hex()}"
    rows = fx.obligations.select(
        F.col("obligation_id").cast("string").alias("id"), F.col("obligation_text").alias("text"), "status", "created_at")
    X.write_csv(rows, path)
    return fx.spark.read.option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path).drop("created_at")


@query("A10_client_rows", """
select obligation_text as "Obligation", obligation_type as "Type", severity as "Severity", coalesce(llm_severity, '') as "LLM Severity", status as "Status",
  coalesce(llm_quality_confidence, system_confidence)::varchar as "Confidence", coalesce(due_date::varchar, '') as "Due Date" from {obligations} where status <> 'rejected'""")
def client(fx):
    from covenantry.operators.listing import visible_items
    return X.client_rows(visible_items(fx.obligations))


@query("A11_ground_truth_files", """
select document_id, item_no, quote, severity, page_hint from {truth}""")
def ground_truth(fx):
    """Items written as one JSON document per document, read back."""
    path = f"{shared_folder(fx.spark)}/truth-{os.urandom(6).hex()}"
    none = F.lit(None).cast("string")
    items = fx.truth.select(
        "document_id", F.lit("obligation").alias("kind"), "item_no", "quote", none.alias("obligation_type"),
        none.alias("risk_type"), none.alias("modality"), "severity", "page_hint")
    X.write_ground_truth(items, path)
    back = X.read_ground_truth(fx.spark, path)
    return back.select("document_id", F.col("page_hint").cast("bigint").alias("item_no"), "quote", "severity", "page_hint")
