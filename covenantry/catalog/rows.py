"""Filters, page and chunk stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.operators import integrity as I, listing as L, pages as P
from covenantry.operators.contradictions import contradiction_pairs
from covenantry.rules import RuleBase

# The given texts hold no contract words, so the keyword rules are parameters here.
LANGUAGE_RULES = [("contract", [" the "]), ("lease", [" der "]), ("rfi", [" que "])]
LANGUAGE_BASE = RuleBase({
    "english": {"doc_types": ["contract"], "heuristics": {"contract": [" the "]}},
    "german": {"doc_types": ["lease"], "heuristics": {"lease": [" der "]}},
    "romance": {"doc_types": ["rfi"], "heuristics": {"rfi": [" que "]}},
})


@query("C1_list_obligations", """
select o.obligation_id, o.document_id, o.obligation_type, o.severity from {obligations} o
join {docs} d on d.document_id = o.document_id
where o.status = 'needs_review' and o.severity = 'high' and d.asset_id = 7""")
def list_obligations(fx):
    return L.list_obligations(
        fx.obligations, fx.docs, status="needs_review", severity="high", asset_id=7
    ).select("obligation_id", "document_id", "obligation_type", "severity")


@query("C2_list_risks", """
select risk_id, document_id, risk_type, severity, status from {risks}
where risk_type = 'financial' and status = 'needs_review'""")
def list_risks(fx):
    return L.list_risks(fx.risks, risk_type="financial", status="needs_review").select(
        "risk_id", "document_id", "risk_type", "severity", "status")


@query("C3_list_asset_documents", """
select document_id, asset_id, source_name from {docs} where doc_type = 'contract' and parse_status = 'complete'""")
def asset_documents(fx):
    return L.list_asset_documents(fx.docs, doc_type="contract", parse_status="complete").select(
        "document_id", "asset_id", "source_name")


@query("C4_visible_items", """
select o.obligation_id, coalesce(d.domain, 'general') as domain, o.status from {obligations} o
join {docs} d on d.document_id = o.document_id
where o.status <> 'rejected' and coalesce(d.domain, 'general') = 'general'""")
def visible(fx):
    items = fx.obligations.join(fx.docs.select("document_id", "domain"), "document_id")
    return L.visible_items(items, domain="general").select(
        "obligation_id", F.coalesce("domain", F.lit("general")).alias("domain"), "status")


@query("C5_normalize_pages", """
select document_id, page_number, processing_status, length(normalized_text) as size,
  case when processing_status = 'processed' then sha256(normalized_text) else sha256('') end as text_sha256 from {pages_doc}""")
def normalized(fx):
    return fx.pages_doc.select(
        "document_id", "page_number", "processing_status",
        F.length("normalized_text").cast("long").alias("size"), "text_sha256")


@query("C6_doc_type_early_guess", """
with h as (select * from (select *, row_number() over (partition by document_id order by page_number) as n from {pages_line}) x where n <= 3),
b as (select document_id, lower(string_agg(trim(raw_text, e' \\t\\r\\n'), ' ' order by n)) as blob from h
      where trim(raw_text, e' \\t\\r\\n') <> '' group by document_id)
select d.doc_id as document_id, case when contains(blob, ' the ') then 'contract' when contains(blob, ' der ') then 'lease'
  when contains(blob, ' que ') then 'rfi' else 'unknown' end as doc_type
from {documents} d left join b on b.document_id = d.doc_id""")
def early(fx):
    docs = fx.documents.select(F.col("doc_id").alias("document_id"), F.lit("unknown").alias("doc_type"))
    return P.early_types(docs, fx.pages_line, rules=LANGUAGE_RULES)


@query("C7_doc_type_gate", """
with h as (select document_id, n, trim(case when normalized_text <> '' then normalized_text else raw_text end, e' \\t\\r\\n') as t
           from (select *, row_number() over (partition by document_id order by page_number) as n from {pages_line}
                 where trim(case when normalized_text <> '' then normalized_text else raw_text end, e' \\t\\r\\n') <> '') x where n <= 3),
b as (select document_id, lower(string_agg(t, ' ' order by n)) as blob from h group by document_id),
a as (select doc_id as document_id, case lang when 'en' then 'contract' when 'de' then 'lease' when 'fr' then 'rfi' else 'unknown' end as proposed,
        (doc_id % 100) / 100.0::double as confidence from {documents}),
g as (select a.*, case proposed when 'unknown' then true when 'contract' then contains(coalesce(blob, ''), ' the ')
        when 'lease' then contains(coalesce(blob, ''), ' der ') else contains(coalesce(blob, ''), ' que ') end as agree
      from a left join b on b.document_id = a.document_id)
select document_id, case when agree then proposed else 'unknown' end as doc_type, case when agree then confidence end as doc_type_confidence,
  case when not agree or proposed = 'unknown' then 'general' when proposed = 'contract' then 'english' when proposed = 'lease' then 'german'
    else 'romance' end as domain from g""")
def gate(fx):
    lang = F.col("lang")
    proposed = F.when(lang == "en", " Contract").when(lang == "de", "LEASE").when(lang == "fr", "rfi").otherwise("poem")
    docs = fx.documents.select(F.col("doc_id").alias("document_id"), F.lit("unknown").alias("doc_type"))
    answers = fx.documents.select(
        F.col("doc_id").alias("document_id"), proposed.alias("proposed_type"),
        ((F.col("doc_id") % 100) / F.lit(100.0)).alias("confidence"))
    return P.gate_types(docs, fx.pages_line.drop("normalized_text"), answers, rules=LANGUAGE_BASE)


@query("C14_integrity_report", """
select 'no_evidence' as rule, cast(obligation_id as varchar) as record_id from {obligations} o
where status <> 'rejected' and not exists (select 1 from {evidence} e where e.obligation_id = o.obligation_id)
union all
select 'no_approval', cast(obligation_id as varchar) from {obligations} o
where status = 'confirmed' and not exists (select 1 from {reviews} r where r.obligation_id = o.obligation_id
  and r.decision in ('approve', 'edit_approve'))
union all
select 'confidence_range', cast(obligation_id as varchar) from {obligations} where system_confidence not between 0 and 100
union all
select 'duplicate_evidence', quote_sha256 || '|' || document_id || '|' || page_number || '|' || normalized_char_start || '|' || normalized_char_end
from {evidence} group by quote_sha256, document_id, page_number, normalized_char_start, normalized_char_end having count(*) > 1""")
def integrity(fx):
    return I.integrity_report(fx.obligations, fx.evidence, fx.reviews)


@query("C14_quote_offsets", """
select 'quote_offsets' as rule, cast(q.item_id as varchar) as record_id from {quotes} q
join {pages_line} p on p.document_id = q.document_id and p.page_number = q.line_no
where substr(p.normalized_text, 1, length(q.quote)) is distinct from q.quote""")
def offsets(fx):
    proof = fx.quotes.select(
        F.col("item_id").alias("evidence_id"), "document_id", F.col("line_no").alias("page_number"), "quote",
        F.lit(0).alias("normalized_char_start"), F.length("quote").alias("normalized_char_end"))
    return I.misplaced_quotes(proof, fx.pages_line)


@query("C14_pair_order", """
select 'pair_order' as rule, 'none' as record_id where 1 = 0""")
def pair_order(fx):
    return I.unordered_pairs(contradiction_pairs(fx.obligations))


_SECTIONS = """
with s as (select document_id, count(*) as total, sum(case when section_label is null or section_label = 'agreement_body' then 1 else 0 end) as agreement
           from {stripped_labels} group by document_id)"""


@query("C15_section_filter", _SECTIONS + """
select c.document_id, c.page_number, c.char_start,
  case when agreement = 0 or (total - agreement)::double / total >= 0.9 then 'all_chunks_fallback' else 'filtered' end as chunk_source
from {stripped_labels} c join s on s.document_id = c.document_id
where c.section_label is null or c.section_label = 'agreement_body' or agreement = 0 or (total - agreement)::double / total >= 0.9""")
def section_filter(fx):
    return P.section_filter(fx.labeled_chunks).select("document_id", "page_number", "char_start", "chunk_source")


@query("C15_section_stats", """
with s as (select l.document_id % 50 as document_id, l.section_label from {stripped_labels} l),
t as (select document_id, count(*) as total, cast(sum(case when section_label is null or section_label = 'agreement_body' then 1 else 0 end) as bigint) as agreement
      from s group by document_id)
select document_id, total, agreement, total - agreement as non_agreement, round((total - agreement)::double / total, 4) as non_agreement_ratio,
  agreement = 0 or (total - agreement)::double / total >= 0.2 as bypassed from t""")
def section_stats(fx):
    folded = fx.labeled_chunks.withColumn("document_id", F.col("document_id") % 50)
    return P.section_stats(folded, bypass_ratio=0.2).drop("chunk_source")


@query("C16_section_label", """
with n as (select *, row_number() over (partition by document_id order by page_number, char_start) as no from {stripped_chunks})
select document_id, page_number, char_start,
  case when (document_id + no) % 3 = 0 and no <= greatest(ceil(n_chars / 4000), 1) then 'non_agreement' else 'agreement_body' end as section_label
from n join {documents} on doc_id = document_id""")
def section_label(fx):
    no = F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("n_chars") / 4000).cast("int"), F.lit(1))))
    said = fx.documents.select(F.col("doc_id").alias("document_id"), no.alias("section"))
    pick = (F.col("document_id") + F.col("section")) % 3
    labels = said.withColumns({
        "label": F.when(pick == 0, "non_agreement").when(pick == 1, "agreement_body").otherwise("unsure"),
        "answer_no": F.col("section")})
    return P.label_sections(fx.chunks, labels).select("document_id", "page_number", "char_start", "section_label")


@query("C17_zero_result_retry", """
with o as (select document_id, count(*) as n from {obligations} group by document_id),
r as (select document_id, count(*) as n from {risks} group by document_id)
select d.document_id, coalesce(o.n, 0) + coalesce(r.n, 0) = 0 and d.document_id % 5 <> 0 as retry_all_chunks
from {docs} d left join o on o.document_id = d.document_id left join r on r.document_id = d.document_id""")
def retry(fx):
    source = F.when(F.col("document_id") % 5 == 0, "all_chunks_fallback").otherwise("filtered")
    passes = None
    for kind, items in (("obligation", fx.obligations), ("risk", fx.risks)):
        counts = items.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        part = fx.docs.select("document_id").join(counts, "document_id", "left").select(
            "document_id", F.lit(kind).alias("kind"), F.coalesce("n", F.lit(0)).alias("item_count"),
            source.alias("chunk_source"))
        passes = part if passes is None else passes.unionByName(part)
    return P.zero_result_retry(passes)


@query("C18_extraction_mode", """
select document_id, cast(floor(sum(length(text)) / 4.0) as bigint) + 1500 as estimated_tokens,
  case when floor(sum(length(text)) / 4.0) + 1500 <= 2500 then 'full_doc' else 'chunked' end as extraction_mode
from {chunks} group by document_id""")
def mode(fx):
    return P.extraction_mode(fx.chunks, limit=2500)


@query("C22_chunk_pages", """
select document_id, page_number, char_start, char_end, sha256(text) as chunk_sha256, split_reason from {stripped_chunks}""")
def chunk_rows(fx):
    return fx.chunks.drop("text")


@query("H1_page_of", """
select obligation_id, created_at, severity from {obligations} order by created_at desc, obligation_id limit 50 offset 100""")
def page(fx):
    items, _ = L.page_of(fx.obligations, F.col("created_at").desc(), F.col("obligation_id"), limit=50, cursor=100)
    return items.select("obligation_id", "created_at", "severity")


@query("H1_next_cursor", """
select cast(case when (select count(*) from {obligations}) > 150 then '150' end as varchar) as next_cursor""")
def next_cursor(fx):
    return L.page_of(fx.obligations, F.col("created_at").desc(), F.col("obligation_id"), limit=50, cursor=100)[1]


@query("H1_first_page_per_asset", """
select asset_id, obligation_id, cast(position as int) as position from (
  select d.asset_id, o.obligation_id, row_number() over (partition by d.asset_id order by o.created_at desc, o.obligation_id) as position
  from {obligations} o join {docs} d on d.document_id = o.document_id) x where position <= 5""")
def first_pages(fx):
    items = fx.obligations.join(fx.docs.select("document_id", "asset_id"), "document_id")
    return L.first_pages(items, partition="asset_id", key="obligation_id", size=5).select(
        "asset_id", "obligation_id", "position")


@query("H2_sorted_items", """
select obligation_id, severity, cast(case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end as int) as sort_key
from {obligations}""")
def sorted_items(fx):
    return L.sorted_items(fx.obligations, "severity").select("obligation_id", "severity", "sort_key")


@query("H2_sorted_by_confidence", """
select obligation_id, coalesce(llm_quality_confidence, system_confidence) as sort_key from {obligations}""")
def sorted_confidence(fx):
    return L.sorted_items(fx.obligations, "confidence").select("obligation_id", "sort_key")


@query("H3_lists_by_name", """
select name, asset_id from {assets}""")
def by_name(fx):
    return fx.assets.select("name", "asset_id").orderBy("name", "asset_id")


@query("H4_entity_suggestions", """
select mention_id, document_id, suggested_entity_id from {mentions} where not resolved and suggested_entity_id is not null""")
def suggestions(fx):
    return L.entity_suggestions(fx.mentions).select("mention_id", "document_id", "suggested_entity_id")
