"""Text functions over documents, lines and obligation texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.fixtures import norm_sql
from covenantry.functions import coerce as C, text as X
from covenantry.functions.similarity import rouge_l, seq_ratio
from covenantry.operators.pages import chunk_pages


@query("B1_normalize_text", f"""
select doc_id, {norm_sql('text')} as normalized, length({norm_sql('text')}) as size
from {{documents}}""")
def normalize(fx):
    return fx.documents.select("doc_id", X.normalize_text("text").alias("normalized")).withColumn(
        "size", F.length("normalized").cast("long"))


@query("B2_sha256_text", f"""
select document_id, page_number, sha256({norm_sql('raw_text')}) as text_sha256 from {{pages_line}}""")
def sha256(fx):
    return fx.pages_line.select("document_id", "page_number", X.sha256_text("normalized_text").alias("text_sha256"))


@query("B3_word_tokens", """
with t as (select document_id, page_number, regexp_extract_all(lower(raw_text), '[a-z0-9]+') as w from {pages_line})
select document_id, page_number, array_to_string(w, ' ') as tokens, cast(len(w) as int) as token_count,
  cast(len(list_distinct(w)) as int) as distinct_tokens from t""")
def tokens(fx):
    words = X.word_tokens("raw_text")
    return fx.pages_line.select(
        "document_id", "page_number", F.array_join(words, " ").alias("tokens"),
        F.size(words).alias("token_count"), F.size(F.array_distinct(words)).alias("distinct_tokens"))


@query("B4_external_reference", """
select obligation_id, contains(lower(obligation_text), 'per exhibit') or contains(lower(obligation_text), 'as defined in')
  or contains(lower(obligation_text), 'pursuant to') or contains(lower(obligation_text), 'referenced in')
  or contains(lower(obligation_text), 'attached hereto') as has_external_reference from {obligations}""")
def external(fx):
    return fx.obligations.select(
        "obligation_id", X.has_external_reference("obligation_text").alias("has_external_reference"))


@query("B5_predicates", r"""
select obligation_id,
  regexp_matches(obligation_text, '(?i)\b(by|before|within|no later than|after|days?|weeks?|months?)\b') as deadline,
  regexp_matches(obligation_text, '(?i)(§|C\.R\.S\.|U\.S\.C\.|statute|regulation)') as statute,
  regexp_matches(obligation_text, '(?i)(\$[\d,]+|dollar)') as monetary from {obligations}""")
def predicates(fx):
    t = "obligation_text"
    return fx.obligations.select(
        "obligation_id", X.implies_deadline(t).alias("deadline"), X.cites_statute(t).alias("statute"),
        X.names_amount(t).alias("monetary"))


@query("B6_payment_amounts", r"""
select obligation_id, array_to_string(list_sort(list_distinct(
  regexp_extract_all(obligation_text, '\$\s*([\d,]+(?:\.\d+)?)', 1))), '|') as amounts from {obligations}""")
def amounts(fx):
    return fx.obligations.select(
        "obligation_id", F.array_join(X.payment_amounts("obligation_text"), "|").alias("amounts"))


@query("B7_looks_like_table", r"""
with l as (select doc_id, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(x, e' \t\r\n') <> '') as lines
           from {documents})
select doc_id, len(list_filter(lines, lambda x: contains(x, '|') or contains(x, chr(9)))) >= 2
  or len(list_filter(lines, lambda x: contains(x, '  ') and len(regexp_extract_all(x, '[^\s]+')) >= 3)) >= 3 as has_tables
from l""")
def tables(fx):
    return fx.documents.select("doc_id", X.looks_like_table("text").alias("has_tables"))


@query("B8_split_into_chunks", """
select document_id, page_number, char_start, char_end, split_reason, length(text) as size from {stripped_chunks}""")
def chunks(fx):
    return chunk_pages(fx.pages_doc).select(
        "document_id", "page_number", "char_start", "char_end", "split_reason",
        F.length("text").cast("long").alias("size"))


@query("B9_parse_page_ranges", """
select o_orderkey, array_to_string(list_sort(list_distinct(list_concat(range(a, b + 1), [c]))), ',') as pages
from (select o_orderkey, o_custkey % 7 + 1 as a, o_custkey % 7 + 1 + o_orderkey % 5 as b, o_orderkey % 40 + 1 as c
      from {orders}) x""")
def ranges(fx):
    a = F.col("o_custkey") % 7 + 1
    spec = F.concat(a.cast("string"), F.lit("-"), (a + F.col("o_orderkey") % 5).cast("string"), F.lit(", "),
                    (F.col("o_orderkey") % 40 + 1).cast("string"))
    return fx.orders.select("o_orderkey", F.array_join(X.page_ranges(spec), ",").alias("pages"))


_STATUTORY = """case l_linenumber % 5 when 0 then 'A landlord must repair lot ' when 1 then 'Under Section '
  when 2 then 'Illinois law requires lot ' when 3 then 'The lessee pays for lot ' else 'Landlords are required to keep ' end"""


@query("B10_statutory_pattern", rf"""
with q as (select l_orderkey, l_linenumber, l_partkey, {_STATUTORY} || cast(l_partkey as varchar) as quote from {{lineitem}})
select l_orderkey, l_linenumber, l_partkey,
  case when regexp_matches(quote, '(?i)^\s*A\s+landlord\s+(must|may|shall)') then 'landlord_must'
    when regexp_matches(quote, '(?i)^\s*Landlord(s)?\s+(must|are\s+required)') then 'landlords_required'
    when regexp_matches(quote, '(?i)^\s*A\s+tenant\s+(must|may|shall)') then 'tenant_must'
    when regexp_matches(quote, '(?i)Under\s+\[?(?:Section|Code|§)') then 'under_code'
    when regexp_matches(quote, '(?i)Illinois\s+law\s+requires') then 'illinois_law' end as pattern from q""")
def statutory(fx):
    n = F.col("l_linenumber") % 5
    head = F.when(n == 0, "A landlord must repair lot ").when(n == 1, "Under Section ").when(
        n == 2, "Illinois law requires lot ").when(n == 3, "The lessee pays for lot ").otherwise(
        "Landlords are required to keep ")
    return fx.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        X.statutory_pattern(F.concat(head, F.col("l_partkey").cast("string"))).alias("pattern"))


@query("B11_truncate_text", """
with t as (select document_id, page_number, trim(raw_text, e' \\t\\r\\n') as s from {pages_line}),
c as (select *, substr(s, 1, 121) as cut from t),
p as (select *, case when strpos(reverse(cut), ' ') > 0 then length(cut) - strpos(reverse(cut), ' ') else -1 end as sp from c)
select document_id, page_number, case when length(s) <= 120 then s
  else rtrim(substr(s, 1, case when sp <= 40 then 120 else sp end), e' \\t\\r\\n') || chr(8230) end as short_text from p""")
def truncate(fx):
    return fx.pages_line.select("document_id", "page_number", X.truncate_text("raw_text").alias("short_text"))


@query("B12_summarize_text", r"""
with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as s from {documents}),
p as (select *, strpos(s, '. ') - 1 as stop, substr(s, 1, 120) as head from t),
q as (select *, case when strpos(reverse(head), ' ') > 0 then length(head) - strpos(reverse(head), ' ') else -1 end as sp from p)
select doc_id, case when length(s) <= 120 then s when stop > 0 and stop < 120 then substr(s, 1, stop + 1)
  else (case when sp > 0 then substr(head, 1, sp) else head end) || chr(8230) end as summary from q""")
def summarize(fx):
    return fx.documents.select("doc_id", X.summarize_text("text").alias("summary"))


@query("B13_format_quote", r"""
with t as (select doc_id, text, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x, e' \t')), lambda x: x <> '') as lines
           from {documents}),
m as (select *, list_filter(lines, lambda x: regexp_matches(x, '^[•\-–*]\s*') or regexp_matches(x, '^[0-9]+[.)]\s+')) as marked from t)
select doc_id, case when len(marked) >= 2 then 'bullets' else 'paragraph' end as kind,
  case when len(marked) >= 2 then array_to_string(list_filter(list_transform(marked,
    lambda x: trim(regexp_replace(regexp_replace(x, '^[•\-–*]\s*', ''), '^[0-9]+[.)]\s+', ''))), lambda x: x <> ''), '|')
  else trim(regexp_replace(text, '\s+', ' ', 'g')) end as body from m""")
def format_quote(fx):
    q = X.format_quote("text")
    return fx.documents.select("doc_id", q.alias("q")).select(
        "doc_id", F.col("q.type").alias("kind"),
        F.coalesce(F.array_join("q.items", "|"), F.col("q.text")).alias("body"))


@query("B14_slug_filename", r"""
select c_custkey, case when s = '' then 'all' else s end as slug,
  'risks_' || (case when s = '' then 'all' else s end) || '_2024-05-01.csv' as filename
from (select c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name || ' & ' || c_mktsegment), '\s+', '_', 'g'),
        '[^a-z0-9_-]', '', 'g'), '_+', '_', 'g'), '_-') as s from {customer}) x""")
def slugs(fx):
    name = F.concat("c_name", F.lit(" & "), "c_mktsegment")
    day = F.lit("2024-05-01").cast("date")
    return fx.customer.select(
        "c_custkey", X.slug(name).alias("slug"), X.export_filename("risks", name, day, "csv").alias("filename"))


@query("B15_quote_preview", """
select doc_id, substr(text, 1, 120) as p120, substr(text, 1, 300) as p300, substr(text, 1, 500) as p500,
  substr(text, 1, 600) as p600 from {documents}""")
def previews(fx):
    return fx.documents.select("doc_id", *(X.preview("text", n).alias(f"p{n}") for n in (120, 300, 500, 600)))


@query("C8_coerce_enum", """
select event_id, case when lower(trim(s)) in ('low', 'medium', 'high', 'critical') then lower(trim(s)) else 'medium' end as severity
from (select event_id, case event_type when 'view' then ' High ' when 'click' then 'LOW' when 'error' then 'critical'
        when 'signup' then null else event_type end as s from {events}) x""")
def coerce_severity(fx):
    kind = F.col("event_type")
    loose = F.when(kind == "view", " High ").when(kind == "click", "LOW").when(kind == "error", "critical").when(
        kind == "signup", F.lit(None)).otherwise(kind)
    from covenantry.schema import SEVERITIES
    return fx.events.select("event_id", C.coerce_enum(loose, SEVERITIES, "medium").alias("severity"))


@query("C9_alias_obligation_type", """
select event_id, case event_type when 'view' then 'submission' when 'click' then 'inspection' when 'purchase' then 'compliance'
  when 'signup' then 'payment' else 'other' end as obligation_type from {events}""")
def aliases(fx):
    kind = F.col("event_type")
    raw = F.when(kind == "view", "Delivery ").when(kind == "click", "maintenance").when(
        kind == "purchase", "REPORTING").when(kind == "signup", " payment").otherwise(kind)
    return fx.events.select("event_id", C.obligation_type(raw).alias("obligation_type"))


@query("C10_parse_due_fields", """
with r as (select document_id, obligation_id, case rn % 4 when 0 then '2024-02-30' when 1 then ' ' || cast(cast(created_at as date) as varchar)
             when 2 then replace(cast(cast(created_at as date) as varchar), '-', '') end as date_text,
           case when rn % 3 = 0 then ' within ' || cast(rn as varchar) || ' days ' when rn % 3 = 1 then '  ' end as rule_text from {obligations}),
p as (select *, case when date_text is null or date_text = '2024-02-30' then null
        when length(trim(date_text)) = 8 then strptime(trim(date_text), '%Y%m%d')::date else trim(date_text)::date end as due_date,
      nullif(trim(rule_text), '') as due_rule from r)
select obligation_id, case when due_date is not null then 'absolute' when due_rule is not null then 'relative' else 'none' end as due_kind,
  due_date, due_rule from p""")
def due(fx):
    n, day = F.col("rn") % 4, F.date_format("created_at", "yyyy-MM-dd")
    date_text = F.when(n == 0, "2024-02-30").when(n == 1, F.concat(F.lit(" "), day)).when(n == 2, F.replace(day, F.lit("-"), F.lit("")))
    k = F.col("rn") % 3
    rule = F.when(k == 0, F.concat(F.lit(" within "), F.col("rn").cast("string"), F.lit(" days "))).when(k == 1, "  ")
    return fx.obligations.select("obligation_id", C.due_fields(date_text, rule).alias("d")).select("obligation_id", "d.*")


@query("C20_remap_risk_type", """
select event_id, case event_type when 'view' then 'schedule' when 'click' then 'contractual' when 'purchase' then 'compliance'
  when 'signup' then 'quality' else 'unknown_risk' end as risk_type from {events}""")
def remap(fx):
    kind = F.col("event_type")
    old = F.when(kind == "view", "approval_overdue").when(kind == "click", "payment_term_conflict").when(
        kind == "purchase", "missing_required_document").when(
        kind == "signup", "inspection_failed_reinspection_required").otherwise(kind)
    return fx.events.select("event_id", C.remap_risk_type(old).alias("risk_type"))


@query("C21_progress_percent", """
select document_id, cast(case when parse_status in ('complete', 'partially_processed', 'failed') then 100
  else least(greatest(case parse_status when 'uploaded' then 5 else 0 end,
    floor((document_id % 4 + document_id % 3) * 100.0 / total_pages + 0.5)), 99) end as int) as percent from {docs}""")
def progress(fx):
    return fx.docs.select("document_id", C.progress_percent(
        "parse_status", F.col("document_id") % 4, F.col("document_id") % 3, "total_pages").alias("percent"))


_KEYWORDS = "['shall', 'must', 'required', 'within', 'deadline']"


@query("C19_relevance_score", f"""
with t as (select document_id, page_number, char_start, lower(text) as s, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as n
           from {{stripped_chunks}})
select document_id, page_number, char_start, round(case when n = 0 then 0 else
  0.75 * len(list_filter({_KEYWORDS}, lambda k: contains(s, k))) / 5.0 + 0.25 * least(1.0, n / 200.0) end, 6) as relevance from t""")
def relevance(fx):
    return fx.chunks.select(
        "document_id", "page_number", "char_start",
        F.round(C.relevance("text", F.lit("unknown"), "obligation_extraction"), 6).alias("relevance"))


_NEXT_LINE = """
with l as (select document_id, page_number, raw_text, lead(raw_text) over (partition by document_id order by page_number) as next_text
           from {pages_line})"""


def _neighbours(fx):
    from pyspark.sql import Window as W
    w = W.partitionBy("document_id").orderBy("page_number")
    return fx.pages_line.select(
        "document_id", "page_number", "raw_text", F.lead("raw_text").over(w).alias("next_text")
    ).filter(F.col("next_text").isNotNull())


@query("G13_jaccard", _NEXT_LINE + """,
t as (select document_id, page_number, list_distinct(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) as a,
        list_distinct(regexp_extract_all(lower(next_text), '[a-z0-9]+')) as b from l where next_text is not null)
select document_id, page_number, round(case when len(a) > 0 and len(b) > 0 then
  len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) else 0 end, 6) as jaccard from t""")
def jaccard(fx):
    return _neighbours(fx).select("document_id", "page_number", F.round(
        X.jaccard(X.token_set("raw_text"), X.token_set("next_text")), 6).alias("jaccard"))


@query("G8_rouge_l")
def rouge(fx):
    return _neighbours(fx).select("document_id", "page_number", rouge_l("raw_text", "next_text").alias("rouge_l"))


@query("G8_sequence_ratio")
def ratio(fx):
    return fx.quotes.join(
        fx.pages_line.select("document_id", F.col("page_number").alias("line_no"), "normalized_text"),
        ["document_id", "line_no"]).select("item_id", seq_ratio("quote", "normalized_text").alias("ratio"))
