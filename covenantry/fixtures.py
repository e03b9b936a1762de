"""The given tables seen as the tables of this data model.

Each relational view is one SQL text that Spark and the checking engine both
run; ``{name}`` stands for a given table or another view.  Views over text come
in two spellings, because exploding lists differs between the engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from covenantry.functions.text import PY_SPACE, normalize_text
from covenantry.operators.pages import chunk_pages, normalize_pages, page_rows

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

SQL: dict[str, str] = {}

SQL["users"] = """
select cast(n_nationkey as bigint) as user_id, concat(lower(n_name), '@example.org') as email,
  n_name as name,
  case when n_regionkey = 0 then 'admin' when n_regionkey = 1 then 'reviewer' else 'viewer' end as role,
  n_nationkey % 5 <> 4 as is_active, n_nationkey % 3 <> 0 as digest_enabled
from {nation}"""

SQL["assets"] = """
select c_custkey as asset_id, c_name as name, cast(c_nationkey as bigint) as created_by
from {customer}"""

SQL["assignments"] = """
select cast(c_nationkey as bigint) as user_id, c_custkey as asset_id from {customer}"""

SQL["docs"] = """
select o_orderkey as document_id, o_custkey as asset_id,
  concat('order_', cast(o_orderkey as string), '.pdf') as source_name, o_custkey % 25 as uploaded_by,
  o_orderdate as uploaded_at, 'application/pdf' as mime_type,
  case o_orderpriority when '1-URGENT' then 'contract' when '2-HIGH' then 'invoice'
    when '3-MEDIUM' then 'lease' when '5-LOW' then 'loan_agreement' else 'unknown' end as doc_type,
  case o_orderpriority when '1-URGENT' then 'construction' when '2-HIGH' then 'construction'
    when '3-MEDIUM' then 'real_estate' when '5-LOW' then 'financial' end as domain,
  case o_orderstatus when 'F' then 'complete' when 'O' then 'partially_processed'
    else 'uploaded' end as parse_status,
  cast(floor(o_totalprice / 10000.0) as int) + 1 as total_pages
from {orders}"""

SQL["obligations"] = """
select l_orderkey * 100 + rn as obligation_id, l_orderkey as document_id,
  case l_partkey % 6 when 0 then 'payment' when 1 then 'submission' when 2 then 'notification'
    when 3 then 'compliance' when 4 then 'inspection' else 'other' end as obligation_type,
  concat('Party ', cast(l_suppkey as string), ' shall deliver lot ', cast(l_partkey as string),
    case when l_tax >= 0.04 then concat(' and pay $', cast(cast(floor(l_extendedprice) as bigint) as string)) else '' end,
    case when l_linenumber % 3 = 0 then ' within the term' else '' end,
    case when l_linenumber % 5 = 0 then ' pursuant to regulation' else '' end, '.') as obligation_text,
  case l_linenumber when 1 then 'must' when 2 then 'shall' when 3 then 'required' when 4 then 'should'
    when 5 then 'may' else 'unknown' end as modality,
  case when l_suppkey % 4 = 0 then null else l_suppkey % 10 end as responsible_entity_id,
  case when l_linestatus = 'F' then 'absolute' when l_linenumber % 2 = 0 then 'relative' else 'none' end as due_kind,
  case when l_linestatus = 'F' then cast(l_shipdate as date) end as due_date,
  case when l_linestatus = 'O' and l_linenumber % 2 = 0 then 'within 10 days' end as due_rule,
  case when l_quantity <= 12 then 'low' when l_quantity <= 25 then 'medium'
    when l_quantity <= 38 then 'high' else 'critical' end as severity,
  case l_returnflag when 'R' then 'rejected' when 'A' then 'confirmed' else 'needs_review' end as status,
  cast(l_quantity as int) * 2 as system_confidence,
  case when l_returnflag = 'N' then cast(null as int) else cast(l_quantity as int) end as llm_quality_confidence,
  case when l_quantity > 45 then 'high' end as llm_severity,
  cast(null as int) as reviewer_confidence, false as contradiction_flag,
  cast(l_shipdate as timestamp) as created_at, rn, l_discount as d, l_tax as t, l_quantity as qty
from (select *, cast(row_number() over (partition by l_orderkey
        order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as bigint) as rn from {lineitem}) numbered"""

# Items of very small quantity have no evidence.
SQL["evidence"] = """
select obligation_id * 10 + 1 as evidence_id, obligation_id, document_id, cast(rn as int) as page_number,
  obligation_text as quote, sha256(obligation_text) as quote_sha256,
  cast(0 as int) as raw_char_start, cast(length(obligation_text) as int) as raw_char_end,
  cast(0 as int) as normalized_char_start, cast(length(obligation_text) as int) as normalized_char_end,
  case when d >= 0.08 then 'ocr' else 'pdf_text' end as source,
  case rn % 4 when 0 then 'fuzzy' when 1 then 'sentence' else 'exact' end as verification_method,
  case when rn % 4 = 0 then 0.85 + t end as fuzzy_similarity, created_at
from {obligations} where qty > 6"""

SQL["risks"] = """
select event_id as risk_id, user_id as document_id,
  case event_type when 'purchase' then 'financial' when 'signup' then 'schedule' when 'click' then 'quality'
    when 'error' then 'safety' else 'compliance' end as risk_type,
  concat('Exposure of ', case when value < 20 then 'dollar ' else 'lot ' end,
    cast(cast(floor(value) as bigint) as string),
    case when event_type = 'error' then ' within 30 days' else '' end,
    case when event_type = 'click' then ' under regulation 7' else '' end, '.') as risk_text,
  case when value < 20 then 'low' when value < 60 then 'medium' when value < 120 then 'high'
    else 'critical' end as severity,
  case event_id % 3 when 0 then 'needs_review' when 1 then 'confirmed' else 'rejected' end as status,
  cast(0 as int) as system_confidence, cast(null as int) as llm_quality_confidence,
  cast(null as string) as llm_severity,
  event_type = 'view' as has_external_reference, event_type = 'signup' as contradiction_flag,
  case when event_type = 'view' then cast(null as bigint) else event_id end as extraction_run_id,
  ts as created_at, value
from {events}"""

SQL["risk_evidence"] = """
select risk_id * 10 + 2 as evidence_id, risk_id, document_id, cast(1 + risk_id % 3 as int) as page_number,
  risk_text as quote, cast(0 as int) as raw_char_start, cast(length(risk_text) as int) as raw_char_end,
  case when severity = 'critical' then 'ocr' else 'pdf_text' end as source,
  case risk_id % 4 when 0 then 'fuzzy' when 1 then 'sentence' else 'exact' end as verification_method,
  case when risk_id % 4 = 0 then 0.85 + cast(risk_id % 16 as double) / 100 end as fuzzy_similarity, created_at
from {risks} where value >= 5"""

SQL["reviews"] = """
select event_id as review_id, user_id * 100 + 1 as obligation_id, event_id % 25 as reviewer_id,
  case event_type when 'error' then 'reject' when 'click' then 'edit_approve' else 'approve' end as decision,
  case when event_type = 'view' then cast(null as int) else cast(event_id % 101 as int) end as reviewer_confidence,
  ts as decided_at,
  case when event_type = 'click' and value >= 10 then 'critical' end as edit_severity,
  case when event_type = 'click' then concat('within ', cast(user_id as string), ' days of ', cast(event_id as string)) end as edit_due_rule
from {events}"""

SQL["runs"] = """
select event_id as run_id, user_id as document_id,
  case event_type when 'view' then 'classification' when 'click' then 'obligation_extraction'
    when 'purchase' then 'risk_extraction' when 'signup' then 'entity_extraction'
    else 'critic_detection' end as stage,
  'model-a' as model_used, case when value >= 100 then 'failed' else 'completed' end as status,
  ts as started_at, ts as completed_at
from {events}"""

SQL["page_texts"] = """
select doc_id as document_id, cast(1 as int) as page_number, text as raw_text,
  case when n_chars < 60 then 'damaged' end as error, source, lang
from {documents}"""

SQL["entities"] = """
select s_suppkey as entity_id, s_suppkey as entity_no, s_name as canonical_name, s_nationkey
from {supplier}"""

SQL["mentions"] = """
select obligation_id as mention_id, document_id, responsible_entity_id as entity_id,
  case when responsible_entity_id is null then rn % 7 end as suggested_entity_id,
  responsible_entity_id is not null as resolved, cast(null as bigint) as resolved_by, created_at
from {obligations}"""

SQL["notification_events"] = """
select event_id, case when value >= 60 then 'risk_detected' else 'processing_complete' end as event_type,
  props as payload from {events}"""

SQL["notifications"] = """
select event_id as notification_id, user_id % 25 as user_id, event_id + 7 as event_id, 'in_app' as channel,
  case event_type when 'view' then 'read' when 'click' then 'sent' else 'pending' end as status,
  cast(null as timestamp) as read_at
from {events}"""

# Text views of the checking engine.  The Spark spelling is in Fixtures below.
_NORM = ("trim(regexp_replace(replace(translate(replace(replace(replace(replace(replace(nfc_normalize({c}),"
         "chr(64256),'ff'),chr(64257),'fi'),chr(64258),'fl'),chr(64259),'ffi'),chr(64260),'ffl'),"
         "concat(chr(8216),chr(8217),chr(8218),chr(8219),chr(8220),chr(8221),chr(8222),chr(8223),"
         "chr(8211),chr(8212),chr(8213),chr(160),chr(8201),chr(8202),chr(8239)),"
         "'''''''''\"\"\"\"---    '),chr(8230),'...'),'[ \\t\\r\\n]+',' ','g'))")


def norm_sql(column: str) -> str:
    """normalize_text in the checking engine's SQL."""
    return _NORM.replace("{c}", column)


# White space as Python's: its characters, and within a class of the checking engine's expressions.
_SPACE_SQL = " || ".join(f"chr({ord(c)})" for c in PY_SPACE)
_SPACE_CLASS = "".join(f"\\x{ord(c):02x}" if ord(c) < 128 else c for c in PY_SPACE)
# Headings; check_sql takes a word in braces for a view, so the class of digits is put together from two strings.
_NUMBERED = rf"'(^|[{_SPACE_CLASS}])(\p{{' || 'Nd}}+[.)][{_SPACE_CLASS}]+[A-Za-z][^\n]{{1,120}})()'"
_CAPITAL = rf"'(^|[{_SPACE_CLASS}])([A-Z][A-Z{_SPACE_CLASS}]{{4,40}})([{_SPACE_CLASS}]|$)'"


def _starts_sql(heading: str) -> str:
    """Where the second group of an expression starts, for every match in t: chr(1) marks the places."""
    parts = (f"list_transform(string_split(regexp_replace(replace(t, chr(1), chr(2)), {heading}, "
             rf"'\1' || chr(1) || '\2\3', 'g'), chr(1)), lambda p: length(p))")
    return f"list_transform(range(1, len({parts})), lambda i: cast(list_sum(({parts})[1:i]) as bigint))"


# Starts of headings, the numbered ones first, each kept if it lies 250 characters behind the one kept last; -250 opens the list.
_KEPT_SQL = f"""
select *, list_reduce(
    list_prepend([cast(-250 as bigint)], list_transform(list_concat(numbered, capital), lambda x: [x])),
    lambda a, x: case when x[1] >= a[-1] + 250 then list_concat(a, x) else a end) as kept
from (select document_id, page_number, t, length(t) as size,
        case when length(t) > 4000 then {_starts_sql(_NUMBERED)} else [] end as numbered,
        case when length(t) > 4000 then {_starts_sql(_CAPITAL)} else [] end as capital
      from (select document_id, page_number, normalized_text as t from {{pages_doc}} where processing_status = 'processed') n) h"""


CHECK_SQL: dict[str, str] = {
    "pages_doc": f"""
select document_id, page_number, case when error is null then raw_text else '' end as raw_text,
  case when error is null then {norm_sql('raw_text')} else '' end as normalized_text,
  'pdf_text' as text_source,
  case when error is null then 'processed' else 'failed' end as processing_status,
  error is null and length(trim(raw_text, chr(32) || chr(10) || chr(9) || chr(13))) < 50 as is_scanned
from {{page_texts}}""",
    "pages_line": f"""
select document_id, cast(i as int) as page_number, l as raw_text, {norm_sql('l')} as normalized_text,
  'pdf_text' as text_source, 'processed' as processing_status
from (select doc_id as document_id, unnest(string_split(text, chr(10))) as l,
        unnest(range(1, 1 + len(string_split(text, chr(10))))) as i from {{documents}}) x""",
    "chunks": """
select document_id, page_number, cast(s as int) as char_start,
  cast(least(s + 4000, length(normalized_text)) as int) as char_end,
  substr(normalized_text, cast(s as int) + 1, 4000) as text,
  case when length(normalized_text) <= 4000 then 'full_page' else 'token_limit' end as split_reason
from (select *, unnest(range(0, greatest(length(normalized_text), 1), 4000)) as s from {pages_doc}
      where processing_status = 'processed') x
where trim(substr(normalized_text, cast(s as int) + 1, 4000)) <> ''""",
    # Chunks by the whole rule: texts above the limit are cut at headings and, between them, at every 4 000 characters.
    "split_chunks": f"""
select document_id, page_number, char_start, char_end, text, split_reason from (
  select document_id, page_number, cast(s as int) as char_start, cast(least(s + 4000, stop) as int) as char_end,
    substr(t, cast(s as int) + 1, cast(least(s + 4000, stop) - s as int)) as text,
    case when size <= 4000 then 'full_page' when headed and stop - s <= 4000 then 'section_split' else 'token_limit' end as split_reason
  from (select *, unnest(range(start, greatest(stop, start + 1), 4000)) as s
        from (select *, unnest(edges) as start, unnest(list_concat(edges[2:], [size])) as stop
              from (select *, list_concat([cast(0 as bigint)], list_filter(kept, lambda x: x > 0)) as edges, len(kept) > 1 as headed
                    from ({_KEPT_SQL}) k) e) x) y) z
where trim(text, {_SPACE_SQL}) <> ''""",
    "labeled_chunks": """
select c.*, case l.quality when 1 then 'agreement_body' when 0 then 'non_agreement' end as section_label
from {split_chunks} c left join {labels} l on l.doc_id = c.document_id""",
    "quotes": f"""
select document_id * 100000 + page_number as item_id, document_id, page_number as line_no,
  case page_number % 4 when 1 then concat(raw_text, ' NOTE: ', reverse(raw_text))
    when 2 then replace(raw_text, 'tion', 'tlon') else raw_text end as quote,
  timestamp '2024-01-01 00:00:00' as created_at
from {{pages_line}} where raw_text <> ''""",
    "truth": """
select document_id, cast(page_number as bigint) as item_no, raw_text as quote, cast(page_number as int) as page_hint,
  case page_number % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as severity
from {pages_line} where raw_text <> ''""",
}
# Normalised text without white space of any kind at its ends, as normalize_text gives it, '' where there is none, and what is cut from it.
CHECK_SQL["stripped_pages"] = f"""
select * replace (coalesce(raw_text, '') as raw_text, coalesce(trim(normalized_text, {_SPACE_SQL}), '') as normalized_text) from {{pages_doc}}"""
CHECK_SQL["stripped_chunks"] = CHECK_SQL["split_chunks"].replace("{pages_doc}", "{stripped_pages}")
CHECK_SQL["stripped_labels"] = CHECK_SQL["labeled_chunks"].replace("{split_chunks}", "{stripped_chunks}")
# Uploads of a stream, the first copy of a text in a source alone, as one page each, and what is cut from it.
CHECK_SQL["fresh_pages"] = f"""
select doc_id as document_id, cast(1 as int) as page_number, coalesce(trim({norm_sql('text')}, {_SPACE_SQL}), '') as normalized_text,
  'processed' as processing_status from {{documents}} where doc_id in (select min(doc_id) from {{documents}} group by sha256(text), source)"""
CHECK_SQL["fresh_chunks"] = CHECK_SQL["split_chunks"].replace("{pages_doc}", "{fresh_pages}")


def strip_sql(column: str) -> str:
    """strip in the checking engine's SQL."""
    return f"trim({column}, {_SPACE_SQL})"


def check_sql(text: str) -> str:
    """Text for the checking engine: views used become common table expressions."""
    used: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\{(\w+)\}", body):
            if name in TABLES or name in used:
                continue
            visit(CHECK_SQL.get(name) or SQL[name])
            used.append(name)

    visit(text)
    parts = [f"{n} as materialized ({CHECK_SQL.get(n) or SQL[n]})" for n in used]
    head = "with " + ",\n".join(parts) + "\n" if parts else ""
    body = text.strip()
    if head and body.lower().startswith("with "):
        head, body = head.rstrip() + ",\n", body[5:]
    sql = head + body
    sql = re.sub(r"cast\(floor\((.*?)\) as int\)", r"cast(floor(\1) as int)", sql)
    return re.sub(r"\{(\w+)\}", r"\1", sql)


class Fixtures:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._build(name)
        return self._known[name]

    def _build(self, name: str) -> DataFrame:
        if hasattr(type(self), "view_" + name):
            return getattr(self, "view_" + name)()
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return self._spread(table) if name == "documents" else table
        if name in SQL:
            return self.sql(SQL[name])
        raise AttributeError(name)

    def _spread(self, table: DataFrame) -> DataFrame:
        """Long texts in fewer files than cores are dealt out; a table of many files stays as it lies."""
        cores = self.spark.sparkContext.defaultParallelism
        return table.repartition(cores) if len(table.inputFiles()) < cores else table

    def sql(self, text: str) -> DataFrame:
        text = text.replace("sha256(", "sha2_256(")
        text = re.sub(r"sha2_256\((\w+)\)", r"sha2(\1, 256)", text)
        names = dict.fromkeys(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})

    def view_pages_doc(self) -> DataFrame:
        return normalize_pages(page_rows(self.page_texts))

    def view_pages_line(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "raw_text")
        ).select(
            "document_id", (F.col("i") + 1).alias("page_number"), "raw_text",
            normalize_text("raw_text").alias("normalized_text"), F.lit("pdf_text").alias("text_source"),
            F.lit("processed").alias("processing_status"))

    def view_chunks(self) -> DataFrame:
        return chunk_pages(self.pages_doc)

    def view_labeled_chunks(self) -> DataFrame:
        label = F.when(F.col("quality") == 1, "agreement_body").when(F.col("quality") == 0, "non_agreement")
        labels = self.labels.select(F.col("doc_id").alias("document_id"), label.alias("section_label"))
        return self.chunks.join(labels, "document_id", "left")

    def view_quotes(self) -> DataFrame:
        raw, n = F.col("raw_text"), F.col("page_number") % 4
        quote = F.when(n == 1, F.concat(raw, F.lit(" NOTE: "), F.reverse(raw))).when(
            n == 2, F.replace(raw, F.lit("tion"), F.lit("tlon"))).otherwise(raw)
        return self.pages_line.filter(F.col("raw_text") != "").select(
            (F.col("document_id") * 100000 + F.col("page_number")).alias("item_id"), "document_id",
            F.col("page_number").alias("line_no"), quote.alias("quote"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))

    def view_truth(self) -> DataFrame:
        n = F.col("page_number") % 4
        severity = F.when(n == 0, "low").when(n == 1, "medium").when(n == 2, "high").otherwise("critical")
        return self.pages_line.filter(F.col("raw_text") != "").select(
            "document_id", F.col("page_number").cast("long").alias("item_no"), F.col("raw_text").alias("quote"),
            F.col("page_number").cast("int").alias("page_hint"), severity.alias("severity"))
