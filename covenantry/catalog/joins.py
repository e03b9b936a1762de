"""Joins, scope and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.operators import contradictions as K, entities as E, evaluation as V, listing as L
from covenantry.operators.containment import distinct_needles, first_pages
from covenantry.operators.anchoring import EVIDENCE_KEY, anchor_exact
from covenantry.operators.notices import recipients
from covenantry.operators.scoring import last_answer
from covenantry.session import written
from covenantry.sources.files import check_requests


@query("D1_item_asset_join", """
select o.obligation_id, d.asset_id, a.name as asset_name from {obligations} o
join {docs} d on d.document_id = o.document_id join {assets} a on a.asset_id = d.asset_id""")
def item_asset(fx):
    return L.with_asset(fx.obligations, fx.docs, fx.assets).select("obligation_id", "asset_id", "asset_name")


@query("D2_visible_assets", """
select a.user_id, a.asset_id, s.name from (select distinct user_id, asset_id from {assignments}) a
join {users} u on u.user_id = a.user_id join {assets} s on s.asset_id = a.asset_id where u.role <> 'admin'""")
def visible_assets(fx):
    return L.visible_assets(fx.assets, fx.assignments, fx.users)


@query("D2_row_scope", """
select o.obligation_id from {obligations} o join {docs} d on d.document_id = o.document_id
where d.asset_id in (select asset_id from {assignments} where user_id = 19) and d.asset_id = 1""")
def row_scope(fx):
    return L.in_scope(
        fx.obligations, fx.docs, fx.assignments, user_id=19, role="viewer", asset_id=1
    ).select("obligation_id")


_PROOF = """(select *, row_number() over (partition by obligation_id order by created_at, evidence_id) as n from {evidence})"""
_LAST = """(select *, row_number() over (partition by obligation_id order by decided_at desc, review_id desc) as n from {reviews})"""


@query("D3_export_lookups", f"""
select o.obligation_id, d.source_name as document_filename, a.name as asset_name, e.page_number as evidence_page_number,
  e.raw_char_end as evidence_char_end, r.decided_at as last_reviewed_at, u.email as reviewer_email
from {{obligations}} o left join {{docs}} d on d.document_id = o.document_id left join {{assets}} a on a.asset_id = d.asset_id
left join {_PROOF} e on e.obligation_id = o.obligation_id and e.n = 1
left join {_LAST} r on r.obligation_id = o.obligation_id and r.n = 1
left join {{users}} u on u.user_id = r.reviewer_id""")
def lookups(fx):
    return L.resolve_export_rows(
        fx.obligations, fx.docs, fx.assets, fx.evidence, fx.reviews, fx.users, key="obligation_id"
    ).select("obligation_id", "document_filename", "asset_name", "evidence_page_number", "evidence_char_end",
             "last_reviewed_at", "reviewer_email")


@query("D4_evidence_anti_join", """
select e.evidence_id from {evidence} e where not exists (
  select 1 from {evidence} x where x.source = 'ocr' and x.quote_sha256 = e.quote_sha256 and x.document_id = e.document_id
    and x.page_number = e.page_number and x.normalized_char_start = e.normalized_char_start and x.normalized_char_end = e.normalized_char_end)""")
def anti(fx):
    stored = fx.evidence.filter(F.col("source") == "ocr").select(*EVIDENCE_KEY)
    return fx.evidence.join(stored, EVIDENCE_KEY, "left_anti").select("evidence_id")


_PAIRS = r"""
with a as (select *, case when obligation_type = 'payment' then array_to_string(list_sort(list_distinct(
             regexp_extract_all(obligation_text, '\$\s*([\d,]+(?:\.\d+)?)', 1))), '|') else '' end as amounts
           from {obligations} where status <> 'rejected'),
p as (select x.document_id, x.obligation_id as first_id, y.obligation_id as second_id, x.created_at as first_at, y.created_at as second_at
      from a x join a y on x.document_id = y.document_id and x.obligation_type = y.obligation_type
        and (x.created_at < y.created_at or (x.created_at = y.created_at and x.obligation_id < y.obligation_id))
      where (x.due_date <> y.due_date) or (x.responsible_entity_id = y.responsible_entity_id and x.severity <> y.severity)
        or (x.amounts <> '' and y.amounts <> '' and x.amounts <> y.amounts))"""


@query("D5_contradiction_pairs", _PAIRS + """
select document_id, case when first_id::varchar < second_id::varchar then first_id else second_id end as a_id,
  case when first_id::varchar < second_id::varchar then second_id else first_id end as b_id from p""")
def pairs(fx):
    return K.contradiction_pairs(fx.obligations).select("document_id", "a_id", "b_id")


@query("D5_contradiction_flags", _PAIRS + """
select obligation_id, obligation_id in (select first_id from p union all select second_id from p) as contradiction_flag from {obligations}""")
def flags(fx):
    return K.flag_contradictions(fx.obligations).select("obligation_id", "contradiction_flag")


@query("D5_conflict_groups", _PAIRS + """,
v as (select document_id, obligation_type, 'due_date' as conflict, null::varchar as party, due_date::varchar as value from a where due_date is not null
      union all select document_id, obligation_type, 'amounts', null, amounts from a where amounts <> ''
      union all select document_id, obligation_type, 'severity', responsible_entity_id::varchar, severity from a where responsible_entity_id is not null),
c as (select *, cast(count(*) as bigint) as members from v group by all),
o as (select *, cast(sum(members) over (partition by document_id, obligation_type, conflict, party) - members as bigint) as others from c)
select * from o where others > 0""")
def groups(fx):
    return K.conflict_groups(fx.obligations)


@query("D6_contradiction_outputs", _PAIRS + """,
s as (select *, first_id as obligation_id, 0 as side from p union all select *, second_id, 1 from p),
w as (select s.*, e.page_number, e.quote_sha256, e.normalized_char_end, row_number() over (
        partition by e.quote_sha256, e.document_id, e.page_number, e.normalized_char_start, e.normalized_char_end
        order by first_at, first_id, second_at, second_id, side, evidence_id) as n
      from s join {evidence} e on e.obligation_id = s.obligation_id)
select sha256(least(first_id::varchar, second_id::varchar) || ':' || greatest(first_id::varchar, second_id::varchar)) as risk_id,
  document_id, page_number, quote_sha256, normalized_char_end from w where n = 1""")
def outputs(fx):
    found = K.contradiction_pairs(fx.obligations)
    return K.contradiction_outputs(found, fx.evidence)[2].select(
        "risk_id", "document_id", "page_number", "quote_sha256", "normalized_char_end")


@query("D7_text_containment_join", """
select q.item_id, min(p.page_number) as page_number from {quotes} q join {pages_line} p on p.document_id = q.document_id
where strpos(p.normalized_text, q.quote) > 0 group by q.item_id""")
def containment(fx):
    asked, needles = distinct_needles(fx.quotes.select("item_id", "document_id", F.col("quote").alias("needle")))
    # stored, as pages are read more than once, and normalised once only
    pages = written(fx.pages_line.select(
        "document_id", "page_number", F.col("text_source").alias("source"), F.col("normalized_text").alias("page_text")))
    found = first_pages(needles, pages.filter(F.col("page_text") != ""))
    return asked.join(found, ["document_id", "needle_id"]).select("item_id", "page_number")


def _loose_names(fx):
    """Part and supplier names, each also with a letter doubled or changed."""
    names = fx.supplier.select(F.col("s_name").alias("n")).unionByName(fx.part.select(F.col("p_name").alias("n")))
    forms = F.array(F.col("n"), F.upper("n"), F.replace("n", F.lit("p"), F.lit("pp")), F.replace("n", F.lit("e"), F.lit("a")))
    return names.select(F.explode(forms).alias("mentioned_name"))


@query("D8_fuzzy_entity_join")
def fuzzy_entities(fx):
    known = fx.entities.withColumn("aliases", F.array(F.concat(F.lit("The "), F.col("canonical_name"))))
    return E.suggest_entities(_loose_names(fx), known)


@query("D9_notification_events", """
select n.notification_id, n.user_id, n.event_id, e.event_type, e.payload from {notifications} n
left join {notification_events} e on e.event_id = n.event_id""")
def notification_events(fx):
    return L.notification_view(fx.notifications, fx.notification_events).select(
        "notification_id", "user_id", "event_id", "event_type", "payload")


@query("D10_id_list_enrichment", """
select o.obligation_id, r.decision, r.reviewer_confidence from {obligations} o left join (
  select obligation_id, decision, reviewer_confidence, row_number() over (partition by obligation_id order by review_id desc) as n
  from {reviews}) r on r.obligation_id = o.obligation_id and r.n = 1""")
def enrichment(fx):
    answers = fx.reviews.select(
        "obligation_id", F.col("review_id").alias("answer_no"), "decision", "reviewer_confidence")
    return fx.obligations.select("obligation_id").join(
        last_answer(answers, "obligation_id"), "obligation_id", "left")


def expected_pages(fx):
    return fx.documents.select(
        F.col("doc_id").alias("document_id"),
        F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("page_number"))


@query("D11_label_errors", """
select document_id, page_number, char_start, case when document_id % 2 = 0 and section_label = 'non_agreement' then 'false_exclusion'
  when document_id % 2 = 1 and section_label = 'agreement_body' then 'false_inclusion' end as label_error from {stripped_labels}""")
def label_errors(fx):
    return V.label_errors(fx.labeled_chunks, expected_pages(fx)).select(
        "document_id", "page_number", "char_start", "label_error")


@query("D12_reference_check", """
select l_orderkey * 100 + l_linenumber as request_id, l_partkey, l_suppkey,
  case when l_partkey % 1000 >= 900 then 'IFC model not found' when o.o_orderkey is null then 'Spec document not found' end as reason
from {lineitem} l left join {orders} o on o.o_orderkey = l.l_orderkey and o.o_orderpriority = '1-URGENT'""")
def reference_check(fx):
    requests = fx.lineitem.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("request_id"), "l_partkey", "l_suppkey",
        (F.col("l_partkey") % 1000).alias("ifc_model_id"), F.col("l_orderkey").alias("spec_document_id"))
    models = fx.part.select((F.col("p_partkey") % 1000).alias("ifc_model_id")).filter(
        F.col("ifc_model_id") < 900).distinct()
    specs = fx.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("document_id"))
    return check_requests(requests, models, specs).select("request_id", "l_partkey", "l_suppkey", "reason")


@query("I1_items_union", """
select 'obligation' as kind, obligation_id as item_id, document_id, obligation_type as item_type, obligation_text as quote, severity, status,
  system_confidence from {obligations}
union all select 'risk', risk_id, document_id, risk_type, risk_text, severity, status, system_confidence from {risks}""")
def union(fx):
    parts = [
        df.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("item_id"), "document_id",
                  F.col(f"{kind}_type").alias("item_type"), F.col(f"{kind}_text").alias("quote"),
                  "severity", "status", "system_confidence")
        for kind, df in (("obligation", fx.obligations), ("risk", fx.risks))]
    return parts[0].unionByName(parts[1])


@query("I2_recipients", """
select document_id, uploaded_by as user_id from {docs} union
select d.document_id, a.user_id from {docs} d join {assignments} a on a.asset_id = d.asset_id""")
def receivers(fx):
    return recipients(fx.docs, fx.assignments)


@query("I3_alias_union", """
select s_nationkey, array_to_string(list_sort(list_distinct(list(n))), '|') as aliases from (
  select s_nationkey, s_name as n from {supplier} union all
  select s_nationkey, case when s_suppkey % 2 = 0 then 'Group ' || s_nationkey else s_name end from {supplier}) x group by s_nationkey""")
def alias_union(fx):
    second = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Group "), F.col("s_nationkey").cast("string"))).otherwise(F.col("s_name"))
    names = fx.supplier.select("s_nationkey", F.explode(F.array_union(F.array("s_name"), F.array(second))).alias("n")).distinct()
    return names.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("n")), "|").alias("aliases"))
