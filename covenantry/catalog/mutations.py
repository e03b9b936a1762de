"""Change sets applied to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.operators import mutations as M, scoring as S


def reviews_with_edits(fx):
    """Reviews with their field edits as a map; keys that may not be edited are in it too."""
    severity, rule = F.col("edit_severity"), F.col("edit_due_rule")
    entries = F.array(
        F.when(severity.isNotNull(), F.struct(F.lit("severity").alias("k"), severity.alias("v"))),
        F.when(rule.isNotNull(), F.struct(F.lit("due_rule").alias("k"), rule.alias("v"))),
        F.struct(F.lit("status").alias("k"), F.lit("hacked").alias("v")))
    return fx.reviews.withColumn("field_edits", F.map_from_entries(F.array_compact(entries)))


@query("J1_apply_reviews", """
with l as (select obligation_id, arg_max(decision, (decided_at, review_id)) as decision,
             arg_max(reviewer_confidence, (decided_at, review_id)) filter (where reviewer_confidence is not null) as confidence,
             arg_max(edit_severity, (decided_at, review_id)) filter (where decision = 'edit_approve' and edit_severity is not null) as severity,
             arg_max(edit_due_rule, (decided_at, review_id)) filter (where decision = 'edit_approve' and edit_due_rule is not null) as due_rule
           from {reviews} group by obligation_id)
select o.obligation_id, case when l.decision is null then o.status when l.decision = 'reject' then 'rejected' else 'confirmed' end as status,
  l.confidence as reviewer_confidence, coalesce(l.severity, o.severity) as severity, coalesce(l.due_rule, o.due_rule) as due_rule
from {obligations} o left join l on l.obligation_id = o.obligation_id""")
def reviews(fx):
    return M.apply_reviews(fx.obligations, reviews_with_edits(fx), "obligation_id").select(
        "obligation_id", "status", "reviewer_confidence", "severity", "due_rule")


@query("J1_apply_risk_reviews", """
select r.risk_id, case when v.decision = 'reject' then 'rejected' else 'confirmed' end as status, v.reviewer_confidence,
  case when v.decision = 'edit_approve' and v.edit_severity is not null then v.edit_severity else r.severity end as severity, r.risk_text
from {risks} r join {reviews} v on v.review_id = r.risk_id""")
def risk_reviews(fx):
    found = reviews_with_edits(fx).withColumn("risk_id", F.col("review_id"))
    return M.apply_risk_reviews(fx.risks, found).select("risk_id", "status", "reviewer_confidence", "severity", "risk_text")


@query("J1_review_audit", """
select 'obligations' as table_name, obligation_id as record_id, 'update' as action,
  '{"status":"' || case when decision = 'reject' then 'rejected' else 'confirmed' end || '","review_decision":"' || decision || '","reviewer_id":"' || reviewer_id || '"}' as new_values,
  reviewer_id as performed_by from {reviews}""")
def review_audit(fx):
    return M.review_audit(fx.reviews, "obligation_id", "obligations").drop("old_values", "performed_at")


@query("J2_apply_critic", """
with v as (select user_id * 100 + 1 as obligation_id, event_id, event_type = 'click' as valid, cast(floor(value) as int) as confidence
           from {events} where event_type in ('click', 'error')),
l as (select obligation_id, arg_max(valid, event_id) as critic_valid, cast(least(greatest(arg_max(confidence, event_id), 0), 100) as int) as critic_confidence,
        bool_or(not valid and least(greatest(confidence, 0), 100) >= 70) as sunk from v group by obligation_id)
select o.obligation_id, case when sunk then 'rejected' else status end as status, critic_valid, critic_confidence
from {obligations} o left join l on l.obligation_id = o.obligation_id""")
def critic(fx):
    kind = F.col("event_type")
    verdicts = fx.events.select(
        (F.col("user_id") * 100 + 1).alias("obligation_id"), F.col("event_id").alias("answer_no"),
        F.when(kind == "click", "true").when(kind == "error", "false").when(kind == "view", "\"yes\"").alias("valid"),
        F.col("value").alias("confidence"), kind.alias("reasoning"))
    return S.apply_critic(fx.obligations, verdicts, "obligation_id").select(
        "obligation_id", "status", "critic_valid", "critic_confidence")


@query("J3_apply_rescore", """
with v as (select user_id * 100 + 1 as obligation_id, event_id, case event_type when 'view' then 'high' when 'click' then 'low' end as severity,
             case when event_type <> 'signup' then cast(least(greatest(floor(value), 0), 100) as int) end as quality from {events}),
l as (select obligation_id, arg_max(severity, event_id) filter (where severity is not null) as severity,
        arg_max(quality, event_id) filter (where quality is not null) as quality, min(quality) as lowest from v group by obligation_id)
select o.obligation_id, coalesce(l.severity, o.llm_severity) as llm_severity, coalesce(l.quality, o.llm_quality_confidence) as llm_quality_confidence,
  case when lowest < 30 and status = 'needs_review' then 'rejected' else status end as status
from {obligations} o left join l on l.obligation_id = o.obligation_id""")
def rescore(fx):
    kind = F.col("event_type")
    answers = fx.events.select(
        (F.col("user_id") * 100 + 1).alias("obligation_id"), F.col("event_id").alias("answer_no"),
        F.when(kind == "view", " HIGH").when(kind == "click", "low").otherwise("grave").alias("revised_severity"),
        F.when(kind != "signup", F.col("value")).alias("quality_confidence"))
    return S.apply_rescore(fx.obligations, answers, "obligation_id").select(
        "obligation_id", "llm_severity", "llm_quality_confidence", "status")


def _merges(fx):
    """Suppliers fold into the first one of their nation."""
    first = fx.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("target_id"))
    return fx.supplier.join(first, "s_nationkey").filter(F.col("s_suppkey") != F.col("target_id")).select(
        F.col("s_suppkey").alias("source_id"), "target_id")


_MERGE = """
with m as (select s_suppkey as source_id, min(s_suppkey) over (partition by s_nationkey) as target_id, s_name, s_nationkey from {supplier})"""


@query("J4_merge_entities", _MERGE + """
select s_suppkey as entity_id, array_to_string(list_sort(list_distinct((select list(s_name) from m where m.target_id = s.s_suppkey))), '|') as aliases
from {supplier} s where s_suppkey in (select target_id from m)""")
def merge(fx):
    known = fx.entities.withColumn("aliases", F.array("canonical_name"))
    entities, _ = M.merge_entities(known, fx.mentions, _merges(fx))
    return entities.select("entity_id", F.array_join(F.array_sort("aliases"), "|").alias("aliases"))


@query("J4_merged_mentions", _MERGE + """
select mention_id, coalesce(a.target_id, entity_id) as entity_id, coalesce(b.target_id, suggested_entity_id) as suggested_entity_id
from {mentions} x left join m a on a.source_id = x.entity_id left join m b on b.source_id = x.suggested_entity_id""")
def merged_mentions(fx):
    known = fx.entities.withColumn("aliases", F.array("canonical_name"))
    return M.merge_entities(known, fx.mentions, _merges(fx))[1].select("mention_id", "entity_id", "suggested_entity_id")


@query("J4_merge_chains", """
select s_suppkey as source_id, cast((select min(s_suppkey) from {supplier}) as bigint) as target_id from {supplier}
where s_suppkey > (select min(s_suppkey) from {supplier})""")
def chains(fx):
    """Every supplier merged into the one before it: one chain through the whole table."""
    pairs = fx.supplier.select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") - 1).alias("target_id"))
    start = fx.supplier.agg(F.min("s_suppkey").alias("first"))
    return M.resolve_merges(pairs.join(start, F.col("source_id") == F.col("first"), "left_anti"))


@query("J5_resolve_mentions", """
select mention_id, coalesce(s.s_suppkey, m.entity_id) as entity_id, resolved or s.s_suppkey is not null as resolved,
  coalesce(case when s.s_suppkey is not null then 7 end, resolved_by)::bigint as resolved_by
from {mentions} m left join {supplier} s on s.s_suppkey = m.document_id and not m.resolved""")
def resolve(fx):
    decisions = fx.mentions.filter(~F.col("resolved")).select(
        "mention_id", F.col("document_id").alias("entity_id"), F.lit(7).cast("bigint").alias("resolved_by"))
    return M.resolve_mentions(fx.mentions, decisions, fx.entities).select(
        "mention_id", "entity_id", "resolved", "resolved_by")


def _tables(fx):
    return {
        "documents": fx.docs, "obligations": fx.obligations, "risks": fx.risks, "obligation_evidence": fx.evidence,
        "obligation_reviews": fx.reviews, "entity_mentions": fx.mentions, "extraction_runs": fx.runs,
        "assets": fx.assets, "user_asset_assignments": fx.assignments}


def _sizes(tables):
    parts = [df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_GONE = "(select document_id from {docs} where doc_type = 'invoice')"


@query("J6_cascade_delete", f"""
select 'documents' as table_name, count(*) as n from {{docs}} where document_id not in {_GONE}
union all select 'obligations', count(*) from {{obligations}} where document_id not in {_GONE}
union all select 'risks', count(*) from {{risks}} where document_id not in {_GONE}
union all select 'obligation_evidence', count(*) from {{evidence}} where obligation_id not in (select obligation_id from {{obligations}} where document_id in {_GONE})
union all select 'obligation_reviews', count(*) from {{reviews}} where obligation_id not in (select obligation_id from {{obligations}} where document_id in {_GONE})
union all select 'entity_mentions', count(*) from {{mentions}} where document_id not in {_GONE}
union all select 'extraction_runs', count(*) from {{runs}} where document_id not in {_GONE}
union all select 'assets', count(*) from {{assets}}
union all select 'user_asset_assignments', count(*) from {{assignments}}""")
def cascade(fx):
    return _sizes(M.cascade_delete(_tables(fx), fx.docs.filter(F.col("doc_type") == "invoice")))


@query("J6_delete_assets", """
select document_id, asset_id from {docs} where asset_id not in (select asset_id from {assets} where created_by = 3)""")
def delete_assets(fx):
    return M.delete_assets(_tables(fx), fx.assets.filter(F.col("created_by") == 3))["documents"].select(
        "document_id", "asset_id")


@query("J7_clear_extractions", f"""
select 'documents' as table_name, count(*) as n from {{docs}}
union all select 'obligations', count(*) from {{obligations}} where document_id not in {_GONE}
union all select 'obligation_evidence', count(*) from {{evidence}} where obligation_id not in (select obligation_id from {{obligations}} where document_id in {_GONE})
union all select 'obligation_reviews', count(*) from {{reviews}}""")
def clear(fx):
    tables = M.clear_extractions(_tables(fx), fx.docs.filter(F.col("doc_type") == "invoice"))
    return _sizes({k: tables[k] for k in ("documents", "obligations", "obligation_evidence", "obligation_reviews")})


@query("J8_mark_read", """
select notification_id, case when user_id = 3 then 'read' else status end as status,
  case when user_id = 3 then timestamp '2024-06-01 00:00:00' else read_at end as read_at from {notifications}""")
def mark_read(fx):
    asked = fx.notifications.select(
        "notification_id", F.lit(3).cast("bigint").alias("user_id"),
        F.lit("2024-06-01").cast("timestamp").alias("read_at"))
    return M.mark_read(fx.notifications, asked).select("notification_id", "status", "read_at")


@query("J9_assign_assets", """
select user_id, asset_id from {assignments} union select o_custkey % 25, o_custkey from {orders}""")
def assign(fx):
    asked = fx.orders.select((F.col("o_custkey") % 25).alias("user_id"), F.col("o_custkey").alias("asset_id"))
    return M.assign_assets(fx.assignments, asked)[0]


@query("J9_remove_assets", """
select user_id, asset_id from {assignments} where not exists (select 1 from {orders} where o_custkey % 25 = user_id and o_custkey = asset_id)""")
def remove(fx):
    asked = fx.orders.select((F.col("o_custkey") % 25).alias("user_id"), F.col("o_custkey").alias("asset_id"))
    return M.remove_assets(fx.assignments, asked)


@query("J10_advance_status", """
select document_id, case when asset_id % 10 = 0 then 'failed' else 'scoring' end as parse_status from {docs}""")
def advance(fx):
    docs = fx.docs.withColumn("parse_status", F.when(F.col("asset_id") % 10 == 0, "failed").otherwise(F.col("parse_status")))
    return M.advance_status(docs, "scoring").select("document_id", "parse_status")


@query("J11_audit_rows", """
select 'assets' as table_name, asset_id as record_id, 'create' as action, '{"name":"' || name || '"}' as new_values from {assets}""")
def audit(fx):
    return M.audit_rows(fx.assets, "assets", "asset_id", "create", new=["name"]).drop("old_values")


@query("J12_update_users", """
select u.user_id, coalesce(c.role, u.role) as role, coalesce(c.digest_enabled, u.digest_enabled) as digest_enabled from {users} u
left join (select c_nationkey as user_id, case when count(*) % 2 = 0 then 'reviewer' end as role, case when count(*) % 3 = 0 then false end as digest_enabled
           from {customer} group by c_nationkey) c on c.user_id = u.user_id""")
def users(fx):
    n = F.count(F.lit(1))
    changes = fx.customer.groupBy(F.col("c_nationkey").cast("bigint").alias("user_id")).agg(
        F.when(n % 2 == 0, "reviewer").alias("role"), F.when(n % 3 == 0, False).alias("digest_enabled"))
    return M.update_users(fx.users, changes).select("user_id", "role", "digest_enabled")


@query("J12_role_audit", """
select 'users' as table_name, cast(c_nationkey as bigint) as record_id, 'update' as action, '{{"role":"reviewer"}}' as new_values, c_custkey as performed_by
from {customer} where c_nationkey in (select n_nationkey from {nation}) and c_acctbal > 0""".replace("{{", "{").replace("}}", "}"))
def role_audit(fx):
    changes = fx.customer.select(
        F.col("c_nationkey").cast("bigint").alias("user_id"), F.when(F.col("c_acctbal") > 0, "reviewer").alias("role"),
        F.col("c_custkey").alias("performed_by"))
    return M.role_audit(fx.users, changes).drop("old_values")
