"""Notifications, digests and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.operators import listing as L, notices as N

TODAY = "1998-06-01"


def today():
    return F.lit(TODAY).cast("date")


_EVENTS = """
with e as (select document_id, 'processing_complete' as event_type,
             '{"document_id":"' || document_id || '","asset_id":"' || asset_id || '","parse_status":"' || parse_status || '","source_name":"' || source_name || '"}' as payload
           from {docs}
           union all
           select d.document_id, 'risk_detected', '{"document_id":"' || d.document_id || '","asset_id":"' || d.asset_id || '","high_or_critical_count":' || r.n || '}'
           from {docs} d join (select document_id, count(*) as n from {risks} where severity in ('high', 'critical') group by document_id) r
             on r.document_id = d.document_id)"""


@query("L2_document_events", _EVENTS + """
select document_id, event_type, payload, sha256(document_id || ':' || event_type) as event_id from e""")
def events(fx):
    return N.document_events(fx.docs, fx.risks)


@query("L2_user_notifications", _EVENTS + """,
r as (select document_id, uploaded_by as user_id from {docs} union select d.document_id, a.user_id from {docs} d join {assignments} a on a.asset_id = d.asset_id)
select e.document_id, e.event_type, r.user_id, c.channel, 'pending' as status from e join r on r.document_id = e.document_id
cross join (select 'in_app' as channel union all select 'email') c""")
def notifications(fx):
    return N.emit_notifications(fx.docs, fx.assignments, fx.risks, email_enabled=True)[1].drop("event_id")


@query("L3_compliance_notices", """
select o_orderkey as report_id, o_custkey % 25 as user_id, 'processing_complete' as event_type, 'in_app' as channel,
  '{"report_id":"' || o_orderkey || '","status":"' || case o_orderstatus when 'F' then 'completed' else 'failed' end || '","total":' || o_custkey || ',"failed":' || o_orderkey % 5 || '}' as payload
from {orders} where o_orderstatus <> 'P'""")
def compliance(fx):
    state = F.col("o_orderstatus")
    return N.compliance_notices(fx.orders.select(
        F.col("o_orderkey").alias("report_id"), (F.col("o_custkey") % 25).alias("created_by"),
        F.when(state == "F", "completed").when(state == "O", "failed").otherwise("running").alias("status"),
        F.col("o_custkey").alias("total"), (F.col("o_orderkey") % 5).alias("failed")))


_DIGEST = f"""
with i as (select u.user_id, u.email, o.obligation_id, a.name as asset_name, o.obligation_text, o.due_date, o.severity,
             cast(o.due_date - date '{TODAY}' as int) as days_left
           from {{obligations}} o join {{docs}} d on d.document_id = o.document_id join {{assignments}} s on s.asset_id = d.asset_id
           join {{users}} u on u.user_id = s.user_id join {{assets}} a on a.asset_id = d.asset_id
           where u.is_active and u.digest_enabled and o.due_date between date '{TODAY}' and date '{TODAY}' + 30 and o.status in ('confirmed', 'needs_review')),
b as (select *, case when days_left <= 7 and severity in ('critical', 'high') then 'critical_this_week' when days_left <= 14 then 'due_next_14_days'
        else 'coming_up_30_days' end as bucket from i)"""


def _items(fx):
    return N.digest_items(fx.users, fx.assignments, fx.assets, fx.docs, fx.obligations, today())


@query("L4_digest_items", _DIGEST + """
select user_id, email, obligation_id, asset_name, obligation_text, due_date, severity, days_left, bucket from b""")
def digest_items(fx):
    return _items(fx)


@query("L4_weekly_digest", _DIGEST + """,
r as (select *, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end as rank from b)
select user_id, email as recipient, count(*) as item_count, count(*) filter (where bucket = 'critical_this_week') as critical_count,
  case when count(*) filter (where bucket = 'critical_this_week') > 0 then count(*) filter (where bucket = 'critical_this_week') || ' critical obligations due this week'
    else 'Your weekly digest ' || chr(8212) || ' ' || count(*) || ' obligations approaching' end as subject,
  coalesce(string_agg(obligation_id, ',' order by due_date, -rank, obligation_id) filter (where bucket = 'critical_this_week'), '') as critical_this_week,
  coalesce(string_agg(obligation_id, ',' order by due_date, -rank, obligation_id) filter (where bucket = 'due_next_14_days'), '') as due_next_14_days,
  coalesce(string_agg(obligation_id, ',' order by due_date, -rank, obligation_id) filter (where bucket = 'coming_up_30_days'), '') as coming_up_30_days
from r group by user_id, email""")
def weekly(fx):
    d = N.weekly_digest(_items(fx))
    ids = {b: F.array_join(F.transform(b, lambda e: e["obligation_id"].cast("string")), ",") for b in N.BUCKETS}
    return d.withColumns(ids)


@query("L5_inbox_unread", """
select user_id, count(*) as total, count(*) filter (where status <> 'read') as unread from {notifications} group by user_id""")
def unread(fx):
    return L.unread_counts(fx.notifications)


@query("L5_inbox", """
select notification_id, n.user_id, n.status, e.payload from {notifications} n left join {notification_events} e on e.event_id = n.event_id
where n.user_id = 3 order by notification_id desc limit 50""")
def inbox(fx):
    rows = L.notification_view(fx.notifications.filter(F.col("user_id") == 3), fx.notification_events)
    return L.page_of(rows, F.col("notification_id").desc(), limit=50)[0].select(
        "notification_id", "user_id", "status", "payload")


@query("L6_deadline_approaching", f"""
select obligation_id, document_id, due_date, cast(due_date - date '{TODAY}' as int) as days_left from {{obligations}}
where due_date in (date '{TODAY}' + 7, date '{TODAY}' + 1) and status <> 'rejected'""")
def deadlines(fx):
    return N.approaching_deadlines(fx.obligations, today())


@query("L6_awaiting_review", """
select d.asset_id, count(*) as awaiting_review from {obligations} o join {docs} d on d.document_id = o.document_id
where o.status = 'needs_review' group by d.asset_id""")
def awaiting(fx):
    return N.awaiting_review(fx.obligations, fx.docs)
