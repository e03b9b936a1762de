"""Quality against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.catalog.joins import expected_pages
from covenantry.operators import evaluation as V


def extracted(fx):
    """Found items: lines with a small edit, every fourth line joined with its own end."""
    raw, n = F.col("quote"), F.col("item_no") % 4
    quote = F.when(n == 0, F.concat(F.reverse("quote"), F.lit(" "), raw)).when(
        n == 1, F.replace(raw, F.lit("tion"), F.lit("tlon"))).otherwise(raw)
    severity = F.when(n == 2, "critical").otherwise(F.col("severity"))
    return fx.truth.select("document_id", "item_no", quote.alias("quote"), severity.alias("severity"))


@query("N1_match_items")
def match(fx):
    return V.match_items(fx.truth, extracted(fx))


@query("N1_unmatched_items")
def unmatched(fx):
    found = extracted(fx)
    return V.unmatched_items(fx.truth, found, V.match_items(fx.truth, found))


_COUNTS = """
with c as (select document_id, cast(count(*) filter (where status = 'confirmed') as bigint) as tp, cast(count(*) filter (where status = 'rejected') as bigint) as fp,
             cast(count(*) filter (where status = 'needs_review') as bigint) as fn from {obligations} group by document_id),
m as (select *, case when tp + fp > 0 then tp::double / (tp + fp) end as p, case when tp + fn > 0 then tp::double / (tp + fn) end as r from c)"""


def _counts(fx):
    state = F.col("status")
    return fx.obligations.groupBy("document_id").agg(
        F.count_if(state == "confirmed").alias("tp"), F.count_if(state == "rejected").alias("fp"),
        F.count_if(state == "needs_review").alias("fn"))


@query("N2_precision_recall", _COUNTS + """
select document_id, tp, fp, fn, round(p, 3) as precision, round(r, 3) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) end, 3) as f1 from m""")
def prf(fx):
    return V.prf(_counts(fx))


@query("N3_severity_agreement", """
with p as (select document_id, created_at, obligation_id, case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end as g,
             case status when 'rejected' then 1 when 'confirmed' then 3 else 4 end as h from {obligations}),
k as (select *, row_number() over (partition by document_id order by g, obligation_id) as rg, row_number() over (partition by document_id order by h, obligation_id) as rh from p)
select document_id, count(*) as pairs, round(count(*) filter (where g = h)::double / count(*), 3) as exact_match_rate,
  round(count(*) filter (where abs(g - h) <= 1)::double / count(*), 3) as adjacent_agreement_rate,
  case when count(*) >= 2 then round(1.0::double - 6.0::double * sum((rg - rh) * (rg - rh)) / (count(*) * (count(*) * count(*) - 1)), 3) end as spearman_rho
from k group by document_id""")
def severity(fx):
    said = F.when(F.col("status") == "rejected", "low").when(F.col("status") == "confirmed", "high").otherwise("critical")
    pairs = fx.obligations.select(
        "document_id", F.col("obligation_id").alias("pair_no"), F.col("severity").alias("gt_severity"),
        said.alias("pl_severity"))
    return V.severity_agreement(pairs, "document_id")


@query("N4_judged_items", """
select o.obligation_id as item_no, o.document_id, coalesce(r.decision, 'reject') as verdict from {obligations} o left join (
  select obligation_id, arg_max(decision, review_id) as decision from {reviews} group by obligation_id) r on r.obligation_id = o.obligation_id""")
def judged(fx):
    items = fx.obligations.select("document_id", F.lit("obligation").alias("kind"), F.col("obligation_id").alias("item_no"))
    verdicts = fx.reviews.join(fx.obligations.select("obligation_id", "document_id"), "obligation_id").select(
        "document_id", F.lit("obligation").alias("kind"), F.col("obligation_id").alias("item_no"),
        F.col("decision").alias("verdict"), F.col("review_id").alias("answer_no"))
    return V.judged(items, verdicts, "reject").select("item_no", "document_id", "verdict")


@query("N4_adjusted_metrics", """
with c as (select document_id, count(*) filter (where l.status = 'confirmed') as tp, count(*) filter (where l.status = 'rejected' and qty <= 20) as accepted_fp,
             count(*) filter (where l.status = 'rejected' and qty > 20) as rejected_fp, count(*) filter (where l.status = 'needs_review' and qty <= 30) as real_miss_fn,
             count(*) filter (where l.status = 'needs_review' and qty > 30) as gt_error_fn from {obligations} l group by document_id),
m as (select *, coalesce(case when tp + accepted_fp + rejected_fp > 0 then (tp + accepted_fp)::double / (tp + accepted_fp + rejected_fp) end, 0) as p,
        coalesce(case when tp + accepted_fp + real_miss_fn > 0 then (tp + accepted_fp)::double / (tp + accepted_fp + real_miss_fn) end, 0) as r from c)
select document_id, round(p, 3) as precision, round(r, 3) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 3) as f1,
  gt_error_fn as gt_errors_dropped from m""")
def adjusted(fx):
    state, q = F.col("status"), F.col("qty")
    counts = fx.obligations.groupBy("document_id").agg(
        F.count_if(state == "confirmed").alias("tp"),
        F.count_if((state == "rejected") & (q <= 20)).alias("accepted_fp"),
        F.count_if((state == "rejected") & (q > 20)).alias("rejected_fp"),
        F.count_if((state == "needs_review") & (q <= 30)).alias("real_miss_fn"),
        F.count_if((state == "needs_review") & (q > 30)).alias("gt_error_fn"))
    return V.adjusted_metrics(counts).select("document_id", "precision", "recall", "f1", "gt_errors_dropped")


_CURATED = r"""
with q as (select document_id, item_no, page_hint, case item_no % 5 when 0 then 'A landlord must keep ' when 1 then 'The tenant has the right to ' else '' end || quote as quote from {truth}),
c as (select *, case when page_hint between 2 and 3 or page_hint = 7 then 'page_range' when regexp_matches(quote, '(?i)^\s*A\s+landlord\s+(must|may|shall)') then 'pattern:landlord_must'
        when regexp_matches(quote, '(?i)The\s+tenant\s+has\s+the\s+right\s+to') then 'pattern:tenant_has_right' end as removed_reason from q)"""


def _curated(fx):
    n = F.col("item_no") % 5
    head = F.when(n == 0, "A landlord must keep ").when(n == 1, "The tenant has the right to ").otherwise("")
    items = fx.truth.select("document_id", "item_no", "page_hint", F.concat(head, F.col("quote")).alias("quote"))
    pages = fx.documents.select(F.col("doc_id").alias("document_id"), F.lit("2-3, 7").alias("pages"))
    return V.curate(items, pages, has_page_hint=True)


@query("N5_curate_ground_truth", _CURATED + """
select document_id, item_no, removed_reason from c""")
def curate(fx):
    return _curated(fx).select("document_id", "item_no", "removed_reason")


@query("I4_removal_counts", _CURATED + """
select document_id, coalesce(removed_reason, 'kept') as reason, count(*) as items from c group by document_id, 2""")
def removal(fx):
    return V.removal_counts(_curated(fx))


@query("N6_section_filter_report", """
select document_id, count(*) as total, count(*) filter (where section_label = 'agreement_body') as agreement_body,
  count(*) filter (where section_label = 'non_agreement') as non_agreement, count(*) filter (where section_label is null) as unlabeled,
  count(*) filter (where document_id % 2 = 0 and section_label = 'non_agreement') as false_exclusions,
  count(*) filter (where document_id % 2 = 1 and section_label = 'agreement_body') as false_inclusions
from {labeled_chunks} group by document_id""")
def section_report(fx):
    return V.section_filter_report(fx.labeled_chunks, expected_pages(fx))


@query("N7_experiment_comparison")
def experiment(fx):
    """Matching, metrics and severity agreement of another answer set, per document."""
    truth, found = fx.truth, extracted(fx)
    pairs = V.match_items(truth, found)
    metrics = V.prf(V.match_counts(truth, found, pairs))
    gt = truth.select("document_id", F.col("item_no").alias("gt_no"), F.col("severity").alias("gt_severity"))
    pl = found.select("document_id", F.col("item_no").alias("pl_no"), F.col("severity").alias("pl_severity"))
    judged_pairs = pairs.join(gt, ["document_id", "gt_no"]).join(pl, ["document_id", "pl_no"]).select(
        "document_id", F.col("gt_no").alias("pair_no"), "gt_severity", "pl_severity")
    return metrics.join(V.severity_agreement(judged_pairs, "document_id"), "document_id", "left")
