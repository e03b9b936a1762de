"""Anchoring, de-duplication, scoring and chunk selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenantry.catalog import query
from covenantry.fixtures import norm_sql
from covenantry.functions.text import collapse_js, normalize_text
from covenantry.operators import anchoring as A, dedup as D, pages as P, scoring as S
from covenantry.operators.context import context_blocks, context_digest


@query("G1_anchor_exact", """
with q as (select item_id, document_id, NORM(quote) as needle from {quotes}),
h as (select q.item_id, q.document_id, p.page_number, strpos(p.normalized_text, needle) - 1 as s, length(needle) as n,
        row_number() over (partition by q.item_id order by p.page_number) as r
      from q join {pages_line} p on p.document_id = q.document_id where needle <> '' and strpos(p.normalized_text, needle) > 0)
select item_id, document_id, page_number, cast(s as int) as start_at, cast(s + n as int) as end_at from h where r = 1""".replace(
    "NORM(quote)", norm_sql("quote")))
def exact(fx):
    hits = A.anchor_exact(fx.quotes, A.prepare_pages(fx.pages_line))
    return hits.select("item_id", "document_id", "hit.page_number", "hit.start_at", "hit.end_at")


@query("G2_anchor_sentence", r"""
with m as (select item_id, document_id, unnest(regexp_split_to_array(quote, '(?i)(?:REMEDY|PROVIDED THAT|EXCEPTION|NOTE|WARNING|CONDITION|PROVISO)\s*:')) as part,
             unnest(range(1, 1 + len(regexp_split_to_array(quote, '(?i)(?:REMEDY|PROVIDED THAT|EXCEPTION|NOTE|WARNING|CONDITION|PROVISO)\s*:')))) as mi from {quotes}),
b as (select *, string_split(regexp_replace(part, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) as l from m),
s as (select item_id, document_id, mi, unnest(range(1, 1 + len(l))) as si, trim(unnest(l), e' \t\r\n') as sentence from b),
c as (select *, NORM(sentence) as needle from s where length(sentence) >= 30),
h as (select c.item_id, c.document_id, p.page_number, strpos(p.normalized_text, needle) - 1 as st, length(needle) as n,
        row_number() over (partition by c.item_id order by -length(sentence), mi, si, p.page_number) as r
      from c join {pages_line} p on p.document_id = c.document_id where needle <> '' and strpos(p.normalized_text, needle) > 0)
select item_id, document_id, page_number, cast(st as int) as start_at, cast(st + n as int) as end_at from h where r = 1""".replace(
    "NORM(sentence)", norm_sql("sentence")))
def sentence(fx):
    hits = A.anchor_sentence(fx.quotes, A.prepare_pages(fx.pages_line))
    return hits.select("item_id", "document_id", "hit.page_number", "hit.start_at", "hit.end_at")


@query("G3_anchor_fuzzy")
def fuzzy(fx):
    """Fuzzy matching of every quote, also of those that anchor exactly."""
    return A.anchor_fuzzy(fx.quotes, A.prepare_pages(fx.pages_line)).select("document_id", "item_id", "hit.*")


def _items(fx):
    return fx.quotes.select(
        "item_id", "document_id", F.lit("obligation").alias("kind"), "quote", "created_at",
        F.lit("needs_review").alias("status"))


@query("G4_verify_items")
def verify(fx):
    return A.verify_items(_items(fx), fx.pages_line)[0].drop("quote")


@query("G5_evidence_dedup", """
select evidence_id from (select *, row_number() over (partition by quote_sha256, document_id, page_number, normalized_char_start, normalized_char_end
  order by created_at, evidence_id) as n from (select evidence_id, quote_sha256, document_id, 1 as page_number, normalized_char_start, normalized_char_end, created_at from {evidence}
     union all select evidence_id + 5, quote_sha256, document_id, 1, normalized_char_start, normalized_char_end, created_at from {evidence} where source = 'ocr') e) x where n = 1""")
def owners(fx):
    proof = fx.evidence.withColumn("page_number", F.lit(1))
    ids = F.when(F.col("source") == "ocr", F.array("evidence_id", F.col("evidence_id") + 5)).otherwise(F.array("evidence_id"))
    return A.first_owner(proof.withColumn("evidence_id", F.explode(ids)), "created_at", "evidence_id").select("evidence_id")


@query("G6_reset_verification", """
select risk_id, risk_type, 'needs_review' as status, false as has_external_reference, false as contradiction_flag
from (select *, case when value >= 50 and contradiction_flag then 'contractual' else risk_type end as new_type from {risks}) x
where not (contradiction_flag and new_type = 'contractual')""")
def reset(fx):
    made = F.when((F.col("value") >= 50) & F.col("contradiction_flag"), "contractual").otherwise(F.col("risk_type"))
    return A.reset_verification(fx.risks.withColumn("risk_type", made), kind="risk").select(
        "risk_id", "risk_type", "status", "has_external_reference", "contradiction_flag")


@query("G7_dedupe_candidates")
def dedupe(fx):
    return D.dedupe_candidates(
        fx.obligations, text="obligation_text", order="obligation_id", richness=D.obligation_richness()
    ).select("obligation_id", "document_id", "obligation_type", "due_date")


@query("G7_dedupe_lines")
def dedupe_lines(fx):
    lines = fx.truth.withColumn("risk_type", F.lit("quality"))
    return D.dedupe_candidates(
        lines, text="quote", order="item_no", richness=D.risk_richness(), due_date=None, party=None
    ).select("document_id", "item_no", "severity")


@query("G7_removed_counts")
def removed(fx):
    lines = fx.truth.withColumn("risk_type", F.lit("quality"))
    kept = D.dedupe_candidates(lines, text="quote", order="item_no", richness=D.risk_richness(), due_date=None, party=None)
    return D.removed_counts(lines, kept)


@query("G7_exact_copies", """
with q as (select document_id, item_no, lower(NORM(quote)) as q from {truth})
select document_id, min(item_no) as item_no from q where q <> '' group by document_id, q""".replace(
    "NORM(quote)", norm_sql("quote")))
def exact_copies(fx):
    body = fx.truth.select("document_id", "item_no", F.lower(normalize_text("quote")).alias("q"))
    return body.filter(F.col("q") != "").groupBy("document_id", "q").agg(F.min("item_no").alias("item_no")).drop("q")


@query("G9_critic_new_items")
def critic_new(fx):
    late = fx.quotes.select("document_id", "item_id", "quote", "created_at")
    stored = fx.truth.filter(F.col("severity").isin("low", "high")).select("document_id", "quote")
    new = D.novel_items(late, stored, text="quote", order="item_id")
    items = new.select("item_id", "document_id", F.lit("obligation").alias("kind"), "quote", "created_at",
                       F.lit("needs_review").alias("status"))
    _, evidence = A.verify_items(items, fx.pages_line)
    return items.join(evidence.select("document_id", "item_id"), ["document_id", "item_id"], "left_semi").select(
        "document_id", "item_id")


_FACTS = r"""
f as (select {key}, count(*) as n, bool_or(source = 'ocr') as ocr, bool_or(verification_method = 'fuzzy') as fuzzy,
        min(case when verification_method = 'fuzzy' then coalesce(nullif(fuzzy_similarity, 0), 1.0) end) as worst,
        bool_or(verification_method = 'sentence') as sentence from {{{table}}} group by {key})"""
_MATCH = """case when ocr then -15 else 0 end + case when fuzzy then cast(trunc(-10.0::double - 15.0::double * (1.0::double - least(greatest(worst, 0.85::double), 1.0::double)) / 0.15::double) as int)
  when sentence then -10 else 0 end + case when contradiction_flag then -30 else 0 end"""
OB_POINTS = rf"""55 + case when modality in ('must', 'shall', 'required') then 15 else 0 end
  + case when due_kind in ('absolute', 'resolved_relative') or coalesce(trim(due_rule), '') <> '' then 10 else 0 end
  + case when responsible_entity_id is not null then 10 else 0 end
  + case when case doc_type when 'invoice' then obligation_type = 'payment' when 'contract' then obligation_type in ('compliance', 'submission', 'payment', 'notification')
      when 'lease' then obligation_type in ('payment', 'compliance', 'notification') when 'loan_agreement' then obligation_type in ('payment', 'compliance', 'submission')
      else true end then 10 else 0 end
  + case when regexp_matches(obligation_text, '(?i)(§|C\.R\.S\.|U\.S\.C\.|statute|regulation)') then 5 else 0 end
  + case when regexp_matches(obligation_text, '(?i)(\$[\d,]+|dollar)') then 5 else 0 end
  + case when modality in ('should', 'may') then -25 else 0 end + {_MATCH}
  + case when regexp_matches(obligation_text, '(?i)\b(by|before|within|no later than|after|days?|weeks?|months?)\b') and due_date is null
      and coalesce(trim(due_rule), '') = '' then -10 else 0 end
  + case when obligation_type = 'payment' and not regexp_matches(obligation_text, '(?i)(\$[\d,]+|dollar)') then -10 else 0 end"""
_OB_SCORED = "with " + _FACTS.format(key="obligation_id", table="evidence") + rf""",
s as (select o.*, f.n, case when f.n is null then 0 else {OB_POINTS} end as points
      from {{obligations}} o left join {{docs}} d on d.document_id = o.document_id left join f on f.obligation_id = o.obligation_id)"""


@query("G10_score_obligations", _OB_SCORED + """
select obligation_id, cast(case when status = 'rejected' then system_confidence else least(greatest(points, 0), 100) end as int) as system_confidence,
  case when status = 'rejected' or n is null or points < 50 then 'rejected' else 'needs_review' end as status from s""")
def score_obligations(fx):
    return S.score_obligations(fx.obligations, fx.docs, fx.evidence).select("obligation_id", "system_confidence", "status")


RISK_POINTS = rf"""55 + case when regexp_matches(risk_text, '(?i)(§|C\.R\.S\.|U\.S\.C\.|statute|regulation)') then 10 else 0 end
  + case when regexp_matches(risk_text, '(?i)(\$[\d,]+|dollar)') then 5 else 0 end
  + case when regexp_matches(risk_text, '(?i)\b(by|before|within|no later than|after|days?|weeks?|months?)\b') then 5 else 0 end
  + case when contradiction_flag then 5 else 0 end + case when has_external_reference then 5 else 0 end + {_MATCH}"""


@query("G11_score_risks", "with " + _FACTS.format(key="risk_id", table="risk_evidence") + rf""",
s as (select r.*, f.n, case when f.n is null then 0 else {RISK_POINTS} end as points from {{risks}} r left join f on f.risk_id = r.risk_id)
select risk_id, cast(case when status = 'rejected' then system_confidence else least(greatest(points, 0), 100) end as int) as system_confidence,
  case when status = 'rejected' or n is null or points < 50 then 'rejected' else 'needs_review' end as status from s""")
def score_risks(fx):
    return S.score_risks(fx.risks, fx.risk_evidence).select("risk_id", "system_confidence", "status")


@query("K1_score_breakdown", _OB_SCORED + """
select obligation_id, cast(points as bigint) as points from s""")
def breakdown(fx):
    rows = S.obligation_breakdown(fx.obligations, fx.docs, fx.evidence)
    return rows.groupBy("obligation_id").agg(F.sum("delta").alias("points"))


_HITS = r"""[{'label': 'quote_verified', 'delta': 40}, {'label': 'verifier_pass', 'delta': 15},
  case when regexp_matches(risk_text, '(?i)(§|C\.R\.S\.|U\.S\.C\.|statute|regulation)') then {'label': 'statute_reference', 'delta': 10} end,
  case when regexp_matches(risk_text, '(?i)(\$[\d,]+|dollar)') then {'label': 'monetary_amount', 'delta': 5} end,
  case when regexp_matches(risk_text, '(?i)\b(by|before|within|no later than|after|days?|weeks?|months?)\b') then {'label': 'explicit_deadline', 'delta': 5} end,
  case when contradiction_flag then {'label': 'cross_obligation_linked', 'delta': 5} end,
  case when has_external_reference then {'label': 'external_reference', 'delta': 5} end,
  case when ocr then {'label': 'ocr_source', 'delta': -15} end,
  case when fuzzy then {'label': 'fuzzy_verified', 'delta': cast(trunc(-10.0::double - 15.0::double * (1.0::double - least(greatest(worst, 0.85::double), 1.0::double)) / 0.15::double) as int)}
    when sentence then {'label': 'sentence_verified', 'delta': -10} end,
  case when contradiction_flag then {'label': 'contradiction', 'delta': -30} end]"""


# The structs' braces are no table names.
@query("K1_risk_breakdown_labels", "with " + _FACTS.format(key="risk_id", table="risk_evidence") + f""",
h as (select risk_id, unnest({_HITS}) as hit from {{risks}} join f using (risk_id))
select risk_id, hit.label as label, hit.delta as delta from h where hit is not null
union all select risk_id, 'no_evidence', 0 from {{risks}} where risk_id not in (select risk_id from f)""")
def risk_labels(fx):
    return S.risk_breakdown(fx.risks, fx.risk_evidence)


_BLOCKS = r"""
with l as (select doc_id as document_id, unnest(string_split(replace(replace(MARKED, chr(13), ''), '•', chr(10) || '• '), chr(10))) as raw,
             unnest(range(1, 1 + len(string_split(replace(replace(MARKED, chr(13), ''), '•', chr(10) || '• '), chr(10))))) as i from {documents}),
t as (select document_id, i, regexp_matches(trim(raw, e' \t'), '^[•\-–]') as marked,
        trim(regexp_replace(regexp_replace(trim(raw, e' \t'), '^[•\-–]+\s*', ''), '\s+', ' ', 'g')) as body from l),
u as (select *, sum(case when marked then 1 else 0 end) over (partition by document_id order by i) as b from t where body <> ''),
bl as (select document_id, b, string_agg(body, ' ' order by i) as block from u group by document_id, b),
blocks as (select document_id, cast(row_number() over (partition by document_id order by b) - 1 as int) as block_no, block from bl where b > 0 and length(block) > 12)""".replace("MARKED", "replace(text, '. ', '.' || chr(10) || '- ')")


def _marked(fx):
    """Documents with every sentence but a line's first set as a list entry."""
    return fx.documents.select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"),
        F.replace("text", F.lit(". "), F.lit(".\n- ")).alias("raw_text"))


@query("G12_context_blocks", _BLOCKS + """
select document_id, block_no, block from blocks""")
def blocks(fx):
    return context_blocks(_marked(fx)).select("document_id", "block_no", "block")


@query("G12_context_digest", _BLOCKS + r"""
, q as (select document_id * 100000 + page_number as evidence_id, document_id, trim(regexp_replace(raw_text, '\s+', ' ', 'g')) as q
        from {pages_line} where raw_text <> ''),
e as (select evidence_id, document_id, q from q),
n as (select document_id, block_no, block, lag(block) over w as before, lead(block) over w as after from blocks
      window w as (partition by document_id order by block_no)),
h as (select e.evidence_id, e.q, n.before, n.after, row_number() over (partition by e.evidence_id order by n.block_no) as r
      from e join n on n.document_id = e.document_id where contains(n.block, e.q)),
s as (select evidence_id, q, side, t from (select evidence_id, q, 1 as side, before as t from h where r = 1 union all select evidence_id, q, 2, after from h where r = 1) x
      where t is not null),
c as (select *, trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as a,
        trim(regexp_replace(regexp_replace(lower(q), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as b from s),
k as (select * from c where not (a <> '' and b <> '' and (contains(a, b) or contains(b, a) or
        len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::double / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) >= 0.8))
      and len(string_split(t, ' ')) >= 5 and not regexp_matches(t, '[(-]$') and not (regexp_matches(t, '(?i)^\(?eff\.\s*[0-9]') and len(string_split(t, ' ')) < 7))
select e.evidence_id, cast(count(distinct k.t) as int) as bullets from e left join k on k.evidence_id = e.evidence_id group by e.evidence_id""")
def digest(fx):
    q = collapse_js("quote")
    proof = fx.truth.select(
        (F.col("document_id") * 100000 + F.col("item_no")).alias("evidence_id"), "document_id",
        F.lit(1).alias("page_number"), q.alias("quote"))
    return context_digest(proof, _marked(fx)).select("evidence_id", F.size("bullets").alias("bullets"))


@query("G12_context_references")
def references(fx):
    proof = fx.obligations.select(
        F.col("obligation_id").alias("evidence_id"), F.col("document_id"), F.lit(1).alias("page_number"),
        F.col("obligation_text").alias("quote"))
    d = context_digest(proof, _marked(fx))
    return d.select("evidence_id", F.size("bullets").alias("bullets"), F.array_join("references", "|").alias("refs"))


def _scored_lines(fx):
    lines = fx.pages_line.filter(F.col("normalized_text") != "").select(
        "document_id", "page_number", F.lit(0).alias("char_start"), F.col("normalized_text").alias("text"))
    docs = fx.documents.select(F.col("doc_id").alias("document_id"), F.lit("unknown").alias("doc_type"))
    return P.score_chunks(lines, docs, "obligation_extraction")


@query("G14_select_top_chunks", """
with t as (select document_id, page_number, 0.25::double * least(1.0, len(list_distinct(regexp_extract_all(lower(normalized_text), '[a-z0-9]+'))) / 200.0::double)
             + 0.75::double * (len(list_filter(['shall', 'must', 'required', 'within', 'deadline'], lambda k: contains(lower(normalized_text), k))) / 5.0::double) as rel
           from {pages_line} where normalized_text <> '')
select document_id, page_number, cast(n as int) as rank from (select *, row_number() over (partition by document_id order by round(rel, 9) desc, page_number) as n from t) x
where n <= 5""")
def top_chunks(fx):
    scored = _scored_lines(fx).withColumn("relevance", F.round("relevance", 9))
    return P.select_top_chunks(scored, 5).select("document_id", "page_number", "rank")


@query("G14_select_chunks_mmr")
def mmr_chunks(fx):
    return P.select_mmr_chunks(_scored_lines(fx), 5).select("document_id", "page_number")


@query("G15_locate_spans")
def spans(fx):
    listed = fx.pages_line.select(
        "document_id", F.lit(1).alias("page_number"), F.col("page_number").alias("span_no"), F.col("raw_text").alias("span_text"))
    pages = fx.documents.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").alias("raw_text"))
    return P.locate_spans(listed, pages)
