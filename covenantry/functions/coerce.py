"""Turning loose answer fields into typed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from covenantry import schema as S
from covenantry.functions.text import CURRENCY_RE, contains_any, strip, token_set
from covenantry.rules import (
    EARLY_TYPE_RULES, OBLIGATION_ALIASES, RISK_TYPE_REMAP, RULES, RuleBase,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_enum(c: Column | str, allowed: tuple[str, ...], default: str | None) -> Column:
    """Trimmed lower-case value of a closed domain, the default for anything else."""
    value = F.lower(strip(c))
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default).cast("string"))


def _case(value: Column, mapping: dict[str, str], default: Column) -> Column:
    expr = None
    for key, out in mapping.items():
        expr = F.when(value == key, out) if expr is None else expr.when(value == key, out)
    return default if expr is None else expr.otherwise(default)


def alias_obligation_type(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    value = F.lower(strip(c))
    return _case(value, OBLIGATION_ALIASES if aliases is None else aliases, value)


def obligation_type(c: Column | str) -> Column:
    return coerce_enum(alias_obligation_type(c), S.OBLIGATION_TYPES, "other")


def remap_risk_type(c: Column | str) -> Column:
    return _case(_col(c), RISK_TYPE_REMAP, F.lit("unknown_risk"))


def iso_date(c: Column | str) -> Column:
    """ISO calendar and week dates; anything else is NULL, never an error."""
    text = strip(c)
    calendar = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")
    ).when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    week_form = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?$"
    year = F.regexp_extract(text, week_form, 1)
    week = F.regexp_extract(text, week_form, 3)
    day = F.regexp_extract(text, week_form, 4)
    fourth = F.try_to_date(F.concat(year, F.lit("-01-04")), "yyyy-MM-dd")
    monday = F.date_sub(fourth, F.weekday(fourth))
    offset = (week.try_cast("int") - 1) * 7 + F.coalesce(day.try_cast("int"), F.lit(1)) - 1
    from_week = F.when(text.rlike(week_form), F.date_add(monday, offset))
    in_year = (F.weekofyear(from_week) == week.try_cast("int")) & (
        F.extract(F.lit("YEAROFWEEK"), from_week) == year.try_cast("int")
    )
    found = F.coalesce(calendar, F.when(in_year, from_week))
    return F.when(F.year(found) >= 1, found)


def due_fields(date_col: Column | str, rule_col: Column | str) -> Column:
    """struct(due_kind, due_date, due_rule)."""
    due_date = iso_date(date_col)
    rule = F.nullif(strip(rule_col), F.lit(""))
    kind = (
        F.when(due_date.isNotNull(), "absolute")
        .when(rule.isNotNull(), "relative")
        .otherwise("none")
    )
    return F.struct(kind.alias("due_kind"), due_date.alias("due_date"), rule.alias("due_rule"))


def clamp_percent(c: Column | str) -> Column:
    """Whole number in 0..100, truncating towards zero first; NULL stays NULL."""
    value = _col(c).cast("double")
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), whole))).cast("int")


def early_type_guess(blob: Column | str, rules=None) -> Column:
    """First document type whose phrases occur; NULL where none does."""
    text = F.lower(_col(blob))
    expr = None
    for doc_type, phrases in rules or EARLY_TYPE_RULES:
        hit = contains_any(text, phrases)
        expr = F.when(hit, doc_type) if expr is None else expr.when(hit, doc_type)
    return expr.otherwise(F.lit(None).cast("string"))


def heuristics_agree(doc_type: Column | str, blob: Column | str, rules: RuleBase = RULES) -> Column:
    """Does the text carry a keyword of the proposed type?  'unknown' always agrees."""
    kind, text = _col(doc_type), F.lower(_col(blob))
    expr = F.when(kind == "unknown", True)
    for name, words in rules.type_keywords().items():
        if name == "unknown":
            continue
        hit = contains_any(text, words)
        if name == "invoice":
            hit = hit | text.rlike(CURRENCY_RE)
        expr = expr.when(kind == name, hit)
    return expr.otherwise(F.lit(False))


def domain_of(doc_type: Column | str, rules: RuleBase = RULES) -> Column:
    return _case(_col(doc_type), rules.domain_of(), F.lit("general"))


def type_aligned(doc_type: Column | str, item_type: Column | str, rules: RuleBase = RULES) -> Column:
    """Is the obligation type expected in this document type?  Unlisted types expect all."""
    kind, item = _col(doc_type), _col(item_type)
    expr = None
    for name, expected in rules.aligned_types().items():
        if not expected:
            continue
        hit = item.isin(*expected)
        expr = F.when(kind == name, hit) if expr is None else expr.when(kind == name, hit)
    return F.lit(True) if expr is None else expr.otherwise(F.lit(True))


def relevance(
    text: Column | str, doc_type: Column | str, stage: str, rules: RuleBase = RULES
) -> Column:
    """0.75 x share of stage keywords present + 0.25 x token richness."""
    body = F.coalesce(_col(text), F.lit(""))
    lowered, tokens = F.lower(body), F.size(token_set(body))
    domain = domain_of(doc_type, rules)
    share = None
    for name, words in rules.stage_keywords(stage).items():
        if words:
            hits = sum((lowered.contains(w.lower()).cast("int") for w in words), F.lit(0))
            value = hits / F.lit(float(len(words)))
        else:
            value = F.lit(None).cast("double")
        share = F.when(domain == name, value) if share is None else share.when(domain == name, value)
    share = share.otherwise(F.lit(None).cast("double"))
    richness = F.least(F.lit(1.0), tokens / F.lit(200.0))
    return (
        F.when(tokens == 0, F.lit(0.0))
        .when(share.isNull(), richness)
        .otherwise(F.lit(0.75) * share + F.lit(0.25) * richness)
    )


def progress_percent(
    status: Column | str, done: Column | str, failed: Column | str, total: Column | str
) -> Column:
    """Stage or page progress, whichever is further; below 100 until a final status."""
    state, pages = _col(status), _col(total)
    stage = S.rank_of(state, S.STAGE_PROGRESS)
    share = (_col(done) + _col(failed)) / F.nullif(pages, F.lit(0)) * 100
    by_page = F.coalesce(F.when(pages > 0, F.floor(share + 0.5)), F.lit(0))
    return F.when(F.coalesce(state.isin(*S.TERMINAL_STATUSES), F.lit(False)), 100).otherwise(
        F.least(F.greatest(stage, by_page), F.lit(99))
    ).cast("int")
