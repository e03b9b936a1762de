"""Text functions as Column builders: everything stays in the JVM except NFC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from covenantry.rules import EXTERNAL_REFERENCE_PHRASES, STATUTORY_PATTERNS

# What Python's str.strip() / str.isspace() regard as white space.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a Java character class.
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# ECMAScript white space: no control separators, but the byte order mark.
JS_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
JS_WS = r"\s\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Ligatures and typographic characters with their plain forms.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
PLAIN_FORMS = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2013": "-", "\u2014": "-", "\u2015": "-",
    "\u00a0": " ", "\u2009": " ", "\u200a": " ", "\u202f": " ",
}
ELLIPSIS = "\u2026"

# Characters in these ranges may change under NFC; all outside are stable
# and do not combine, so texts made of them alone never leave the JVM.
# The same set as a negated class of the stable ranges takes Java several times as long.
NFC_UNSTABLE = "[\u0300-\u2001\u2070-\u209f\u20c0-\U0010ffff]"

# What plain forms and single spaces may replace (by ranges, so a few stable characters too).
NOT_PLAIN = r"[\t\r\n\u00a0\u2009-\u202f\ufb00-\ufb04]| {2}"

# What single spaces may replace in ECMAScript's sense (by ranges, so a few other characters too).
NOT_SINGLE = r"[\t-\r\u00a0\u1680\u2000-\u3000\ufeff]"

# Patterns of deadlines, statutes, amounts and line breaks.
DEADLINE_RE = r"(?iU)\b(by|before|within|no later than|after|days?|weeks?|months?)\b"
STATUTE_RE = r"(?iU)(§|C\.R\.S\.|U\.S\.C\.|statute|regulation)"
MONETARY_RE = r"(?iU)(\$[\d,]+|dollar)"
AMOUNT_RE = r"(?U)\$\s*([\d,]+(?:\.\d+)?)"
CURRENCY_RE = r"(?U)\$\s?\d"
LINE_BREAK_RE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip(c: Column | str) -> Column:
    """Strip white space as Python does; SQL trim would only drop U+0020."""
    return F.btrim(_col(c), F.lit(PY_SPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def normalize_text(c: Column | str) -> Column:
    """NFC, plain forms of typographic characters, single spaces, stripped; NULL -> ''.

    The Arrow UDF receives NULL for every row that NFC cannot change.
    """
    text = F.coalesce(_col(c), F.lit(""))
    text = F.coalesce(nfc(F.when(text.rlike(NFC_UNSTABLE), text)), text)
    # most texts are plain already: one look instead of a dozen passes that copy them
    return F.when(text.rlike(NOT_PLAIN), _plain_forms(text)).otherwise(strip(text))


def _plain_forms(text: Column) -> Column:
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    text = F.translate(text, "".join(PLAIN_FORMS), "".join(PLAIN_FORMS.values()))
    text = F.replace(text, F.lit(ELLIPSIS), F.lit("..."))
    return strip(F.regexp_replace(text, r"[ \t\r\n]{2,}|[\t\r\n]", " "))


def sha256_text(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def word_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(word_tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token sets, 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union
    ).otherwise(F.lit(0.0))


def contains_any(lowered: Column, phrases) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | lowered.contains(phrase)
    return hit


def has_external_reference(c: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(_col(c), F.lit(""))), EXTERNAL_REFERENCE_PHRASES)


def implies_deadline(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(DEADLINE_RE)


def cites_statute(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(STATUTE_RE)


def names_amount(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(MONETARY_RE)


def payment_amounts(c: Column | str) -> Column:
    """Sorted distinct amounts, compared as strings ('1,000' differs from '1000')."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(AMOUNT_RE), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def lines_of(c: Column | str) -> Column:
    return F.split(_col(c), LINE_BREAK_RE)


def looks_like_table(c: Column | str) -> Column:
    lines = F.filter(lines_of(F.coalesce(_col(c), F.lit(""))), lambda x: ~is_blank(x))
    delimited = F.filter(lines, lambda x: x.contains("|") | x.contains("\t"))
    columns = F.filter(
        lines,
        lambda x: x.contains("  ")
        & (F.size(F.regexp_extract_all(x, F.lit(f"[^{WS}]+"), F.lit(0))) >= 3),
    )
    return (F.size(delimited) >= 2) | (F.size(columns) >= 3)


def page_ranges(c: Column | str) -> Column:
    """'5-13,43' -> sorted distinct page numbers; an empty or reversed spec is an error."""
    spec = _col(c)
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda t: t != "")

    def expand(token: Column) -> Column:
        first = strip(F.substring_index(token, "-", 1)).cast("int")
        last = strip(F.regexp_replace(token, r"^[^-]*-", "")).cast("int")
        return F.when(
            token.contains("-"),
            F.when(
                first > last,
                F.raise_error(F.concat(F.lit("reversed page range: "), token)).cast("array<int>"),
            ).otherwise(F.sequence(first, last)),
        ).otherwise(F.array(token.cast("int")))

    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))
    return F.when(
        is_blank(spec), F.raise_error(F.lit("empty page spec")).cast("array<int>")
    ).otherwise(pages)


def statutory_pattern(c: Column | str) -> Column:
    """Name of the first statutory phrase found, NULL where none is."""
    quote = _col(c)
    expr = None
    for name, pattern in STATUTORY_PATTERNS:
        hit = quote.rlike("(?iU)" + pattern)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(F.lit(None).cast("string"))


def last_space(c: Column) -> Column:
    """0-based position of the last space, -1 where there is none."""
    back = F.instr(F.reverse(c), " ")
    return F.when(back > 0, F.length(c) - back).otherwise(F.lit(-1))


def truncate_text(c: Column | str, limit: int = 120, floor: int = 40) -> Column:
    text = strip(c)
    pivot = last_space(F.substring(text, 1, limit + 1))
    pivot = F.when(pivot <= floor, limit).otherwise(pivot)
    cut = F.rtrim(text.substr(F.lit(1), pivot), F.lit(PY_SPACE))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(ELLIPSIS)))


def collapse_js(c: Column | str) -> Column:
    text = _col(c)
    single = F.when(text.contains("  ") | text.rlike(NOT_SINGLE), F.regexp_replace(text, f"[{JS_WS}]+", " ")).otherwise(text)
    return F.btrim(single, F.lit(JS_SPACE))


def summarize_text(c: Column | str, limit: int = 120) -> Column:
    """First sentence where it ends before the limit, else a cut at a word."""
    text = collapse_js(c)
    stop = F.instr(text, ". ") - 1
    head = F.substring(text, 1, limit)
    space = last_space(head)
    cut = F.when(space > 0, head.substr(F.lit(1), space)).otherwise(head)
    return (
        F.when(F.length(text) <= limit, text)
        .when((stop > 0) & (stop < limit), text.substr(F.lit(1), stop + 1))
        .otherwise(F.concat(cut, F.lit(ELLIPSIS)))
    )


BULLET = rf"^[\u2022\-\u2013*][{JS_WS}]*"
NUMBERED = rf"^[0-9]+[.)][{JS_WS}]+"


def format_quote(c: Column | str) -> Column:
    """struct(type, text, items): a bullet list from two marked lines on, else one paragraph."""
    quote = _col(c)
    lines = F.filter(
        F.transform(
            F.split(F.replace(quote, F.lit("\r"), F.lit("")), "\n"),
            lambda x: F.btrim(x, F.lit(JS_SPACE)),
        ),
        lambda x: x != "",
    )
    marked = F.filter(lines, lambda x: x.rlike(BULLET) | x.rlike(NUMBERED))
    items = F.filter(
        F.transform(
            marked,
            lambda x: F.btrim(
                F.regexp_replace(F.regexp_replace(x, BULLET, ""), NUMBERED, ""), F.lit(JS_SPACE)
            ),
        ),
        lambda x: x != "",
    )
    bullets = F.size(marked) >= 2
    return F.struct(
        F.when(bullets, "bullets").otherwise("paragraph").alias("type"),
        F.when(~bullets, collapse_js(quote)).alias("text"),
        F.when(bullets, items).alias("items"),
    )


def slug(c: Column | str) -> Column:
    name = F.lower(F.coalesce(_col(c), F.lit("")))
    name = F.regexp_replace(name, f"[{WS}]+", "_")
    name = F.regexp_replace(name, "[^a-z0-9_-]", "")
    name = F.btrim(F.regexp_replace(name, "_+", "_"), F.lit("_-"))
    return F.when(name == "", "all").otherwise(name)


def export_filename(entity: str, asset_name: Column | str, day: Column, ext: str) -> Column:
    return F.concat(
        F.lit(entity + "_"), slug(asset_name), F.lit("_"), F.date_format(day, "yyyy-MM-dd"),
        F.lit("." + ext),
    )


def preview(c: Column | str, size: int = 120) -> Column:
    return F.substring(F.coalesce(_col(c), F.lit("")), 1, size)
