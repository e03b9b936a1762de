"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are matches of base patterns and of looser ones.  Four labelers vote on each: the
format (Luhn, ranges, numbers of digits), gazetteers (top-level domains, card issuers, calling
codes), cue words in the context, and the neighbouring characters.  Expectation-maximisation over
the counts of vote patterns, taken over all documents, estimates how reliable each labeler is for
each kind; its posteriors are soft labels for a final naive Bayes classifier over span features.
Base spans always stay; a loose candidate is added where the classifier is sure and no base span overlaps it.

What reaches the driver is bounded: 3**4 vote patterns a kind, and the features' closed domains.
Offsets are running sums of the lengths of matches and of the text between them.  All grouping
is per document and kind, so no key is hotter than a text is long.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOOSE = ("loose_email", "loose_phone")
ADDED_AT = 0.9
CONTEXT = 40
EM_ROUNDS = 30
LOCAL = "[A-Za-z0-9._%+-]"
# The contracts' patterns; runs are taken whole (possessive) and begun once, so long runs stay linear.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "loose_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,64}+"
                   r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,12}+",
    "loose_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|0[0-9]{1,4}|00[0-9]{1,3})(?:[\x20./-]?[0-9]{2,8}+){2,6}+(?![0-9A-Za-z])",
}
IP_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
# Gazetteers and cue words.
DOMAINS = "com|org|net|edu|gov|int|io|info|biz|de|fr|es|it|uk|eu|us|ca|ch|at|nl|be|pt|pl|se|jp|cn|in|br|au"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
CALLING = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": "mail|e-mail|email|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|addr|login|client|adresse",
    "card": "card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|contact|anruf|appel",
}
AGAINST = "version|isbn|issn|order|invoice|ref|id|no|serial|build|page|article|section|price|total"


def matches(text: Column, kind: str) -> Column:
    """Array of matches of a kind with the length of the text before each, and both contexts."""
    pattern = F.lit(PATTERNS[kind])
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    return F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("no"), F.length(F.get(gaps, i)).alias("gap"), m.alias("match"),
        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("next")))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, kind, match, left, next, start, end`` of every match of every pattern."""
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.filter(matches(F.lit(""), "ip"), lambda _: F.lit(False))
    digits = F.col("text").rlike("[0-9]")
    needs = {"email": F.contains("text", F.lit("@")), "ip": digits, "card": digits,
             "phone": F.contains("text", F.lit("+")), "loose_email": F.col("text").rlike(r"(?:\(at\)|\[at\]|\x20at\x20).{0,70}dot"),
             "loose_phone": digits}
    parts = [F.when(needs[k], matches(F.col("text"), k)).otherwise(empty) for k in PATTERNS]
    rows = docs.select("doc_id", F.xxhash64(text).alias("copy"), text.alias("text"))
    flat = rows.select("doc_id", "copy", F.explode(F.concat(*parts)).alias("m")).select("doc_id", "copy", "m.*")
    flat = flat.dropDuplicates(["doc_id", "copy", "kind", "no"])  # rows that repeat a whole document
    before = Window.partitionBy("doc_id", "copy", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(before)
    return flat.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).drop("gap", "no")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + _luhn_part(
        F.ascii(F.substr(back, i, F.lit(1))) - 48, i % 2 == 0))
    return total % 10 == 0


def _luhn_part(digit: Column, doubled: Column) -> Column:
    return F.when(~doubled, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)


def judged(found: DataFrame) -> DataFrame:
    """Candidates with ``base`` (a base span that passes), its final kind and the four votes -1, 0, 1."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    kind = F.when(F.col("kind") == "loose_email", "email").when(F.col("kind") == "loose_phone", "phone").otherwise(F.col("kind"))
    passes = (F.when(F.col("kind") == "email", True)
              .when(F.col("kind") == "ip", F.col("match").rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
              .when(F.col("kind") == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
              .when(F.col("kind") == "phone", n.between(9, 15)).otherwise(False))
    found = found.withColumn("n_digits", n).withColumn("base", passes).withColumn("loose", F.col("kind").isin(*LOOSE))
    found = found.withColumn("kind", kind)
    left = F.lower("left")

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    of = F.col("kind")
    form = (F.when(F.col("loose"), vote((of == "email") | n.between(9, 13), n < 7)).when(F.col("base"), 1).otherwise(-1))
    domain = F.col("match").rlike(rf"(?i)[.\x20\])](?:{DOMAINS})$")
    issuer, calling = digits.rlike(ISSUERS), F.col("match").rlike(CALLING)
    gazetteer = (F.when(of == "email", vote(domain, F.lit(False)))
                 .when(of == "card", vote(issuer, ~issuer)).when(of == "phone", vote(calling, ~calling & ~F.col("loose")))
                 .otherwise(vote(~digits.startswith("0"), F.col("match").rlike(r"^0|\.0[0-9]"))))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((of == k) & left.rlike(rf"(?:^|[^a-z])(?:{words})[^a-z]{{0,3}}(?:[a-z]{{1,4}}[^a-z]{{1,3}})?$"))
    context = vote(cue, left.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]{{0,4}}$"))
    glued = F.col("left").rlike(r"[\p{L}\p{N}_]$") | F.col("next").rlike(r"^[\p{L}\p{N}_@]")
    edge = vote(~glued, glued)
    return found.select("doc_id", "copy", "kind", "start", "end", "base", "loose", "n_digits", "match", "left", "next",
                        form.alias("v1"), gazetteer.alias("v2"), context.alias("v3"), edge.alias("v4"))


VOTES = ("v1", "v2", "v3", "v4")


def reliabilities(patterns: list[dict]) -> dict[tuple, float]:
    """Posterior of each (kind, votes) by expectation-maximisation; ``patterns`` has their counts.

    A labeler is a distribution of its three votes for either truth; the start trusts votes by
    their sign.  Counts are smoothed by one.
    """
    out: dict[tuple, float] = {}
    for kind in sorted({p["kind"] for p in patterns}):
        rows = [(tuple(p[v] for v in VOTES), p["n"]) for p in patterns if p["kind"] == kind]
        post = {votes: 1 / (1 + math.exp(-1.5 * sum(votes))) for votes, _ in rows}
        for _ in range(EM_ROUNDS):
            prior, total = [1.0, 1.0], [[[1.0] * 3 for _ in VOTES] for _ in range(2)]
            for votes, n in rows:
                for truth, share in ((1, post[votes]), (0, 1 - post[votes])):
                    prior[truth] += n * share
                    for k, v in enumerate(votes):
                        total[truth][k][v + 1] += n * share
            for votes, _ in rows:
                odds = math.log(prior[1] / prior[0])
                for k, v in enumerate(votes):
                    odds += math.log(total[1][k][v + 1] / sum(total[1][k])) - math.log(total[0][k][v + 1] / sum(total[0][k]))
                post[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= {(kind, *votes): p for votes, p in post.items()}
    return out


def features() -> list[Column]:
    """Features of a span, each with a closed domain of values."""
    def char(c: Column) -> Column:
        return (F.when(F.coalesce(c, F.lit("")) == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter")
                .when(c.rlike(r"\p{N}"), "number").when(c.rlike(r"[.,;:!?]"), "stop").otherwise("sign"))

    return [
        F.concat(F.lit("digits="), F.least(F.col("n_digits"), F.lit(20)).cast("string")),
        F.concat(F.lit("length="), F.least(F.length("match") / 4, F.lit(16)).cast("int").cast("string")),
        F.concat(F.lit("before="), char(F.right("left", F.lit(1)))), F.concat(F.lit("after="), char(F.col("next"))),
        F.concat(F.lit("signs="), F.col("match").rlike(r"[()]").cast("string"), F.col("match").rlike(r"\x20").cast("string"),
                 F.col("match").rlike("-").cast("string")),
        *[F.concat(F.lit(f"{v}="), F.col(v).cast("string")) for v in VOTES],
    ]


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    pairs = chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in sorted(table.items()))
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def classified(votes: DataFrame) -> DataFrame:
    """Candidates with ``score``, the final classifier's probability; fitted on all of them."""
    pattern = F.concat_ws("|", "kind", *VOTES)
    counts = [r.asDict() for r in votes.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).collect()]
    post = {"|".join(map(str, k)): p for k, p in reliabilities(counts).items()}
    soft = votes.withColumn("soft", lookup(post, pattern, 0.5)).withColumn("features", F.array(*features()))
    sums = (soft.select("kind", "soft", F.explode("features").alias("feature")).groupBy("kind", "feature")
            .agg(F.sum("soft").alias("yes"), F.sum(1 - F.col("soft")).alias("no")).collect())
    yes: dict[str, float] = {}
    no: dict[str, float] = {}
    for p in counts:
        share = post["|".join(str(p[c]) for c in ("kind", *VOTES))]
        yes[p["kind"]] = yes.get(p["kind"], 1.0) + share * p["n"]
        no[p["kind"]] = no.get(p["kind"], 1.0) + (1 - share) * p["n"]
    weight = {f"{r.kind}|{r.feature}": math.log((r.yes + 1) / (yes[r.kind] + 1)) - math.log((r.no + 1) / (no[r.kind] + 1))
              for r in sums}
    bias = {k: math.log(yes[k] / no[k]) for k in yes}
    odds = lookup(bias, F.col("kind"), 0.0)
    for i in range(len(features())):
        odds = odds + lookup(weight, F.concat_ws("|", F.col("kind"), F.col("features")[i]), 0.0)
    return soft.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds)))))


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of base spans, their digest, and all spans as text.

    Null and empty texts have none.  Rows that repeat an id are judged by their own text; equal
    rows give equal results.  Other columns are not read.
    """
    from covenantry.llm.shared import written

    votes = written(judged(candidates(docs)), "pii-votes")
    spans = classified(votes).filter("base or loose")
    order = Window.partitionBy("doc_id", "copy").orderBy("start", "end")
    held = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(held, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("clear", clear).filter(F.col("base") | (F.col("clear") & (F.col("score") >= ADDED_AT)))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.struct("start", number.alias("number"), "end", "kind")
    base = F.when(F.col("base"), entry)
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    of_doc = spans.groupBy(F.col("doc_id").alias("id"), F.col("copy").alias("id_copy")).agg(
        *counts, F.sort_array(F.collect_list(base)).alias("base"), F.sort_array(F.collect_list(entry)).alias("all"))

    def listed(spans_: str) -> Column:
        text = F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.coalesce(F.array_join(text, ","), F.lit(""))

    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("copy"))
    joined = rows.join(of_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("id_copy")), "left")
    return joined.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
                         F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))
