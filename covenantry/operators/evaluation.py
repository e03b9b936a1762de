"""Quality against ground truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from covenantry.functions.similarity import rouge_l
from covenantry.functions.text import page_ranges, statutory_pattern, word_tokens
from covenantry.operators.graph import components
from covenantry.schema import SEVERITY_RANK, rank_of
from covenantry.session import cut_lineage, spread

SMALL = 256


def reported_risks(risks: DataFrame) -> DataFrame:
    """Risks that count in an evaluation: those generated from contradictions are left out."""
    return risks.filter(~F.coalesce("contradiction_flag", F.lit(False)))


def quote_pairs(truth: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(document_id, gt_key, pl_key, score) of distinct quotes at or above the threshold.

    Copies are folded before anything is paired.  Two exact bounds are part of the join
    condition and keep the rest from the UDF: the LCS is at most the shorter token list, and
    at most a list less its distinct tokens that do not occur on the other side.  Tokens are told apart
    by their hashes, which can only raise the bound, and what both hold is counted once a pair.
    """
    def quotes(df: DataFrame, side: str) -> DataFrame:
        body = df.select("document_id", F.coalesce("quote", F.lit("")).alias("q")).distinct()
        words = body.select("*", word_tokens("q").alias("t"))
        return words.select(
            "document_id", F.xxhash64("q").alias(f"{side}_key"), F.col("q").alias(f"{side}_q"),
            F.size("t").alias(f"{side}_n"), F.array_distinct(F.transform("t", lambda w: F.hash(w))).alias(f"{side}_set"))

    m, n = F.col("gt_n"), F.col("pl_n")
    low = threshold - 1e-9
    # of both sides at once: a filter on one of them would be pushed down and take every quote's tokens again
    by_length = (F.least(m, n) > 0) & ((2.0 * F.least(m, n)) / (m + n) >= low)
    common = F.size(F.array_intersect("gt_set", "pl_set"))
    reach = common + F.least(m - F.size("gt_set"), n - F.size("pl_set"))
    pairs = quotes(truth, "gt").join(quotes(found, "pl"), "document_id").filter(
        by_length & ((2.0 * reach) / (m + n) >= low))
    return spread(pairs, "gt_key", "pl_key").select(
        "document_id", "gt_key", "pl_key", rouge_l("gt_q", "pl_q").alias("score")
    ).filter(F.col("score") > low)


def match_items(truth: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy one-to-one matching per document: (document_id, gt_no, pl_no, score).

    ``truth``: document_id, item_no, quote.  ``found``: document_id, item_no, quote.  Each
    truth item in order takes the best free found item, the earlier one on a tie.

    Pairs of distinct quotes are scored and written once.  A document of at most ``SMALL`` items with
    a partner is one bounded row.  In a larger one, a pair of quotes that both match nothing else
    settles in a join, where the copies of one side take those of the other in order; what competes is split in
    components, which cannot take items from each other, and only keys and scores of one
    component meet in the sequential step.
    """
    edges = cut_lineage(quote_pairs(truth, found, threshold))

    def live(items: DataFrame, side: str) -> DataFrame:
        rows = items.select("document_id", F.col("item_no").cast("long").alias(f"{side}_no"),
                            F.xxhash64(F.coalesce("quote", F.lit(""))).alias(f"{side}_key"))
        return cut_lineage(rows.join(edges.select("document_id", f"{side}_key").distinct(), ["document_id", f"{side}_key"], "left_semi"))

    sides = gt, pl = live(truth, "gt"), live(found, "pl")
    sizes = gt.select("document_id").unionByName(pl.select("document_id")).groupBy("document_id").agg(F.count("*").alias("n"))
    large = cut_lineage(sizes.filter(F.col("n") > SMALL).select("document_id"))
    if large.isEmpty():
        return _assign(*sides, edges, ["document_id"])
    little, much = (tuple(df.join(large, "document_id", how) for df in (*sides, edges)) for how in ("left_anti", "left_semi"))
    return _assign(*little, ["document_id"]).unionByName(_match_large(*much))


def _match_large(gt: DataFrame, pl: DataFrame, edges: DataFrame) -> DataFrame:
    alone = [F.count("*").over(W.partitionBy("document_id", key)) == 1 for key in ("gt_key", "pl_key")]
    edges = cut_lineage(edges.withColumns({"a": alone[0], "b": alone[1]}).withColumn("alone", F.col("a") & F.col("b")).drop("a", "b"))

    def marked(rows: DataFrame, side: str) -> DataFrame:
        return rows.join(edges.select("document_id", f"{side}_key", "alone").distinct(), ["document_id", f"{side}_key"])

    gt, pl = marked(gt, "gt"), marked(pl, "pl")

    def in_turn(rows: DataFrame, side: str) -> DataFrame:
        order = W.partitionBy("document_id", f"{side}_key").orderBy(f"{side}_no")
        return rows.filter("alone").drop("alone").withColumn("turn", F.row_number().over(order))

    settled = (
        in_turn(gt, "gt").join(edges.filter("alone").drop("alone"), ["document_id", "gt_key"])
        .join(in_turn(pl, "pl"), ["document_id", "pl_key", "turn"]).select("document_id", "gt_no", "pl_no", "score"))

    def node(side: str) -> Column:
        return F.xxhash64("document_id", F.lit(side), f"{side}_key")

    rivals = edges.filter("not alone").withColumns({"a": node("gt"), "b": node("pl")})
    roots = components(rivals)

    def placed(df: DataFrame, at: Column) -> DataFrame:
        return df.join(roots, at == roots["node"]).drop("node")

    return settled.unionByName(_assign(
        placed(gt.filter("not alone"), node("gt")), placed(pl.filter("not alone"), node("pl")), placed(rivals, F.col("a")),
        ["document_id", "root"]))


def _assign(gt: DataFrame, pl: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """The sequential rule within each group of items that may compete."""
    def gathered(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    groups = (
        gathered(gt, "g", "gt_no", "gt_key").join(gathered(pl, "p", "pl_no", "pl_key"), key)
        .join(gathered(edges, "e", "gt_key", "pl_key", "score"), key))
    result = T.ArrayType(T.StructType().add("gt_no", "long").add("pl_no", "long").add("score", "double"))

    @F.pandas_udf(result)
    def assign(gt_no, gt_key, pl_no, pl_key, from_key, to_key, score):
        return pd.Series([
            greedy_match(*columns) for columns in zip(gt_no, gt_key, pl_no, pl_key, from_key, to_key, score)])

    fields = ("g.gt_no", "g.gt_key", "p.pl_no", "p.pl_key", "e.gt_key", "e.pl_key", "e.score")
    return spread(groups, *key).select("document_id", F.inline(assign(*map(F.col, fields))))


def unmatched_items(truth: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """(document_id, item_no, quote, outcome): truth items without a partner are missed, found items spurious."""
    def rest(items: DataFrame, number: str, outcome: str) -> DataFrame:
        taken = matched.select("document_id", F.col(number).alias("item_no"))
        return items.join(taken, ["document_id", "item_no"], "left_anti").select(
            "document_id", F.col("item_no").cast("long").alias("item_no"), "quote", F.lit(outcome).alias("outcome"))

    return rest(truth, "gt_no", "missed").unionByName(rest(found, "pl_no", "spurious"))


def greedy_match(gt_no, gt_key, pl_no, pl_key, from_key, to_key, score) -> list[dict]:
    """Truth items in order, each to its best free partner, the earlier one on a tie."""
    free: dict[int, list[int]] = {}
    for no, key in zip(reversed(pl_no), reversed(pl_key)):
        free.setdefault(key, []).append(no)
    partners: dict[int, list[tuple[int, float]]] = {}
    for a, b, s in zip(from_key, to_key, score):
        partners.setdefault(a, []).append((b, s))
    out = []
    for no, key in zip(gt_no, gt_key):
        options = [(-s, free[b][-1], b) for b, s in partners.get(key, ()) if free.get(b)]
        if options:
            best, chosen, b = min(options)
            free[b].pop()
            out.append({"gt_no": int(no), "pl_no": int(chosen), "score": -best})
    return out


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r))


def prf(counts: DataFrame) -> DataFrame:
    """precision, recall and F1 to three digits from tp, fp, fn; NULL where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumns({
        "precision": F.round(p, 3), "recall": F.round(r, 3), "f1": F.round(_f1(p, r), 3)})


def match_counts(truth: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    def per_document(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))

    df = per_document(truth, "gt_count").join(per_document(found, "pl_count"), "document_id", "full")
    df = df.join(per_document(pairs, "tp"), "document_id", "left").fillna(0, ["gt_count", "pl_count", "tp"])
    return df.select(
        "document_id", "tp", (F.col("pl_count") - F.col("tp")).alias("fp"),
        (F.col("gt_count") - F.col("tp")).alias("fn"))


def severity_agreement(pairs: DataFrame, *keys: str) -> DataFrame:
    """Exact and adjacent rates over all pairs, Spearman from ordinal ranks.

    ``pairs``: keys, pair_no, gt_severity, pl_severity.  Ties rank by order of the pairs.
    The rank of a severity is the count of lower ones plus the place among equals, so the
    ranks come from per-severity counts and one window per (keys, severity).
    """
    g, p = rank_of("gt_severity", SEVERITY_RANK), rank_of("pl_severity", SEVERITY_RANK)
    df = pairs.withColumns({"g": g, "p": p}).withColumn("both", (F.col("g") > 0) & (F.col("p") > 0))
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("both") & (F.col("g") == F.col("p"))).alias("exact"),
        F.count_if(F.col("both") & (F.abs(F.col("g") - F.col("p")) <= 1)).alias("adjacent"),
    )
    known = df.filter("both")
    ranked = known.withColumns({
        "rg": F.row_number().over(W.partitionBy(*keys).orderBy("g", "pair_no")),
        "rp": F.row_number().over(W.partitionBy(*keys).orderBy("p", "pair_no")),
    })
    d2 = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(F.pow(F.col("rg") - F.col("rp"), F.lit(2.0))).alias("d2"))
    rho = 1.0 - (6.0 * F.col("d2")) / (F.col("k") * (F.col("k") * F.col("k") - 1))
    return base.join(d2, list(keys), "left").select(
        *keys, F.col("n").alias("pairs"),
        F.round(F.col("exact") / F.col("n"), 3).alias("exact_match_rate"),
        F.round(F.col("adjacent") / F.col("n"), 3).alias("adjacent_agreement_rate"),
        F.when(F.col("k") >= 2, F.round(rho, 3)).alias("spearman_rho"),
    )


def judged(items: DataFrame, verdicts: DataFrame, default: str) -> DataFrame:
    """Items with their verdict; one the judge left out gets the default.

    ``items``: document_id, kind, item_no.  ``verdicts``: the same keys, verdict, answer_no.
    """
    key = ["document_id", "kind", "item_no"]
    last = verdicts.groupBy(*key).agg(F.max_by("verdict", "answer_no").alias("verdict"))
    return items.join(last, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def adjusted_metrics(counts: DataFrame) -> DataFrame:
    """Metrics after judging: accepted false positives are hits, mistaken truths drop out.

    ``counts``: tp, accepted_fp, rejected_fp, real_miss_fn, gt_error_fn.
    """
    tp = F.col("tp") + F.col("accepted_fp")
    p = F.coalesce(_ratio(tp, tp + F.col("rejected_fp")), F.lit(0.0))
    r = F.coalesce(_ratio(tp, tp + F.col("real_miss_fn")), F.lit(0.0))
    f1 = F.coalesce(_f1(p, r), F.lit(0.0))
    return counts.withColumns({
        "precision": F.round(p, 3), "recall": F.round(r, 3), "f1": F.round(f1, 3),
        "gt_errors_dropped": F.col("gt_error_fn")})


def curate(items: DataFrame, statutory_pages: DataFrame, *, has_page_hint: bool) -> DataFrame:
    """Items with removed_reason (NULL = kept).

    ``statutory_pages``: document_id, pages (text such as '5-13,43').  The page rule comes
    first and applies to obligations only, then the phrases.
    """
    specs = statutory_pages.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set("pages")), ",").alias("pages"))
    df = items.join(specs.select("document_id", page_ranges("pages").alias("_pages")), "document_id", "left")
    by_phrase = F.concat(F.lit("pattern:"), statutory_pattern(F.coalesce("quote", F.lit(""))))
    if has_page_hint:
        on_page = F.coalesce(F.array_contains("_pages", F.col("page_hint")), F.lit(False))
        reason = F.when(on_page, "page_range").otherwise(by_phrase)
    else:
        reason = by_phrase
    return df.withColumn("removed_reason", reason).drop("_pages")


def removal_counts(curated: DataFrame) -> DataFrame:
    return curated.groupBy("document_id", F.coalesce("removed_reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("items"))


def label_errors(chunks: DataFrame, expected_pages: DataFrame) -> DataFrame:
    """Chunks whose label contradicts the expected agreement pages.

    ``expected_pages``: document_id, page_number.  Documents without expectations are left
    out; on the others every page not listed is expected to be non-agreement.
    """
    pages = expected_pages.select("document_id", "page_number").distinct().withColumn("_on", F.lit(True))
    scope = expected_pages.select("document_id").distinct()
    df = chunks.join(scope, "document_id", "left_semi").join(pages, ["document_id", "page_number"], "left")
    on = F.coalesce("_on", F.lit(False))
    error = F.when(on & (F.col("section_label") == "non_agreement"), "false_exclusion").when(
        ~on & (F.col("section_label") == "agreement_body"), "false_inclusion")
    return df.withColumn("label_error", error).drop("_on")


def section_filter_report(chunks: DataFrame, expected_pages: DataFrame) -> DataFrame:
    label, error = F.col("section_label"), F.col("label_error")
    return label_errors(chunks, expected_pages).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(label == "agreement_body").alias("agreement_body"),
        F.count_if(label == "non_agreement").alias("non_agreement"),
        F.count_if(label.isNull()).alias("unlabeled"),
        F.count_if(error == "false_exclusion").alias("false_exclusions"),
        F.count_if(error == "false_inclusion").alias("false_inclusions"),
    )
