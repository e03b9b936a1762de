"""What stands around a quote on its page (G12), for all evidence at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from covenantry.functions.text import JS_SPACE, JS_WS, collapse_js, jaccard

# List marks, and what counts as a reference.
MARK = r"^[•\-–]"
REFERENCE_RE = (
    rf"(?i)(?:§+[{JS_WS}]*[0-9]+(?:\.[0-9]+)*)"
    rf"|(?:section|sec\.|clause|article|paragraph)[{JS_WS}]+[A-Za-z0-9.-]+"
    r"|\b[0-9]+(?:\.[0-9]+)+\b"
    rf"|\$[{JS_WS}]*[0-9,]+(?:\.[0-9]+)?"
    rf"|\b[0-9]+[{JS_WS}]*(?:days?|weeks?|months?|years?)\b"
    r"|\b[0-9]+(?:\.[0-9]+)?%"
)
MIN_BLOCK = 12
MIN_WORDS = 5
SAME_FROM = 0.8


def references(texts: Column) -> Column:
    """Distinct references of an array of texts in order of appearance."""
    found = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(REFERENCE_RE), F.lit(0))))
    return F.array_distinct(F.transform(found, collapse_js))


def context_blocks(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, block_no, block) from raw page text.

    A marked line opens a block, any other line joins the block before it; a leading
    unmarked block and blocks of up to 12 characters drop out.  A page is folded within
    its own row, so nothing is shuffled.
    """
    raw = F.replace(F.replace("raw_text", F.lit("\r"), F.lit("")), F.lit("•"), F.lit("\n• "))
    lines = F.filter(
        F.transform(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit(JS_SPACE))), lambda x: x != "")
    parsed = F.filter(
        F.transform(lines, lambda x: F.struct(
            x.rlike(MARK).alias("marked"),
            collapse_js(F.regexp_replace(x, rf"^[•\-–]+[{JS_WS}]*", "")).alias("body"))),
        lambda x: x["body"] != "")
    kind = "array<struct<marked:boolean,body:string>>"

    def add(done: Column, line: Column) -> Column:
        # Texts of one block are kept as lines and joined once at the end.
        last = F.element_at(done, -1)
        grown = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["marked"].alias("marked"),
                             F.concat(last["body"], F.lit(" "), line["body"]).alias("body"))))
        return F.when(line["marked"] | (F.size(done) == 0), F.concat(done, F.array(line))).otherwise(grown)

    blocks = F.aggregate(parsed, F.array().cast(kind), add)
    kept = F.filter(
        F.filter(blocks, lambda b, i: b["marked"] | (i > 0)),
        lambda b: F.length(b["body"]) > MIN_BLOCK)
    return pages.select("document_id", "page_number", F.posexplode(F.transform(kept, lambda b: b["body"]))
                        .alias("block_no", "block"))


def canonical(c: Column) -> Column:
    """Lower-case words parted by single spaces; white space goes with whatever else is no letter or digit."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))


def redundant(a: Column, a_words: Column, b: Column, b_words: Column) -> Column:
    """Do two canonical texts (with their word sets) say the same?"""
    close = jaccard(a_words, b_words) >= SAME_FROM
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a) | close)


def useful(c: Column) -> Column:
    text = collapse_js(c)
    words = F.size(F.split(text, " "))
    bare = (words < 7) & text.rlike(rf"(?i)^\(?eff\.[{JS_WS}]*[0-9]")
    return (words >= MIN_WORDS) & ~text.endswith("(") & ~text.endswith("-") & ~bare


def context_digest(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Per evidence row: useful neighbours of the block that holds the quote, and references.

    ``evidence``: evidence_id, document_id, page_number, quote.  Neighbours are attached to
    a block by a window over the blocks of its page before quotes meet the blocks, and the
    containment test is part of that join.  What a quote and its neighbours say is worked out only where
    a block was found, so texts alone are moved and sorted.
    """
    w = W.partitionBy("document_id", "page_number").orderBy("block_no")
    blocks = context_blocks(pages).withColumns({"before": F.lag("block").over(w), "after": F.lead("block").over(w)})
    asked = evidence.select("evidence_id", "document_id", "page_number", collapse_js("quote").alias("q"))
    hit = (
        asked.join(blocks, ["document_id", "page_number"])
        .filter(F.contains(F.col("block"), F.col("q")))
        .groupBy("document_id", "page_number", "evidence_id")
        .agg(F.min_by(F.struct("before", "after"), "block_no").alias("near"))
    )
    df = asked.join(hit, ["document_id", "page_number", "evidence_id"], "left")
    sides = {"q": F.col("q"), "before": F.col("near.before"), "after": F.col("near.after")}
    df = df.withColumns({f"{n}_plain": F.when(F.col("near").isNotNull(), canonical(c)) for n, c in sides.items()})
    df = df.withColumns({f"{n}_words": F.array_distinct(F.split(f"{n}_plain", " ")) for n in sides})

    def neighbour(name: str) -> Column:
        text = sides[name]
        keep = (text != "") & useful(text) & ~redundant(
            F.col(f"{name}_plain"), F.col(f"{name}_words"), F.col("q_plain"), F.col("q_words"))
        return F.when(keep, text)

    around = F.array_compact(F.array(neighbour("before"), neighbour("after")))
    df = df.withColumn("bullets", F.when(F.col("near").isNotNull(), F.array_distinct(around))
                       .otherwise(F.array().cast("array<string>")))
    own = F.when(F.col("q") == "", F.array().cast("array<string>")).otherwise(F.array("q"))
    return df.select(
        "evidence_id", "document_id", "page_number", "bullets",
        references(F.when(F.col("near").isNotNull(), F.col("bullets")).otherwise(own)).alias("references"))
