"""Page and chunk stages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from covenantry.functions.keys import last_per_key
from covenantry.functions.coerce import (
    coerce_enum, domain_of, early_type_guess, heuristics_agree, relevance,
)
from covenantry.functions.similarity import split_sections
from covenantry.functions.text import (
    is_blank, looks_like_table, normalize_text, sha256_text, strip, token_set,
)
from covenantry.operators.rollups import sample_pages
from covenantry.rules import LIMITS, RULES, RuleBase
from covenantry.schema import DOCUMENT_TYPES, SECTION_LABELS
from covenantry.session import spread


def page_rows(texts: DataFrame, min_chars: int = LIMITS.min_page_chars) -> DataFrame:
    """Page rows of extracted text; an extraction error gives a failed page with empty text.

    ``texts``: document_id, page_number, raw_text, error.
    """
    failed = F.col("error").isNotNull()
    raw = F.when(failed, "").otherwise(F.coalesce("raw_text", F.lit("")))
    return texts.withColumn("raw_text", raw).select(
        "document_id", "page_number", "raw_text", F.lit("").alias("normalized_text"),
        F.lit("pdf_text").alias("text_source"), sha256_text("raw_text").alias("text_sha256"),
        (~failed & looks_like_table("raw_text")).alias("has_tables"),
        F.when(failed, "failed").otherwise("pending").alias("processing_status"),
        F.substring(F.concat(F.lit("pdf_page_parse_failed: "), "error"), 1, 1000)
        .alias("processing_error"),
        (~failed & (F.length(strip("raw_text")) < min_chars)).alias("is_scanned"),
    )


def page_counts(pages: DataFrame) -> DataFrame:
    """Per document: pages and scanned pages, the latter at least the failed ones."""
    return pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.greatest(
            F.count_if("is_scanned"), F.count_if(F.col("processing_status") == "failed")
        ).alias("scanned_page_count"),
    )


def text_pages(files: DataFrame) -> DataFrame:
    """One pending page per text file; ``files``: document_id, raw_text."""
    return files.select(
        "document_id", F.lit(1).alias("page_number"), "raw_text",
        F.lit("pdf_text").alias("text_source"), sha256_text("raw_text").alias("text_sha256"),
        looks_like_table("raw_text").alias("has_tables"),
        F.lit("pending").alias("processing_status"),
    )


def apply_ocr(
    pages: DataFrame, documents: DataFrame, results: DataFrame,
    min_chars: int = LIMITS.min_page_chars,
) -> DataFrame:
    """Take recognised text for scanned or failed pages of PDF documents.

    ``results``: document_id, page_number, ocr_text, ocr_error; of several for a page the last counts.
    """
    pdf = documents.filter(
        (F.col("mime_type") == "application/pdf") & (F.col("parse_status") != "failed")
    ).select("document_id", F.lit(True).alias("_pdf"))
    wanted = (F.length(strip("raw_text")) < min_chars) | (F.col("processing_status") == "failed")
    df = pages.join(pdf, "document_id", "left").join(
        last_per_key(results, "document_id", "page_number").select("document_id", "page_number", "ocr_text", "ocr_error"),
        ["document_id", "page_number"], "left",
    )
    tried = F.coalesce(F.col("_pdf"), F.lit(False)) & wanted
    read = tried & F.col("ocr_error").isNull() & F.col("ocr_text").isNotNull()
    error = F.substring(
        F.concat(F.lit("ocr_failed: "), F.coalesce("ocr_error", F.lit("no result"))), 1, 1000)
    return df.select(
        "document_id", "page_number",
        F.when(read, F.col("ocr_text")).otherwise(F.col("raw_text")).alias("raw_text"),
        F.when(read, "ocr").otherwise(F.col("text_source")).alias("text_source"),
        F.when(read, "pending").when(tried, "failed").otherwise(F.col("processing_status"))
        .alias("processing_status"),
        F.when(read, None).when(tried, error).otherwise(F.col("processing_error"))
        .alias("processing_error"),
    )


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Failed pages pass through; the others get text, hash and status."""
    failed = F.col("processing_status") == "failed"
    text = normalize_text("raw_text")
    return pages.withColumn("_n", text).withColumns({
        "normalized_text": F.when(failed, F.col("normalized_text")).otherwise(F.col("_n")),
        "text_sha256": F.when(failed, F.col("text_sha256")).otherwise(sha256_text("_n")),
        "processing_status": F.when(failed, "failed").otherwise("processed"),
        "processing_error": F.when(failed, F.col("processing_error")),
    }).drop("_n")


# Superset of both heading patterns; texts without it are cut natively.
MAY_HAVE_HEADING = r"(?U)\d[.)][\s\x1c-\x1f]|[A-Z][A-Z\s\x1c-\x1f]{4}"


def chunk_slices(text: Column | str, limit: int = LIMITS.max_chars) -> Column:
    """array<struct(char_start, char_end, split_reason)> of one page text."""
    c = F.col(text) if isinstance(text, str) else text
    size = F.length(c)
    whole = F.array(F.struct(
        F.lit(0).alias("char_start"), size.alias("char_end"), F.lit("full_page").alias("split_reason")))
    fixed = F.transform(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(limit)),
        lambda s: F.struct(
            s.alias("char_start"), F.least(s + limit, size).alias("char_end"),
            F.lit("token_limit").alias("split_reason")),
    )
    headed = (size > limit) & c.rlike(MAY_HAVE_HEADING)
    cut = split_sections(F.when(headed, c), limit)
    return F.when(size <= limit, whole).when(headed, cut).otherwise(fixed)


def chunk_pages(pages: DataFrame, limit: int = LIMITS.max_chars) -> DataFrame:
    """Chunks of processed pages; a narrow stage, nothing is shuffled."""
    text = F.coalesce("normalized_text", F.lit(""))
    rows = pages.filter(F.col("processing_status") == "processed").select(
        "document_id", "page_number", text.alias("page_text"))
    cut = rows.select("*", F.inline(chunk_slices("page_text", limit)))
    piece = F.col("page_text").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return cut.withColumn("text", piece).filter(~is_blank("text")).select(
        "document_id", "page_number", "char_start", "char_end", "text",
        sha256_text("text").alias("chunk_sha256"), "split_reason",
    )


def early_types(documents: DataFrame, pages: DataFrame, first: int = 3, rules=None) -> DataFrame:
    """Type guess from the non-blank ones among the first pages; no hit leaves the type."""
    w = W.partitionBy("document_id").orderBy("page_number")
    head = pages.select("document_id", "page_number", "raw_text").withColumn(
        "_no", F.row_number().over(w)).filter(F.col("_no") <= first)
    blob = (
        head.filter(~is_blank("raw_text"))
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("page_number", strip("raw_text").alias("t")))).alias("p"))
        .select("document_id", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("blob"))
    )
    guess = blob.select("document_id", early_type_guess("blob", rules).alias("guess"))
    return documents.join(guess, "document_id", "left").withColumn(
        "doc_type", F.coalesce("guess", "doc_type")).drop("guess")


def gate_types(
    documents: DataFrame, pages: DataFrame, answers: DataFrame, *, rules: RuleBase = RULES, n: int = 3
) -> DataFrame:
    """Accept a proposed type only where the sample's keywords agree.

    ``answers``: document_id, proposed_type, confidence; the last of a document counts.  Documents without an answer keep
    their type.
    """
    blob = (
        sample_pages(pages, n).groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("sample_no", strip("sample_text").alias("t")))).alias("p"))
        .select("document_id", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("blob"))
    )
    asked = last_per_key(answers, "document_id").select(
        "document_id", coerce_enum("proposed_type", DOCUMENT_TYPES, "unknown").alias("_type"),
        F.col("confidence").cast("double").alias("_confidence"), F.lit(True).alias("_asked"),
    )
    df = documents.join(asked, "document_id", "left").join(blob, "document_id", "left")
    agree = heuristics_agree("_type", F.coalesce("blob", F.lit("")), rules)
    final = F.when(agree, F.col("_type")).otherwise("unknown")
    return df.withColumns({
        "doc_type": F.when(F.col("_asked"), final).otherwise(F.col("doc_type")),
        "doc_type_confidence": F.when(F.col("_asked") & agree, F.col("_confidence")),
        "domain": F.when(F.col("_asked"), domain_of(final, rules)),
    }).drop("_type", "_confidence", "_asked", "blob")


# --- selection of chunks ------------------------------------------------------------

def _chunk_order() -> W:
    return W.partitionBy("document_id").orderBy("page_number", "char_start")


def label_sections(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels by section number; ``labels``: document_id, section, label, answer_no.

    Only the two valid labels count, the last one wins, missing -> agreement_body.
    """
    valid = labels.filter(F.col("label").isin(*SECTION_LABELS)).groupBy(
        "document_id", F.col("section").cast("int").alias("section_no")
    ).agg(F.max_by("label", "answer_no").alias("label"))
    numbered = chunks.withColumn("section_no", F.row_number().over(_chunk_order()))
    return numbered.join(valid, ["document_id", "section_no"], "left").withColumn(
        "section_label", F.coalesce("label", F.lit("agreement_body"))).drop("label")


def section_stats(
    chunks: DataFrame, bypass_ratio: float = LIMITS.bypass_ratio, force_all: bool = False
) -> DataFrame:
    keep = F.col("section_label").isNull() | (F.col("section_label") == "agreement_body")
    stats = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("agreement"))
    ratio = (F.col("total") - F.col("agreement")) / F.col("total")
    bypass = F.lit(force_all) | (F.col("agreement") == 0) | (
        ratio >= min(1.0, max(0.0, bypass_ratio)))
    return stats.withColumns({
        "non_agreement": F.col("total") - F.col("agreement"),
        "non_agreement_ratio": F.round(ratio, 4),
        "bypassed": bypass,
        "chunk_source": F.when(bypass, "all_chunks_fallback").otherwise("filtered"),
    })


def section_filter(
    chunks: DataFrame, bypass_ratio: float = LIMITS.bypass_ratio, force_all: bool = False
) -> DataFrame:
    """Chunks to extract from, with the source that was chosen for the document."""
    stats = section_stats(chunks, bypass_ratio, force_all)
    keep = F.col("section_label").isNull() | (F.col("section_label") == "agreement_body")
    return chunks.join(
        stats.select("document_id", "bypassed", "chunk_source"), "document_id"
    ).filter(keep | F.col("bypassed")).drop("bypassed")


def zero_result_retry(passes: DataFrame) -> DataFrame:
    """``passes``: document_id, kind, item_count, chunk_source; both kinds must come up empty."""
    return passes.groupBy("document_id").agg(
        ((F.sum("item_count") == 0)
         & F.bool_and(F.col("chunk_source") == "filtered")).alias("retry_all_chunks"))


def extraction_mode(
    chunks: DataFrame, mode: str = "auto", limit: int = LIMITS.token_threshold,
    chars_per_token: int = LIMITS.chars_per_token, overhead: int = LIMITS.prompt_overhead,
) -> DataFrame:
    tokens = F.floor(F.sum(F.length(F.coalesce("text", F.lit("")))) / max(1, chars_per_token)) + overhead
    fits = F.col("estimated_tokens") <= limit
    choice = {"chunked": F.lit("chunked"), "full_doc": F.lit("full_doc")}.get(
        mode.strip().lower(), F.when(fits, "full_doc").otherwise("chunked"))
    return chunks.groupBy("document_id").agg(tokens.alias("estimated_tokens")).withColumn(
        "extraction_mode", choice)


def score_chunks(chunks: DataFrame, documents: DataFrame, stage: str, rules: RuleBase = RULES) -> DataFrame:
    kinds = documents.select("document_id", "doc_type")
    return chunks.join(kinds, "document_id").withColumn(
        "relevance", relevance("text", "doc_type", stage, rules))


def select_top_chunks(scored: DataFrame, k: int) -> DataFrame:
    """The k most relevant chunks per document; ties keep page order."""
    w = W.partitionBy("document_id").orderBy(
        F.col("relevance").desc(), "page_number", "char_start")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def select_mmr_chunks(scored: DataFrame, k: int, weight: float = LIMITS.mmr_lambda) -> DataFrame:
    """k chunks per document by maximal marginal relevance; documents up to k keep all.

    Only (order, relevance, hashed token set) of documents above k travels to Python.
    """
    weight = min(1.0, max(0.0, weight))
    sized = scored.withColumns({
        "_n": F.count(F.lit(1)).over(W.partitionBy("document_id")),
        "_pos": F.row_number().over(_chunk_order()),
    })
    entry = F.struct(
        (-F.col("relevance")).alias("order"), "_pos", F.col("relevance").alias("score"),
        F.transform(token_set("text"), lambda t: F.xxhash64(t)).alias("tokens"))
    big = sized.filter(F.col("_n") > k).groupBy("document_id").agg(
        F.sort_array(F.collect_list(entry)).alias("c"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def choose(positions, scores, tokens):
        return pd.Series([mmr(p, s, t, k, weight) for p, s, t in zip(positions, scores, tokens)])

    chosen = spread(big, "document_id").select(
        "document_id", F.explode(choose(F.col("c._pos"), F.col("c.score"), F.col("c.tokens"))).alias("_pos"))
    small = sized.filter(F.col("_n") <= k)
    picked = sized.filter(F.col("_n") > k).join(chosen, ["document_id", "_pos"], "left_semi")
    return small.select(*picked.columns).unionByName(picked).drop("_n", "_pos")


def mmr(positions, scores, tokens, k: int, weight: float) -> list[int]:
    """Positions of k entries, given by falling relevance; ties go to the earlier entry."""
    tokens = [set(t) for t in tokens]
    nearest = [0.0] * len(tokens)
    left, taken = list(range(len(tokens))), []
    while left and len(taken) < k:
        best = left[0] if not taken else max(
            left, key=lambda i: (weight * scores[i] - (1.0 - weight) * nearest[i], -i))
        left.remove(best)
        taken.append(best)
        for i in left:
            joint = len(tokens[i] & tokens[best])
            if joint:
                nearest[i] = max(nearest[i], joint / (len(tokens[i]) + len(tokens[best]) - joint))
    return [int(positions[i]) for i in taken]


# --- groups and assembled text ---------------------------------------------------------

def group_chunks(chunks: DataFrame, size: int = LIMITS.chunks_per_group) -> DataFrame:
    """Consecutive groups of ``size`` chunks with page range and assembled text."""
    no = F.floor((F.row_number().over(_chunk_order()) - 1) / max(1, size)).cast("int")
    head = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), "text")
    return chunks.withColumn("group_no", no).groupBy("document_id", "group_no").agg(
        F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"),
        F.count(F.lit(1)).alias("chunks"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("page_number", "char_start", head.alias("t")))),
                lambda x: x["t"]),
            "\n\n").alias("text"),
    )


def item_batches(items: DataFrame, size: int, *order: str) -> DataFrame:
    """batch_index of consecutive items of a document."""
    w = W.partitionBy("document_id").orderBy(*order)
    return items.withColumn(
        "batch_index", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def full_text(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Page texts of a document joined by blank lines; ``limit`` is the critic's own cut."""
    text = F.coalesce(F.nullif("normalized_text", F.lit("")), "raw_text", F.lit(""))
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("page_number", text.alias("t")))),
                    lambda x: x["t"]), "\n\n")
    out = pages.groupBy("document_id").agg(joined.alias("full_text"))
    return out if limit is None else out.withColumn("full_text", F.substring("full_text", 1, limit))


def page_view(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Pages with their spans in order of char_start."""
    listed = spans.groupBy("document_id", "page_number").agg(
        F.sort_array(F.collect_list(F.struct("char_start", "char_end", "span_text"))).alias("spans"))
    return pages.join(listed, ["document_id", "page_number"], "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<char_start:int,char_end:int,span_text:string>>")))


def locate_spans(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Offsets of spans in their page, searched from a cursor that moves with every hit.

    ``spans``: document_id, page_number, span_no, span_text.  The cursor makes a page
    sequential, so a page is one row: its text and its spans, folded by ``aggregate``.
    """
    text = strip("span_text")
    listed = spans.filter(text != "").groupBy("document_id", "page_number").agg(
        F.sort_array(F.collect_list(F.struct("span_no", text.alias("t"), "span_text"))).alias("s"))
    df = listed.join(pages.select("document_id", "page_number", "raw_text"), ["document_id", "page_number"])
    hit_type = "array<struct<span_no:int,char_start:int,char_end:int,span_text:string>>"

    def step(acc: Column, span: Column) -> Column:
        ahead = F.call_function("locate", span["t"], F.col("raw_text"), acc["cursor"] + 1)
        at = F.when(ahead > 0, ahead).otherwise(F.instr(F.col("raw_text"), span["t"])) - 1
        end = at + F.length(span["t"])
        row = F.struct(
            span["span_no"].cast("int").alias("span_no"), at.cast("int").alias("char_start"),
            end.cast("int").alias("char_end"), span["span_text"].alias("span_text"))
        return F.struct(
            F.when(at >= 0, end).otherwise(acc["cursor"]).cast("int").alias("cursor"),
            F.when(at >= 0, F.concat(acc["hits"], F.array(row))).otherwise(acc["hits"]).alias("hits"))

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(hit_type).alias("hits"))
    found = F.aggregate("s", start, step, lambda acc: acc["hits"])
    return df.select("document_id", "page_number", F.inline(found))
