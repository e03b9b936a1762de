"""Uploads: reading files, accepting them, dropping duplicates."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


UPLOAD_KEY = ["sha256", "asset_id"]
WHOLE_BYTES = 32 << 20  # files up to this size are hashed as one value
PIECE_BYTES = 8 << 10
# Spark's reader of lines unpacks files of these names and leaves off a byte order mark.
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def read_files(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _digests(batches):
    """Digests of files whose pieces come in order: as they are, with a last line break, and both behind a byte order mark."""
    def finish():
        plain, marked = hashes
        for h in hashes:
            h.update(last[:-1])
        ended = [h.copy() for h in hashes]
        for h in ended:
            h.update(b"\n")
        names = [h.hexdigest() for h in (plain, ended[0], marked, ended[1])]
        return pa.record_batch([pa.array([file], pa.int64()), pa.array([size - 1], pa.int64()), pa.array([names])], names=["file", "size", "digests"])

    file, size, hashes, last = None, 0, [], b""
    for batch in batches:
        for own, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
            if own != file:
                if file is not None:
                    yield finish()
                file, size, hashes, last = own, 0, [hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)], b""
            for h in hashes:
                h.update(last)
            last = piece.as_py()
            size += len(last)
    if file is not None:
        yield finish()


def _streamed(spark: SparkSession, path: str, glob: str | None, above: int) -> DataFrame:
    """(file, size, digests) of files above a size, read as lines in parts and put in order again, so none is ever held whole."""
    reader = spark.read.option("lineSep", "\n")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path).filter(F.col("_metadata.file_size") > above)
    lines = lines.filter(~F.col("_metadata.file_name").rlike(PACKED)).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("no"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    at = F.explode(F.sequence(F.lit(1), F.octet_length("line"), F.lit(PIECE_BYTES)))
    pieces = lines.select("file", "start", "no", at.alias("at"), "line").select(
        "file", "start", "no", "at", F.substring("line", F.col("at"), F.lit(PIECE_BYTES)).alias("piece"))
    ordered = pieces.repartition("file").sortWithinPartitions("file", "start", "no", "at").select("file", "piece")
    return ordered.mapInArrow(_digests, "file long, size long, digests array<string>")


def hashed_files(spark: SparkSession, path: str, *, glob: str | None = None, whole: int = WHOLE_BYTES) -> DataFrame:
    """(path, modificationTime, length, sha256) of files; those above ``whole`` bytes are streamed through their hash.

    A file's SHA-256 is sequential, so its pieces meet in one task, a few at a time.  Names that Spark's reader of
    lines would unpack are hashed whole, however long the file.
    """
    files = read_files(spark, path, glob=glob)
    named = files.withColumn("file", F.xxhash64("_metadata.file_path"))
    # one condition a filter: by size and by name files are passed over before anything of them is read
    large, packed = named.filter(F.col("length") > whole), F.col("_metadata.file_name").rlike(PACKED)
    some, rest = (df.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))
                  for df in (named.filter(F.col("length") <= whole), large.filter(packed)))
    long = large.filter(~packed).select("path", "modificationTime", "length", "file").join(_streamed(spark, path, glob, whole), "file")
    missing = F.col("length") - F.col("size")
    digest = F.when(missing.isin(0, 1), F.get("digests", missing.cast("int"))).when(
        missing.isin(3, 4), F.get("digests", (missing - 1).cast("int"))).otherwise(
        F.raise_error(F.concat(F.lit("not read in full: "), "path")))
    return some.unionByName(rest).unionByName(long.select("path", "modificationTime", "length", digest.alias("sha256")))


def uploads_from_files(files: DataFrame, *, asset_id, uploaded_by, mime_type: Column | None = None) -> DataFrame:
    """Upload requests from :func:`hashed_files`."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.lower(name).endswith(".pdf"), "application/pdf").otherwise("text/plain")
    return files.select(
        F.lit(asset_id).alias("asset_id"), F.lit(uploaded_by).alias("uploaded_by"),
        name.alias("source_name"), (kind if mime_type is None else mime_type).alias("mime_type"),
        F.col("length").alias("size"), "sha256",
        F.lit(None).cast("int").alias("total_pages"), F.col("modificationTime").alias("uploaded_at"),
        "path")


def upload_kind() -> Column:
    name, mime = F.lower("source_name"), F.coalesce("mime_type", F.lit(""))
    pdf = (mime == "application/pdf") | name.endswith(".pdf")
    text = mime.isin("text/plain", "application/octet-stream") | name.endswith(".txt")
    return F.when(pdf, "pdf").when(text, "text").otherwise("other")


def check_uploads(uploads: DataFrame, max_pages: int | None = None, *, pdf_only: bool = False) -> DataFrame:
    """Uploads with their kind and the reason for which they are refused, if any."""
    df = uploads.withColumn("kind", upload_kind())
    wrong = F.col("kind") != "pdf" if pdf_only else F.col("kind") == "other"
    message = "Only PDF uploads are supported" if pdf_only else "Only PDF or .txt uploads are supported"
    pages = F.when(F.col("kind") == "pdf", F.col("total_pages"))
    too_long = F.lit(False) if max_pages is None else pages > max_pages
    return df.withColumn(
        "reason",
        F.when(F.coalesce("size", F.lit(0)) == 0, "Empty upload").when(wrong, message)
        .when(too_long, F.concat(
            F.lit("Page count "), pages.cast("string"), F.lit(f" exceeds limit {max_pages}"))))


def ingest_new(uploads: DataFrame, documents: DataFrame, *order: str) -> DataFrame:
    """Uploads to store: not there yet for their asset, and the first of their batch.

    The first of a group of copies is a partial aggregate, so copies are folded before the
    shuffle; the anti join drops what is stored.
    """
    rest = [c for c in uploads.columns if c not in UPLOAD_KEY]
    firsts = uploads.groupBy(*UPLOAD_KEY).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*UPLOAD_KEY, "row.*")
    return firsts.join(documents.select(*UPLOAD_KEY), UPLOAD_KEY, "left_anti").select(*uploads.columns)


def ingest_bulk(
    uploads: DataFrame, documents: DataFrame, *order: str, max_files: int | None = None
) -> DataFrame:
    """Outcome per file of a bulk request: status, reason, document_id.

    PDF only; a duplicate succeeds with the stored id, or that of its first copy in the
    batch.  A request with too many files is refused; one without a single success
    stores nothing.  ``uploads`` carries request_id and upload_id; requests are independent.
    """
    df = check_uploads(uploads, pdf_only=True)
    ok = df.filter(F.col("reason").isNull())
    first = ok.groupBy(*UPLOAD_KEY).agg(F.min_by("upload_id", F.struct(*order)).alias("first_id"))
    stored = documents.groupBy(*UPLOAD_KEY).agg(F.min("document_id").alias("stored_id"))
    size = uploads.groupBy("request_id").agg(F.count(F.lit(1)).alias("files"))
    df = (
        df.join(first, UPLOAD_KEY, "left").join(stored, UPLOAD_KEY, "left").join(size, "request_id")
    )
    many = F.lit(False) if max_files is None else F.col("files") > max_files
    reason = F.when(many, f"Maximum {max_files} files per request").otherwise(F.col("reason"))
    new_id = F.concat(F.lit("new-"), F.col("first_id").cast("string"))
    return df.select(
        "request_id", "upload_id", "source_name", reason.alias("reason"),
        F.when(reason.isNull(), "succeeded").otherwise("failed").alias("status"),
        F.when(reason.isNull(), F.coalesce(F.col("stored_id").cast("string"), new_id)).alias("document_id"),
        (reason.isNull() & F.col("stored_id").isNull() & (F.col("first_id") == F.col("upload_id")))
        .alias("is_new"))


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (path, raw_text); invalid UTF-8 is replaced, not refused."""
    return read_files(spark, path).select(
        "path", F.decode(F.col("content"), F.lit("UTF-8")).alias("raw_text"))


def check_requests(requests: DataFrame, models: DataFrame, documents: DataFrame) -> DataFrame:
    """Compliance requests with the reference they lack, if any; the model is looked up first."""
    m = models.select("ifc_model_id").distinct().withColumn("_m", F.lit(True))
    d = documents.select(F.col("document_id").alias("spec_document_id")).distinct().withColumn("_d", F.lit(True))
    return requests.join(m, "ifc_model_id", "left").join(d, "spec_document_id", "left").withColumn(
        "reason", F.when(F.col("_m").isNull(), "IFC model not found")
        .when(F.col("_d").isNull(), "Spec document not found")).drop("_m", "_d")
