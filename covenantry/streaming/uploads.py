"""Uploads as streams (L1 up to chunks, L7); :mod:`covenantry.streaming.stages` runs all stages.

Every micro-batch runs the batch operators and replaces its own partition of the
target tables, so a batch that is retried after a failure leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from covenantry.functions.text import sha256_text
from covenantry.operators.pages import chunk_pages, normalize_pages, page_rows
from covenantry.sources.files import UPLOAD_KEY, ingest_new


def write_batch(df: DataFrame, root: str, table: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch}")


def stored(spark: SparkSession, root: str, table: str, like: DataFrame, before: int) -> DataFrame:
    """Rows of earlier batches; an empty frame of the same shape where there are none."""
    if before == 0:
        return like.limit(0)
    try:
        schema = T.StructType([*like.schema.fields, T.StructField("batch", T.IntegerType())])
        rows = spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)
    return rows.filter(F.col("batch") < before).drop("batch")


def ingest_batch(root: str) -> Callable[[DataFrame, int], None]:
    """Accept new uploads of a batch, then their pages and chunks."""
    def run(batch: DataFrame, batch_id: int) -> None:
        loads = batch.withColumn("sha256", sha256_text("raw_text"))
        keys = loads.select(*UPLOAD_KEY)
        known = stored(batch.sparkSession, root, "documents", keys, batch_id)
        fresh = ingest_new(loads, known, "document_id")
        write_batch(fresh, root, "documents", batch_id)
        # Read back what was stored: the stages below share it instead of ingesting again.
        kept = batch.sparkSession.read.schema(fresh.schema).parquet(f"{root}/documents/batch={batch_id}")
        pages = normalize_pages(page_rows(kept.select(
            "document_id", F.lit(1).alias("page_number"), "raw_text", F.lit(None).cast("string").alias("error"))))
        write_batch(pages, root, "document_pages", batch_id)
        pages = batch.sparkSession.read.schema(pages.schema).parquet(f"{root}/document_pages/batch={batch_id}")
        write_batch(chunk_pages(pages), root, "chunks", batch_id)

    return run


def process_uploads(
    uploads: DataFrame, root: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """``uploads``: a stream of document_id, asset_id, raw_text and further columns."""
    writer = uploads.writeStream.foreachBatch(ingest_batch(root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def distinct_batch(root: str) -> Callable[[DataFrame, int], None]:
    """Keep the keys of a batch that no earlier batch has brought."""
    def run(batch: DataFrame, batch_id: int) -> None:
        keys = batch.select(*UPLOAD_KEY).distinct()
        known = stored(batch.sparkSession, root, "upload_keys", keys, batch_id)
        write_batch(keys.join(known, UPLOAD_KEY, "left_anti"), root, "upload_keys", batch_id)

    return run


def distinct_uploads(
    uploads: DataFrame, root: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Each (sha256, asset_id) once, in ``upload_keys``, however late it arrives.

    The stored keys are the state, so there is no watermark behind which a first upload would be
    lost, and none is held in memory.  A batch that is repeated replaces its own partition.
    """
    writer = uploads.writeStream.foreachBatch(distinct_batch(root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
