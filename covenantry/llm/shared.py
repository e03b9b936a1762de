"""Tables that a job writes between its steps, in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a scratch folder is set only on a local master without it."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if name is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        name = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id, of: int, remainder: int):
    """crc32 of the id as text, modulo ``of``, is ``remainder`` (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == remainder, F.lit(False))


FILTER_BITS_MAX = 1 << 27


class IdFilter:
    """A broadcast bitmap of hashed ids, at most 16 MB whatever their number.

    It never denies an id that it was built from; others pass by chance, ever more often as ids
    outgrow it, so an exact join follows wherever it is used.  ``hashed``: the ids are hashes themselves, and their
    lowest bits tell their place.
    """

    def __init__(self, ids: DataFrame, name: str, hashed: bool = False) -> None:
        spark, n, self.bits, self.hashed = ids.sparkSession, ids.count(), 1 << 20, hashed
        while self.bits < 64 * n and self.bits < FILTER_BITS_MAX:
            self.bits *= 2
        at = self.place(name)
        words = (ids.select(F.floor(at / 64).alias("word"),
                            F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
                 .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())
        bitmap = np.zeros(self.bits // 64, np.int64)
        bitmap[words["word"].to_numpy()] = words["bit"].to_numpy()
        self.bitmap = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def place(self, name: str):
        """The bit of an id column."""
        if self.hashed:
            return F.col(name).bitwiseAND(F.lit(self.bits - 1))
        return F.pmod(F.xxhash64(F.col(name)), F.lit(self.bits))

    @staticmethod
    def hits(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def maybe(self, name: str):
        """Whether an id may be among those the filter was built from; only the id goes to Python."""
        bitmap = self.bitmap

        @F.pandas_udf("boolean")
        def maybe(at: pd.Series) -> pd.Series:
            return pd.Series(IdFilter.hits(bitmap.value, at.to_numpy()))

        return maybe(self.place(name))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids.doc_id``; only rows that may go are shuffled."""
    ids = ids.select(F.col("doc_id").alias("gone")).distinct()
    may_go = IdFilter(ids, "gone").maybe("doc_id")
    rest = docs.filter(may_go)
    return docs.filter(~may_go).unionByName(rest.join(ids, rest["doc_id"] == ids["gone"], "left_anti"))
