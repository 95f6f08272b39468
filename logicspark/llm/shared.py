"""Help that several operators need: tables, row buckets, cut lineage."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that the session names, shared by driver and executors.

    Only a local session without such a folder gets one of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs no more than its tasks.

    Spark removes the files when nothing refers to them, if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def root_buckets(rows: int) -> int:
    """A power of two near the root of ``rows``: as many buckets as rows in each, at any size."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows)) / 2))


def id_digest(doc_id: Column) -> Column:
    """Hex MD5 of the id as text; its order is the fixed shuffled order of rows. Null counts as empty."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def digest_bucket(digest: Column, buckets: int) -> Column:
    """Bucket that rises with the hex digest, of a power-of-two number of equal ones."""
    top = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(top * F.lit(buckets), 32).cast("int")
