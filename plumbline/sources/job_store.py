"""The job store: one JSON document for each job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import STORED_JOB


def read_jobs(spark: SparkSession, folder: str, one_a_file: bool = False) -> DataFrame:
    """All readable documents with their ``file`` name; corrupt ones vanish. A document is a line, or a whole file in any layout."""
    raw = spark.read.schema(STORED_JOB).option("multiLine", one_a_file).option("mode", "DROPMALFORMED").json(folder)
    return raw.withColumn("file", F.col("_metadata.file_name")).where(F.col("id").isNotNull())


def last_files(spark: SparkSession, folder: str, limit: int = 50) -> DataFrame:
    """The documents of the last ``limit`` files in the order of their names, last first (``file`` and the stored columns).

    The files are chosen before they are read, so a corrupt one takes up a place and then vanishes.
    """
    raw = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    newest = raw.where(F.col("file").endswith(".json")).orderBy(F.col("file").desc()).limit(limit)
    read = newest.select("file", F.from_json("value", STORED_JOB).alias("job"))
    return read.where(F.col("job.id").isNotNull()).select("file", "job.*").orderBy(F.col("file").desc())


def write_jobs(jobs: DataFrame, folder: str) -> None:
    """Replace the store by these documents."""
    jobs.select([f.name for f in STORED_JOB.fields if f.name in jobs.columns]).write.mode("overwrite").json(folder)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The documents of ``new`` and those of ``old`` that it doesn't replace."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def without_incomplete(jobs: DataFrame) -> DataFrame:
    """The store after a restart: running and queued jobs are gone."""
    return jobs.where(~F.col("status").isin("running", "queued") | F.col("status").isNull())


def summaries(jobs: DataFrame) -> DataFrame:
    """The projection that lists show."""
    slots = F.coalesce(F.array_size("slotResults"), F.lit(0)) if isinstance(jobs.schema["slotResults"].dataType, T.ArrayType) else F.lit(0)
    return jobs.select("id", "status", F.substring(F.coalesce("scenario.english", F.lit("")), 1, 80).alias("english"), "createdAt", "completedAt", slots.alias("slot_count"))
