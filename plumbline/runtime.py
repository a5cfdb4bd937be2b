"""Session helpers shared by all operators: reading tables and cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Configuration entry that names a folder which all executors share.
CHECKPOINT_CONF = "spark.checkpoint.dir"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python functions can import it there."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline.zip"
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(packed))
    sc._plumbline_shipped = True


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base``."""
    ship(spark)
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, which is deleted when the application ends.

    The folder named by ``spark.checkpoint.dir`` is used as it is. Where the session names none, a temporary folder is set
    on a local master; on a cluster, whose executors couldn't read it, that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    if not getattr(sc, "_plumbline_swept", False):
        path = sc._jvm.org.apache.hadoop.fs.Path(current.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        sc._plumbline_swept = True
    return current.get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there: it cuts the lineage, survives the loss of
    executors, is compressed, and its readers take only the columns that they need."""
    spark = df.sparkSession
    folder = shared_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
