"""Tables written to the shared folder between the rounds of iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))]))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; on one machine a temporary one where it is missing."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Delete everything that this application has staged; what was read from there must have been used by then."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Give a written folder another name, under which a stream finds its files all at once; false if there is none."""
    source, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(source):
        return False
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")
    return True


def staged_at(df: DataFrame, name: str, **options: str) -> str:
    """The new path in the shared folder to which df is written."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return path


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written and read back: lineage ends here, and a lost executor costs a reread. drop_staged deletes such tables."""
    return df.sparkSession.read.schema(df.schema).parquet(staged_at(df, name, **options))
