"""Sessions with the settings that the operators assume, and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}


def session(app: str = "nivalis", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`. Only a local session may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        found = "file://" + tempfile.mkdtemp(prefix="nivalis-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd", path: str | None = None, by: str | None = None) -> DataFrame:
    """`df` written once to the shared folder and read again; each value of the column `by` has a folder.

    A lost executor costs only a re-read, and what follows doesn't compute `df` again."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession)
    df.write.option("compression", codec).partitionBy(*[by] if by else []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table, or a folder of one, that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """What actions shuffle is deleted when they end: for steps that are each run once and written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in all float columns: every source adapter does this, and no operator sees NaN."""
    return df.select(*[F.nanvl(f.name, F.lit(None).cast(f.dataType)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields])
