"""Stages that turn `documents` into a shuffled training mix."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm import decontaminate, mixing, neardup, quality, sharding
from nivalis.llm.tables import read, unused, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts have a score too; repeated rows are each judged alike."""
    machine = quality.fit(docs, read(spark, sf_dir, "labels"))
    (name,) = unused(docs, "score")
    return quality.scored(docs, machine, score=name).filter(F.col(name) >= quality.THRESHOLD).drop(name)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Rows of null or empty text are one group."""
    return neardup.one_of_each(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages to speak of. Null and empty texts hold none."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def keep_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time that most of the words are taken, one at least if any are.
    Texts without words are in no mix; a null source is a source."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt to shards and shuffled within them; null ids and repeated rows too."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    return sharding.external_shuffle(docs, "doc_id", row_bytes=size)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontamination", keep_clean), ("mixing", keep_mix), ("sharding", shards)]
#: The classifier's scores and the schedule's order can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` through all stages; what each returns is written, and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
