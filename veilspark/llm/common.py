"""What the training-data operators share: table access, word splitting, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is space, tab, newline, vertical tab, form feed, carriage return; all else is part of a word.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
NOT_WORD = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for a null, empty or blank one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs in one process."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not (d := spark.conf.get("spark.checkpoint.dir", None)):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="spark-shared-")
    sc.setCheckpointDir(d)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: later reads neither recompute them nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT_KEYS, HOT_ROWS = 1000, 10_000


def spread_join(many: DataFrame, one: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """many joined with one, which has one row per key, so that no key's rows of many meet in one task.

    A key is hot if it has HOT_ROWS rows and more than 1/HOT_KEYS of all: there are fewer hot keys
    than HOT_KEYS, so they are broadcast. Rows of hot keys are dealt over ``salts`` tasks, and one's
    rows of these keys are there in each of them. Keys are compared by ``=``: null matches nothing.
    counts: on and n, how many rows of many each key has, where that is known already.
    """
    if counts is None:
        counts = many.groupBy(*on).agg(F.count("*").alias("n"))
    wanted = [*on, "n"]
    large = counts.select(*wanted).where(f"n >= {HOT_ROWS}").orderBy(F.desc("n"), *on).limit(HOT_KEYS - 1).collect()
    total = many.count() if len(large) == HOT_KEYS - 1 else 0  # with fewer of them, all may be dealt out
    if not (large := [r for r in large if r["n"] > total / HOT_KEYS]):
        return many.join(one, on, how)
    found = many.sparkSession.createDataFrame(large, counts.select(*wanted).schema)
    hot = F.broadcast(found.select(*on, F.lit(1).alias("__hot")))
    deal = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in many.columns)), F.lit(salts))
    left = many.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot") == 1, deal).otherwise(0).cast("int")).drop("__hot")
    copies = F.when(F.col("__hot") == 1, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(hot, on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [*on, "__salt"], how).drop("__salt")
