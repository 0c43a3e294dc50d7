"""Shared helpers: inputs, scratch tables in the shared folder, fixed patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and line rule in this package.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where none is set and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_quietly_remove, spark, folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM is gone already: nothing is left to clean up with
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor makes Spark read the table again instead of repeating the
    work before it.  ``drop`` frees those that no later step reads; the rest go
    when the driver exits, because a lazily returned result may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/tracelode-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(_quietly_remove, spark, self.root)

    def path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def keep(self, df: DataFrame) -> DataFrame:
        out = self.path()
        df.write.option("compression", "zstd").parquet(out)
        self.spark._jvm.System.gc()  # Spark frees the shuffle files of plans that the driver has let go
        kept = self.spark.read.schema(df.schema).parquet(out)
        kept.scratch_path = out
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            remove(self.spark, df.scratch_path)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    bare = F.btrim(text, F.lit(SPACES))
    words = F.size(F.split(bare, SPACE_CLASS + "+"))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(words).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
