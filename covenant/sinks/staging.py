"""Intermediate tables that every executor can read again after a loss."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.contract import REASON
from covenant.operators.columns import fresh, ref


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A session on a local master that names none, as in tests, gets a temporary folder of its own.
    On a cluster that would be a folder of one machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="covenant-")


class SharedStage:
    """Stores rows that feed both results once, as Parquet in the shared folder, and reads them back.

    Every stage has a folder of its own, so runs and outcomes do not disturb each other. It is
    looked up when something is stored for the first time, so a run that stores nothing needs none. It stays
    until ``discard``: whoever writes the results calls that afterwards. The two kinds of rows
    lie in separate partitions, so each result reads only its own.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        self._folder: str | None = None

    @property
    def path(self) -> str:
        if self._folder is None:
            self._folder = f"{shared_folder(self.spark)}/staged/{self.name}-{uuid.uuid4()}"
        return self._folder

    def available(self) -> bool:
        """Whether there is a folder to store in."""
        try:
            return bool(self.path)
        except ValueError:
            return False

    def __call__(self, judged: DataFrame) -> DataFrame:
        """Judged rows, stored by whether a soft rule rejects them."""
        stored, rejected = self._stored(judged, F.col(REASON).isNotNull(), "judged")
        reason = F.when(F.col(rejected), F.col(REASON))
        return stored.withColumn(REASON, reason).select(*[ref(f) for f in judged.columns])

    def land(self, typed: DataFrame, incomplete: Column) -> tuple[DataFrame, DataFrame]:
        """The rows that are complete and those that are not, from one pass over what ``typed`` is made of."""
        stored, lacking = self._stored(typed, incomplete, "typed")
        columns = [ref(f) for f in typed.columns]
        return stored.where(~F.col(lacking)).select(*columns), stored.where(F.col(lacking)).select(*columns)

    def _stored(self, df: DataFrame, condition: Column, part: str) -> tuple[DataFrame, str]:
        """df with the condition as a column, read back from partitions by it; and the column's name."""
        kind = fresh(df.columns, "__rejected")
        marked = df.withColumn(kind, condition)
        marked.write.partitionBy(kind).parquet(f"{self.path}/{part}")
        return self.spark.read.schema(marked.schema).parquet(f"{self.path}/{part}"), kind

    def discard(self) -> None:
        """Remove the folder, where the session reaches the file system (a remote client does not)."""
        if self._folder is not None and hasattr(self.spark, "_jvm"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
