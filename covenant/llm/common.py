"""What several operators share: cutting lineage, checked broadcasts, words, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in a text, as a class for regular expressions.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """df, stored in the folder that spark.checkpoint.dir names, so that it is computed once and outlives executors.

    Where that setting is absent, a local master gets a folder of its own; any other master gets an error.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to a folder of its own under the shared one and read again: for whole tables with texts.

    The folder stays until whoever owns spark.checkpoint.dir clears it, since the result is read later.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that are taken, case aside."""
    names, out = {name.lower() for name in taken}, []
    for name in wanted:
        while name.lower() in names:
            name = f"_{name}"
        names.add(name.lower())
        out.append(name)
    return out


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has at most so many rows; else a join with it stays a shuffle. df: a settled or tiny frame."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links lead to, for each node in edges (a, b), two columns of one type.

    Alternates the large-star and small-star steps until the links are stars around the smallest nodes. Every step
    takes minima per node with map-side combine and joins them back, so a node with very many links is no hot spot.
    """
    links = _links(edges.select("a", "b"))
    before = None
    while True:
        links = settled(links)
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = _links(small.unionByName(least.withColumnRenamed("least", "b")))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _links(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
