"""Helpers that the training-data operators share: scratch tables, row keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = tempfile.mkdtemp(prefix="tallywright-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


PART_ROWS = 20_000  # rows of a part of a table whose size is known


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    save() writes and rereads; drop() removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.top = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: about how many df has at most, where known; a small table then is written and read by few tasks."""
        if rows is not None:
            df = df.coalesce(1 + rows // PART_ROWS)
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.top}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            path = path_of(f"{self.top}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str, scratch: Scratch, table: str) -> DataFrame:
    """df with a row number, written: a number taken in two plans may differ, as the split of files into tasks may."""
    return scratch.save(df.select(F.monotonically_increasing_id().alias(name), *df.columns), table)


def part_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; a row without an id falls in part 0, which is always held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows per Arrow batch, `rows` at most: a batch of long texts then fits in a worker. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): label is the smallest node reached over edges (a, b); only nodes of edges appear.

    Each round maps every node to its smallest neighbour's smallest neighbour and so on, four steps far, and
    replaces the ends of edges by what they map to. Loops and repeats go, so edges shrink by more than half a
    round and rows moved are in proportion to the edges in all. A component's smallest node maps to itself in every
    round, so it is the one that is left. At the end the rounds' maps are chained from the last to the first.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    left = scratch.save(ordered(edges), f"{name}-edges-0")
    maps, sizes = [], []
    while n := left.count():
        k = len(maps)
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), f"{name}-step-{k}", 2 * n)
        twice = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"))
        far = twice.join(twice.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"))
        far = scratch.save(far, f"{name}-map-{k}", 2 * n)
        of = lambda c: far.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = left.join(of("a"), "a").join(of("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        # A node that others map to, and that maps on itself, stays tied to where it goes.
        tied = far.filter("node <> to").select(F.col("to").alias("a")).distinct().join(of("a"), "a").select("a", F.col("a_to").alias("b"))
        left = scratch.save(ordered(moved.union(tied)), f"{name}-edges-{k + 1}", n)
        scratch.drop(f"{name}-edges-{k}", f"{name}-step-{k}")
        maps.append(far)
        sizes.append(2 * n)
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[-1]
    for k in range(len(maps) - 2, -1, -1):
        on = labels.select(F.col("node").alias("to"), F.col("to").alias("far"))
        labels = scratch.save(maps[k].join(on, "to", "left").select("node", F.coalesce("far", "to").alias("to")), f"{name}-labels-{k}", sizes[k])
        scratch.drop(f"{name}-map-{k}", f"{name}-map-{k + 1}", f"{name}-labels-{k + 1}")
    return labels.select("node", F.col("to").alias("label"))
