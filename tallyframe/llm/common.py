"""Cutting lineage in the cluster's shared folder, and connected components by contraction."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id in internal keys; null ids sort first.
NO_ID = -(2**63)


#: Bytes of a row group of large rows.
ROW_GROUP = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only on a single machine, where that may be unset, one under /tmp."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints"


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: Arrow batches of 1,024 rows keep a worker's and its executor's buffers to a few MB; a setting of the user's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def sample_bound(rows: int, total: int) -> int:
    """Of ``total`` evenly spread signed 64-bit hashes about ``rows`` are below this number; it takes part of any total, however large."""
    return min(-(2**63) + 2**64 * rows // max(total, 1), 2**63 - 1)


def sampled(h: Column, rows: int, total: int) -> Column:
    """Whether a row with the 64-bit hash ``h`` is among about ``rows`` of ``total``."""
    return F.lit(True) if rows >= total else h < F.lit(sample_bound(rows, total)).cast("long")


class Scratch:
    """Tables written to the shared folder, so that later steps reread them and lost executors cost nothing."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/tallyframe-{uuid.uuid4().hex}"
        self.held: set[str] = set()
        self.made = 0

    def write(self, df: DataFrame, narrow: bool = True, large_rows: bool = False) -> DataFrame:
        """Write and reread; ``narrow`` tables (a few numbers a row) go to four files a core at most, as tiny files cost more than they hold.

        ``large_rows`` are of about a MB or more: a row group is closed at ``ROW_GROUP`` and not at 100 rows or more, as a reader holds one at a time.
        """
        if narrow:
            df = df.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        self.made += 1
        path = f"{self.folder}/{self.made}"
        sizes = {"parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if large_rows else {}
        df.write.option("compression", "zstd").options(**sizes).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        self.held.add(path)
        return back

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables written so far but these, which are what the result is read from."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in self.held - {t.scratch_path for t in tables}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
            self.held.discard(name)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges (u long, v long)``: the smallest node it reaches.

    Every round maps each node to the smallest of itself and its neighbours, follows that map once more, contracts the
    edges by it and writes both; a component loses at least half of its nodes that still have edges, so the rounds are
    logarithmic. Minima combine before the shuffle and the joins may be split by AQE, so that a node with very
    many edges does not land in one task. The maps are then followed from the last round back to the first.
    Empty input gives an empty result.
    """
    edges = scratch.write(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("low"))
        low = scratch.write(low)
        once = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        low = scratch.write(low.join(once, "low").select("node", F.col("lower").alias("low")))
        maps.append(low)
        joined = edges.join(low.select(F.col("node").alias("u"), F.col("low").alias("a")), "u")
        joined = joined.join(low.select(F.col("node").alias("v"), F.col("low").alias("b")), "v")
        edges = scratch.write(joined.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = maps[-1].select("node", F.col("low").alias("component"))
    for low in reversed(maps[:-1]):
        step = found.select(F.col("node").alias("low"), "component")
        found = low.join(step, "low", "left").select("node", F.coalesce("component", "low").alias("component"))
    return scratch.write(found) if len(maps) > 1 else found


def joined_components(known: DataFrame | None, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components ``(node, component)`` of all edges behind ``known`` and of ``edges``; only the new ones are contracted."""
    if known is None:
        return components(edges, scratch)
    if edges.isEmpty():
        return known
    u, v = (known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "uv")
    lifted = edges.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"), F.col("u").alias("a"), F.col("v").alias("b"))
    lifted = scratch.write(lifted)
    new = components(lifted.select("u", "v"), scratch)
    every = known.unionByName(lifted.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("u").alias("component")), F.struct(F.col("b").alias("node"), F.col("v").alias("component")))).alias("e")).select("e.*")).distinct()
    out = every.join(new.select(F.col("node").alias("component"), F.col("component").alias("lower")), "component", "left")
    return scratch.write(out.select("node", F.coalesce("lower", "component").alias("component")))
