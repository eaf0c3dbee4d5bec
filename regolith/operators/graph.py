"""Connected components and bounded traversal over edge tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="regolith-"))
        atexit.register(shutil.rmtree, _own_dirs[0], ignore_errors=True)
    return "file://" + os.path.abspath(_own_dirs[0])


def materialised(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, opened again: cuts lineage, and outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each end of an edge.

    Every round a node takes the smallest label among its neighbours, then the label of its label (pointer jumping),
    so that a path of n nodes takes about log n rounds. A round is aggregated joins on node, and is written down.
    """
    undirected = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    both = materialised(undirected.unionByName(undirected.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    state = materialised(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        heard = both.join(state.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("heard"))
        lower = state.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        jumped = lower.join(up, "label").select("node", "old", F.least("label", "jump").alias("label"))
        # the old label hears of the new one too, which joins trees at their roots
        hooked = jumped.filter("label < old").groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        step = jumped.join(hooked, "node", "left").select("node", "old", F.least("label", F.coalesce("hook", "label")).alias("label"))
        step = materialised(step, "labels")
        if step.filter("label <> old").isEmpty():
            return step.select("node", F.col("label").alias("component"))
        state = step.select("node", "label")


def ancestors(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, depth): ancestors over (child, parent) edges with their least distance, up to depth; cycles are safe."""
    level = materialised(start.select(F.col("node"), F.col("node").alias("ancestor")).distinct().withColumn("depth", F.lit(0)), "ancestors")
    found = level
    for d in range(1, depth + 1):
        up = level.join(edges, level["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor")).distinct()
        fresh = up.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(d))
        level = materialised(fresh, "ancestors")  # a level is written once; what was found before is only read
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.filter("depth > 0 and ancestor not like '\\_:%'")

