"""Iteration over DataFrames: reliable checkpoints and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local session may have none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: MB of rows above which a written table is never broadcast.
MOST_BROADCAST_MB = 4


def cut(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends, and lost executors cost nothing.

    Its size is that of its files. A checkpoint would keep the plan's estimate, the product of
    the sizes of all joins so far, whose digits double from round to round. Files of few different
    values are far smaller than their rows, so a table of many rows asks for joins that shuffle.
    ``drop`` deletes it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if table.count() * 16 * len(df.columns) > MOST_BROADCAST_MB * 1_000_000:
        table = table.hint("merge")
    table.cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables written by ``cut`` that nothing will read again; any other DataFrame is left alone."""
    for table in tables:
        path = getattr(table, "cut_path", None)
        if path:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def min_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node reaches over edges (a, b).

    A round hooks every component to the smallest one that touches it, shortens the chains of
    hooks by pointer jumps and contracts the edges to those between components. Components that
    touch a smaller one vanish, so rounds are few whatever the paths' lengths.
    """
    oriented = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, open_ = nodes.select("node", F.col("node").alias("component")), cut(oriented(edges))
    held = None  # the table behind ``now``
    while not open_.isEmpty():
        table = hooks = cut(open_.groupBy("a").agg(F.min("b").alias("to")))
        while True:
            on = hooks.select(F.col("a").alias("to"), F.col("to").alias("far"))
            longer = cut(hooks.join(on, "to", "left").select("a", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
            drop(table)
            table, hooks = longer, longer.select("a", "to")
            if longer.filter("moved").isEmpty():
                break
        root = lambda df, c: df.join(hooks.select(F.col("a").alias(c), F.col("to").alias("root")), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        now = cut(root(now, "component").select("node", "component"))
        rest = cut(oriented(root(root(open_, "a"), "b")))
        drop(held, table, open_)
        held, open_ = now, rest
    drop(open_)
    return now
