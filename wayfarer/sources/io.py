"""Readers and writers: building documents, packed grids, entity tables, streams of changes and device samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAPH_SCHEMA = (
    "floors array<struct<id: string, name: string, pageIndex: int>>, "
    "nodes array<struct<id: string, floorId: string, x: double, y: double, label: string, type: string, groupId: string>>, "
    "edges array<struct<id: string, `from`: string, `to`: string, weight: double, distance: double, interFloor: boolean, path: array<array<double>>>>"
)
GRID_SCHEMA = (
    "floorId string, pageIndex int, width int, height int, scale double, pageWidth double, pageHeight double, data string, distanceData string"
)


def read_building_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """floors, nodes and edges of nested building documents; an edge weighs its weight, else its distance, else 1."""
    doc = spark.read.schema(GRAPH_SCHEMA).json(path, multiLine=True)
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    edges = doc.select(F.explode("edges").alias("e")).select(
        F.col("e.id").alias("edge_id"),
        F.col("e.from").alias("src"),
        F.col("e.to").alias("dst"),
        F.coalesce("e.weight", "e.distance", F.lit(1.0)).alias("weight"),
        F.coalesce("e.interFloor", F.lit(False)).alias("inter_floor"),
        F.transform("e.path", point).alias("path"),
    )
    return {
        "floors": doc.select(F.explode("floors").alias("f")).select(F.col("f.id").alias("floor_id"), "f.name", F.col("f.pageIndex").alias("floor_no")),
        "nodes": doc.select(F.explode("nodes").alias("n")).select(F.col("n.id").alias("node_id"), F.col("n.floorId").alias("floor_id"), "n.x", "n.y", "n.label", "n.type"),
        "edges": edges,
    }


def building_documents(floors: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "building_id") -> DataFrame:
    """One row per building with the nested document: coordinates to 5 places, weights to 1, counts in ``meta``."""
    f = floors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("floor_id").alias("id"), "name", F.col("floor_no").alias("pageIndex")))).alias("floors"))
    n = nodes.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("node_id").alias("id"), F.col("floor_id").alias("floorId"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "label", "type"))).alias("nodes")
    )
    e = edges.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), F.bround("weight", 1).alias("weight"), F.col("inter_floor").alias("interFloor")))).alias("edges")
    )
    meta = F.struct(F.size("nodes").alias("nodes"), F.size("edges").alias("edges"))
    return f.join(n, key, "left").join(e, key, "left").withColumn("meta", meta)


def write_building_graph(floors: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, key: str = "building_id") -> None:
    building_documents(floors, nodes, edges, key).write.partitionBy(key).json(path)


def decode_grid_cells(grids: DataFrame) -> DataFrame:
    """(floor_id, x, y, passable, dist): bits from the most significant on, eight cells a byte; distances a byte a cell."""
    raw = grids.select(F.col("floorId").alias("floor_id"), "width", "height", F.hex(F.unbase64("data")).alias("bits"), F.hex(F.unbase64("distanceData")).alias("far"))
    n = F.col("width") * F.col("height")
    cells = raw.filter(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    byte = lambda c, i: F.conv(F.substr(F.col(c), 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    bit = F.floor(byte("bits", F.floor(F.col("i") / 8).cast("int")) / F.pow(F.lit(2.0), 7 - F.col("i") % 8)).cast("int") % 2
    return cells.select(
        "floor_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), bit.alias("passable"), byte("far", F.col("i")).alias("dist")
    )


def encode_grid_cells(cells: DataFrame) -> DataFrame:
    """Inverse of ``decode_grid_cells``: one document row per floor, row-major, padded to whole bytes, without line breaks."""
    size = cells.groupBy("floor_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    i = F.col("y") * F.col("width") + F.col("x")
    placed = cells.join(size, "floor_id").withColumn("i", i)
    value = F.sum(F.col("passable") * F.pow(F.lit(2), 7 - F.col("i") % 8)).cast("int")
    packed = placed.groupBy("floor_id", "width", "height", F.floor(F.col("i") / 8).alias("at")).agg(value.alias("v"))
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda b: F.lpad(F.hex(b.v), 2, "0")), "")
    return packed.groupBy("floor_id", "width", "height").agg(F.regexp_replace(F.base64(F.unhex(digits)), "[\r\n]", "").alias("data")).select(
        F.col("floor_id").cast("string").alias("floorId"), "width", "height", "data", F.lit(None).cast("string").alias("distanceData")
    )


def write_grid_cells(cells: DataFrame, path: str) -> None:
    encode_grid_cells(cells).write.partitionBy("floorId").json(path)


def read_entity_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A typed scan of one entity table; a schema is applied where given."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def change_stream(spark: SparkSession, path: str, schema: str, format_: str = "json") -> DataFrame:
    """A file stream of changed rows (alerts or votes)."""
    return spark.readStream.schema(schema).format(format_).load(path)


def device_stream(spark: SparkSession, path: str, schema: str, ts: str = "ts", delay: str = "10 minutes", format_: str = "json", per_trigger: int | None = None) -> DataFrame:
    """A file stream of fixes or samples with an event-time watermark; at most ``per_trigger`` files at a time."""
    reader = spark.readStream.schema(schema).format(format_)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.load(path).withWatermark(ts, delay)
