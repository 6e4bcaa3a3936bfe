"""Lineage edges and walks over them (G1-G5). Edges: edge_id, source, target, transformation, schemas, counts, loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import add, again, released, written

EDGE = "edge_id long, source string, target string, transformation string, schema_before map<string,string>, schema_after map<string,string>, rows_before long, rows_after long, loss_pct double"


def edges(spark: SparkSession, rows) -> DataFrame:
    """G1: edges of (edge_id, source, target, transformation, schema before, after, rows before, after); the loss of an empty source is 0."""
    loss = lambda a, b: 100.0 * (a - b) / a if a else 0.0
    return spark.createDataFrame([(*r, loss(r[6], r[7])) for r in rows], EDGE)


def edge(spark: SparkSession, source: str, target: str, transformation: str, before: dict, after: dict, rows_before: int, rows_after: int, edge_id: int = 0) -> DataFrame:
    """G1: one edge."""
    return edges(spark, [(edge_id, source, target, transformation, before, after, rows_before, rows_after)])


def chain(edges: DataFrame, table: str, column: str | None = None) -> DataFrame:
    """From the latest edge into the table back along each edge's predecessor, the latest earlier edge into its source.

    ``column`` keeps edges whose schema after holds it. Predecessors come from one running maximum by table; the walk
    doubles: in round k every edge reached so far jumps 2^k edges back, and jumps are joined with themselves, so a chain
    of n edges takes about log n rounds. Each round is written out; whether it reached anything is all that comes back.
    """
    e = edges.where(F.map_contains_key("schema_after", F.lit(column))) if column else edges
    # At one table: what comes in and what goes out, in order; an edge is not its own predecessor.
    ends = e.select(F.col("source").alias("t"), "edge_id", F.lit(0).alias("comes")).union(e.select("target", "edge_id", F.lit(1)))
    w = Window.partitionBy("t").orderBy("edge_id", "comes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = ends.withColumn("prev", F.max(F.when(F.col("comes") == 1, F.col("edge_id"))).over(w)).where("comes = 0 and prev is not null")
    jumps = written(prev.select("edge_id", F.col("prev").alias("to")))
    start = e.where(F.col("target") == table).agg(F.max("edge_id").alias("edge_id")).where("edge_id is not null")
    reached, length = written(start.select("edge_id", F.lit(0).alias("step"))), 1
    while True:
        more = written(reached.join(jumps, "edge_id").select(F.col("to").alias("edge_id"), (F.col("step") + length).alias("step")))
        if more.isEmpty():
            break
        all_ = written(reached.union(more))
        further = written(jumps.join(jumps.select(F.col("edge_id").alias("to"), F.col("to").alias("beyond")), "to").select("edge_id", F.col("beyond").alias("to")))
        released(reached, more, jumps)
        reached, jumps, length = all_, further, 2 * length
    released(more, jumps)
    return reached.join(e, "edge_id").select("step", "edge_id", "source", "target", "transformation")


def impact(edges: DataFrame, table: str) -> DataFrame:
    """Tables downstream with their least depth, and whether they hang on the table directly. Cycles end at a table seen before.

    A breadth-first frontier of any depth: each round joins the edges with the tables reached in the one before and is
    added to a table of those seen, so that a round's plan does not grow; only whether it found any comes back.
    """
    spark = edges.sparkSession
    e = written(edges.select("source", F.col("target").alias("table_name")).distinct())
    front = written(spark.range(1).select(F.lit(table).alias("source")))
    seen = written(front.select(F.col("source").alias("table_name"), F.lit(0).alias("depth")))
    depth = 0
    while True:
        depth += 1
        new = written(e.join(front, "source").select("table_name").distinct().join(seen, "table_name", "left_anti"))
        released(front)
        if new.isEmpty():
            break
        add(new.withColumn("depth", F.lit(depth)), seen)
        seen = again(seen)
        front = again(new).withColumnRenamed("table_name", "source")
        front._written_to = new._written_to
    released(new, e)
    return seen.where("depth > 0").select("table_name", "depth", F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("impact"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row of totals; counts by transformation are in ``by_transformation``."""
    tables = edges.select(F.col("source").alias("t")).union(edges.select("target")).distinct().agg(F.count("*").alias("unique_tables"))
    own = edges.agg(F.count("*").alias("transformations"), F.coalesce(F.sum(F.col("rows_before") - F.col("rows_after")), F.lit(0)).alias("rows_lost"), F.coalesce(F.avg("loss_pct"), F.lit(0.0)).alias("mean_loss_pct"))
    return own.crossJoin(tables)


def by_transformation(edges: DataFrame) -> DataFrame:
    return edges.groupBy("transformation").agg(F.count("*").alias("n"))


def graph(edges: DataFrame) -> DataFrame:
    """Sorted nodes and edges in one table of (kind, a, b, label)."""
    none = F.lit(None).cast("string")
    nodes = edges.select(F.col("source").alias("a")).union(edges.select("target")).distinct().select(F.lit("node").alias("kind"), "a", none.alias("b"), none.alias("label"))
    return nodes.union(edges.select(F.lit("edge"), "source", "target", "transformation")).orderBy("kind", "a", "b", "label")


def graph_json(edges: DataFrame) -> DataFrame:
    """The same as one JSON text; a lineage graph fits a row."""
    g = graph(edges)
    return g.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.when(F.col("kind") == "node", F.col("a")))).alias("nodes"), F.sort_array(F.collect_list(F.when(F.col("kind") == "edge", F.struct("a", "b", "label")))).alias("edges"))).alias("graph"))

