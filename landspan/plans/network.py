"""Road networks: vertices, snapping, shortest path costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.operators import spatial
from landspan.session import cut

OFFSET = 1 << 31


def vertex_id(x, y, tolerance: float):
    """Id of a snapped place: its grid cell, packed into one number."""
    cx = F.floor(x / tolerance + 0.5).cast("bigint") + OFFSET
    cy = F.floor(y / tolerance + 0.5).cast("bigint") + OFFSET
    return F.shiftleft(cx, 32).bitwiseOR(cy)


def topology(edges: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """TRN04: vertices of all line ends and edges with source and target.

    Ends in one grid cell of the tolerance are one vertex, placed at their first point.
    Ids follow from the place, so a rerun gives the same ids and no global numbering
    is needed.  ``edges``: id, length, x1, y1, x2, y2.
    """
    known = F.col("x1").isNotNull() & F.col("x2").isNotNull()
    out = edges.withColumns(
        {
            "source": F.when(known, vertex_id(F.col("x1"), F.col("y1"), tolerance)),
            "target": F.when(known, vertex_id(F.col("x2"), F.col("y2"), tolerance)),
        }
    )
    ends = out.where(known).select(
        F.explode(
            F.array(
                F.struct(F.col("source").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y")),
                F.struct(F.col("target").alias("id"), F.col("x2").alias("x"), F.col("y2").alias("y")),
            )
        ).alias("e")
    ).select("e.*")
    vertices = ends.groupBy("id").agg(
        F.min(F.struct("x", "y")).alias("p"), F.count("*").alias("degree")
    ).select("id", "p.x", "p.y", "degree")
    return vertices, out


def topology_report(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """TRN04: one row of counts."""
    n = vertices.agg(
        F.struct(F.count("*").alias("n"), F.count_if(F.col("degree") == 1).alias("dead")).alias("v")
    ).scalar()
    valid = F.col("source").isNotNull() & F.col("target").isNotNull()
    return (
        edges.agg(F.count_if(valid).alias("edge_count"), F.count("*").alias("total_edges"))
        .withColumn("_v", n)
        .select(F.col("_v.n").alias("vertex_count"), "edge_count", "total_edges", F.col("_v.dead").alias("dead_end_count"))
    )


def snap(parcels: DataFrame, vertices: DataFrame, cell: float) -> DataFrame:
    """TRN05: nearest vertex and its distance per parcel."""
    out = spatial.nearest(parcels.where("x IS NOT NULL"), vertices.withColumnRenamed("id", "node_id"), "parcel_id", "node_id", cell)
    return out.select("parcel_id", "node_id", F.col("distance").alias("distance_m"))


def shortest_costs(
    edges: DataFrame, origins: DataFrame, destinations: DataFrame | None = None, longest: float | None = None
) -> DataFrame:
    """TRN06: least cost (origin, node, distance) over undirected edges.

    Every round extends the places reached in the last round by one edge and keeps
    improvements; it ends when nothing improves.  Each round's state is written to
    the shared folder.  Parallel edges are reduced to the shortest first.
    ``longest`` bounds the distance where only near pairs are wanted.
    """
    one_way = edges.select("source", "target", "length")
    both = one_way.unionByName(
        one_way.select(F.col("target").alias("source"), F.col("source").alias("target"), "length")
    )
    steps = cut(both.where("source <> target").groupBy("source", "target").agg(F.min("length").alias("length")))
    nodes = origins.select(F.col("node").alias("origin")).distinct()
    best = cut(nodes.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("distance")))
    frontier = best
    while True:
        reached = (
            frontier.join(steps, F.col("node") == F.col("source"))
            .select("origin", F.col("target").alias("node"), (F.col("distance") + F.col("length")).alias("distance"))
        )
        if longest is not None:
            reached = reached.where(F.col("distance") <= longest)
        reached = reached.groupBy("origin", "node").agg(F.min("distance").alias("_new"))
        merged = cut(
            best.join(reached, ["origin", "node"], "full").select(
                "origin",
                "node",
                F.least("distance", "_new").alias("distance"),
                (F.col("distance").isNull() | (F.col("_new") < F.col("distance"))).alias("_better"),
            )
        )
        best = merged.select("origin", "node", "distance")
        frontier = merged.where("_better").select("origin", "node", "distance")
        if frontier.isEmpty():
            break
    if destinations is None:
        return best
    wanted = destinations.select("node").distinct()
    return best.join(wanted, "node", "left_semi").select("origin", "node", "distance")


def distance_matrix(costs: DataFrame, snapped: DataFrame) -> DataFrame:
    """TRN06: parcel pairs in kilometres; one parcel (the last id) stands for a node.

    ``costs``: origin, node, distance in metres; ``snapped``: parcel_id, node_id.
    """
    owner = snapped.groupBy("node_id").agg(F.max("parcel_id").alias("parcel_id"))
    o = owner.select(F.col("node_id").alias("origin"), F.col("parcel_id").alias("origin_parcel_id"))
    d = owner.select(F.col("node_id").alias("node"), F.col("parcel_id").alias("dest_parcel_id"))
    return costs.join(o, "origin").join(d, "node").select(
        "origin_parcel_id", "dest_parcel_id", (F.col("distance") / 1000.0).alias("network_distance_km")
    )
