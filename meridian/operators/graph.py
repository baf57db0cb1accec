"""Graph views and traversals over edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_view(edges: DataFrame, names: DataFrame, least: float | None = None) -> DataFrame:
    """(subject, predicate, object) by name, distinct: nodes of one name are one node. ``least``:
    only edges of strictly larger confidence."""
    kept = edges if least is None else edges.where(F.col("confidence") > least)
    side = lambda key, name: names.select(F.col("entity_id").alias(key), F.col("name").alias(name))
    return kept.join(side("a", "subject"), "a").join(side("b", "object"), "b").select("subject", F.col("type").alias("predicate"), "object").distinct()


def one_hop(edges: DataFrame, names: DataFrame, subject: str, predicate: str) -> DataFrame:
    """(subject, object): where edges of one type lead from the entities of one name, distinct."""
    start = names.where(F.col("name") == subject).select(F.col("entity_id").alias("a"), F.col("name").alias("subject"))
    end = names.select(F.col("entity_id").alias("b"), F.col("name").alias("object"))
    return edges.where(F.col("type") == predicate).join(start, "a").join(end, "b").select("subject", "object").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both orientations as (edge_id, src, dst, type): an OR join becomes an equi-join."""
    out = edges.select("edge_id", F.col("a").alias("src"), F.col("b").alias("dst"), "type")
    back = edges.where("a <> b").select("edge_id", F.col("b").alias("src"), F.col("a").alias("dst"), "type")
    return out.unionByName(back)


def shared_dir(spark) -> str:
    """This application's folder below ``spark.checkpoint.dir``. On a single machine the setting may
    be missing; on a cluster its nodes need a folder that they share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/meridian-{spark.sparkContext.applicationId}"


def _cut(df: DataFrame) -> DataFrame:
    """Ends lineage in the shared checkpoint folder."""
    path = f"{shared_dir(df.sparkSession)}/core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trails(edges: DataFrame, roots: DataFrame, hops: int, labels: list[str] | None = None, cut_every: int = 2) -> DataFrame:
    """Undirected trails of 1..hops edges from ``roots`` (root): (root, connected, first_type,
    length), one row a trail without a repeated edge. ``labels``: only edges of these types."""
    both = symmetric(edges if labels is None else edges.where(F.col("type").isin(labels)))
    step = both.select(F.col("src").alias("at"), F.col("dst").alias("to"), "edge_id", "type")
    front = roots.select(F.col("root"), F.col("root").alias("at"), F.lit(None).cast("string").alias("first_type"), F.array().cast("array<long>").alias("path"))
    found = None
    for k in range(1, hops + 1):
        nxt = front.join(step, "at").where(~F.array_contains("path", F.col("edge_id")))
        front = nxt.select("root", F.col("to").alias("at"), F.coalesce("first_type", "type").alias("first_type"), F.concat("path", F.array("edge_id")).alias("path"))
        front = _cut(front) if k % cut_every == 0 and k < hops else front
        rows = front.select("root", F.col("at").alias("connected"), "first_type", F.lit(k).alias("length"))
        found = rows if found is None else found.unionByName(rows)
    return found


def trail_counts(edges: DataFrame, roots: DataFrame, hops: int, labels: list[str] | None = None) -> DataFrame:
    """(root, connected, length, n): how many rows ``trails`` has of each kind. The last hop is
    counted and not listed: all ways on from a node, less those over an edge of the trail itself."""
    kept = edges if labels is None else edges.where(F.col("type").isin(labels))
    step = symmetric(kept).select(F.col("src").alias("at"), F.col("dst").alias("connected"), "edge_id")
    front = roots.select("root", F.col("root").alias("at"), F.array().cast("array<long>").alias("path"))
    ways = step.groupBy("at", "connected").agg(F.count("*").alias("w"))
    found = None
    for k in range(1, hops + 1):
        every = front.groupBy("root", "at").agg(F.count("*").alias("c")).join(ways, "at").select("root", "connected", (F.col("c") * F.col("w")).alias("n"))
        again = front.select("root", "at", F.explode("path").alias("edge_id")).join(step, ["at", "edge_id"]).select("root", "connected", F.lit(-1).cast("long").alias("n"))
        rows = every.unionByName(again).groupBy("root", "connected").agg(F.sum("n").alias("n")).where("n > 0").select("root", "connected", F.lit(k).alias("length"), "n")
        found = rows if found is None else found.unionByName(rows)
        if k < hops:
            nxt = front.join(step, "at").where(~F.array_contains("path", F.col("edge_id")))
            front = _cut(nxt.select("root", F.col("connected").alias("at"), F.concat("path", F.array("edge_id")).alias("path")))
    return found


def reach(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, node, distance): nodes within ``hops``, each at its least distance. Grows with the
    nodes reached, not with the ways to them."""
    step = symmetric(edges).select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance"))
    front = seen
    for k in range(1, hops + 1):
        new = front.join(step, "node").select("root", F.col("to").alias("node")).distinct()
        front = _cut(new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def expansion(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """Distinct (edge_id, a, b, type, hop) met by relational expansion: a frontier edge meets every
    edge that shares an end, unless both of that edge's ends are on the path already."""
    e = edges.select("edge_id", "a", "b", "type")
    ends = e.withColumn("end", F.explode(F.array_distinct(F.array("a", "b"))))
    start = ends.join(roots.select(F.col("root").alias("end")), "end", "left_semi")
    front = start.select("edge_id", "a", "b", "type", F.array("a", "b").alias("path")).distinct()
    found = front.select("edge_id", "a", "b", "type", F.lit(1).alias("hop"))
    for k in range(2, hops + 1):
        last = front.select("path", F.explode(F.array_distinct(F.array("a", "b"))).alias("end")).distinct()
        met = last.join(ends, "end").where(~(F.array_contains("path", F.col("a")) & F.array_contains("path", F.col("b"))))
        front = _cut(met.select("edge_id", "a", "b", "type", F.concat("path", F.array("a", "b")).alias("path")).distinct())
        found = found.unionByName(front.select("edge_id", "a", "b", "type", F.lit(k).alias("hop")))
    return found.distinct()


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) counting each touching edge once."""
    return edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def smallest_label(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(i, g): for each of ``nodes`` (i) the smallest node that ``links`` (i, j, both directions)
    reach. Each round takes the smallest label of a node's neighbours and that label's own label, so
    the rounds grow with the logarithm of a component's length; each is written once. Raises if
    ``rounds`` do not suffice."""
    links = _cut(links.where("i <> j").distinct())
    label = _cut(nodes.select("i", F.col("i").alias("g")))
    for _ in range(rounds):
        low = links.join(label.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.min("g").alias("m"))
        hop = low.join(label.select(F.col("i").alias("m"), F.col("g").alias("mg")), "m", "left")
        now = _cut(label.join(hop, "i", "left").select("i", F.least("g", "m", "mg").alias("g"), (F.least("m", "mg") < F.col("g")).alias("moved")))
        label = now.select("i", "g")
        if now.where("moved").isEmpty():
            return label
    raise RuntimeError(f"labels did not settle in {rounds} rounds")
