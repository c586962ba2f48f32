"""Queries over entity and relation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .graph_build import Graph

#: Colours by type, and for types without one.
NODE_COLORS = {"FILE": "#f7c59f", "FUNCTION": "#f6f930", "VARIABLE": "#84dcc6", "STRUCT": "#e07a5f", "FIELD": "#57a773", "TYPEDEF": "#6a4c93"}
EDGE_COLORS = {"CONTAINS": "gray", "CALLS": "blue", "REFERENCES": "green", "HAS_MEMBER": "#ffb347", "HAS_PARAMETER": "#00bcd4", "HAS_VARIABLE": "#90caf9", "ASSIGNED_TO": "#ff1744", "RETURNS": "#9575cd", "TYPE_OF": "#00897b"}
OTHER_NODE, OTHER_EDGE = "#cccccc", "black"


def collapse_parallel(edges: DataFrame, order: str) -> DataFrame:
    """One edge per (head, tail); of parallel ones the last in ``order`` gives the type."""
    return edges.groupBy("head", "tail").agg(F.max_by("type", order).alias("type"))


def label(name: Column, type_: Column) -> Column:
    return F.concat(name, F.lit("\n("), type_, F.lit(")"))


def style(type_: Column, colors: dict[str, str], other: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in colors.items() for x in pair])
    return F.coalesce(F.try_element_at(table, type_), F.lit(other))


def distinct_tails(edges: DataFrame, head, type_: str) -> DataFrame:
    return edges.where((F.col("head") == head) & (F.col("type") == type_)).select("tail").distinct()


def neighbors(edges: DataFrame, node, type_: str | None = None, direction: str = "out") -> DataFrame:
    """Distinct nodes next to one: along its edges (out), against them (in) or both."""
    e = edges if type_ is None else edges.where(F.col("type") == type_)
    out = e.where(F.col("head") == node).select(F.col("tail").alias("node"))
    into = e.where(F.col("tail") == node).select(F.col("head").alias("node"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


def histogram(relations: DataFrame) -> DataFrame:
    return relations.groupBy("type").agg(F.count("*").alias("n"))


def k_hop(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, node, hops): the least number of steps, up to ``depth``, from each of the sources (column source).

    A frontier join per step keeps only pairs not reached before, so cycles end; every step's pairs are a table of their
    own, and no step follows one that reached nothing.
    """
    e = kept(edges.select(F.col("head").alias("at"), F.col("tail").alias("next")).distinct(), "steps")
    seen = sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops"))
    frontier = seen
    for step in range(1, depth + 1):
        reached = frontier.join(e, F.col("node") == F.col("at")).select("source", F.col("next").alias("node")).distinct()
        frontier = reached.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(step))
        frontier = kept(frontier, "hops")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, path array) of all simple paths of 1 to ``depth`` steps from each of the sources."""
    e = kept(edges.select(F.col("head").alias("at"), F.col("tail").alias("next")).distinct(), "steps")
    now = sources.select("source", F.array("source").alias("path"))
    out = None
    for _ in range(depth):
        now = now.join(e, F.element_at("path", -1) == F.col("at")).where(~F.array_contains("path", F.col("next"))).select("source", F.concat("path", F.array("next")).alias("path"))
        now = kept(now, "paths")  # each step is found once and read by the next one and the result
        out = now if out is None else out.unionByName(now)
    return out


def degree(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree)."""
    ends = edges.select(F.col("head").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("tail").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def dangling(edges: DataFrame, entities: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with an end that is no entity."""
    ids = entities.select(F.col(id_col)).distinct()
    known = lambda end: ids.select(F.col(id_col).alias(f"__{end}"))
    ends = edges.join(known("head"), F.col("head") == F.col("__head"), "left").join(known("tail"), F.col("tail") == F.col("__tail"), "left")
    return ends.where("__head is null or __tail is null").drop("__head", "__tail")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges (head, tail, type) with change = added or removed."""
    columns = ["head", "tail", "type"]
    a, b = before.select(*columns).distinct(), after.select(*columns).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def diff_histogram(before: Graph, after: Graph) -> DataFrame:
    """(type, change, n): what diff() of the graphs' edges has, counted by type.

    Files' products stay factors: distinct ones have as many edges as their files times their tails, and only the edges of
    both graphs that are stated are looked up in them.
    """
    e = None
    for at, g in (("a", before), ("b", after)):
        rows = g.stated_edges().select("head", "tail", "type")
        if g.everywhere is not None:
            rows = rows.union(g.edges_everywhere().where("head is not null").select("head", "tail", "type"))
        rows = rows.select("head", "tail", "type", *[F.lit(x == at).alias(x) for x in ("a", "b")])
        e = rows if e is None else e.unionByName(rows)
    e = e.groupBy("head", "tail", "type").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    factors = {}
    for at, g in (("a", before), ("b", after)):
        if g.everywhere is None:
            e = e.withColumn(f"in_{at}", F.lit(False))
            continue
        heads, tails = g.files.select(F.col("gid").alias("head")).distinct(), g.edges_everywhere().where("head is null").select("type", "tail").distinct()
        factors[at] = (heads, tails)
        e = e.join(heads.withColumn("__head", F.lit(True)), "head", "left").join(tails.withColumn("__tail", F.lit(True)), ["type", "tail"], "left")
        e = e.withColumn(f"in_{at}", F.col("__head").isNotNull() & F.col("__tail").isNotNull()).drop("__head", "__tail")
    parts = []
    for change, x, y in (("removed", "a", "b"), ("added", "b", "a")):
        # stated by x alone, and stated by y in what only x has as a product
        gone = F.col(x) & ~F.col(f"in_{x}") & ~F.col(y) & ~F.col(f"in_{y}")
        common = F.col(f"in_{x}") & F.col(y) & ~F.col(f"in_{y}")
        parts.append(e.select("type", F.lit(change).alias("change"), (gone.cast("long") - common.cast("long")).alias("n")))
        if x in factors:
            product = lambda heads, tails, sign: tails.groupBy("type").agg(F.count("*").alias("m")).crossJoin(heads.agg(F.count("*").alias("files"))).select("type", F.lit(change).alias("change"), (sign * F.col("m") * F.col("files")).alias("n"))  # noqa: B023, E731
            parts.append(product(*factors[x], 1))
            if y in factors:
                parts.append(product(factors[x][0].intersect(factors[y][0]), factors[x][1].intersect(factors[y][1]), -1))
    return reduce(DataFrame.unionByName, parts).groupBy("type", "change").agg(F.sum("n").alias("n")).where("n > 0")


def styled(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables with labels and colours, for drawing."""
    nodes = entities.select("id", label(F.col("name"), F.col("type")).alias("label"), style(F.col("type"), NODE_COLORS, OTHER_NODE).alias("color"))
    return nodes, edges.select("head", "tail", "type", style(F.col("type"), EDGE_COLORS, OTHER_EDGE).alias("color"))
