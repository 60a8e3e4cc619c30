"""Directed multi-edge graphs: edges (source, target, relation, ...) in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ladders import FORWARDED, IN_DEGREE, RECOMMENDED, RELATIONS, SOURCES, ladder
from tidemark.sources.io import settle, spread


def degrees(edges: DataFrame) -> DataFrame:
    """GR3, JN8: in- and out-degree of every vertex, by one pass over the edges and one aggregation."""
    end = lambda name, i, o: F.struct(F.col(name).alias("vertex"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.inline(F.array(end("source", 0, 1), end("target", 1, 0))))
    return ends.groupBy("vertex").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def in_profile(edges: DataFrame, families: dict[str, list[str]] | None = None) -> DataFrame:
    """GR3: in-degree, distinct sources and relations of each target, and the edges of each family of relations.

    ``families`` names the relations (aliases too) of a family; ``importance`` looks for
    ``recommendation`` and ``forward``. Edges are counted by target, source and relation first,
    so that no distinct count expands them. A null relation is none of the kinds.
    """
    families = families or {"recommendation": ["recommendation"], "forward": ["forward"]}
    pairs = edges.groupBy("target", "source", "relation").agg(F.count("*").alias("n"))
    ends = pairs.groupBy("target", "source").agg(F.sum("n").alias("n"), F.collect_set("relation").alias("kinds"), *[F.sum(F.when(F.col("relation").isin(*names), F.col("n")).otherwise(0)).alias(f"{k}s") for k, names in families.items()])
    kinds = F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))).cast("long")
    return ends.groupBy("target").agg(F.sum("n").alias("in_degree"), F.count("source").alias("sources"), kinds.alias("relations"), *[F.sum(f"{k}s").alias(f"{k}s") for k in families])


def importance(profile: DataFrame) -> DataFrame:
    """SC33: points for in-degree, recommendations, forwards, relation kinds and distinct sources, at most 100."""
    parts = {"in_degree": IN_DEGREE, "recommendations": RECOMMENDED, "forwards": FORWARDED, "relations": RELATIONS, "sources": SOURCES}
    return profile.withColumn("importance", F.least(F.lit(100), sum((ladder(F.col(k), steps) for k, steps in parts.items()), F.lit(0))))


def neighbours(edges: DataFrame, vertex: Column | int, k: int) -> DataFrame:
    """GR2: a vertex's targets by occurrences, then recency."""
    return edges.filter(F.col("source") == vertex).orderBy(F.desc("occurrences"), F.desc("last_seen"), "target", "relation").limit(k)


def bounded_bfs(edges: DataFrame, seeds: DataFrame, depth: int, per_vertex: int | None = None, rows: int = 0) -> DataFrame:
    """GR5-GR7: (vertex, hop) reachable within ``depth`` hops, at most ``per_vertex`` children of each if given.

    One join and one anti-join a hop, each hop written out, so that no hop is computed again;
    nothing is collected. A vertex keeps its least hop. ``rows`` says how many edges there are at
    most, so that they are dealt to enough tasks.
    """
    # dealt by source, equal edges meet and children are ranked without another shuffle
    steps = spread(edges.select("source", "target"), rows, "source").distinct()
    if per_vertex is not None:
        steps = steps.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("target"))).filter(F.col("_r") <= per_vertex).drop("_r")
    steps = settle(steps, "steps")
    seen = frontier = seeds.select(F.col("vertex")).distinct().withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        reached = frontier.join(steps, frontier.vertex == steps.source).select(F.col("target").alias("vertex")).distinct()
        frontier = settle(reached.join(seen, "vertex", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.unionByName(frontier)
    return seen
