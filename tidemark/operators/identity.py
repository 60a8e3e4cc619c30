"""GR8, GR9: vertices that go by several names, and edges between platforms.

Found rows name a vertex by a canonical id, by name and platform, or both. Rows that share
either are one vertex, and so are rows that a chain of such rows joins. Components are found by
joining smallest neighbours (large-star and small-star steps): a hub's names are never gathered,
and the rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.io import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that links lead to. Null ends are left out; loops keep their node."""
    both = edges.select("a", "b").dropna()
    nodes = settle(both.select(F.col("a").alias("node")).unionAll(both.select("b")).distinct(), "nodes")
    links = settle(both.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not links.isEmpty():
        # large star: larger neighbours hang on the smallest of a node and its neighbours
        turned = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = turned.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = turned.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = settle(small, "links")
        changed = not now.exceptAll(links).isEmpty() or not links.exceptAll(now).isEmpty()
        links = now
        if not changed:
            break
    found = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _names(found: DataFrame, canonical: str, name: str, platform: str) -> DataFrame:
    """``found`` with its two names as text, each null where it is not given."""
    own = F.concat(F.lit("n:"), F.lower(platform), F.lit(":"), F.lower(F.trim(name)))
    return found.withColumns({
        "by_id": F.when(F.trim(canonical) != "", F.concat(F.lit("c:"), F.trim(canonical))), "by_name": F.when((F.trim(name) != "") & (F.trim(platform) != ""), own),
    })


def resolve(found: DataFrame, row: str, canonical: str, name: str, platform: str, seen: str) -> DataFrame:
    """GR8: (vertex, canonical, name, platform, n_rows, first_seen) of all found rows.

    ``vertex`` is the least of the vertex's names. Of its ids, names and platforms, those of the
    earliest row that has one stay (by ``seen``, then ``row``). Rows without either name are left
    out; case and outer blanks of names and platforms do not count, those of ids do.
    """
    rows = settle(_names(found, canonical, name, platform).filter("by_id is not null or by_name is not null"), "named")
    linked = components(rows.select(F.coalesce("by_id", "by_name").alias("a"), F.coalesce("by_name", "by_id").alias("b")))
    at = F.struct(seen, row)
    first = lambda x, ok: F.min_by(F.trim(x), F.when(ok, at))
    joined = rows.withColumn("node", F.coalesce("by_id", "by_name")).join(linked, "node")
    return joined.groupBy(F.col("component").alias("vertex")).agg(
        first(canonical, F.col("by_id").isNotNull()).alias("canonical"), first(name, F.col("by_name").isNotNull()).alias("name"), first(platform, F.col("by_name").isNotNull()).alias("platform"),
        F.count("*").alias("n_rows"), F.min(seen).alias("first_seen"),
    )


def cross_edges(found: DataFrame, links: DataFrame, row: str, canonical: str, name: str, platform: str, source: str, target: str, ts: str, confidence: str) -> DataFrame:
    """GR9: (source, target, source_platform, target_platform, cross, occurrences, confidence, last_seen) of links between found rows.

    ``links`` names rows of ``found`` (by ``row``) as source and target; both become their
    vertices, so links of one pair under different names are one edge. Confidence is that of the
    first link and 5 for each further one, 100 at most. Links whose rows have no name, and those
    within one vertex, are left out. A platform is the vertex's; ``cross`` says that both differ.
    """
    rows = settle(_names(found, canonical, name, platform).filter("by_id is not null or by_name is not null"), "named")
    linked = components(rows.select(F.coalesce("by_id", "by_name").alias("a"), F.coalesce("by_name", "by_id").alias("b")))
    member = settle(rows.withColumn("node", F.coalesce("by_id", "by_name")).join(linked, "node").select(F.col(row).alias("row_"), F.col("component").alias("vertex"), F.lower(F.trim(platform)).alias("platform"), F.col("by_name").isNotNull().alias("own")), "members")
    # a vertex's platform is that of its first row with a name
    shown = member.groupBy("vertex").agg(F.min_by("platform", F.when(F.col("own"), F.col("row_"))).alias("platform"))
    side = lambda n: member.select(F.col("row_").alias(n), F.col("vertex").alias(f"{n}_vertex"))
    ends = links.join(side(source), source).join(side(target), target).filter(F.col(f"{source}_vertex") != F.col(f"{target}_vertex"))
    edges = ends.groupBy(F.col(f"{source}_vertex").alias("s_"), F.col(f"{target}_vertex").alias("t_")).agg(
        F.count("*").alias("occurrences"), F.min_by(confidence, F.struct(ts, source, target)).alias("first_"), F.max(ts).alias("last_seen"))
    edges = edges.join(shown.select(F.col("vertex").alias("s_"), F.col("platform").alias("source_platform")), "s_").join(shown.select(F.col("vertex").alias("t_"), F.col("platform").alias("target_platform")), "t_")
    return edges.select(
        F.col("s_").alias("source"), F.col("t_").alias("target"), "source_platform", "target_platform", F.coalesce(F.col("source_platform") != F.col("target_platform"), F.lit(False)).alias("cross"),
        "occurrences", F.least(F.lit(100), F.col("first_") + 5 * (F.col("occurrences") - 1)).cast("long").alias("confidence"), "last_seen",
    )
