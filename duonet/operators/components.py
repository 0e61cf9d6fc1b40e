"""Connected components as DataFrame joins: alternating large-star and small-star rounds (Kiveris et al. 2014), so long chains
take few rounds.

Edges are a DataFrame (a, b) of any orderable type. Each round is two grouped minima and joins; only counts reach the
driver. Lineage is cut at a checkpoint each round.

No task gathers the edges of a hub: nodes with more than ``max(LEAST_HOT, edges / MOST_HOT)`` edges meet their minimum by a
broadcast, so their edges stay where they are. An edge has two ends, so there are at most ``2 * MOST_HOT`` such nodes at any
size; the others' edges are joined by a shuffle, and none of their groups is larger than that share. Rounds end when
every node hangs on its root alone, which edges that are stars already do at once, and a run that does not get there raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duonet.operators.lineage import cut

MAX_ROUNDS = 60
#: Hubs are nodes with more edges than LEAST_HOT and than this fraction of all edges, 1 / MOST_HOT.
LEAST_HOT, MOST_HOT = 64, 50_000
#: Edges in a partition: small edge tables stay in few partitions, large ones keep all of Spark's.
EDGES_EACH, LEAST_WIDTH = 100_000, 16


def _with_least(edges: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """edges (a, b) with m of their a. least: a, m and its number of edges n, one row a node."""
    hubs = F.broadcast(least.where(F.col("n") > hot).select("a", "m"))  # at most 2 * MOST_HOT rows
    by_hub = edges.join(hubs, "a", "left").withColumnRenamed("m", "hub_m")
    rest = by_hub.where("hub_m is null").select("a", "b").join(least.where(F.col("n") <= hot).select("a", "m"), "a")
    return by_hub.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")).unionByName(rest)


def _star(edges: DataFrame, large: bool, width: int, hot: int) -> DataFrame:
    """edges: (a, b) with a > b. Large star: neighbours above a node hang on its least neighbour; small star: those below."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n").coalesce(width)
        out = _with_least(both.where(F.col("b") > F.col("a")), least, hot).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).coalesce(width)
        out = _with_least(edges, least, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).coalesce(width).distinct().coalesce(width)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component; only nodes with an edge to another node appear."""
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(ordered.distinct())
    n = edges.count()
    width, hot = max(LEAST_WIDTH, 1 + n // EDGES_EACH), max(LEAST_HOT, n // MOST_HOT)
    for _ in range(MAX_ROUNDS):
        if not _unsettled(edges):
            break
        for large in (True, False):  # cut between the two, since each reads its edges several times
            edges = cut(_star(edges.coalesce(width), large, width, hot))
    else:
        raise RuntimeError(f"the components are not settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _unsettled(edges: DataFrame) -> int:
    """Nodes that hang on several others, or on one and have others hanging on them: with none, the edges are the answer."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    held = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]
