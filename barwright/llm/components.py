"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edges, settled in the shared folder; a node with very many
edges sits on one side of a join that Spark can split. Nothing but two totals a round reaches the driver.
"""

from pyspark.sql import functions as F

from barwright.llm.common import settle


def _mark(edges):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(edges, most_rounds=100, tasks=None):
    """(node, component) for all nodes of edges (a long, b long): component is the smallest node reachable.

    Loops and repeated edges do no harm; rows with a null end are no edges. No edges: no rows. ``tasks``, where given, is how many
    tasks the edges are held in within and between rounds.
    """
    few = (lambda df: df) if tasks is None else lambda df: df.coalesce(tasks)
    held = lambda df: settle(few(df))
    e = held(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = few(few(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = few(large.join(least, F.col("a") == F.col("u")))
        e = held(small.select("b", "m").where("b <> m").unionByName(small.select(F.col("u").alias("b"), "m"))
                   .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        last, mark = mark, _mark(e)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return held(leaves.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
