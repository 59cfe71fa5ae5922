"""Consolidating pairwise matches into groups (problem 3).

Links (rows that share a key) become star edges to the smallest row of the key, so
their number stays linear.  The giant component is peeled by frontier breadth-first
joins from the highest-degree vertex and anti-joined away; what remains is labelled
by minimum propagation with hooking and pointer jumping, in a number of rounds that
grows with the logarithm of the longest chain.  Round tables are written to the
shared checkpoint folder, nothing but counts and one vertex comes to the driver.

Defined results: null keys and null ids link nothing; repeated (id, key) rows count
once; a row without partners belongs to no group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.ids import arxiv_id, card_name, doi
from paperloom.skew import hot_values, split_join
from paperloom.storage import Scratch

#: A frontier of up to so many vertices (8 bytes each) is broadcast; a larger one is shuffled.
FRONTIER_ROWS = 500_000
#: Breadth-first rounds before the visited part is handed to minimum propagation.
BFS_ROUNDS = 40


def star_edges(keyed: DataFrame) -> DataFrame:
    """(u, v), u <> v: each row of ``keyed`` (id, key) linked with the smallest id of its key."""
    scratch = Scratch(keyed.sparkSession, "stars")
    keyed = scratch.save(keyed.where("id IS NOT NULL AND key IS NOT NULL").distinct())
    centres = keyed.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    hot = scratch.save(hot_values(keyed, "key", keyed.count()))
    hot = hot if hot.limit(1).count() else None
    return split_join(keyed, centres, "key", hot).where("id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")).distinct()


def connected(edges: DataFrame, bfs_rounds: int = BFS_ROUNDS) -> DataFrame:
    """(id, group_id) for every vertex of ``edges`` (u, v): group_id is the smallest vertex reachable."""
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    both = scratch.save(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()
    if not top:
        return both.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    hot = scratch.save(hot_values(both, "u", both.count()))
    hot = hot if hot.limit(1).count() else None

    # peel: the component of the highest-degree vertex, one frontier after another
    seen = scratch.save(spark.createDataFrame([(top[0]["u"],)], both.select("u").schema))
    frontier, n_frontier, closed = seen, 1, False
    tables = [seen]
    for _ in range(bfs_rounds):
        small = n_frontier <= FRONTIER_ROWS
        reached = both.join(F.broadcast(frontier), "u", "left_semi") if small else split_join(both, frontier, "u", hot)
        near = reached.select(F.col("v").alias("u")).distinct()
        # in an undirected graph a frontier only meets itself, its predecessor and new vertices
        for known in tables[-2:]:
            near = near.join(F.broadcast(known) if small else known, "u", "left_anti")
        frontier = scratch.save(near.coalesce(8) if small else near)
        n_frontier = frontier.count()
        if not n_frontier:
            closed = True
            break
        tables.append(frontier)
    seen = spark.read.schema(seen.schema).parquet(*[t._scratch_path for t in tables])
    low = seen.agg(F.min("u")).first()[0]
    giant = seen.select(F.col("u").alias("id"), F.lit(low).cast("bigint").alias("group_id"))
    if closed:
        rest = scratch.save(both.join(seen, "u", "left_anti"))
        start = rest.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "id")
        return giant.unionByName(_propagate(rest, start, scratch, hot))
    # a component of very long chains: what was visited starts with its common label
    start = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("own")).withColumnRenamed("u", "id")
    start = start.join(giant, "id", "left").select("id", F.least("own", "group_id").alias("label"))
    return _propagate(both, start, scratch, hot)


def _propagate(edges: DataFrame, start: DataFrame, scratch: Scratch, hot: DataFrame | None) -> DataFrame:
    """Minimum propagation to the fixpoint; labels are vertices of the same component throughout."""
    labels = scratch.save(start)
    vertices = labels.count()
    while True:
        # labels grow hot as components merge, so they are counted anew; at most HOT_PARTS of them and of ``hot``
        crowded = hot_values(labels, "label", vertices).withColumnRenamed("label", "u")
        crowded = scratch.save((crowded.union(hot) if hot is not None else crowded).distinct())
        busy = crowded if crowded.limit(1).count() else None
        ends = labels.select(F.col("id").alias("u"), F.col("label").alias("far"))
        low = split_join(edges, ends, "u", hot).groupBy("v").agg(F.min("far").alias("low")).withColumnRenamed("v", "id")
        met = labels.join(low, "id").select("id", "label", "low")
        # hooking: the old label's own row hears of the smaller one, too
        heard = met.select("id", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("moved"))
        hooks = met.where("low < label").select(F.col("label").alias("id"), F.col("low").alias("label"), F.lit(True).alias("moved"))
        merged = heard.unionByName(hooks).groupBy("id").agg(F.min("label").alias("label"), F.max("moved").alias("moved"))
        # pointer jumping: rows grouped by label are few labels with many rows, so the label side is looked up split
        roots = merged.select(F.col("id").alias("label"), F.col("label").alias("root"))
        step = split_join(merged, roots, "label", busy.withColumnRenamed("u", "label") if busy is not None else None).select("id", F.least("label", "root").alias("label"), (F.col("moved") | (F.col("root") < F.col("label"))).alias("moved"))
        fresh = scratch.save(step)
        scratch.drop(labels)
        if not fresh.where("moved").limit(1).count():
            return fresh.select("id", F.col("label").alias("group_id"))
        labels = fresh.select("id", "label")
        labels._scratch_path = fresh._scratch_path


def followup_links(followups: DataFrame) -> DataFrame:
    """(id, key): the DOIs and arXiv ids in either field of each row and its citing cards, one row per key."""
    fields = [F.col("doi"), F.col("arxivid")]
    named = [F.concat(F.lit(p), read(f)) for f in fields for p, read in (("d:", doi), ("a:", arxiv_id))]
    cards = F.transform(F.coalesce("citedby", F.array()), lambda c: F.concat(F.lit("c:"), card_name(c)))
    keys = F.array_compact(F.concat(F.array(*named), cards))
    return followups.select(F.col("followup_id").alias("id"), F.explode(F.array_distinct(keys)).alias("key"))


def groups(keyed: DataFrame, bfs_rounds: int = BFS_ROUNDS) -> DataFrame:
    """(group_id, id) of every row of ``keyed`` (id, key) that is linked with another one."""
    return connected(star_edges(keyed), bfs_rounds).select("group_id", "id")
