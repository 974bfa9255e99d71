"""From buckets of candidates to groups, without all pairs of a bucket.

Only which nodes hang together is wanted, so pairs inside a group that is known already need no look.
First each bucket's members are compared with one member of it, in later rounds with one of the
bucket's largest group; a bucket of two is settled by that. Then whatever still lies in one bucket but
in different groups is compared by keys of which a linked pair must share one, which is the exact way
for what the stars missed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import written
from phenogrid.llm.components import connected_components


def cross_pairs(keyed: DataFrame, may, also=None, blocks=None) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a key but not a component.

    keyed: (key, node, n, component, ...). The largest component of a key is only paired with the
    others, so that one that holds most rows of a key isn't paired with itself. also is
    a further condition on the columns of both sides, named with the suffixes _x and _y. blocks says
    in how many parts a key's rows are dealt, each of which meets all of them in a task of its own.
    """
    size = keyed.groupBy("key", "component").count()
    largest = size.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    tagged = keyed.join(largest, "key")
    named = lambda df, s: df.select("key", *[F.col(c).alias(c + s) for c in df.columns if c != "key"])
    few, every = named(tagged.where("component <> largest"), "_x"), named(tagged, "_y")
    condition = (F.col("component_x") != F.col("component_y")) & may(F.col("n_x"), F.col("n_y"))
    on = ["key"]
    if blocks is not None:
        parts = tagged.select("key", blocks.alias("blocks")).distinct()
        few = few.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("node_x"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
        every = every.join(parts, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        on = ["key", "block"]
        # As a number that is said: few rows make many pairs, and would be put into one task.
        n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        few, every = few.repartition(n, *on), every.repartition(n, *on)
    both = few.join(every, on).where(condition if also is None else condition & also)
    return both.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame], may, star_rounds: int = 1, tag: str = "link") -> DataFrame:
    """(node, component) for the nodes with a verified link.

    members: (bucket, node, n, copies), the buckets with at least two members; a bucket is compared with the
    node of most copies, around which others tend to lie; verify keeps the true links of
    distinct pairs (a, b), a < b; may(n, other n) is an exact bound that rules pairs out, n a number or
    a struct; rest gives the pairs to compare in the end of (bucket, node, n, copies, component), the buckets
    of three members or more that lie in several components.
    """
    links = groups = done = None

    def labelled() -> DataFrame:
        if groups is None:
            return members.withColumn("component", F.col("node"))
        return members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))

    for turn in range(star_rounds + 1):
        now = labelled()
        ends = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")]
        if turn in (0, star_rounds):
            star = F.min_by(F.struct("node", "n", "component"), F.struct(-F.col("copies"), F.xxhash64("node"), "node")).alias("rep")
            mixed = now.groupBy("bucket").agg(*ends, star).where("lo <> hi")
        else:
            drawn = F.min_by(F.struct("node", "n", "component"), F.struct(F.xxhash64("node", "bucket", F.lit(turn)), "node")).alias("drawn")
            parts = now.groupBy("bucket", "component").agg(F.count("*").alias("size"), drawn)
            mixed = parts.groupBy("bucket").agg(*ends[:2], F.sum("size").alias("c"), F.max_by("drawn", F.struct("size", "component")).alias("rep")).where("lo <> hi")
        if turn:
            mixed = mixed.where("c > 2")
        if turn < star_rounds:
            joined = now.join(mixed.select("bucket", "rep"), "bucket").where((F.col("component") != F.col("rep.component")) & may(F.col("n"), F.col("rep.n")))
            pairs = joined.select(F.least("node", "rep.node").alias("a"), F.greatest("node", "rep.node").alias("b")).distinct()
        else:
            pairs = rest(now.join(mixed.select("bucket"), "bucket", "left_semi"))
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, f"{tag}-pairs")
        if pairs.isEmpty():
            continue
        found = written(verify(pairs), f"{tag}-links")
        done = pairs if done is None else done.unionByName(pairs)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            groups = written(connected_components(links, f"{tag}-components"), f"{tag}-groups")
    if groups is None:
        return members.sparkSession.createDataFrame([], "node long, component long")
    return groups
