"""Communities of the weighted thread graph by seeded modularity moves on edge and community tables.

In a step every node looks at the communities of its neighbours and wishes for the one that raises modularity
most. By a seeded draw half of the communities give nodes and half receive them, so that wishes don't undo each
other, and the wishes between these are granted at once, and one other always. A step that doesn't raise a source's
modularity is taken back there and fewer wishes are granted in the next, down to one, whose gain is exact; after
a good step it is more again. When nobody wishes to move, communities become the nodes
of a smaller graph, until nothing merges. Modularity only ever rises, and no source is one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut_lineage

#: Gains and qualities that differ by less are equal.
LEAST_GAIN = 1e-9
#: At least one wish in so many is granted.
MOST = 1 << 40
#: Steps of one level, after which it is left as it is.
MAX_STEPS = 200


def _graph(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, links): nodes as communities of their own, with degree and their source's total weight.

    ``links`` has (source, u, v, w) in both directions; a loop's weight counts twice.
    """
    links = cut_lineage(links.groupBy("source", "u", "v").agg(F.sum("w").alias("w")))
    degrees = links.groupBy("source", F.col("u").alias("node")).agg(F.sum("w").alias("degree"))
    totals = links.groupBy("source").agg(F.sum("w").alias("total")).where("total > 0")
    state = nodes.join(degrees, ["source", "node"]).join(totals, "source")
    return cut_lineage(state.withColumn("comm", F.col("node"))), links


def wishes(state: DataFrame, links: DataFrame) -> DataFrame:
    """(source, node, comm, best) of the nodes that another community suits better; ties go to the smaller number."""
    of = state.select("source", F.col("node").alias("v"), F.col("comm").alias("near"))
    near = links.where("u <> v").join(of, ["source", "v"]).select("source", F.col("u").alias("node"), "near", F.col("w").alias("link"))
    own = state.select("source", "node", F.col("comm").alias("near"), F.lit(0.0).alias("link"))
    offers = near.unionByName(own).groupBy("source", "node", "near").agg(F.sum("link").alias("link"))
    sizes = state.groupBy("source", F.col("comm").alias("near")).agg(F.sum("degree").alias("size"))
    offers = offers.join(state, ["source", "node"]).join(sizes, ["source", "near"])
    stays = F.col("near") == F.col("comm")
    others = F.col("size") - F.when(stays, F.col("degree")).otherwise(0.0)
    offers = offers.withColumn("gain", F.round(F.col("link") - others * F.col("degree") / F.col("total"), 9))
    best = offers.groupBy("source", "node", "comm").agg(F.max_by("near", F.struct("gain", stays, -F.col("near"))).alias("best"), F.max("gain").alias("most"), F.max(F.when(stays, F.col("gain"))).alias("now"))
    return best.where(F.col("most") > F.col("now") + LEAST_GAIN).select("source", "node", "comm", "best")


def quality(state: DataFrame, links: DataFrame, comm: str = "comm") -> DataFrame:
    """(source, quality): modularity of the communities in column ``comm``."""
    of = lambda end: state.select("source", F.col("node").alias(end), F.col(comm).alias(f"c{end}"))
    inside = links.join(of("u"), ["source", "u"]).join(of("v"), ["source", "v"]).where("cu = cv").groupBy("source").agg(F.sum("w").alias("inside"))
    sizes = state.groupBy("source", "total", comm).agg(F.sum("degree").alias("size"))
    spread = sizes.groupBy("source", "total").agg(F.sum(F.col("size") * F.col("size")).alias("squares"))
    share: Column = F.coalesce("inside", F.lit(0.0)) / F.col("total") - F.col("squares") / (F.col("total") * F.col("total"))
    return spread.join(inside, "source", "left").select("source", share.alias("quality"))


def _settled(state: DataFrame, links: DataFrame, seed: int) -> DataFrame:
    """The state in which no node wishes to move.

    A source in which none wishes to won't change any more: it waits outside, and when half of the sources do,
    the tables of the others are written anew. So a step costs what the unsettled sources hold.
    """
    done, held = [], None
    pace = quality(state, links).withColumn("share", F.lit(1).cast("long"))
    for step in range(MAX_STEPS):
        drawn = lambda c: F.xxhash64(c, F.lit(seed), F.lit(step))  # noqa: E731, B023
        wanted = cut_lineage(wishes(state, links).withColumn("turn", drawn("node")))
        if wanted.isEmpty():
            break
        first = cut_lineage(wanted.groupBy("source").agg(F.min("turn").alias("first")))
        moving, held = first.count(), held or state.select("source").distinct().count()
        if 2 * moving <= held:
            done.append(cut_lineage(state.join(first, "source", "left_anti")))
            state, links, pace = (cut_lineage(df.join(first.select("source"), "source", "left_semi")) for df in (state, links, pace))
            held = moving
        # Half of the communities give and half receive, so no two nodes change places.
        gives = (F.pmod(drawn("comm"), F.lit(2)) == 0) & (F.pmod(drawn("best"), F.lit(2)) == 1) & (F.pmod("turn", "share") == 0)
        granted = wanted.join(first, "source").join(pace.select("source", "share"), "source").where((F.col("turn") == F.col("first")) | gives)
        tried = cut_lineage(state.join(granted.select("source", "node", "best"), ["source", "node"], "left").withColumn("next", F.coalesce("best", "comm")).drop("best"))
        found = quality(tried, links, "next").withColumnRenamed("quality", "reached")
        better = F.coalesce(F.col("reached") > F.col("quality") + LEAST_GAIN / 1000, F.lit(False))
        share = F.when(better, F.greatest(F.lit(1), F.col("share") / 2)).otherwise(F.least(F.lit(MOST), F.col("share") * 4))
        judged = cut_lineage(pace.join(found, "source").select("source", better.alias("better"), F.when(better, F.col("reached")).otherwise(F.col("quality")).alias("quality"), share.cast("long").alias("share")))
        state = tried.join(judged.select("source", "better"), "source").withColumn("comm", F.when(F.col("better"), F.col("next")).otherwise(F.col("comm"))).drop("next", "better")
        pace = judged.drop("better")
    return cut_lineage(reduce(DataFrame.unionByName, done, state))


def thread_communities(members: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """(source, id, community): communities within each source, named by their smallest member.

    ``edges`` has (source, id, target, weight); parallel edges add up, and a node without edges is a community
    of its own. Equal seeds give equal results, however the rows are dealt.
    """
    nodes = members.select("source", F.col("id").alias("node")).distinct()
    one = edges.select("source", F.col("id").alias("u"), F.col("target").alias("v"), F.col("weight").cast("double").alias("w"))
    links = one.unionByName(one.select("source", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    placed = cut_lineage(nodes.withColumn("comm", F.col("node")))
    while True:
        state, links = _graph(nodes, links)
        settled = _settled(state, links, seed)
        moved = settled.select("source", "node", F.col("comm").alias("to"))
        if moved.where("node <> to").isEmpty():
            break
        placed = cut_lineage(placed.join(moved.withColumnRenamed("node", "comm"), ["source", "comm"], "left").select("source", "node", F.coalesce("to", "comm").alias("comm")))
        of = lambda end: moved.select("source", F.col("node").alias(end), F.col("to").alias(f"_{end}"))  # noqa: E731, B023
        links = links.join(of("u"), ["source", "u"]).join(of("v"), ["source", "v"]).select("source", F.col("_u").alias("u"), F.col("_v").alias("v"), "w")
        nodes = moved.select("source", F.col("to").alias("node")).distinct()
    least = placed.groupBy("source", "comm").agg(F.min("node").alias("community"))
    return placed.join(least, ["source", "comm"]).select("source", F.col("node").alias("id"), "community")
