"""Numbers, running sums and joins in which no key is ever one task.

Rows are dealt to range partitions by key and order, so a key with a third of all rows fills many of them. What
depends on earlier partitions is one row a partition, or one row a chunk of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.session import cut_lineage

#: A key with more than one in HOT of all rows is hot, so fewer than HOT keys are.
HOT = 1000
#: Rows of a key that are summed together before their sums are.
CHUNK = 4096
#: So many links of one parent are no burden to a task.
FEW = 100_000
_EARLIER = (Window.unboundedPreceding, -1)


def ranged(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows in range partitions sorted by ``order``, checkpointed, with ``_part`` and ``_at``: the
    number of the partition and the place inside it."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()))
    # The function's value is the partition's number times 2^33 and the place.
    return placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))


def global_number(rows: DataFrame, order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Number all rows from 0 by ``order``: places inside range partitions and the partitions' offsets."""
    dealt = ranged(rows, order)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row a partition, in the window and in the broadcast.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*_EARLIER)), F.lit(0)).alias("_off"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_off") + F.col("_at")).cast("bigint")).drop("_part", "_off", "_at")


def number_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Number the rows of each key from 1 by ``order``. Only the first key of a range partition can have
    begun in an earlier one; those offsets are broadcast, one row a partition."""
    key = F.struct(*keys)
    dealt = ranged(rows, [*keys, *order]).withColumn("_key", key)
    inside = Window.partitionBy("_part", "_key").orderBy("_at")
    counts = dealt.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(*_EARLIER))
    offsets = F.broadcast(counts.withColumn("_before", before).where("_before > 0").select("_key", "_part", "_before"))
    numbered = dealt.withColumn(name, F.row_number().over(inside)).join(offsets, ["_part", "_key"], "left")
    return numbered.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_part", "_at", "_key", "_before")


def running_sum(rows: DataFrame, keys: Sequence[str], place: str, value: str, name: str = "upto", chunk: int = CHUNK) -> DataFrame:
    """With ``name``: the sum of ``value`` up to each row's ``place`` (1, 2, ... within its key), and ``n``,
    the key's rows. Chunks of a key are summed each; sums of whole chunks, one row each, go before them."""
    cut = rows.withColumn("_chunk", F.expr(f"({place} - 1) div {chunk}"))
    sums = cut.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(whole.orderBy("_chunk").rowsBetween(*_EARLIER)), F.lit(0))).withColumn("n", F.sum("_rows").over(whole)).drop("_sum", "_rows")
    inside = F.sum(value).over(Window.partitionBy(*keys, "_chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(name, inside).join(sums, [*keys, "_chunk"]).withColumn(name, F.col(name) + F.col("_before")).drop("_chunk", "_before")


def meet(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined to the one row of ``values`` that has their key. Keys in ``hot`` (``hot_keys``) are
    broadcast with their values, the others meet theirs in a shuffle where no key has many rows."""
    few = F.broadcast(values.join(F.broadcast(hot.select(key)), key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values, key))


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """Keys with more than one in HOT of ``total`` rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > F.lit(total) / HOT).select(key)


def _jumped(links: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """``n`` links whose parent is looked up in ``values`` (parent and more). A parent can have no more links
    than there are, so only many are looked at for hot ones."""
    return links.join(values, "parent") if n <= FEW else meet(links, values, "parent", hot_keys(links, "parent", n))


def climb(links: DataFrame, marked: DataFrame) -> DataFrame:
    """``marked`` (child) and all that lies above it in a forest of links (child, parent), one link a child.

    Links are doubled in length each round, so rounds grow with the logarithm of the depth.
    """
    while n := links.count():
        above = marked.join(links, "child").select(F.col("parent").alias("child"))
        marked = cut_lineage(marked.unionByName(above).distinct())
        ups = links.select(F.col("child").alias("parent"), F.col("parent").alias("_up"))
        links = cut_lineage(_jumped(links, ups, n).select("child", F.col("_up").alias("parent")))
    return marked


def roots(links: DataFrame) -> DataFrame:
    """(child, root) of a forest of links (child, parent), one link a child: the last parent, found by
    pointer jumping. A link that has reached its root waits for nobody and isn't joined again."""
    inner = links.select(F.col("child").alias("parent"), F.lit(True).alias("_inner"))
    links = cut_lineage(links.join(inner, "parent", "left").select("child", "parent", F.col("_inner").isNull().alias("done")))
    while n := links.where("not done").count():
        ups = links.select(F.col("child").alias("parent"), F.col("parent").alias("_up"), F.col("done").alias("_done"))
        jumped = _jumped(links.where("not done").select("child", "parent"), ups, n).select("child", F.col("_up").alias("parent"), F.col("_done").alias("done"))
        links = cut_lineage(links.where("done").unionByName(jumped))
    return links.select("child", F.col("parent").alias("root"))
