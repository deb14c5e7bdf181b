"""Greedy packing of ordered messages into overlapping windows of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as text_fn
from quillgraph.operators.ranges import running_sum
from quillgraph.session import cut_lineage

# Characters of a window, messages carried over.
MAX_CHARS = 6000
OVERLAP = 4
#: Messages of a thread whose lengths may come together in one array.
SMALL = 4096


def window_slices(lengths: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """array<struct<first,last>> of 1-based slices from the ordered lengths of a thread.

    A message that would exceed ``max_chars`` starts a new window if the current one has more
    than ``overlap`` messages; the new window begins with the last ``overlap`` of the old.
    """
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<struct<first:bigint,last:bigint>>")
    start = F.struct(none.alias("out"), F.lit(1).cast("bigint").alias("first"), zero.alias("n"), zero.alias("chars"), F.array().cast("array<bigint>").alias("tail"))

    def step(a: Column, x: Column) -> Column:
        count = a["n"] - a["first"] + 1
        flush = (a["chars"] + x > max_chars) & (count > overlap)
        carried = F.aggregate(a["tail"], zero, lambda s, y: s + y)
        tail = F.slice(F.concat(F.array(x), a["tail"]), 1, overlap) if overlap else F.array().cast("array<bigint>")
        return F.struct(
            F.when(flush, F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), a["n"].alias("last"))))).otherwise(a["out"]).alias("out"),
            F.when(flush, a["n"] - overlap + 1).otherwise(a["first"]).alias("first"),
            (a["n"] + 1).alias("n"),
            (F.when(flush, carried).otherwise(a["chars"]) + x).alias("chars"),
            tail.alias("tail"),
        )

    def finish(a: Column) -> Column:
        return F.when(a["n"] > 0, F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), a["n"].alias("last"))))).otherwise(a["out"])

    return F.aggregate(lengths, start, step, finish)


def pack_windows(ordered: DataFrame, keys: list[str], length: str = "chars", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, small: int = SMALL) -> DataFrame:
    """(keys, window_idx, first_rn, last_rn) of every thread; ``ordered`` has ``rn`` from 1.

    A thread of at most ``small`` messages is one bounded array of lengths. Longer threads are packed by
    ``long_windows``, which never brings a thread's messages together. A NULL length counts as 0.
    """
    key, length_ = F.struct(*keys).alias("key"), F.coalesce(F.col(length).cast("bigint"), F.lit(0).cast("bigint"))
    rows = cut_lineage(ordered.select(key, "rn", length_.alias("len")))
    held = F.collect_list(F.when(F.col("rn") <= small, F.struct("rn", "len")))
    gathered = rows.groupBy("key").agg(F.max("rn").alias("n"), F.array_sort(held).alias("a")).where(F.col("n") <= small)
    slices = gathered.select("key", F.posexplode(window_slices(F.transform("a", lambda x: x["len"]), max_chars, overlap)).alias("window_idx", "w"))
    found = slices.select("key", F.col("window_idx").cast("bigint").alias("window_idx"), F.col("w.first").alias("first_rn"), F.col("w.last").alias("last_rn"))
    long = cut_lineage(rows.where(F.col("rn") == small + 1).select("key"))
    if not long.isEmpty():
        # Later rows tell by their number that their thread is long; a thread has at most ``small`` others.
        own = rows.where(F.col("rn") > small).unionByName(rows.where(F.col("rn") <= small).join(long, "key", "left_semi"))
        found = found.unionByName(long_windows(own, max_chars, overlap))
    return found.select(*[F.col(f"key.{c}").alias(c) for c in keys], "window_idx", "first_rn", "last_rn")


def next_starts(rows: DataFrame, max_chars: int, overlap: int) -> DataFrame:
    """(key, first, last, next): for a window that would begin with message ``first`` its last message and
    the first message of the window after it (NULL: none), from rows of (key, rn, len).

    A window ends before the first message whose running sum exceeds the sum before ``first`` by more than
    ``max_chars``. Sums are cut into buckets of ``max_chars``, so the last sum within reach lies in the bucket of
    the reach or is the largest of the bucket before: a window over one bucket of distinct sums merges both.
    """
    width = max(1, max_chars)
    summed = cut_lineage(running_sum(rows, ["key"], "rn", "len").withColumn("before", F.col("upto") - F.col("len")))
    sums = summed.groupBy("key", F.col("upto").alias("at")).agg(F.max("rn").alias("rn")).withColumn("bucket", F.expr(f"at div {width}"))
    carried = sums.groupBy("key", (F.col("bucket") + 1).alias("bucket")).agg(F.max("rn").alias("rn")).withColumn("at", F.lit(-1).cast("bigint"))
    asked = summed.select("key", (F.col("before") + max_chars).alias("at")).distinct().withColumn("bucket", F.expr(f"at div {width}"))
    none = F.lit(None).cast("bigint")
    both = sums.unionByName(carried).withColumn("asks", F.lit(False)).unionByName(asked.withColumn("rn", none).withColumn("asks", F.lit(True)))
    reach = F.max("rn").over(Window.partitionBy("key", "bucket").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    within = both.withColumn("within", F.coalesce(reach, F.lit(0))).where("asks").select("key", (F.col("at") - max_chars).alias("before"), "within")
    full = summed.join(within.hint("merge"), ["key", "before"]).withColumn("flush", F.greatest(F.col("rn") + overlap + 1, F.col("within") + 1))
    ends = F.col("flush") > F.col("n")
    return full.select("key", F.col("rn").alias("first"), F.when(ends, F.col("n")).otherwise(F.col("flush") - 1).alias("last"), F.when(~ends, F.col("flush") - overlap).alias("next"))


def long_windows(rows: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, window_idx, first_rn, last_rn) of (key, rn, len), by jump pointers.

    Each message points to the start of the next window, were it a start. A round doubles the pointers and
    adds the starts that they reach from the known ones, so w windows of a thread take log2(w) rounds. The tables
    compress so well that Spark would think them small: without the hints every round sends them through the driver.
    """
    windows = cut_lineage(next_starts(rows, max_chars, overlap))
    jumps = cut_lineage(windows.where("next is not null").select("key", "first", "next"))
    starts = windows.where("first = 1").select("key", "first", F.lit(0).cast("bigint").alias("window_idx"))
    step = 1
    while not jumps.isEmpty():
        reached = starts.join(jumps.hint("merge"), ["key", "first"]).select("key", F.col("next").alias("first"), (F.col("window_idx") + step).alias("window_idx"))
        starts = cut_lineage(starts.unionByName(reached))
        onward = jumps.select("key", F.col("first").alias("next"), F.col("next").alias("further"))
        jumps = cut_lineage(jumps.join(onward.hint("merge"), ["key", "next"]).select("key", "first", F.col("further").alias("next")))
        step *= 2
    return starts.join(windows.hint("merge"), ["key", "first"]).select("key", "window_idx", F.col("first").alias("first_rn"), F.col("last").alias("last_rn"))


def window_members(windows: DataFrame, ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``ordered`` once for each window that holds them. Spark's estimate of ``placed`` is that of the
    windows, not of their messages, so it is kept from broadcasting."""
    placed = windows.withColumn("rn", F.explode(F.sequence("first_rn", "last_rn")))
    return placed.join(ordered.hint("merge"), [*keys, "rn"])


def window_text(members: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """One row a window: its reference, number of messages and rendered text."""
    parts = F.array_sort(F.collect_list(F.struct("rn", F.col("id").alias("id"), F.col(line).alias("line"))))
    rows = members.groupBy(*keys, "thread_idx", "window_idx").agg(parts.alias("m"))
    ref = text_fn.window_ref(F.col("thread_idx"), F.element_at("m", 1)["id"], F.element_at("m", -1)["id"])
    return rows.select(*keys, "thread_idx", "window_idx", ref.alias("window_ref"), F.size("m").cast("bigint").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("window_text"))
