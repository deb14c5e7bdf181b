"""Thread graph: reply edges, look-back similarity edges, threads and their order.

Tables with a row a message are merged, by hint: their Parquet files and estimates are so much smaller than their
rows that Spark would send all messages through the driver as a broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as text_fn
from quillgraph.functions.vectors import norm
from quillgraph.operators.components import connected_components
from quillgraph.operators.ranges import global_number, number_within

# Rows looked back, largest gap, weight of a reply, least similarity.
LOOKBACK = 20
MAX_GAP = "4 hours"
REPLY_WEIGHT = 15.0
THREAD_SIMILARITY = 0.72
#: Rows of a block of the look-back; a block also has the last rows of the one before.
BLOCK = 1024


def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages with text, once an id (the last stands), with the text to embed."""
    kept = messages.where((F.col("type") == "message") & F.col("text").isNotNull() & (F.col("text") != ""))
    last = Window.partitionBy("source", "id").orderBy(F.desc("pos"))
    kept = kept.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return kept.withColumn("embed_text", text_fn.embedding_text(F.col("text")))


def message_lookup(messages: DataFrame) -> DataFrame:
    """(source, id, from, text) of all messages, empty ones too; the last of an id stands."""
    record = F.struct("from", "text")
    return messages.where(F.col("type") == "message").groupBy("source", "id").agg(F.max_by(record, "pos").alias("m")).select("source", "id", "m.from", "m.text")


def reply_edges(messages: DataFrame) -> DataFrame:
    """(source, id, target, weight) of messages that answer a known one, earlier or later."""
    known = messages.select("source", F.col("id").alias("target"))
    asks = messages.where("reply_to_message_id is not null").select("source", "id", F.col("reply_to_message_id").alias("target"))
    return asks.join(known.hint("merge"), ["source", "target"]).select("source", "id", "target", F.lit(REPLY_WEIGHT).alias("weight"))


def _blocks(rows: DataFrame, group: list[str], lookback: int, block: int) -> DataFrame:
    """Rows with ``rn``, ``block`` and ``_own``: numbered over all groups and cut into blocks by their number.

    The last ``lookback`` rows of a block are copied to the next one (not ``_own`` there), so a block has all that its
    rows look back at: one shuffle, no join, and no task that holds a group.
    """
    numbered = global_number(rows, [*group, "pos"], "rn").withColumn("block", F.expr(f"rn div {block}"))
    reach = F.expr(f"(rn + {lookback}) div {block} - block")
    halo = numbered.where(reach > 0).withColumn("block", F.explode(F.transform(F.sequence(F.lit(1).cast("bigint"), reach), lambda x: F.col("block") + x)))
    return numbered.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))


def lookback_pairs(rows: DataFrame, group: list[str], lookback: int = LOOKBACK, max_gap: str = MAX_GAP, block: int = BLOCK) -> DataFrame:
    """Pairs of a row (columns as they are) and each earlier row ``prev_*`` among the last
    ``lookback`` positions of its group that is at most ``max_gap`` older; ``rn`` and ``prev_rn``
    are places in the order of all groups and positions.

    """
    held = _blocks(rows, group, lookback, block)
    last = Window.partitionBy("block").orderBy("rn").rowsBetween(-lookback, -1)
    columns = [*rows.columns, "rn"]
    met = held.withColumn("_last", F.collect_list(F.struct(*columns)).over(last)).where("_own")
    found = met.select(*columns, F.explode("_last").alias("_prev")).select(*columns, *[F.col(f"_prev.{c}").alias(f"_of_{c}" if c in group else f"prev_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    in_time = (F.col("ts") - F.col("prev_ts")) <= F.expr(f"interval {max_gap}")
    return found.where(reduce(and_, same, in_time)).drop(*[f"_of_{c}" for c in group])


def best_previous(pairs: DataFrame, keys: list[str], target: str, similarity: Column, least: float = THREAD_SIMILARITY) -> DataFrame:
    """(keys, target, similarity): of each row's earlier rows the most similar one; ties go
    to the earliest, similarities of 0 or less never count."""
    scored = pairs.withColumn("_s", similarity).where("_s > 0")
    best = scored.groupBy(*keys).agg(F.max_by(F.struct(F.col(target).alias("t"), F.col("_s").alias("s")), F.struct("_s", -F.col("prev_rn"))).alias("b"))
    return best.where(F.col("b.s") >= least).select(*keys, F.col("b.t").alias("target"), F.col("b.s").alias("similarity"))


def best_lookback(messages: DataFrame, lookback: int = LOOKBACK, max_gap: str = MAX_GAP, least: float = THREAD_SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(source, id, target, similarity) like ``best_previous`` of the cosines of ``lookback_pairs``, of the rows that
    ``asks`` marks, from (source, pos, id, ts, vec, asks).

    No pair is made a row: each block is a matrix and looks back by one row, two, and so on. Products are
    added one dimension after another, as Spark's cosine does. Vectors of two lengths aren't alike.
    """
    kind = messages.schema["id"].dataType.simpleString()
    most = messages.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {max_gap})").first()[0]
    narrow = messages.select("source", "pos", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "vec", norm(F.col("vec")).alias("norm"), "asks")
    held = _blocks(narrow, ["source"], lookback, block)

    def look(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        ids, source = table.column("id").combine_chunks(), table.column("source").combine_chunks()
        rn, own = table.column("rn").to_numpy(), table.column("_own").to_numpy() & table.column("asks").to_numpy()
        code = source.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        ts, timed = table.column("ts").fill_null(0).to_numpy(), table.column("ts").is_valid().to_numpy()
        norms = table.column("norm").cast(pa.float64()).fill_null(0.0).to_numpy()
        vec = table.column("vec").combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
        flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        dims = np.zeros((max(1, sizes.max()), len(sizes)))
        dims[np.arange(len(flat)) - (np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0))[at], at] = flat
        best, found = np.zeros(len(sizes)), np.full(len(sizes), -1)
        with np.errstate(all="ignore"):
            # The earliest first, so that it stands among equals.
            for back in range(min(lookback, len(sizes) - 1), 0, -1):
                scale = norms[back:] * norms[:-back]
                fits = own[back:] & (rn[back:] - rn[:-back] == back) & (code[back:] == code[:-back]) & timed[back:] & timed[:-back] & (ts[back:] - ts[:-back] <= most) & (sizes[back:] == sizes[:-back]) & (scale > 0)
                similar = np.where(fits, np.add.reduce(dims[:, back:] * dims[:, :-back], axis=0) / scale, 0.0)
                better = similar > best[back:]
                best[back:][better], found[back:][better] = similar[better], np.flatnonzero(better)
        keep = np.flatnonzero((found >= 0) & (best >= least))
        return pa.table({"source": source.take(pa.array(keep)), "id": ids.take(pa.array(keep)), "target": ids.take(pa.array(found[keep])), "similarity": pa.array(best[keep])})

    return held.groupBy("block").applyInArrow(look, f"source {messages.schema['source'].dataType.simpleString()}, id {kind}, target {kind}, similarity double")


def thread_edges(messages: DataFrame, lookback: int = LOOKBACK, max_gap: str = MAX_GAP, least: float = THREAD_SIMILARITY) -> DataFrame:
    """(source, id, target, weight): reply edges, and for other messages the best look-back
    edge. ``messages`` has (source, pos, id, ts, reply_to_message_id, vec array<double>).

    A NULL vector joins nothing, and so does a NULL time. Of edges on one unordered pair the
    later message's stands.
    """
    replies = reply_edges(messages)
    # Positions count all messages, also those without a vector or time and those that a reply
    # takes out below.
    answering = replies.select("source", "id").distinct().withColumn("_reply", F.lit(True))
    narrow = messages.select("source", "pos", "id", "ts", "vec").join(answering.hint("merge"), ["source", "id"], "left").withColumn("asks", F.col("_reply").isNull())
    similar = best_lookback(narrow, lookback, max_gap, least)
    edges = replies.unionByName(similar.select("source", "id", "target", F.col("similarity").alias("weight")))
    order = messages.select("source", "id", "pos")
    pair = [F.least("id", "target").alias("a"), F.greatest("id", "target").alias("b")]
    latest = edges.join(order.hint("merge"), ["source", "id"]).groupBy("source", *pair).agg(F.max_by(F.struct("id", "target", "weight"), "pos").alias("e"))
    return latest.select("source", "e.id", "e.target", "e.weight")


def thread_members(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, id, thread): connected components; a message without edges is a thread."""
    node = lambda c: F.concat_ws("\x1f", "source", F.lpad(F.col(c).cast("string"), 20, "0"))
    found = connected_components(edges.select(node("id").alias("src"), node("target").alias("dst")))
    own = messages.select("source", "id", node("id").alias("node"))
    return own.join(found.hint("merge"), "node", "left").select("source", "id", F.coalesce("component", "node").alias("thread"))


def order_threads(members: DataFrame) -> DataFrame:
    """Number threads of a source by their first message and messages inside each thread.

    ``members`` has (source, thread, id, pos, ts, ...); adds ``thread_idx`` from 0 and ``rn``
    from 1. NULL times sort last; position breaks ties.
    """
    numbered = number_within(members, ["source", "thread"], [F.asc_nulls_last("ts"), F.col("pos")])
    heads = numbered.where("rn = 1").select("source", "thread", F.col("ts").alias("start"), F.col("pos").alias("start_pos"))
    # Numbered by range, so no source is one task.
    among = number_within(heads, ["source"], [F.asc_nulls_last("start"), F.col("start_pos")], "_n")
    index = among.select("source", "thread", (F.col("_n") - 1).alias("thread_idx"))
    return numbered.join(index.hint("merge"), ["source", "thread"])
