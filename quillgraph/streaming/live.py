"""Streaming forms of the pipeline's steps that make sense on live chats.

Watermarks bound all state. Checkpoint locations belong on shared storage and are the
caller's to name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.functions import votes
from quillgraph.operators.threads import MAX_GAP
from quillgraph.operators.windows import MAX_CHARS, OVERLAP


def live_sessions(messages: DataFrame, gap: str = MAX_GAP, late: str = "1 hour") -> DataFrame:
    """Messages of a source that follow each other within ``gap`` as one session."""
    kept = messages.where((F.col("type") == "message") & (F.coalesce("text", F.lit("")) != ""))
    session = F.session_window("ts", gap)
    grouped = kept.withWatermark("ts", late).groupBy("source", session)
    return grouped.agg(F.count(F.lit(1)).alias("n_messages"), F.sum(F.char_length("text")).cast("bigint").alias("chars")).select("source", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_messages", "chars")


def live_votes(messages: DataFrame, lexicon: votes.VoteLexicon = votes.RUSSIAN, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Votes for and against each target in tumbling windows."""
    voted = messages.withColumn("v", votes.detect_vote(F.col("text"), lexicon)).where("v.direction is not null")
    target = F.coalesce(F.nullif(F.col("v.target"), F.lit("")), F.lit("LAST_MENTIONED")).alias("target")
    grouped = voted.withWatermark("ts", late).groupBy(F.window("ts", every), "source", target)
    return grouped.agg(F.count_if(F.col("v.direction") == "for").alias("votes_for"), F.count_if(F.col("v.direction") == "against").alias("votes_against")).select("source", F.col("window.start").alias("start"), "target", "votes_for", "votes_against")


def live_windows(messages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, idle: str = MAX_GAP) -> DataFrame:
    """Greedy overlapping windows of each source as messages arrive.

    State is the current window only: ids and lengths of its messages. A window is given out
    when it is full, or with the rest when its source falls silent for ``idle``.
    """
    hours = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        if state.hasTimedOut:
            if ids:
                out.append((key[0], ids[0], ids[-1], len(ids), sum(sizes)))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "id"])
            for r in rows.itertuples():
                n = len(r.text)
                if sum(sizes) + n > max_chars and len(ids) > overlap:
                    out.append((key[0], ids[0], ids[-1], len(ids), sum(sizes)))
                    ids, sizes = (ids[-overlap:], sizes[-overlap:]) if overlap else ([], [])
                ids.append(int(r.id))
                sizes.append(n)
            state.update((ids, sizes))
            state.setTimeoutDuration(hours)
        yield pd.DataFrame(out, columns=["source", "first_id", "last_id", "n_messages", "chars"])

    kept = messages.where((F.col("type") == "message") & (F.coalesce("text", F.lit("")) != "")).select("source", "id", "ts", "text")
    return kept.groupBy("source").applyInPandasWithState(
        step, "source string, first_id bigint, last_id bigint, n_messages bigint, chars bigint", "ids array<bigint>, sizes array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
