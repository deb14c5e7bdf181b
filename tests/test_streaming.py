"""Streams over files, run to their end."""

from pyspark.sql import functions as F

from quillgraph.functions import votes
from quillgraph.sources.chat import conversation_messages
from quillgraph.streaming import live


def stream(spark, tmp_path, sf_dir):
    batch = conversation_messages(spark, sf_dir)
    path = str(tmp_path / "in")
    batch.coalesce(1).write.parquet(path)
    return batch, spark.readStream.schema(batch.schema).parquet(path)


def finish(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    # Timeouts by the clock keep a query alive for ever: it is stopped after its input is read.
    q.awaitTermination(20)
    q.stop()
    return df.sparkSession.table(name)


def test_sessions(spark, tmp_path, sf_dir):
    batch, live_rows = stream(spark, tmp_path, sf_dir)
    got = finish(live.live_sessions(live_rows), "sessions", "complete", tmp_path)
    want = batch.where("text <> ''").groupBy("source").count()
    assert {(r.source, r.n_messages) for r in got.collect()} == {(r.source, r["count"]) for r in want.collect()}


def test_votes(spark, tmp_path, sf_dir):
    _, live_rows = stream(spark, tmp_path, sf_dir)
    spoken = live_rows.withColumn("text", F.when(F.col("pos") % 2 == 0, "I vote for tea").otherwise("no"))
    got = finish(live.live_votes(spoken, votes.ENGLISH), "tally", "complete", tmp_path).collect()
    assert {r.target for r in got} == {"tea", "LAST_MENTIONED"} and all(r.votes_against == 0 for r in got if r.target == "tea")


def test_windows(spark, tmp_path, sf_dir):
    batch, live_rows = stream(spark, tmp_path, sf_dir)
    got = finish(live.live_windows(live_rows, max_chars=50, overlap=1), "windows", "append", tmp_path).collect()
    ids = {r.id for r in batch.collect()}
    assert got and all(r.first_id in ids and r.last_id in ids and r.n_messages > 1 for r in got)
