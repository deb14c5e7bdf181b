"""Session and storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("quillgraph").config(map=base).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """``spark.checkpoint.dir`` names the folder all machines share; only where it is unset on
    one machine (tests) a temporary folder takes its place."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not _one_machine(sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgraph-"))


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows go to Python in batches of at most ``rows`` in plans that run inside; the session's own limit returns."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read back: they survive the loss of executors.

    A written table rather than ``checkpoint()``, which computes the rows twice and hands all constraints on to
    later plans, where they multiply in loops. Files are left for the cluster's own cleaning. Rows with a column
    that Parquet can't hold are checkpointed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if "void" in df.schema.simpleString() or "interval" in df.schema.simpleString():
        return df.checkpoint(eager=True)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
