"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.session import ensure_checkpoint_dir

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries
    _trim = None

#: More files than this and the file offsets are joined by shuffle instead of broadcast.
MAX_BROADCAST_FILES = 50_000

#: Rows of one Arrow batch sent to Python; whole texts are long.
ARROW_ROWS = 256


#: The operator whose tables this Python worker holds, and its tables.
_HELD: dict = {"owner": None, "tables": {}}


def worker_table(owner: str, key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, kept in this worker while it works for ``owner``."""
    _own(owner)
    if key not in _HELD["tables"]:
        _HELD["tables"][key] = make()
    return _HELD["tables"][key]


def _own(owner: str) -> None:
    """Workers live on from stage to stage, so another operator's tables go first."""
    if _HELD["owner"] != owner:
        _HELD["owner"], _HELD["tables"] = owner, {}
        trim()


def trim() -> None:
    """Give memory that nothing uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def worker(owner: str, trims: bool = False) -> Callable:
    """Marks a function over Arrow batches as work for ``owner``; with ``trims`` it gives
    its memory back after each task, as a worker may stay idle beside those of the next stage."""

    def wrap(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        def own(batches: Iterator) -> Iterator:
            _own(owner)
            yield from run(batches)
            if trims:
                trim()

        return own

    return wrap


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it, or else the checkpoint directory that was set. Where both
    are missing on one machine (tests) a temporary folder is made; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small (never above a smaller setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column cast to ``kind``; NULL where the table lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def by_bytes(texts: Sequence[str], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of at most ``limit`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def number_rows(df: DataFrame, *columns: Column, name: str = "_row") -> tuple[DataFrame, int]:
    """Number the rows 0..n-1 in stored order; returns (``columns`` and ``name``, n).

    The number is the offset of the row's file (files in path order) plus the row's index
    in the file, so no row moves, a lost task computes the same numbers again, and
    neither the split size nor the cluster changes them. A frame that isn't a plain scan
    of Parquet files is written to the shared folder first.
    """
    try:
        place = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
        counts = place.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("last"))
        files = counts.orderBy("f").limit(MAX_BROADCAST_FILES + 1).collect()
        # A filter leaves gaps in the indices.
        if any(r["n"] != r["last"] + 1 for r in files) or (len(files) > MAX_BROADCAST_FILES and not counts.where("n <> last + 1").isEmpty()):
            files = None
    except AnalysisException:
        files = None
    if files is None:
        narrow = df.select(*columns)
        back = materialize(narrow, "rows")
        return number_rows(back, *[F.col(f"`{c}`") for c in narrow.columns], name=name)
    spark = df.sparkSession
    schema = T.StructType([T.StructField("_file", T.StringType()), T.StructField("_base", T.LongType())])
    if len(files) <= MAX_BROADCAST_FILES:
        base, rows = 0, []
        for r in files:
            rows.append((r["f"], base))
            base += r["n"]
        offsets, n = F.broadcast(spark.createDataFrame(rows, schema)), base
    else:
        # One row a file in one window, never one a document.
        order = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(F.col("f").alias("_file"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_base"))
        n = counts.agg(F.sum("n")).first()[0]
    scan = df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    kept = [c for c in scan.columns if c not in ("_file", "_at")]
    out = scan.join(offsets, "_file")
    return out.select(*[f"`{c}`" for c in kept], (F.col("_base") + F.col("_at")).alias(name)), n
