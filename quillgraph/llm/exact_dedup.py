"""Exact deduplication by skew-safe combining, in DataFrame expressions only.

Texts are equal when they match after whitespace is deleted. Candidates are combined three
times: within each task before the shuffle (partial aggregation), within salted digest
groups (a digest is spread over SALTS keys, and the rows of one task share a salt so that
the local stage isn't undone), and over the salts' winners. All three group by digest *and*
content, so a digest shared by different texts never merges them. No stage holds the rows
of a group: a group is a count and a best row.

Every row then finds its group by digest alone unless some digest has several contents; in
that case all rows are matched by content too. Groups of more than one row in HOT (so fewer than HOT of
them, at any size of the table) are broadcast to their rows, the others meet theirs in a shuffle, where
no key has more than a HOT-th of all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import _shared

#: The characters that normalization deletes (a fixed value).
WHITESPACE = " \t\n\x0b\x0c\r"
SALTS = 16
HOT = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, content, best, group_size) of every distinct text."""
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    best = F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    one = rows.select("digest", "content", salt.alias("salt"), best.alias("best"))
    salted = one.groupBy("digest", "content", "salt").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row a document.

    Of equal texts the row with the most code points in its original text stays; ties go to
    the smaller doc_id, then to ids over NULL, then to the earlier stored row, so exactly
    one row of a group is ``kept``, also among repeated rows. ``keep_id`` is that row's
    doc_id. A NULL text counts as empty; other columns are ignored whatever their names; an
    empty table gives an empty result. Texts are compared whole.
    """
    numbered, n = _shared.number_rows(docs, _shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    return _deduplicated(numbered, n, digest).drop("_row")


def _deduplicated(numbered: DataFrame, n: int, digest: Callable[[Column], Column]) -> DataFrame:
    """``deduplicate`` of the n rows of (doc_id, _row, text), with ``_row``."""
    content = F.translate("text", WHITESPACE, "")
    rows = numbered.select("doc_id", "_row", F.char_length("text").alias("length"), content.alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    found = _shared.materialize(_groups(rows).select("digest", "best", "group_size"), "groups")
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("content", 256)
    narrow = rows.select("doc_id", "_row", "digest", sha.alias("text_sha256"), *([] if digest is sha256 else ["content"]))
    if found.groupBy("digest").count().where("count > 1").isEmpty():
        hot = F.col("group_size") > F.lit(n) / HOT
        few = F.broadcast(found.where(hot).select("digest", F.struct("best", "group_size").alias("known")))
        # Rows of hot groups have their group by now; a key of their own spreads them and meets nothing.
        spread = F.concat(F.lit(b"row"), F.encode(F.col("_row").cast("string"), "utf-8"), F.lit(b"." * 64))
        keyed = narrow.join(few, "digest", "left").withColumn("key", F.when(F.col("known").isNull(), F.col("digest")).otherwise(spread))
        rest = found.where(~hot).select(F.col("digest").alias("key"), F.struct("best", "group_size").alias("met"))
        joined = keyed.join(rest, "key", "left").withColumn("group", F.coalesce("known", "met"))
    else:
        contents = _groups(rows).select("digest", "content", F.struct("best", "group_size").alias("group"))
        joined = rows.select("doc_id", "_row", "digest", "content", sha.alias("text_sha256")).join(contents, ["digest", "content"])
    return joined.select(
        "doc_id",
        F.col("group.best.doc_id").alias("keep_id"),
        F.col("group.group_size").alias("group_size"),
        (F.col("_row") == F.col("group.best._row")).alias("kept"),
        "text_sha256",
        "_row",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row a group, whatever the ids.

    Repeated rows and rows without an id are told apart by their places; columns pass through
    whatever their names and NULLs; an empty table stays empty.
    """
    numbered, n = _shared.number_rows(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = numbered.select((F.col("doc.doc_id") if "doc_id" in docs.columns else F.lit(None)).cast("long").alias("doc_id"), "_row", F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"))
    kept = _shared.materialize(_deduplicated(rows, n, sha256).where("kept").select("_row"), "kept")
    # A merge join at every size: the kept rows grow with the corpus, so they are never broadcast.
    return numbered.join(kept.hint("merge"), "_row", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c
  FROM documents),
g AS (
  SELECT c, count(*) AS group_size, first(doc_id ORDER BY len DESC, doc_id) AS keep_id FROM d GROUP BY c)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.c) AS text_sha256
FROM d JOIN g ON d.c = g.c
"""
