"""The trie of conversations' shared beginnings, rolled up by pointer jumping.

A turn has a digest of its role and text. A beginning of d turns is known by the exclusive or of the hashes of
its (place, turn digest) pairs, 128 bits, so prefixes come from running sums that can be cut anywhere: a
conversation is numbered over range partitions and summed in chunks, and none is one task. Digests key the
nodes, and taking the last turn's hash out again gives the parent's key.

Subtree sums take one round for each doubling of the depth: after k rounds a node has the sum over its
descendants nearer than 2^k and points to its ancestor 2^k above. A round adds what the nodes 2^k below have
(combined before the shuffle, so a root with most nodes below is no burden) and jumps: a pointer becomes its
target's pointer. Targets of more than one pointer in HOT are fewer than HOT and are broadcast to their rows;
nodes whose next ancestor would lie above the root stop without a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm import _shared

#: Conversations that share a base, and the most turns borrowed from it, plus one.
FAMILY, BORROWED = 20, 4
#: Turns summed together before chunks are.
CHUNK = 512
#: Neighbouring numbers whose ids are joined to one string before a node's ids are hashed (a power of two).
IDS_BITS = 12
HOT = 1000

_WORDS = r"[^\x20\x09-\x0D]+"
_KEY = lambda depth, x, y: F.unhex(F.sha2(F.concat_ws(":", depth, x, y), 256))
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_numbers(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words) of (conv_id, turn, _row, digest, words): places from 1 by turn (NULL first),
    then row. Numbered in range partitions; the few conversations that reach over several get an offset."""
    order = [F.asc_nulls_first("turn"), F.col("_row")]
    dealt = turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    dealt = _shared.materialize(dealt, "turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only the first conversation of a partition can have begun in an earlier one.
    offsets = F.broadcast(counts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    numbered = dealt.join(offsets, ["conv_id", "part"], "left").withColumn("pos", inside.cast("long") + F.coalesce("before", F.lit(0)))
    return numbered.select("conv_id", "pos", "digest", "words")


def meet(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row a key): keys in ``hot`` (bounded) by a broadcast, all
    others by a join in which no key has many rows."""
    hot = F.broadcast(hot.select(key))
    few = F.broadcast(values.join(hot, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(hot, key, "left_anti").join(values.hint("merge"), key))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest, words, last) of all rebuilt turns, (conv_id) of conversations left without turns).

    A conversation c takes its first h = crc32(c) mod 4 turns from conversation c - c mod 20.
    """
    numbered = _shared.materialize(turn_numbers(turns), "numbered")
    ids = _shared.materialize(numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "ids")
    total = ids.agg(F.sum("n")).first()[0] or 0
    turn = F.struct("pos", "digest", "words")
    heads = numbered.where((F.col("pos") < BORROWED) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    asked = ids.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    asked = asked.withColumn("head", head).withColumn("k", F.size("head").cast("long"))
    asked = asked.withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    asked = _shared.materialize(asked.select("conv_id", "n", "h", "k", "length", "head"), "asked")
    borrowed = asked.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.words", "length")
    plans = asked.select("conv_id", "h", "k", "length")
    own = meet(numbered, plans, "conv_id", ids.where(F.col("n") > F.lit(total) / HOT)).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "digest", "words", "length")
    out = borrowed.unionByName(own).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return out, asked.where("length = 0").select("conv_id")


def beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, words, last): each rebuilt conversation's prefixes by their digests."""
    x, y = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit("second"))
    rows = turns.withColumn("x", x).withColumn("y", y).withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    rows = _shared.materialize(rows, "rebuilt")
    whole = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("x").alias("cx"), F.bit_xor("y").alias("cy"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("cx", "cy")])
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("sx", F.bit_xor("x").over(inside)).withColumn("sy", F.bit_xor("y").over(inside)).join(before, ["conv_id", "chunk"])
    summed = summed.withColumn("sx", F.col("sx").bitwiseXOR(F.col("cx"))).withColumn("sy", F.col("sy").bitwiseXOR(F.col("cy")))
    up = _KEY(F.col("depth") - 1, F.col("sx").bitwiseXOR(F.col("x")), F.col("sy").bitwiseXOR(F.col("y")))
    return summed.select("conv_id", "depth", _KEY(F.col("depth"), F.col("sx"), F.col("sy")).alias("key"), up.alias("parent"), "words", "last")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the ids of a key, ascending and joined by commas, hashed.

    Ids that share all but IDS_BITS low bits are joined first, and the strings run through the hash one after
    another, so no group is ever held.
    """

    @_shared.worker("prefix_trie")
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    running.update(b"," + ids.encode())
                else:
                    if running is not None:
                        done.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256(ids.encode())
            yield _digests(done)
        if running is not None:
            yield _digests([(key, running.hexdigest())])

    strings = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("key", F.shiftright("conv_id", IDS_BITS).alias("piece")).agg(strings.alias("ids"))
    return pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(digest, "key binary, ends_sha256 string")


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], ["key", "ends_sha256"])


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(key, values summed over each node's subtree) of a forest (key, parent, depth, values), by jumping."""
    state = nodes.select("key", F.col("parent").alias("up"), "depth", *values)
    deepest, n = state.agg(F.max("depth"), F.count(F.lit(1))).first()
    step = 1
    while step <= (deepest or 0):
        below = state.where(F.col("depth") >= step).groupBy(F.col("up").alias("key")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        added = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
        rest = state.where(F.col("depth") < 2 * step).withColumn("up", F.lit(None).cast("binary"))
        far = state.where(F.col("depth") >= 2 * step)
        hot = far.groupBy("up").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(n) / HOT)
        targets = state.where(F.col("depth") >= step).select(F.col("key").alias("up"), F.col("up").alias("next"))
        jumped = meet(far, targets, "up", hot).withColumn("up", F.col("next")).drop("next")
        state = _shared.materialize(rest.unionByName(jumped).join(below, "key", "left").select("key", "up", "depth", *added), "jump")
        step *= 2
    return state.select("key", *values)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns are ordered by ``turn`` (NULL first), ties by stored row; a NULL role or text counts as empty; rows
    without a conv_id belong to no conversation and are left out. Repeated rows are turns each, and other
    columns are ignored whatever their names. An empty table has no nodes, any other has a root. The base of a
    negative id is found by SQL's remainder, which keeps the sign.
    """
    role, text = (F.coalesce(_shared.column_or_null(conversations, c, "string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words")]
    turns, _ = _shared.number_rows(conversations, *columns)
    rows, empty = rebuilt(turns.where("conv_id is not null"))
    members = _shared.materialize(beginnings(rows), "members")
    root: Column = _KEY(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    everyone = members.where("depth = 1").select("conv_id").unionByName(empty)
    top = everyone.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs")
    same = [F.any_value(c).alias(c) for c in ("parent", "depth", "words")]
    nodes = members.groupBy("key").agg(*same, F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).unionByName(top)
    children = members.select("key", "parent").distinct().groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").na.fill(0, ["n_children"])
    leaves, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    nodes = _shared.materialize(nodes.withColumn("n_leaves", leaves).withColumn("saved_tokens", saved), "nodes")
    n = nodes.count()
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
    ends = members.where("last").select("key", "conv_id").unionByName(empty.select(root.alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hot = nodes.where(F.col("n_children") > F.lit(n) / HOT).select(F.col("key").alias("parent"))
    below = meet(nodes.where("depth > 0"), parents, "parent", hot)
    placed = below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    done = placed.drop("n_leaves", "saved_tokens").join(sums, "key").join(end_hashes(ends), "key", "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The remainder of a number's CRC-32 by 4, bit by bit over its digits (-1 stands for a shift).
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384::BIGINT) END)"""
ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, own, xor({_CRC}, 4294967295::BIGINT) % 4 AS h FROM t),
b AS (
  SELECT h.c, list_concat(coalesce(t.own, [])[1:h.h], h.own[h.h + 1:]) AS turns FROM h LEFT JOIN t ON t.c = h.c - h.c % 20),
p AS (
  SELECT c, unnest(range(0, len(turns) + 1)) AS d, turns, len(turns) AS n FROM b),
m AS (
  SELECT c, d, n, md5(CAST(turns[1:d] AS VARCHAR)) || '/' || d AS k, CASE WHEN d > 0 THEN md5(CAST(turns[1:d - 1] AS VARCHAR)) || '/' || (d - 1) END AS up,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].x, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM p),
n AS (
  SELECT k, any_value(up) AS up, any_value(d) AS depth, any_value(words) AS words, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256 FROM m GROUP BY k),
ch AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM n LEFT JOIN ch USING (k)),
a AS (SELECT DISTINCT m.k AS k, z.k AS anc FROM m JOIN m z ON m.c = z.c AND z.d <= m.d),
s AS (SELECT anc AS k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a JOIN v ON a.k = v.k GROUP BY anc)
SELECT CAST(v.conv_id AS BIGINT) AS conv_id, CAST(v.depth AS BIGINT) AS depth, CAST(u.conv_id AS BIGINT) AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs,
  CAST(v.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (k) LEFT JOIN n u ON u.k = v.up
"""
