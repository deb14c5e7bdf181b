"""Similar pairs inside a block (label): exact in matrix blocks, or approximate by hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.vectors import cosine, norm
from quillgraph.operators.ranges import HOT, meet
from quillgraph.session import cut_lineage

# A fixed value: least similarity of duplicates.
DUPLICATE_SIMILARITY = 0.88
#: Rows of one side of a matrix block.
BLOCK_ROWS = 2048
#: Probability with which hashing finds a pair at the threshold.
RECALL = 0.95


def similar_pairs(rows: DataFrame, threshold: float = DUPLICATE_SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(label, a, b, similarity) of pairs a < b of one label with cosine >= threshold.

    ``rows`` has (label, id, vec array<double>). A label's rows are dealt to blocks of bounded
    size and each pair of blocks is one task's matrix product, so a label with a third of
    all rows becomes many tasks, and only pairs that qualify are ever made into rows. NULL
    vectors join nothing; a zero vector's similarity is 0.
    """
    sizes = rows.where("vec is not null").groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    placed = rows.where("vec is not null").join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    dealt = placed.select("label", "id", "vec", "block", F.explode(others).alias("other"))
    dealt = dealt.select("label", "id", "vec", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("left"))

    def multiply(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        ids = table.column("id").to_numpy()
        vecs = vectors_of(table.column("vec"))
        norms = np.linalg.norm(vecs, axis=1)
        unit = np.divide(vecs, norms[:, None], out=np.zeros_like(vecs), where=norms[:, None] > 0)
        left = table.column("left").to_numpy(zero_copy_only=False)
        rows_, cols = (np.arange(len(ids)),) * 2 if x == y else (np.nonzero(left)[0], np.nonzero(~left)[0])
        close = unit[rows_] @ unit[cols].T
        # A little below the threshold; the exact sum decides in Spark.
        i, j = np.nonzero(close >= threshold - 1e-9)
        a, b = rows_[i], cols[j]
        keep = ids[a] < ids[b] if x == y else np.ones(len(a), dtype=bool)
        a, b = a[keep], b[keep]
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        label = pa.array([table.column("label")[0].as_py()] * len(a), table.schema.field("label").type)
        kind = table.schema.field("id").type
        return pa.table({"label": label, "a": pa.array(ids[a], kind), "b": pa.array(ids[b], kind), "similarity": pa.array(close[i, j][keep])})

    kinds = dict(rows.dtypes)
    schema = f"label {kinds['label']}, a {kinds['id']}, b {kinds['id']}, similarity double"
    return dealt.groupBy("label", "x", "y").applyInArrow(multiply, schema).where(F.col("similarity") >= threshold)


def similar_classes(rows: DataFrame, threshold: float = DUPLICATE_SIMILARITY, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (label, id, rep, size) of each row with a vector, and ``similar_pairs`` of representatives.

    Rows of a label with equal vectors are a class (128 bits of hash decide) of ``size`` rows, and its smallest id
    represents it. Their similarity is 1, so copies aren't expanded into pairs. A zero vector or one
    without a finite norm is like no other and a class of its own; so is any row if ``threshold`` is above 1.
    """
    length = norm(F.col("vec"))
    own = ~F.coalesce((length > 0) & (length < float("inf")), F.lit(False)) | F.lit(threshold > 1)
    kept = rows.where("vec is not null").select("label", "id", "vec")
    # The label may be NULL, which joins nothing, so it is hashed with the vector.
    marks = [F.xxhash64(F.lit(n), "label", "vec", F.when(own, F.col("id"))).alias(f"_h{n}") for n in (1, 2)]
    keyed = cut_lineage(kept.select("label", "id", "vec", *marks))
    classes = cut_lineage(keyed.groupBy("_h1", "_h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    reps = keyed.join(classes.select("_h1", "_h2", F.col("rep").alias("id")), ["_h1", "_h2", "id"], "left_semi")
    total = keyed.count()
    # A class can have most rows.
    hot = classes.where(F.col("size") > F.lit(total) / HOT).select(F.struct("_h1", "_h2").alias("_h"))
    mark = F.struct("_h1", "_h2").alias("_h")
    members = meet(keyed.select(mark, "label", "id"), classes.select(mark, "rep", "size"), "_h", hot)
    return members.select("label", "id", "rep", "size"), similar_pairs(reps.select("label", "id", "vec"), threshold, block_rows)


@dataclass(frozen=True)
class Bands:
    """Sign hashes of random hyperplanes: ``bands`` keys of ``bits`` signs each."""

    bits: int
    bands: int
    #: Differing signs of all keys beyond which a pair is no candidate.
    most: int

    @classmethod
    def for_recall(cls, rows: int, threshold: float, recall: float) -> Bands:
        """About one row a bucket for ``rows`` unrelated vectors, and as many bands as it takes for two vectors
        at the threshold to share a bucket with probability ``recall``."""
        bits = int(np.clip(np.ceil(np.log2(max(rows, 2))), 4, 32))
        differ = np.arccos(np.clip(threshold, -1, 1)) / np.pi
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-((1 - differ) ** bits)))))
        total = bits * bands
        # Four deviations above what vectors at the threshold differ by: a few in 100,000 are lost here.
        return cls(bits, bands, int(np.ceil(total * differ + 4 * np.sqrt(total * differ * (1 - differ)))))

    def keys(self, vectors: np.ndarray, seed: int) -> np.ndarray:
        """(rows, bands) keys."""
        planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], self.bits * self.bands))
        signs = (vectors @ planes > 0).reshape(len(vectors), self.bands, self.bits)
        return (signs * (1 << np.arange(self.bits))).sum(axis=2).astype(np.uint32)


def vectors_of(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length, as a matrix."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _bucketed(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(number of each row's bucket, rows) of whole buckets, from rows sorted by ``columns``."""
    held: list[pa.RecordBatch] = []

    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        for c in columns:
            x = table.column(c).combine_chunks()
            codes = x.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        number = numbers(table)
        # The last bucket may go on in the next batch.
        whole = int(np.searchsorted(number, number[-1])) if len(number) else 0
        if whole:
            yield number[:whole], table.slice(0, whole)
            held = table.slice(whole).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield numbers(table), table


def lsh_candidates(rows: DataFrame, threshold: float = DUPLICATE_SIMILARITY, recall: float = RECALL, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(label, a, b, near) of pairs a < b of one label that share a key of some band, once each; ``near``
    tells whether their keys differ so little that they may reach the threshold.

    A row is dealt once a band, with its keys but without its vector. A bucket of more than ``block_rows``
    rows (many near copies) becomes several blocks, and each pair of blocks one task's work.
    """
    ready = rows.where("vec is not null and size(vec) > 0")
    largest = ready.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bands = Bands.for_recall(largest, threshold, recall)
    kinds = dict(rows.dtypes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bands.keys(vectors_of(batch.column("vec")), seed)
                own = pa.array([k.tobytes() for k in keys], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("id"), own, pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64()))], ["label", "id", "own", "keys"])

    keyed = ready.select("label", "id", "vec").mapInArrow(hashed, f"label {kinds['label']}, id {kinds['id']}, own binary, keys array<long>")
    dealt = cut_lineage(keyed.select("label", "id", "own", F.posexplode("keys").alias("band", "key")))
    bucket = ["label", "band", "key"]
    sizes = dealt.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    placed = dealt.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    placed = placed.select(*bucket, "id", "own", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("left"))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _bucketed(batches, [*bucket, "x", "y"]):
            own = np.frombuffer(b"".join(table.column("own").to_pylist()), dtype=np.uint32).reshape(len(table), bands.bands)
            band, crossed = table.column("band").to_numpy(), table.column("x").to_numpy() != table.column("y").to_numpy()
            left, ids, label = table.column("left").to_numpy(), table.column("id").combine_chunks(), table.column("label").combine_chunks()
            # Neighbours at distance 1, 2, ... inside a bucket, until no bucket is that large.
            for away in range(1, len(number)):
                i = np.flatnonzero(number[away:] == number[:-away])
                if not len(i):
                    break
                i = i[~crossed[i] | (left[i] != left[i + away])]
                j = i + away
                # A pair counts in the first band that it shares.
                earlier = (own[i] == own[j]) & (np.arange(bands.bands) < band[i][:, None])
                once = ~earlier.any(axis=1)
                i, j = i[once], j[once]
                if len(i):
                    near = np.bitwise_count(own[i] ^ own[j]).sum(axis=1) <= bands.most
                    yield pa.RecordBatch.from_arrays([label.take(pa.array(i)), ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(near)], ["label", "a", "b", "near"])

    order = [*bucket, "x", "y"]
    found = placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(paired, f"label {kinds['label']}, a {kinds['id']}, b {kinds['id']}, near boolean")
    return found.select("label", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "near").where("a < b")


def lsh_pairs(rows: DataFrame, threshold: float = DUPLICATE_SIMILARITY, recall: float = RECALL, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(label, a, b, similarity) like ``similar_pairs``, without comparing all pairs: candidates by banded
    sign hashes, then the exact cosine. Never a wrong pair; a pair at the threshold is found with
    probability ``recall``, one above it more surely. Work grows with rows times bands, not with their square.
    ``threshold`` must be above 0; NULL and zero vectors join nothing.
    """
    vectors = cut_lineage(rows.where("vec is not null").select("label", "id", "vec"))
    near = lsh_candidates(vectors, threshold, recall, seed, block_rows).where("near")
    of = lambda end: vectors.select("label", F.col("id").alias(end), F.col("vec").alias(f"_{end}"))
    both = near.join(of("a"), ["label", "a"]).join(of("b"), ["label", "b"])
    return both.select("label", "a", "b", cosine(F.col("_a"), F.col("_b")).alias("similarity")).where(F.col("similarity") >= threshold)
