"""Exact top-k inner products by KD-trees per shard.

A small KD-tree over a sample deals the vectors to shards by space; a shard that holds more than
its share (equal vectors can't be parted by space) is cut into blocks. Each shard has a tight
bounding box and builds one KD-tree of median splits over the widest dimension, also with tight
boxes. A query bounds every box by the largest inner product any of its points could have, visits
boxes best-first and stops when the best box left cannot beat the kth score. Each query first
searches the shard with the best bound; the kth score found there goes with it, and only to shards
whose bound reaches it. Queries stream through a shard in Arrow batches: neither they nor the
vectors of more than one shard are held at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm import _shared

#: Vectors of a shard, about; the sample of the dealing tree, a shard; and bytes of all shards' boxes,
#: which every task holds: beyond, shards are larger instead.
SHARD, SAMPLE_PER_SHARD, BOX_BYTES = 1 << 15, 32, 1 << 28
LEAF = 256
_NO_ID = np.iinfo(np.int64).max


class KdTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.lo, self.hi, self.span, self.children = [], [], [], []
        self.order, self.leaf, self.points = np.arange(len(points)), leaf, points
        self._build(0, len(points))
        self.points, self.ids, self.rows = points[self.order], ids[self.order], rows[self.order]
        self.lo, self.hi = np.stack(self.lo), np.stack(self.hi)

    def _build(self, a: int, b: int) -> int:
        own = self.points[self.order[a:b]]
        node = len(self.span)
        low, high = own.min(axis=0), own.max(axis=0)
        self.lo.append(low)
        self.hi.append(high)
        self.span.append((a, b))
        self.children.append(None)
        if b - a > self.leaf and own.shape[1] and (high > low).any():
            axis = int(np.argmax(high - low))
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argsort(own[:, axis], kind="stable")]
            self.children[node] = (self._build(a, a + half), self._build(a + half, b))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point of each box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, query: np.ndarray, bound: np.ndarray, row: int, k: int, least: int | None) -> list[tuple[int, int, int]]:
        """(score, id, row) of the k best but the query's own row; none below ``least``."""
        best: list[tuple] = []  # a heap whose head is the worst: (score, -id, -row)
        heap = [(-bound[0], 0)]
        floor = -np.inf if least is None else least
        while heap:
            top, node = heapq.heappop(heap)
            if -top < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.span[node]
            scores = self.points[a:b] @ query
            for i in np.nonzero(scores >= floor)[0].tolist():
                if self.rows[a + i] == row:
                    continue
                item = (int(scores[i]), -int(self.ids[a + i]), -int(self.rows[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -i, -r) for s, i, r in best]


def _exact(points: np.ndarray, most: int) -> np.ndarray:
    """Doubles if all sums of products stay exact in them, else Python integers."""
    largest = int(np.abs(points).max()) if points.size else 0
    safe = largest * most * max(1, points.shape[1]) < 1 << 53
    return points.astype(np.float64) if safe else points.astype(object)


def _search_shards(k: int):
    """mapInArrow function over rows sorted by (shard, is_query): a shard's vectors, then
    the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, held, whole, reach = None, None, [], None, 0
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.nonzero((np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                part = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, tree, held, whole = shards[a], None, [], None
                ids = part.column("vec_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                rows = part.column("_row").to_numpy()
                v = part.column("v")
                points = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                if not asks[a]:
                    held.append((points, ids, rows))
                    continue
                if whole is None:
                    if not held:
                        continue
                    whole, held = [np.concatenate(x) for x in zip(*held, strict=True)], []
                most = int(np.abs(points).max()) if points.size else 0
                if tree is None or most > reach:
                    reach = max(most, 1 << 20)
                    tree = KdTree(_exact(whole[0], reach), whole[1], whole[2])
                asked = points.astype(tree.points.dtype)
                bounds = tree.bounds(asked)
                least = part.column("least").to_pylist()
                out = []
                for i in range(len(asked)):
                    for s, vec, r in tree.search(asked[i], bounds[i], int(rows[i]), k, least[i]):
                        out.append((int(ids[i]), int(rows[i]), None if vec == _NO_ID else vec, r, s))
                if out:
                    columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_row", "vec_id", "_row", "score"])

    return run


class Dealer:
    """The top of a KD-tree, from a sample: median splits over the widest dimension."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple | None] = []
        self.leaves = 0
        self.root = self._build(sample, max(0, int(np.ceil(np.log2(max(shards, 1))))))

    def _build(self, sample: np.ndarray, depth: int) -> int:
        """Index of a node, or -1 - leaf."""
        wide = (sample.max(axis=0) - sample.min(axis=0)) if len(sample) and sample.shape[1] else np.zeros(1)
        if not depth or not wide.any():
            self.leaves += 1
            return -self.leaves
        axis = int(np.argmax(wide))
        values = np.sort(sample[:, axis])
        cut = values[len(values) // 2]
        cut = cut if cut > values[0] else values[np.searchsorted(values, cut, "right")]
        at = len(self.nodes)
        self.nodes.append(None)
        low = sample[:, axis] < cut
        self.nodes[at] = (axis, cut, self._build(sample[low], depth - 1), self._build(sample[~low], depth - 1))
        return at

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                axis, cut, below, above = self.nodes[node]
                low = points[at, axis] < cut
                todo += [(below, at[low]), (above, at[~low])]
        return out


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(name: str) -> Column:
    """No NULL, NaN or infinity in it. Spark orders NaN above infinity, so one test does."""
    return F.col(name).isNotNull() & F.forall(name, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_size: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Components become floor(scale * x). Candidates are all rows but the query's own row, so
    a repeated id is a candidate of its copy; ties go to the smaller vec_id (NULL last), then
    to the earlier row. Rows whose vector is NULL or holds NULL, NaN or an infinity take no
    part; vectors of different lengths are never compared; fewer than k candidates are all
    given. Other columns are ignored whatever their names; an empty table gives none.
    """
    rows, n = _shared.number_rows(
        vectors,
        _shared.column_or_null(vectors, "vec_id", "long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    ready = rows.where(usable("x")).select("vec_id", "_row", "asks", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))
    widths = ready.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    main = widths[0]["w"] if widths else 0
    while (n // shard_size) * main * 16 > BOX_BYTES:
        shard_size *= 2
    shards = max(1, -(-n // shard_size))
    share = min(1.0, SAMPLE_PER_SHARD * shards / max(1, n))
    drawn = (F.size("v") == main) & (F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
    sample = ready.where(drawn if shards > 1 else F.lit(False)).select("_row", "v").toArrow().sort_by("_row").combine_chunks()
    dealer = Dealer(np.array(sample.column("v").to_pylist(), dtype=np.int64).reshape(len(sample), main), shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column("v")).to_numpy()
            # Vectors of other lengths than the usual one are dealt by their row.
            leaf, usual = batch.column("_row").to_numpy() % shards, np.nonzero(lengths == main)[0]
            leaf[usual] = dealer.leaf(_matrix(batch.take(pa.array(usual)))) if len(usual) else 0
            yield batch.append_column("width", pa.array(lengths.astype(np.int64))).append_column("leaf", pa.array(leaf))

    placed = _shared.materialize(ready.mapInArrow(place, "vec_id long, _row long, asks boolean, v array<long>, width long, leaf long"), "placed")
    # One row a shard.
    counts = {r["leaf"]: r["count"] for r in placed.where(F.col("width") == main).groupBy("leaf").count().collect()}
    blocks = np.array([max(1, -(-counts.get(i, 0) // (2 * shard_size))) for i in range(dealer.leaves)])
    first = np.concatenate(([0], np.cumsum(blocks)))
    if len(blocks) and blocks.max() > 1:
        table = placed.sparkSession.createDataFrame([(i, int(f), int(b)) for i, (f, b) in enumerate(zip(first, blocks, strict=False))], "leaf long, first long, blocks long")
        # A row a shard, within BOX_BYTES as the boxes are.
        placed = placed.join(F.broadcast(table), "leaf", "left").withColumn("leaf", F.when(F.col("width") == main, F.col("first") + F.pmod(F.xxhash64("_row"), "blocks")).otherwise(F.col("leaf")))
    placed = placed.select("vec_id", "_row", "asks", "v", "width", "leaf")
    lo, hi = _boxes(placed.where(F.col("width") == main), int(first[-1]), main)
    empty = (lo > hi).any(axis=1)
    lo[empty] = hi[empty] = 0

    def bounds(asked: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point of each shard's box."""
        largest = max(int(np.abs(asked).max()) if asked.size else 0, 1)
        low, high, q = (_exact(x, y) for x, y in ((lo, largest), (hi, largest), (asked, max(int(np.abs(lo).max(initial=0)), int(np.abs(hi).max(initial=0)), 1))))
        if low.dtype != high.dtype or q.dtype != low.dtype:
            low, high, q = (x.astype(object) for x in (lo, hi, asked))
        return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T

    def visits(least: bool):
        """mapInArrow function from queries to the shards they visit: their home, or those that may
        still hold one of their best."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, (1 << 22) // max(1, len(lo)))
                for s in range(0, len(batch), step):
                    part = batch.slice(s, step)
                    width, own = part.column("width").to_numpy(), part.column("leaf").to_numpy()
                    usual = np.nonzero(width == main)[0]
                    reach = np.where(empty[None, :], -np.inf, bounds(_matrix(part.take(pa.array(usual))))) if len(usual) else None
                    if least:
                        found = part.column("least").to_pylist()
                        kept = [[x for x in range(shards) if x != o] for o in own]
                        for k, i in enumerate(usual.tolist()):
                            kth = -np.inf if found[i] is None else found[i]
                            kept[i] = [x for x in np.nonzero((reach[k] >= kth) & ~empty)[0].tolist() if x != part.column("home")[i].as_py()]
                        home = part.column("home")
                    else:
                        kept, home = [[int(o)] for o in own], own.copy()
                        for k, i in enumerate(usual.tolist()):
                            home[i] = int(np.argmax(reach[k]))
                            kept[i] = [int(home[i])]
                        home = pa.array(home)
                    at = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in kept]))
                    goes = pa.array([x for y in kept for x in y], pa.int64())
                    out = part.take(at)
                    columns = [goes, *[out.column(c) for c in ("vec_id", "_row", "v", "width", "leaf")], home.take(at), out.column("least")]
                    yield pa.RecordBatch.from_arrays(columns, ["goes", "vec_id", "_row", "v", "width", "leaf", "home", "least"])

        return run

    number = F.col("width") * (1 << 32)
    points = placed.select((number + F.col("leaf")).alias("shard"), F.lit(False).alias("is_query"), "vec_id", "_row", "v", F.lit(None).cast("long").alias("least"))
    asked = placed.where("asks").select("vec_id", "_row", "v", "width", "leaf", F.lit(None).cast("long").alias("home"), F.lit(None).cast("long").alias("least"))
    schema = "goes long, vec_id long, _row long, v array<long>, width long, leaf long, home long, least long"

    def search(queries: DataFrame) -> DataFrame:
        sent = queries.select((number + F.col("goes")).alias("shard"), F.lit(True).alias("is_query"), "vec_id", "_row", "v", "least")
        dealt = points.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "is_query", "_row")
        return dealt.mapInArrow(_search_shards(k), "query_id long, query_row long, vec_id long, _row long, score long")

    homes = _shared.materialize(asked.mapInArrow(visits(False), schema), "homes")
    found = _shared.materialize(search(homes), "topk")
    if first[-1] > 1 or shards > 1:
        kth = found.groupBy(F.col("query_row").alias("_row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        known = homes.drop("least").join(kth, "_row", "left").withColumn("least", F.when(F.col("n") == k, F.col("kth")))
        away = known.select("vec_id", "_row", "v", "width", "leaf", "home", "least").mapInArrow(visits(True), schema)
        found = found.unionByName(search(away))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _boxes(placed: DataFrame, leaves: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) component of every shard in every dimension; crossed where it holds none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            leaf, points = batch.column("leaf").to_numpy(), _matrix(batch)
            for i in np.unique(leaf).tolist():
                own = points[leaf == i]
                low, high = own.min(axis=0), own.max(axis=0)
                held[i] = (np.minimum(low, held[i][0]), np.maximum(high, held[i][1])) if i in held else (low, high)
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = [list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["leaf", "lo", "hi"])

    lo, hi = np.full((leaves, width), np.iinfo(np.int64).max), np.full((leaves, width), np.iinfo(np.int64).min)
    each = placed.select("leaf", "v").mapInArrow(run, "leaf long, lo array<long>, hi array<long>").select("leaf", F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "b"))
    both = each.groupBy("leaf", "axis").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    table = both.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("axis", "lo", "hi"))).alias("b")).select("leaf", "b.lo", "b.hi").toArrow()
    for leaf, low, high in zip(*[c.to_pylist() for c in table.columns], strict=True):
        lo[leaf], hi[leaf] = low, high
    return lo, hi


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
