"""SimHash near-duplicates found exactly with vantage-point trees.

1. One pass gives each document its SimHash fingerprint (64 bits a word, one word or more).
2. Equal fingerprints collapse to one representative, combined before the shuffle.
3. A vantage-point tree over a sample (some rows for each shard) splits the space of fingerprints into shards of
   bounded size. A fingerprint goes to its home shard and, as a visitor, to every shard its
   ball of the link radius reaches by the triangle bound |d(v,p) - d(v,q)| <= d(p,q). What a shard
   really holds is counted, and one with more than a block of rows or visitors becomes several tasks.
4. Each shard joins its members with a vantage-point recursion of the same bound and gives
   back a spanning forest of its links: as many rows as fingerprints at most, also where
   thousands lie within the radius of each other.
5. Components of all forests by large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import _shared
from quillgraph.operators.components import connected_components

SEED = 42
#: Fingerprints of a shard, about; and of the sample that places the vantage points: SAMPLE
#: or, with many shards, so many a shard (one fingerprint of thousands at any size).
SHARD = 1 << 16
SAMPLE, SAMPLE_PER_SHARD = 1 << 13, 8
#: Shingles of a block of documents whose sets are compared.
SHINGLES = 1 << 21
#: Pairs compared at once without a further split.
BLOCK = 1 << 18

_MASK = (1 << 64) - 1


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; all words if there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(k, len(words))
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype=np.uint64)


def _spread(h: np.ndarray, word: int) -> np.ndarray:
    """The hash of a further fingerprint word: the first word uses the hash itself."""
    if word == 0:
        return h
    x = h + np.uint64(word * 0x9E3779B97F4A7C15 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int = 1) -> list[int]:
    """A bit is 1 if it is set in over half the hashes; none: zero."""
    out = []
    for w in range(words):
        if not len(h):
            out.append(0)
            continue
        total = np.zeros(64, dtype=np.int64)
        hashes = _spread(h, w)
        for a in range(0, len(h), 1 << 14):
            bits = np.unpackbits(hashes[a : a + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64)
            total += bits.sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big"))
    return out


def shingle_set(text: str, k: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, k))


def alike(a: np.ndarray, b: np.ndarray, share: Fraction) -> bool:
    """Whether two shingle sets have a Jaccard similarity of ``share`` or more, in integers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * share.denominator >= (len(a) + len(b) - both) * share.numerator


def set_prints(rows: DataFrame, k: int, words: int) -> DataFrame:
    """(_row, n_shingles, s0, s1, w0, w1, ...) of rows of (_row, text): number, 128-bit digest and
    fingerprint of the distinct shingles."""
    names = ["_row", "n_shingles", "s0", "s1", *[f"w{i}" for i in range(words)]]

    @_shared.worker("near_dedup", trims=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for text in batch.column(1).to_pylist():
                held = shingle_set(text, k)
                n.append(len(held))
                digest = xxhash.xxh3_128_intdigest(held.tobytes())
                out.append([digest >> 64, digest & _MASK, *fingerprint(held, words)])
            columns = np.array(out, dtype=np.uint64).reshape(-1, words + 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *[pa.array(c) for c in columns.T.copy()]], names)

    _shared.set_batches(rows.sparkSession)
    return rows.select("_row", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def fingerprints(rows: DataFrame, k: int, words: int) -> DataFrame:
    """(doc_id, _row, n_shingles, w0, w1, ...) of rows of (doc_id, _row, text); fingerprint
    words as signed longs.

    Texts must not be NULL (callers make them empty, whose fingerprint is zero); a NULL doc_id stays
    NULL, repeated rows are kept, further columns are dropped, an empty table stays empty.
    """
    names = [f"w{i}" for i in range(words)]

    @_shared.worker("near_dedup", trims=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, n = [], []
            for text in batch.column(2).to_pylist():
                h = shingle_hashes(text, k)
                n.append(len(h))
                prints.append(fingerprint(h, words))
            columns = np.array(prints, dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *[pa.array(columns[:, i]) for i in range(words)]],
                ["doc_id", "_row", "n_shingles", *names],
            )

    _shared.set_batches(rows.sparkSession)
    return rows.select("doc_id", "_row", "text").mapInArrow(run, "doc_id long, _row long, n_shingles long, " + ", ".join(f"{n} long" for n in names))


def distance(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ point).sum(axis=1, dtype=np.int32)


class VantageTree:
    """The top of the tree: inner nodes split at a distance, leaves are shards.

    With a least ratio of sizes a node may split at a size instead: the same bound in one
    dimension. Of the cuts tried, the one that sends the fewest visitors across is taken.
    """

    def __init__(self, sample: np.ndarray, sizes: np.ndarray, shards: int, radius: int, ratio: float = 0.0):
        self.radius, self.ratio, self.nodes, self.leaves = radius, ratio, [], 0
        depth = max(0, int(np.ceil(np.log2(max(shards, 1)))))
        self.root = self._build(sample, sizes, depth)

    def _cuts(self, sample: np.ndarray, sizes: np.ndarray):
        """(vantage point or None for a size, cut, inside, visitors) of candidate splits."""
        for v in sample[:: max(1, len(sample) // 16)][:16]:
            d = distance(sample, v)
            cut = int(np.median(d))
            cut = cut if (d > cut).any() else cut - 1
            yield v, cut, d <= cut, (d > cut - self.radius) & (d <= cut)
        if self.ratio:
            cut = int(np.median(sizes))
            cut = cut if (sizes > cut).any() else cut - 1
            yield None, cut, sizes <= cut, (sizes <= cut) & (sizes > self.ratio * cut)

    def _build(self, sample: np.ndarray, sizes: np.ndarray, depth: int) -> int:
        """Index of a node, or -1 - shard for a leaf."""
        best = None
        for v, cut, inside, visitors in self._cuts(sample, sizes) if depth and len(sample) >= 2 else ():
            balance = min(int(inside.sum()), int((~inside).sum()))
            if balance and (best is None or visitors.sum() / balance < best[0]):
                best = visitors.sum() / balance, v, cut, inside
        if best is None:
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append(None)
        _, v, cut, inside = best
        self.nodes[at] = (v, cut, self._build(sample[inside], sizes[inside], depth - 1), self._build(sample[~inside], sizes[~inside], depth - 1))
        return at

    def route(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, home) of each point's home and of every shard it visits.

        Of a pair that a node parts, the point inside visits the outside; never both.
        """
        index, shard, home = [], [], []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while todo:
            node, at, own = todo.pop()
            if not len(at):
                continue
            if node < 0:
                index.append(at)
                shard.append(np.full(len(at), -1 - node, dtype=np.int64))
                home.append(own)
                continue
            v, cut, inner, outer = self.nodes[node]
            if v is None:
                d = sizes[at]
                reaches_in, reaches_out = self.ratio * d <= cut, d > self.ratio * cut
            else:
                d = distance(points[at], v)
                reaches_in, reaches_out = d <= cut + self.radius, d > cut - self.radius
            goes_in = np.where(own, d <= cut, reaches_in)
            todo.append((inner, at[goes_in], own[goes_in]))
            todo.append((outer, at[reaches_out], (own & (d > cut))[reaches_out]))
        if not index:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate(index), np.concatenate(shard), np.concatenate(home)


class Linker:
    """All pairs within the radius among points, kept as a spanning forest.

    With ``sets`` a pair links only if its shingle sets are alike too; pairs that already hang
    together aren't compared.
    """

    def __init__(self, points: np.ndarray, radius: int, sizes: np.ndarray | None = None, ratio: float = 0.0, sets: list[np.ndarray] | None = None, share: Fraction = Fraction(1)):
        self.p, self.r, self.sizes, self.ratio = points, radius, sizes, ratio
        self.sets, self.share = sets, share
        self.root = np.arange(len(points))
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def block(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        step = max(1, BLOCK // max(1, len(b)))
        for s in range(0, len(a), step):
            part = a[s : s + step]
            d = np.bitwise_count(self.p[part, None, 0] ^ self.p[None, b, 0]).astype(np.int16)
            for w in range(1, self.p.shape[1]):
                d += np.bitwise_count(self.p[part, None, w] ^ self.p[None, b, w])
            close = d <= self.r
            if self.sizes is not None:
                x, y = self.sizes[part, None], self.sizes[None, b]
                close &= np.minimum(x, y) >= self.ratio * np.maximum(x, y)
            if same:
                close &= part[:, None] != b[None, :]
            i, j = np.nonzero(close)
            if not len(i):
                continue
            if self.sets is not None:
                self.compare(part, b, i, j)
            else:
                self.links.append((part[i], b[j]))
                self.held += len(i)
                if self.held > 1 << 20:
                    self.settle()

    def compare(self, part: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Link the pairs (part[i], b[j]), i ascending, whose sets are alike."""
        starts = np.nonzero(np.diff(i, prepend=-1))[0].tolist()
        for s, e in zip(starts, [*starts[1:], len(i)], strict=True):
            x, others = int(part[i[s]]), b[j[s:e]]
            while len(others := others[self.root[others] != self.root[x]]):
                y, others = int(others[0]), others[1:]
                if alike(self.sets[x], self.sets[y], self.share):
                    low, high = sorted((self.root[x], self.root[y]))
                    self.root[self.root == high] = low

    def settle(self) -> None:
        """Fold the links gathered so far into the forest: hook lower roots, then shorten."""
        if not self.links:
            return
        a, b = (np.concatenate(x) for x in zip(*self.links, strict=True))
        self.links, self.held, root = [], 0, self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            first = np.concatenate(([True], high[1:] != high[:-1]))
            root[high[first]] = low[first]
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root[:] = above

    def banded(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Pairs within the ratio of sizes, by blocks of neighbouring sizes; in one set a
        block meets itself and what is larger."""
        a, b = (x[np.argsort(self.sizes[x], kind="stable")] for x in (a, b))
        sizes = self.sizes[b]
        for s in range(0, len(a), 256):
            part = a[s : s + 256]
            low = s if same else np.searchsorted(sizes, self.ratio * self.sizes[part[0]], "left")
            high = np.searchsorted(sizes, self.sizes[part[-1]] / self.ratio, "right")
            if high > low:
                self.block(part, b[low:high], same)

    def alone(self, at: np.ndarray) -> None:
        """Pairs within one set."""
        if len(at) * len(at) <= BLOCK:
            self.block(at, at, True)
            return
        d, cut = self.vantage(at)
        inside, outside = at[d <= cut], at[d > cut]
        near_in, near_out = at[(d <= cut) & (d > cut - self.r)], at[(d > cut) & (d <= cut + self.r)]
        if len(near_in) * len(near_out) >= 0.9 * len(inside) * len(outside):
            # The radius is too wide for this point to prune anything (or all are at one distance).
            self.wide(at, at, True)
            return
        self.alone(inside)
        self.alone(outside)
        self.across(near_in, near_out)

    def wide(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        (self.banded if self.ratio else self.block)(a, b, same)

    def vantage(self, at: np.ndarray) -> tuple[np.ndarray, int]:
        """Distances from the candidate that spreads a few others most, and their median."""
        few = self.p[at[:: max(1, len(at) // 64)][:64]]
        spread = [distance(few, v).std() for v in few[::8]]
        d = distance(self.p[at], few[8 * int(np.argmax(spread))])
        cut = int(np.median(d))
        return d, cut if (d > cut).any() else cut - 1

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs between two disjoint sets."""
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= BLOCK:
            self.block(a, b, False)
            return
        both = np.concatenate((a, b))
        d, cut = self.vantage(both)
        da, db = d[: len(a)], d[len(a) :]
        parts = [
            (a[da <= cut], b[db <= cut]),
            (a[da > cut], b[db > cut]),
            (a[(da <= cut) & (da > cut - self.r)], b[(db > cut) & (db <= cut + self.r)]),
            (a[(da > cut) & (da <= cut + self.r)], b[(db <= cut) & (db > cut - self.r)]),
        ]
        if sum(len(x) * len(y) for x, y in parts) > 0.9 * len(a) * len(b):
            self.wide(a, b, False)
            return
        for x, y in parts:
            self.across(x, y)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        child = np.nonzero(self.root != np.arange(len(self.root)))[0]
        return child, self.root[child]


def near_components(prints: DataFrame, radius: int, words: int, shard_size: int = SHARD, ratio: float = 0.0) -> DataFrame:
    """(node, component) of representatives with a link; a representative is the smallest
    ``_row`` of its fingerprint. ``ratio`` > 0 also asks that the smaller shingle count be
    at least that share of the larger.

    ``prints`` has _row and w0, w1, ... (with ``ratio`` n_shingles too), none NULL; repeated
    fingerprints count once, further columns are ignored, and an empty table gives an empty result.
    """
    names = [f"w{i}" for i in range(words)]
    keys = [*names, "n_shingles"] if ratio else names
    reps = _shared.materialize(prints.groupBy(*keys).agg(F.min("_row").alias("node")), "prints")
    return connected_components(_links(reps, _tree(reps, radius, words, shard_size, ratio), words, shard_size))


def _tree(reps: DataFrame, radius: int, words: int, shard_size: int, ratio: float) -> VantageTree:
    """The tree over a sample of representatives (node, w0, w1, ..., n_shingles)."""
    names = [f"w{i}" for i in range(words)]
    n = reps.count()
    shards = -(-n // shard_size)
    sized = "n_shingles" if ratio else F.lit(0).cast("long").alias("n_shingles")
    # The same on every run, without a sort: the fingerprints whose hash is below a threshold.
    share = min(1.0, max(SAMPLE, SAMPLE_PER_SHARD * shards) / max(1, n))
    drawn = F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))
    chosen = reps.where(drawn if shards > 1 else F.lit(False)).select("node", *names, sized).toArrow().sort_by("node")
    table = np.stack([c.to_numpy() for c in chosen.columns[1:]], axis=1).astype(np.int64)
    return VantageTree(np.ascontiguousarray(table[:, :words]).view(np.uint64), table[:, words], shards, radius, ratio)


def dealt(at: np.ndarray, shard: np.ndarray, home: np.ndarray, spread: np.ndarray, homes: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index, shard, x, y, side) of every task that a routed row takes part in.

    A shard with ``homes`` blocks of its own rows and ``visits`` blocks of visitors is the tasks
    (x, y), x <= y < homes: block x meets block y, or itself; and (x, homes + j): block x meets the
    visitors' block j. The first block of visitors comes to (x, x) instead. ``side`` 0 is block
    x, 1 the other. ``spread`` deals rows to blocks.
    """
    a, b = homes[shard], visits[shard]
    block = (spread % np.where(home, a, np.maximum(b, 1)).astype(np.uint64)).astype(np.int64)
    copies = np.where(home, a + np.maximum(b - 1, 0), a)
    row = np.repeat(np.arange(len(at)), copies)
    c = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    own, i, n = home[row], block[row], a[row]
    among = own & (c < n)
    x = np.where(among, np.minimum(i, c), np.where(own, i, c))
    y = np.where(among, np.maximum(i, c), np.where(own, c + 1, np.where(i == 0, c, n + i)))
    side = np.where(own, among & (c < i), True)
    return at[row], shard[row], x, y, side


def _links(reps: DataFrame, tree: VantageTree, words: int, block: int, share: Fraction | None = None) -> DataFrame:
    """(src, dst): the shards' spanning forests. With ``share`` the representatives carry their
    ``shingles``, and only pairs of that similarity link.

    What each shard really holds, visitors included, is counted first; a shard of more than
    ``block`` (rows, or shingles where they are carried) is cut into tasks of two blocks at most.
    """
    names, radius, ratio = [f"w{i}" for i in range(words)], tree.radius, tree.ratio
    extra = [*(["n_shingles"] if ratio else []), *(["shingles"] if share else [])]

    def routed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).view(np.uint64)
        return tree.route(points, batch.column("n_shingles").to_numpy() if ratio else np.zeros(len(points), dtype=np.int64))

    @_shared.worker("near_dedup", trims=True)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, tree.leaves), dtype=np.int64)
        for batch in batches:
            at, shard, home = routed(batch)
            weight = batch.column("n_shingles").to_numpy()[at] + 1 if share else np.ones(len(at), dtype=np.int64)
            np.add.at(held, (home.astype(np.int64), shard), weight)
        own, shard = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own == 1), pa.array(held[own, shard])], ["shard", "home", "n"])

    # Two rows a shard, one for some ten thousand fingerprints.
    held = np.zeros((2, tree.leaves), dtype=np.int64)
    for r in reps.select(*names, *(["n_shingles"] if ratio or share else [])).mapInArrow(count, "shard long, home boolean, n long").groupBy("shard", "home").agg(F.sum("n").alias("n")).collect():
        held[int(r["home"]), r["shard"]] = r["n"]
    visits, homes = -(-held[0] // block), np.maximum(-(-held[1] // block), 1)

    @_shared.worker("near_dedup", trims=True)
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shard, home = routed(batch)
            spread = _spread(batch.column("node").to_numpy().view(np.uint64), 1)[at]
            at, shard, x, y, side = dealt(at, shard, home, spread, homes, visits)
            # Rows with their shingles go out in small batches.
            step = 256 if share else 1 << 14
            for s in range(0, len(at), step):
                e = s + step
                yield pa.RecordBatch.from_arrays([*[pa.array(c[s:e]) for c in (shard, x, y, side)], *batch.take(pa.array(at[s:e])).columns], ["shard", "x", "y", "side", *batch.schema.names])

    def link(table: pa.Table) -> pa.Table:
        _shared.worker_table("near_dedup", (), dict)
        # Points in a fixed order, block x first, so that a forest's roots are there.
        order = pa.compute.sort_indices(table.select(["side", "node"]), sort_keys=[("side", "ascending"), ("node", "ascending")])
        sets = None
        if share:
            held = [x for c in table.column("shingles").chunks for x in (c[i].values.to_numpy() for i in range(len(c)))]
            sets = [held[i] for i in order.to_pylist()]
            table = table.drop_columns(["shingles"])
        diagonal = table.column("x")[0] == table.column("y")[0]
        table = table.take(order)
        points = np.stack([table.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
        sizes = table.column("n_shingles").to_numpy() if ratio else None
        linker = Linker(points, radius, sizes, ratio, sets, share)
        first = len(points) - int(pa.compute.sum(table.column("side")).as_py() or 0)
        if diagonal:
            linker.alone(np.arange(first))
        linker.across(np.arange(first, len(points)), np.arange(first))
        child, root = linker.forest()
        node = table.column("node").to_numpy()
        return pa.table({"src": pa.array(node[child], pa.int64()), "dst": pa.array(node[root], pa.int64())})

    columns = ", ".join(f"{c} {'array<long>' if c == 'shingles' else 'long'}" for c in [*names, *extra, "node"])
    placed = reps.select(*names, *extra, "node").mapInArrow(route, f"shard long, x long, y long, side boolean, {columns}")
    return _shared.materialize(placed.groupBy("shard", "x", "y").applyInArrow(link, "src long, dst long"), "links")


def similar_classes(rows: DataFrame, k: int, radius: int, words: int, shard_size: int, share: Fraction) -> DataFrame:
    """(_row, component) of rows of (_row, text): components of the links between texts whose
    sets of k-word shingles have a Jaccard similarity of ``share`` or more.

    Fingerprints of the sets within the radius propose pairs, and each proposed pair is held
    against the sets themselves. A first search over all fingerprints finds the rows that have
    any proposal; only these take their sets along into a second search.
    """
    names = [f"w{i}" for i in range(words)]
    prints = _shared.materialize(set_prints(rows, k, words), "simhash")
    reps = _shared.materialize(prints.groupBy("s0", "s1").agg(F.min("_row").alias("node"), *[F.first(c).alias(c) for c in ["n_shingles", *names]]), "prints")
    # A similarity bounds the ratio of the sets' sizes by itself.
    tree = _tree(reps, radius, words, shard_size, float(share) * (1 - 1e-9))
    proposed = _links(reps, tree, words, shard_size)
    nodes = _shared.materialize(proposed.select(F.explode(F.array("src", "dst")).alias("_row")).distinct(), "proposed")

    @_shared.worker("near_dedup", trims=True)
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_set(text, k) for text in batch.column(1).to_pylist()]
            points = np.array([fingerprint(x, words) for x in held], dtype=np.uint64).reshape(-1, words).view(np.int64)
            lists = pa.array([x.view(np.int64) for x in held], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in held], pa.int64()), *[pa.array(c) for c in points.T.copy()], lists], ["node", "n_shingles", *names, "shingles"])

    # A merge join at every size, as below.
    chosen = rows.join(nodes.hint("merge"), "_row", "left_semi").select("_row", "text")
    full = chosen.mapInArrow(sets, f"node long, n_shingles long, {', '.join(f'{n} long' for n in names)}, shingles array<long>")
    linked = connected_components(_links(full, tree, words, SHINGLES, share))
    labels = reps.select("s0", "s1", "node").join(linked, "node", "left").select("s0", "s1", F.coalesce("component", "node").alias("component"))
    return prints.select("_row", "s0", "s1").join(labels, ["s0", "s1"]).select("_row", "component")


def _classes(rows: DataFrame, k: int, radius: int, words: int, shard_size: int, ratio: float) -> DataFrame:
    """(doc_id, _row, fingerprint, component, component_id) of rows of (doc_id, _row, text)."""
    prints = _shared.materialize(fingerprints(rows, k, words), "simhash")
    names = [f"w{i}" for i in range(words)]
    keys = [*names, "n_shingles"] if ratio else names
    linked = near_components(prints, radius, words, shard_size, ratio)
    reps = prints.groupBy(*keys).agg(F.min("_row").alias("node"), F.min("doc_id").alias("low_id"))
    classes = reps.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = classes.groupBy("component").agg(F.min("low_id").alias("component_id"))
    labels = _shared.materialize(classes.join(lowest, "component").select(*keys, "component", "component_id"), "labels")
    hexed = F.concat(*[F.lpad(F.lower(F.hex(n)), 16, "0") for n in names])
    return prints.join(labels, keys).select("doc_id", "_row", hexed.alias("fingerprint"), "component", "component_id")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, words: int = 1, shard_size: int = SHARD, ratio: float = 0.0) -> DataFrame:
    """(doc_id, _row, fingerprint, component, component_id), one row a document.

    ``fingerprint`` is 16 lowercase hex digits a word; ``component`` the smallest row number
    reachable over links and ``component_id`` the smallest doc_id reachable (NULL only if
    all ids there are NULL). A NULL text counts as empty: texts without words have
    fingerprint zero and link like others. Repeated rows share a component; other columns
    of the input are ignored whatever their names; an empty table gives an empty result.
    """
    rows, _ = _shared.number_rows(docs, _shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    return _classes(rows, k, radius, words, shard_size, ratio)


def keep_one(docs: DataFrame, k: int = 5, radius: int = 128, words: int = 8, shard_size: int = SHARD, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents, all columns, without near copies: the first stored row of each class.

    Two texts link if their sets of five-word shingles have an exact similarity of 0.8 or more;
    classes are the components of these links. Pairs are proposed by 512-bit fingerprints of
    the sets at 128 bits: two texts at 0.8 differ in 78 bits on average (deviation 8; 96 and 9 in
    the worst case, sets of 4 and 5), so 2 in 10,000 of the latter are not proposed and
    practically all others are. Texts without words
    (NULL, empty, white space) are one class, repeated rows another each; columns pass through
    whatever their names and NULLs; an empty table stays empty.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered, _ = _shared.number_rows(docs, whole.alias("doc"))
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    rows = numbered.select("_row", text.alias("text"))
    kept = _shared.materialize(similar_classes(rows, k, radius, words, shard_size, share).where("_row = component").select("_row"), "kept")
    # A merge join at every size: the kept rows grow with the corpus, so they are never broadcast.
    return numbered.join(kept.hint("merge"), "_row", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
