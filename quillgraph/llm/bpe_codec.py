"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A pre-token is encoded by halves: each half gives its tokens, and the join re-encodes a
window around the seam. Tokens a, b are *apart* when encoding their joined bytes gives a, b
back. A token list is the BPE encoding of its bytes exactly when all its neighbours are
apart, so the window grows (doubling on the side that fails) only until its first and last
token are apart from the tokens outside: these then provably stay as they are. At worst the
window is the whole pre-token. Decoding joins the tokens' bytes up a tree of wide nodes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import _shared
from quillgraph.llm.token_counts import BEYOND, PATTERN, plain_pattern

#: Bytes that a leaf of the tree merges directly: every longer pre-token is joined from halves.
LEAF = 4
#: Bytes from which a window is merged by a heap.
HEAP = 96
#: Children of a node of the decoding tree.
FAN_OUT = 64
#: Pre-tokens whose ids a worker remembers before the table starts afresh.
REMEMBERED = 400_000


class TreeCodec:
    """Encodes and decodes by a rank file: a line holds base64 of a token and its rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern).findall
        # The fast pattern stands for the published one only.
        self.plain = plain_pattern().findall if pattern == PATTERN else self.pattern
        # Leaves and windows recur in many pre-tokens, and so do seams. Found lists are never changed.
        self.merged: dict[bytes, list[int]] = {}
        self.seams: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def leaf(self, data: bytes) -> list[int]:
        """Merges the lowest-ranked pair, the leftmost of equals, until none is left."""
        if len(data) > HEAP:
            return self._leaf_by_heap(data)
        if (known := self.merged.get(data)) is not None:
            return known
        ranks, none = self.ranks.get, 1 << 40
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks(parts[i - 1] + parts[i], none)
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        found = self.merged[data] = [self.ranks[p] for p in parts]
        return found

    def _leaf_by_heap(self, data: bytes) -> list[int]:
        """The same for long windows: a heap of pairs over a linked list of parts."""
        n, ranks = len(data), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01" * n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = 0, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [self.ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def apart(self, a: int, b: int) -> bool:
        if (found := self.seams.get((a, b))) is None:
            if len(self.seams) > REMEMBERED:
                self.seams.clear()
            found = self.seams[a, b] = self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: tokens of the joined bytes from those of its halves."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            middle = self.leaf(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))
            fits_left = i == len(left) or self.apart(left[-i - 1], middle[0])
            fits_right = j == len(right) or self.apart(middle[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + middle + right[j:]
            i, j = i if fits_left else 2 * i, j if fits_right else 2 * j

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        """A pre-token's ids; one that is a token as a whole is that token."""
        whole = self.ranks.get(data)
        return self.tree(data) if whole is None else [whole]

    def split(self, text: str) -> list[str]:
        return self.pattern(text) if BEYOND.search(text) else self.plain(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens, known = self.split(text), self.known
        new = set(tokens).difference(known)
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(tokens)
            for t in new:
                known[t] = np.array(self.piece(t.encode()), dtype="<u4").tobytes()
        return b"".join(map(known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        level = list(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        while len(level) > 1:
            level = [b"".join(level[k : k + FAN_OUT]) for k in range(0, len(level), FAN_OUT)]
        return level[0] if level else b""


def codec(path: str, pattern: str) -> TreeCodec:
    return _shared.worker_table("bpe_codec", (path, pattern), lambda: TreeCodec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row a document.

    With ``keep_ids`` also ``ids``, the little-endian 32-bit ids as binary. A NULL text
    counts as empty (0 tokens, the digests of nothing); repeated rows stay repeated; other
    columns of the input are ignored whatever their names; a NULL doc_id stays NULL; an
    empty table gives an empty result. Texts are never cut: a pre-token of any length goes
    through the tree, and no special token is looked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    _shared.set_batches(docs.sparkSession)
    narrow = docs.select(_shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return narrow.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN)
