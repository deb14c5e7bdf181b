"""Substring deduplication with a count-min prefilter.

A window is WINDOW_WORDS consecutive words of one text. Windows are counted by their anchor, the
leftmost of the least of their grams of GRAM_WORDS words: equal windows have equal anchors at equal
distances, so the number of places of an anchor is never less than that of a window around it, and the
neighbouring windows of one anchor (a run) cost one count.

First pass: every task sketches its runs (DEPTH counters of each anchor), and the partial sketches are
added up. The sketch is cut into blocks by the anchor's hash, and the number of blocks grows with the
bytes of all texts, so that it is equally full at every size and no machine holds more than a block.

Second pass: the runs meet the block of their anchor. Runs whose estimate is below two are single for
certain, as counters never fall short; only the windows of the others are held and grouped exactly, by
the 64 bits of their anchor, its distance and 48 bits of their own hash.

Skew: a task sends only the first place of a window that it holds several times, and marks the others
at once, so a window meets at most one row a flush, however common it is. A block with more than HOT times
its share of runs (a common phrase with many surroundings) is dealt to several tasks by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import _shared
from quillgraph.llm.line_dedup import _mixed, gram_hashes, hashes_within, marked, windows_inside, word_bounds

WINDOW_WORDS = 20
GRAM_WORDS = 8
#: Counters of an anchor, and counters of a row of the sketch for each run that its block expects.
DEPTH, WIDTH = 2, 4
#: Runs that a block expects; more if there would be over MAX_BLOCKS blocks.
BLOCK_RUNS, MAX_BLOCKS = 1 << 17, 1 << 21
#: Runs that a task combines before it sends them.
FLUSH_RUNS = 1 << 17
#: A block with so many times the runs that it expects is dealt by window.
HOT = 8
#: Bytes of text to a run, about: only the number of blocks depends on it.
RUN_BYTES = 45
#: Tasks that the runs are dealt to at most.
MAX_TASKS = 1 << 16
#: An id for NULL, after all others.
NO_ID = np.iinfo(np.int64).max

_LOW48 = np.uint64((1 << 48) - 1)


class Runs:
    """Neighbouring windows with one anchor: anchor hash, ids and row of the document, first window's
    start, distance of the anchor from it, and the hashes of ``size`` windows each, one after another."""

    FIELDS = ("anchor", "doc", "row", "start", "distance", "size", "window")

    def __init__(self, *columns: np.ndarray):
        self.anchor, self.doc, self.row, self.start, self.distance, self.size, self.window = columns

    def __len__(self) -> int:
        return len(self.anchor)

    @classmethod
    def joined(cls, parts: list[Runs]) -> Runs:
        return cls(*[np.concatenate([getattr(p, f) for p in parts]) for f in cls.FIELDS])

    def in_order(self) -> Runs:
        """Sorted by document and start."""
        a, b, c = self.doc, self.row, self.start
        same = a[1:] == a[:-1]
        if ((a[1:] > a[:-1]) | (same & ((b[1:] > b[:-1]) | ((b[1:] == b[:-1]) & (c[1:] > c[:-1]))))).all():
            return self
        order = np.lexsort((c, b, a))
        return self.taken(order)

    def taken(self, which: np.ndarray) -> Runs:
        """The runs of these numbers, with their windows."""
        begin = np.cumsum(self.size, dtype=np.int64) - self.size
        size = self.size[which].astype(np.int64)
        at = np.repeat(begin[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return Runs(*[getattr(self, f)[which] for f in self.FIELDS[:-1]], self.window[at])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(run, number inside the run) of each window."""
        size = self.size.astype(np.int64)
        run = np.repeat(np.arange(len(self)), size)
        return run, np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)

    def regrouped(self, keep: np.ndarray, alone: np.ndarray | None = None) -> Runs:
        """Runs of the kept windows only; windows that are ``alone`` become runs of their own."""
        run, inside = self.windows()
        run, inside = run[keep], inside[keep]
        new = np.ones(len(run), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (inside[1:] != inside[:-1] + 1)
        if alone is not None:
            new |= alone[keep]
        head = np.flatnonzero(new)
        r, i = run[head], inside[head]
        size = np.diff(np.append(head, len(run))).astype(np.uint8)
        return Runs(self.anchor[r], self.doc[r], self.row[r], self.start[r] + i.astype(np.int32), (self.distance[r] - i).astype(np.uint8), size, self.window[keep])


def runs_of(texts: pa.Array, doc: np.ndarray, row: np.ndarray, window_words: int, gram_words: int) -> Runs:
    """The runs of a batch of texts, in stored order."""
    data, offsets, starts, ends = word_bounds(texts)
    words, first = hashes_within(data, starts, ends), np.searchsorted(starts, offsets)
    least = at = None
    if len(words) >= window_words:
        least = gram_hashes(words, gram_words)
        at = np.arange(len(least))
        size, span = 1, window_words - gram_words + 1
        while size < span:
            step = min(size, span - size)
            right = least[step:] < least[:-step]
            at = np.where(right, at[step:], at[:-step])
            least = np.where(right, least[step:], least[:-step])
            size += step
        start = np.flatnonzero(windows_inside(len(words), first, window_words))
    else:
        start = np.zeros(0, dtype=np.int64)
    if not len(start):
        none = np.zeros(0, dtype=np.uint64)
        return Runs(none, none.view(np.int64), none.view(np.int64), none.astype(np.int32), none.astype(np.uint8), none.astype(np.uint8), none)
    at, anchors = at[start], least[start]
    head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    text = np.searchsorted(first, start[head], "right") - 1
    size = np.diff(np.append(head, len(start))).astype(np.uint8)
    return Runs(anchors[head], doc[text], row[text], (start[head] - first[text]).astype(np.int32), (at[head] - start[head]).astype(np.uint8), size, gram_hashes(words, window_words)[start])


def ranges(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of neighbouring starts, which are sorted within a row."""
    if not len(row):
        return row, start, start
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))))
    return row[head], start[head], start[np.append(head[1:], len(row)) - 1]


def later_windows(runs: Runs) -> np.ndarray:
    """Of each window of ordered runs whether an equal one starts earlier among them."""
    run, inside = runs.windows()
    own = (runs.window << np.uint64(16)) | (runs.distance[run] - inside).astype(np.uint64)
    anchor = runs.anchor[run]
    key = _mixed(anchor ^ (own * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    equal = same & (anchor[order[1:]] == anchor[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    if (same & ~equal).any():  # one key for different windows
        order = np.lexsort((np.arange(len(own)), own, anchor))
        equal = (anchor[order[1:]] == anchor[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    later = np.zeros(len(own), dtype=bool)
    later[order[1:]] = equal
    return later


def starts_of(runs: Runs, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    run, inside = runs.windows()
    run, inside = run[which], inside[which]
    return ranges(runs.row[run], runs.start[run].astype(np.int64) + inside)


def cells(anchor: np.ndarray, width: int) -> np.ndarray:
    """The counter of each anchor in each of the DEPTH rows of its block."""
    return np.stack([(_mixed(anchor + np.uint64(0x632BE59BD9B4E019 + 2 * d)) & np.uint64(width - 1)).astype(np.uint32) for d in range(DEPTH)])


def _planes(x: np.ndarray) -> bytes:
    """The bytes of whole numbers, all first bytes first: neighbours are alike, so this compresses well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T).view(kind).ravel()


def pack(runs: Runs) -> list[bytes]:
    six = runs.window.view(np.uint8).reshape(-1, 8)[:, :6]
    return [_planes(getattr(runs, f)) for f in Runs.FIELDS[:-1]] + [np.ascontiguousarray(six).tobytes()]


def unpack(n: int, columns: list[bytes]) -> Runs:
    kinds = (np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint8)
    six = np.frombuffer(columns[6], dtype=np.uint8).reshape(-1, 6)
    window = np.zeros((len(six), 8), dtype=np.uint8)
    window[:, :6] = six
    return Runs(*[_numbers(c, k, n) for c, k in zip(columns, kinds, strict=False)], window.view(np.uint64).ravel())


def _flushes(batches: Iterator[pa.RecordBatch], window_words: int, gram_words: int) -> Iterator[Runs]:
    """Runs of (_row, doc_id, text) batches, FLUSH_RUNS or a little more at a time."""
    held, n = [], 0
    for batch in batches:
        doc = pc.fill_null(batch.column(1), int(NO_ID)).to_numpy()
        held.append(runs_of(batch.column(2), doc, batch.column(0).to_numpy(), window_words, gram_words))
        n += len(held[-1])
        if n >= FLUSH_RUNS:
            yield Runs.joined(held)
            held, n = [], 0
    if n:
        yield Runs.joined(held)


def _groups(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[order])) + 1
    for part in np.split(order, edges) if len(order) else ():
        yield int(block[part[0]]), part


def sketch(rows: DataFrame, blocks: int, width: int, window_words: int, gram_words: int) -> DataFrame:
    """(block, n, bits): number of runs, and of each counter of each row whether it is two or more."""

    @_shared.worker("substring_dedup", trims=True)
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _flushes(batches, window_words, gram_words):
            anchor, count = np.unique(runs.anchor, return_counts=True)
            out = []
            for block, at in _groups((anchor % np.uint64(blocks)).astype(np.int64)):
                # Counts above two say no more than two does.
                out.append((block, int(count[at].sum()), cells(np.repeat(anchor[at], np.minimum(count[at], 2)), width).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["block", "n", "cells"])

    @_shared.worker("substring_dedup", trims=True)
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True))
        for block, parts in groupby(rows, key=itemgetter(0)):
            total, counters = 0, np.zeros((DEPTH, width), dtype=np.uint8)
            for _, n, held in parts:
                total += n
                for d, c in enumerate(np.frombuffer(held, dtype=np.uint32).reshape(DEPTH, -1)):
                    at, more = np.unique(c, return_counts=True)
                    counters[d, at] = np.minimum(counters[d, at] + more, 2)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total], pa.int64()), pa.array([np.packbits(counters > 1).tobytes()], pa.binary())], ["block", "n", "bits"])

    parts = rows.mapInArrow(partial, "block int, n long, cells binary").repartition("block").sortWithinPartitions("block")
    return _shared.materialize(parts.mapInArrow(merge, "block int, n long, bits binary"), "sketch")


_SENT = ["block", "part", "kind", "n", *Runs.FIELDS]
_SENT_TYPE = "block int, part int, kind int, n int, anchor binary, doc binary, row binary, start binary, distance binary, size binary, window binary"
_CUT_TYPE = "_row long, first int, last int"


def repeated_windows(rows: DataFrame, window_words: int, gram_words: int, block_runs: int = BLOCK_RUNS, hot: int = HOT) -> DataFrame:
    """(_row, first, last): starts of windows of (_row, doc_id, text) that an earlier place holds.

    Places are ordered by id (NULL last), row and start.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, size // RUN_BYTES)
    share = max(block_runs, -(-expected // MAX_BLOCKS))
    blocks, width = -(-expected // share), 1 << int(WIDTH * share - 1).bit_length()
    table = sketch(rows, blocks, width, window_words, gram_words)
    # Fewer than blocks / hot or so, whatever the corpus.
    above = F.col("n") > hot * share
    parts = {r["block"]: r["parts"] for r in table.where(above).select("block", F.ceil(F.col("n") / share).cast("int").alias("parts")).collect()}
    shared = rows.sparkSession.sparkContext.broadcast((np.array(sorted(parts), dtype=np.int64), np.array([parts[b] for b in sorted(parts)], dtype=np.int64)))

    def sent(block: int, part: int, kind: int, n: int, columns: list[bytes]) -> tuple:
        return (block, part, kind, n, *columns)

    @_shared.worker("substring_dedup", trims=True)
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_blocks, hot_parts = shared.value
        types = [pa.int32()] * 4 + [pa.binary()] * len(Runs.FIELDS)
        for runs in _flushes(batches, window_words, gram_words):
            runs, out = runs.in_order(), []
            runs.window &= _LOW48
            later = later_windows(runs)
            row, first, last = starts_of(runs, later)
            if len(row):
                out.append(sent(int(row[0] % blocks), 0, 2, len(row), [b"", b"", _planes(row), _planes(first.astype(np.int32)), b"", b"", _planes(last.astype(np.int32))]))
            alone = None
            if len(hot_blocks):
                alone = np.repeat(np.isin(runs.anchor % np.uint64(blocks), hot_blocks.astype(np.uint64)), runs.size)
            runs = runs.regrouped(~later, alone)
            block = (runs.anchor % np.uint64(blocks)).astype(np.int64)
            part = np.zeros(len(runs), dtype=np.int64)
            if len(hot_blocks):
                at = np.minimum(np.searchsorted(hot_blocks, block), len(hot_blocks) - 1)
                is_hot = hot_blocks[at] == block
                one = runs.window[np.cumsum(runs.size, dtype=np.int64) - runs.size]  # runs of hot blocks have one window
                part[is_hot] = (_mixed(one[is_hot]) % hot_parts[at[is_hot]].astype(np.uint64)).astype(np.int64)
            for key, which in _groups(block * (part.max(initial=0) + 1) + part):
                piece = runs.taken(which)
                out.append(sent(int(block[which[0]]), int(part[which[0]]), 1, len(piece), pack(piece)))
            for s in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[s : s + 256], strict=True), types, strict=True)], _SENT)

    def cuts(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["_row", "first", "last"])

    @_shared.worker("substring_dedup", trims=True)
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(len(_SENT))], strict=True))
        for _, group in groupby(rows, key=itemgetter(0, 1)):
            bits, held = None, []
            for _, _, kind, n, *columns in group:
                if kind == 0:
                    bits = np.unpackbits(np.frombuffer(columns[0], dtype=np.uint8)).reshape(DEPTH, width).view(bool)
                elif kind == 1:
                    runs = unpack(n, columns)
                    twice = np.logical_and.reduce([b[c] for b, c in zip(bits, cells(runs.anchor, width), strict=True)])
                    held.append(runs.taken(np.flatnonzero(twice)))
                else:
                    yield cuts(_numbers(columns[2], np.int64, n), _numbers(columns[3], np.int32, n), _numbers(columns[6], np.int32, n))
            if held and sum(map(len, held)):
                runs = Runs.joined(held).in_order()
                yield cuts(*starts_of(runs, later_windows(runs)))

    none = [F.lit(b"").alias(c) for c in Runs.FIELDS[1:]]
    copies = F.explode(F.sequence(F.lit(0), F.when(above, F.ceil(F.col("n") / share).cast("int") - 1).otherwise(F.lit(0)))).alias("part")
    filters = table.select("block", copies, F.lit(0).alias("kind"), F.lit(0).alias("n"), F.col("bits").alias("anchor"), *none)
    # A few blocks a task, however many there are.
    tasks = min(MAX_TASKS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 8))
    met = rows.mapInArrow(send, _SENT_TYPE).unionByName(filters).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "kind")
    return met.mapInArrow(decide, _CUT_TYPE)


_KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


def kept_words(text: bytes, spans: list[dict] | None, window_words: int) -> tuple[bytes, int, int]:
    """(kept words joined by one space, words, words removed) of a text and the starts of its later windows."""
    words = text.split()
    if not spans:
        return b" ".join(words), len(words), 0
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        depth[s["first"]] += 1
        depth[s["last"] + window_words] -= 1
    keep = np.cumsum(depth[:-1]) == 0
    return b" ".join(compress(words, keep.tolist())), len(words), int(len(words) - keep.sum())


def deduplicate_substrings(docs: DataFrame, window_words: int = WINDOW_WORDS, gram_words: int = GRAM_WORDS, block_runs: int = BLOCK_RUNS, hot: int = HOT) -> DataFrame:
    """(doc, text, n_words, n_removed): of each row the words that no earlier window covers.

    ``doc`` is a struct of the input's columns as they are, whatever their names and NULLs; ``text`` has the
    kept words joined by one space. A word goes if a window of ``window_words`` words around it also starts
    earlier: in a document with a smaller id, or earlier in its own text, overlapping or not. NULL ids come
    after all others, rows with one id in stored order, so repeated rows lose all that the first one keeps,
    if they have a window's words. A NULL or empty text has no words; texts with fewer words than a window
    stay whole; an empty table gives an empty result.
    """
    _shared.set_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows, _ = _shared.number_rows(docs, whole.alias("doc"))
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    plain = rows.select("_row", (F.col("doc.doc_id") if "doc_id" in docs.columns else F.lit(None)).cast("long").alias("doc_id"), text.alias("text"))
    found = repeated_windows(plain, window_words, gram_words, block_runs, hot)
    spans = _shared.materialize(found.groupBy("_row").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")

    @F.arrow_udf(_KEPT)
    def keep(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = [kept_words(t, s, window_words) for t, s in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True)]
        kept, words, removed = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], ["text", "n_words", "n_removed"])

    # Texts without a mark have no spans and stay where they are; the others meet theirs in a merge join.
    near = marked(docs.sparkSession, spans)
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    met = rows.where(near).join(spans.hint("merge"), "_row", "left").select("doc", "spans")
    both = rows.where(~near).select("doc", none.alias("spans")).unionByName(met)
    done = both.select("doc", keep(text, F.col("spans")).alias("kept"))
    return done.select("doc", "kept.text", "kept.n_words", "kept.n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc.doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM w WHERE len(ws) >= 20),
g AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM p),
r AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM g),
c AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE n > 1),
o AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM o ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
