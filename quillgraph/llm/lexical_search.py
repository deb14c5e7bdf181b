"""Ranked lexical search by Fagin's threshold algorithm.

The forward index has, for each document, how often it holds each term of the queries. Statistics (documents,
their terms, documents a term) are counted over all of it. Then each task makes shards of neighbouring documents;
a shard sorts its postings by impact, reads the lists of a query's terms in turn, a few entries of each in a
round, and scores every document that it meets whole by its row of the forward index. No unread document can
score more than the sum of the impacts last read; once that is strictly below the tenth best score so far, the
shard is done with the query. The best scores go on to the task's next shard, so later shards stop sooner. Only a
task's ten best documents a query are shuffled.

Terms are known by 64 bits of hash. Queries come in blocks of about BLOCK_TERMS terms, which are all that the
driver and a broadcast hold; there is one pass over the documents for a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm import _shared
from quillgraph.llm.line_dedup import hashes_within

TOP = 10
#: Terms of the queries that are answered together.
BLOCK_TERMS = 1 << 20
#: Postings and documents of a shard; it ends with the batch that exceeds one of them.
SHARD_POSTINGS, SHARD_DOCS = 1 << 22, 1 << 16
#: Entries of each list read in the first round; each round reads twice as many as the one before.
FIRST_ROUND = 16
#: Keys that a query's candidates are ranked by before the last ranking.
SALTS = 64

_TERM = np.zeros(256, dtype=bool)
_TERM[128:] = True
for _a, _b in (b"09", b"AZ", b"az"):
    _TERM[_a : _b + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, first term of each text and the end); only A-Z are lower-cased, NULL has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    none = np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    if offsets[0] == offsets[-1]:
        return none
    data = _LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets, inside = offsets - offsets[0], _TERM[data]
    # A term begins after another character or at the border of a text, and ends likewise.
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~border[:-1]
    after = np.concatenate((inside[1:], [False])) & ~border[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return hashes_within(data, starts, ends), np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class Queries:
    """Ids of some queries, their distinct terms' hashes in order, and each query's terms by place."""

    ids: list
    terms: np.ndarray
    held: list[np.ndarray]

    @classmethod
    def of(cls, found: dict) -> Queries:
        terms = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *found.values()]))
        return cls(list(found), terms, [np.searchsorted(terms, np.unique(x)) for x in found.values()])


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, terms) of each row's distinct terms' hashes."""

    @_shared.worker("lexical_search")
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = term_hashes(batch.column(1))
            own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["item_id", "terms"])

    return queries.mapInArrow(read, f"item_id {dict(queries.dtypes)['item_id']}, terms array<long>")


def forward_index(rows: DataFrame, terms: np.ndarray) -> DataFrame:
    """(_row, doc_id, n, terms, counts) of (_row, doc_id, text): the number of a text's terms, and the places in
    ``terms`` of those among them, with how often each occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    @_shared.worker("lexical_search", trims=True)
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        may = np.zeros(1 << 16, dtype=bool)
        may[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            hashes, first = term_hashes(batch.column(2))
            at = np.flatnonzero(may[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.searchsorted(known, hashes[at])
            if len(known):
                sure = known[np.minimum(place, len(known) - 1)] == hashes[at]
                at, place = at[sure], place[sure]
            text = np.searchsorted(first, at, "right") - 1
            entries, counts = np.unique(text * max(1, len(known)) + place, return_counts=True)
            ends = np.searchsorted(entries, np.arange(len(first)) * max(1, len(known))).astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (entries % max(1, len(known)), counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first).astype(np.int64)), *columns], ["_row", "doc_id", "n", "terms", "counts"])

    return rows.mapInArrow(read, "_row long, doc_id long, n long, terms array<int>, counts array<int>")


def holding(index: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term."""

    @_shared.worker("lexical_search", trims=True)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    out = np.zeros(n_terms, dtype=np.int64)
    for r in index.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What occurrences of terms add to the scores of documents of ``n`` terms."""
    m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Documents with their terms' impacts: a row each (the forward index), and a list a term by falling impact."""

    def __init__(self, places: tuple[np.ndarray, ...], ends: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.places, self.ends, self.term, self.impact = places, ends, term, impact
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.lexsort((-impact, term))
        self.falling, self.owner = impact[order], owner[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The whole scores of documents, by random access to their rows."""
        size = self.ends[docs + 1] - self.ends[docs]
        before = np.cumsum(size) - size
        at = np.repeat(self.ends[docs] - before, size) + np.arange(size.sum())
        total = np.concatenate(([0], np.cumsum(self.impact[at] * asked[self.term[at]])))
        return total[before + size] - total[before]

    def best(self, terms: np.ndarray, asked: np.ndarray, top: Best) -> int:
        """Adds the shard's documents to a query's best ones; returns how many documents were scored."""
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        begin, end = self.begin[terms], self.begin[terms + 1]
        seen, depth, step = np.zeros(len(self.ends) - 1, dtype=bool), 0, FIRST_ROUND
        while depth < (end - begin).max(initial=0):
            low, high = np.minimum(begin + depth, end), np.minimum(begin + depth + step, end)
            met = np.zeros(len(seen), dtype=bool)
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                met[self.owner[a:b]] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            top.add(self.scores(new, asked), *[x[new] for x in self.places])
            depth, step = depth + step, step * 2
            # Nothing is left in a list that was read to its end.
            left = high < end
            if self.falling[high[left] - 1].sum() < top.least():
                break
        return int(seen.sum())


class Best:
    """The best documents of a query so far: highest scores above 0, ties by id (NULL last) and row."""

    def __init__(self, k: int):
        self.k = k
        none = np.zeros(0, dtype=np.int64)
        self.found = (none, none, none.astype(bool), none)  # scores, ids, whether they are NULL, rows

    def least(self) -> int:
        """The k-th best score; 0 before there are k."""
        return int(self.found[0][-1]) if len(self.found[0]) == self.k else 0

    def add(self, score: np.ndarray, *places: np.ndarray) -> None:
        near = (score > 0) & (score >= self.least())
        if near.any():
            all_ = [np.concatenate((a, b[near])) for a, b in zip(self.found, (score, *places), strict=True)]
            order = np.lexsort((all_[3], all_[1], all_[2], -all_[0]))[: self.k]
            self.found = tuple(x[order] for x in all_)


def _shards(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int, postings: int) -> Iterator[Shard]:
    held: list[tuple] = []

    def made() -> Shard:
        doc, no_id, row, n, size, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        impact = impacts(weight[term], tf.astype(np.int64), np.repeat(n, size), n_docs, n_terms)
        return Shard((doc, no_id, row), np.concatenate(([0], np.cumsum(size))), term, impact, len(weight))

    total = docs = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        no_id = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        place = pc.fill_null(batch.column(1), 0).to_numpy(), no_id, batch.column(0).to_numpy()
        entries = batch.column(3).flatten().to_numpy()
        held.append((*place, batch.column(2).to_numpy(), pc.list_value_length(batch.column(3)).to_numpy(), entries, batch.column(4).flatten().to_numpy()))
        total, docs = total + len(entries), docs + batch.num_rows
        if total >= postings or docs >= SHARD_DOCS:
            yield made()
            held, total, docs = [], 0, 0
    if held:
        yield made()


def _searched(rows: DataFrame, asked: Queries, top: int, postings: int) -> DataFrame:
    index = _shared.materialize(forward_index(rows, asked.terms), "index")
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(n_docs, holding(index, len(asked.terms)))
    shared = rows.sparkSession.sparkContext.broadcast((asked.held, weight))

    @_shared.worker("lexical_search", trims=True)
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = shared.value
        best = [Best(top) for _ in held]
        for shard in _shards(batches, weight, n_docs, n_terms, postings):
            for terms, found in zip(held, best, strict=True):
                mine = np.zeros(len(weight), dtype=np.int64)
                mine[terms] = 1
                shard.best(terms, mine, found)
        query = np.repeat(np.arange(len(best)), [len(b.found[0]) for b in best])
        score, doc, no_id, row = (np.concatenate(x) for x in zip(*[b.found for b in best], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(score), pa.array(doc, mask=no_id), pa.array(row)], ["query", "score", "doc_id", "_row"])

    return index.where("size(terms) > 0").mapInArrow(search, "query int, score long, doc_id long, _row long")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's best documents with a score above 0.

    Equal scores go by id, NULL ids last, then by stored row; repeated rows are documents each. Rows of
    ``queries`` (item_id, text) with one id are one query with all their terms, each counted once; a NULL or
    empty text has no terms. A document without terms counts in no statistic and is never found. Other columns
    are ignored whatever their names; without documents or queries the result is empty.
    """
    spark = docs.sparkSession
    _shared.set_batches(spark)
    rows, _ = _shared.number_rows(docs, _shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("_row", "doc_id", "text")
    wanted = _shared.materialize(query_terms(queries.select("item_id", F.col("text").cast("string").alias("text"))), "queries")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    kind = dict(queries.dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {kind}, doc_id long, _row long, score long")
    for block in range(blocks):
        found: dict = {}
        own = wanted.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))
        for r in own.toLocalIterator():
            found[r["item_id"]] = np.concatenate([found.get(r["item_id"], np.zeros(0, dtype=np.uint64)), np.array(r["terms"], dtype=np.int64).view(np.uint64)])
        asked = Queries.of(found)
        names = F.broadcast(spark.createDataFrame(list(enumerate(asked.ids)), f"query int, item_id {kind}"))
        out = out.unionByName(_searched(rows, asked, top, postings).join(names, "query").drop("query"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_row")]
    some = Window.partitionBy("item_id", "salt").orderBy(*order)
    near = out.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (
  SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term, n),
w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
r AS (
  SELECT item_id, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
WHERE rank <= 10
"""
