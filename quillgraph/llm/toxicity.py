"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its words and of their beginnings (PREFIXES bytes; they carry
inflected and agglutinated forms), hashed into BUCKETS. The machine adds a weight for every
term and the inner product of two latent vectors for every pair of terms, so a pair such as
an insult beside a group's name can weigh more than its parts do. Pairs cost nothing extra:
sum over pairs <v_i, v_j> = (|sum v_i|^2 - sum |v_i|^2) / 2.

Every bucket that the sample holds is a term of the machine: a term that tells nothing alone may tell
much beside another, so none is chosen or dropped by itself; shrinkage keeps useless ones small.

The model is fitted on a bounded sample of labelled documents (SAMPLE rows, the same on every
run) in one task on an executor; only terms that came to weigh anything travel. Scoring covers all
documents and whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import _shared

#: Labelled documents that the machine is fitted on, at most.
SAMPLE = 20_000
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7)
FACTORS, EPOCHS, BATCH, STEP = 8, 8, 256, 0.5
#: What a vector loses of its length with each step.
SHRINK = 1e-3
#: Words remembered by a worker before its tables start afresh.
REMEMBERED = 200_000

#: ASCII letters fold to lower case; other ASCII but digits parts words.
_FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() and c < 0x80 else 32 for c in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.encode().translate(_FOLD).split())


def term_buckets(word: bytes) -> list[int]:
    out = [zlib.crc32(word) % BUCKETS]
    for n in PREFIXES:
        if len(word) > n:
            out.append(zlib.crc32(word[:n], n) % BUCKETS)
    return out


@dataclass(frozen=True)
class Machine:
    bias: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    factors: np.ndarray  # (terms, FACTORS)

    def margin(self, terms: np.ndarray) -> float:
        v = self.factors[terms]
        total = v.sum(axis=0)
        return self.bias + float(self.weights[terms].sum()) + 0.5 * float(total @ total - (v * v).sum())


def fit_machine(labels: np.ndarray, sizes: np.ndarray, flat: np.ndarray, starts: np.ndarray | None = None, seed: int = 7) -> Machine:
    """Dual averaging on the logistic loss; documents are given as sizes and their buckets in a row
    (or from ``starts`` on).

    A weight leaves zero only as far as its gradients, summed over all batches so far, exceed
    what chance makes of so many terms: sqrt(2 ln terms) standard errors, each sqrt(documents *
    p * (1 - p)) an epoch. The first half of the epochs finds these terms; the second draws them no further and
    fits their weights and vectors together (AdaGrad from a small random start, with shrinkage). The vector of a
    term without a weight joins in once its own sum of gradients exceeds as many standard errors, as many terms
    would fit anything by pairs. Terms without weight and vector aren't kept.
    """
    holding = np.zeros(BUCKETS, dtype=np.int64)
    for s in range(0, len(flat), 1 << 20):
        holding += np.bincount(flat[s : s + (1 << 20)], minlength=BUCKETS)
    chosen = np.nonzero(holding)[0]
    place, holding = np.cumsum(holding > 0, dtype=np.int32) - 1, holding[chosen]
    starts = np.concatenate(([0], np.cumsum(sizes))) if starts is None else starts
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    bias, n = np.log(share / (1 - share)), len(chosen)
    w, start = np.zeros(n, dtype=np.float32), rng.normal(0, 0.01, (n, FACTORS)).astype(np.float32)
    v, gb = start.copy(), 1.0
    # Sums of gradients and of their squares.
    zw, gw = np.zeros(n, dtype=np.float32), np.ones(n, dtype=np.float32)
    zv, gv = np.zeros((n, FACTORS), dtype=np.float32), np.full((n, FACTORS), 1e-8, dtype=np.float32)
    batches, touched, most = max(1, -(-len(labels) // BATCH)), np.zeros(n, dtype=np.int32), 2 * np.log(max(n, 2))
    drawn = np.sqrt(most * share * (1 - share) * holding) / np.minimum(holding, batches)
    half, free, moving = EPOCHS // 2, np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for epoch in range(EPOCHS if n else 0):
        if epoch == half:
            free = w != 0
        order = rng.permutation(len(labels))
        for s in range(0, len(order), BATCH):
            docs = np.sort(order[s : s + BATCH])
            counts = sizes[docs]
            own = np.repeat(np.arange(len(docs)), counts)
            t = place[flat[np.arange(counts.sum()) + np.repeat(starts[docs] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)]]
            by_term = np.argsort(t, kind="stable")
            first = np.nonzero(np.diff(t[by_term], prepend=-1))[0]
            terms, full = t[by_term[first]], counts > 0
            begins = (np.cumsum(counts) - counts)[full]
            total, squares, linear = np.zeros((len(docs), FACTORS)), np.zeros(len(docs)), np.zeros(len(docs))
            if len(begins):
                linear[full] = np.add.reduceat(w[t], begins)
                if epoch >= half:
                    values = v[t]
                    total[full] = np.add.reduceat(values, begins)
                    squares[full] = np.add.reduceat((values * values).sum(axis=1), begins)
            margin = bias + linear + 0.5 * ((total**2).sum(axis=1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[docs]
            gb += slope.sum() ** 2
            bias -= STEP * slope.sum() / np.sqrt(gb)
            if not len(first):
                continue
            owner = own[by_term]
            dw = np.add.reduceat(slope[owner], first)
            zw[terms] += dw
            gw[terms] += dw**2
            touched[terms] += ~free[terms]
            w[terms] = -STEP / np.sqrt(gw[terms]) * _beyond(zw[terms], drawn[terms] * touched[terms])
            if epoch >= half:
                dv = np.add.reduceat((slope[:, None] * total)[owner], first) - v[terms] * dw[:, None]
                zv[terms] += dv
                gv[terms] += dv**2
                error = np.sqrt(gv[terms])
                moving[terms] |= free[terms] | (np.abs(zv[terms]) > np.sqrt(most * (epoch - half + 1)) * error).any(axis=1)
                v[terms] = np.where(moving[terms, None], (1 - SHRINK) * (v[terms] - STEP * dv / error), v[terms])
    v[~moving] = 0
    kept = (w != 0) | (v != 0).any(axis=1)
    return Machine(float(bias), chosen[kept], w[kept].astype(np.float64), v[kept].astype(np.float64))


def _beyond(x: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How far ``x`` lies beyond ``least`` on its side of zero."""
    return np.sign(x) * np.maximum(np.abs(x) - least, 0)


class Scorer:
    def __init__(self, machine: Machine):
        self.machine = machine
        self.place = {int(b): i for i, b in enumerate(machine.buckets)}
        self.seen: set[bytes] = set()
        self.telling: dict[bytes, list[int]] = {}

    def score(self, text: str) -> float:
        words = words_of(text)
        new = words - self.seen
        if new:
            if len(self.seen) + len(new) > REMEMBERED:
                self.seen.clear()
                self.telling.clear()
                new = words
            for word in new:
                if terms := [self.place[b] for b in term_buckets(word) if b in self.place]:
                    self.telling[word] = terms
            self.seen |= new
        terms = {t for word in words & self.telling.keys() for t in self.telling[word]}
        margin = self.machine.margin(np.array(sorted(terms), dtype=np.int64))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def _scorer(packed: tuple[float, bytes, bytes, bytes]) -> Scorer:
    bias, buckets, weights, factors = packed
    v = np.frombuffer(factors).reshape(-1, FACTORS)
    return Scorer(Machine(bias, np.frombuffer(buckets, dtype=np.int64), np.frombuffer(weights), v))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning; a NULL id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents outside the held-out fold (NULL texts count as empty).

    Repeated labels of a document count once (toxic if any says so); labels without an id or a value
    and documents without an id teach nothing, and of documents with one id one text does. Other
    columns are ignored whatever their names. Without a label (or with empty tables), or with a
    single class, the machine is a bias alone.
    """
    usable = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    one = usable.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @_shared.worker("toxicity")
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({b for w in words_of(t) for b in term_buckets(w)}) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    @_shared.worker("toxicity", trims=True)
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), pa.compute.list_value_length(b.column(2)).to_numpy(), b.column(2).flatten().to_numpy()) for b in batches]
        if not held:
            return
        ids, labels, sizes, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        # The same order of documents on every run; their terms stay where they are.
        order, starts = np.argsort(ids, kind="stable"), np.cumsum(sizes) - sizes
        machine = fit_machine(labels[order].astype(np.int64), sizes[order], flat, starts[order])
        rows = [[machine.bias], [machine.buckets.astype(np.int64).tobytes()], [machine.weights.tobytes()], [machine.factors.tobytes()]]
        kinds = [pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["bias", "buckets", "weights", "factors"])

    _shared.set_batches(docs.sparkSession)
    # The chosen labels are SAMPLE rows of two numbers at most, so they may be broadcast; a
    # document takes part once, also if its row is repeated.
    rows = docs.select(_shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    joined = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    features = joined.mapInArrow(terms, "doc_id long, toxic int, terms array<int>").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.max("terms").alias("terms"))
    # One task: SAMPLE rows, whatever the table.
    model = features.repartition(1).mapInArrow(learn, "bias double, buckets binary, weights binary, factors binary").collect()
    if not model:
        return Machine(-5.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    r = model[0]
    return Machine(r["bias"], np.frombuffer(bytes(r["buckets"]), np.int64), np.frombuffer(bytes(r["weights"])), np.frombuffer(bytes(r["factors"])).reshape(-1, FACTORS))


def scorer(machine: Machine) -> Callable[[Column], Column]:
    """A column function from text to the probability that it is toxic."""
    packed = (machine.bias, machine.buckets.tobytes(), machine.weights.tobytes(), machine.factors.tobytes())

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        own = _shared.worker_table("toxicity", packed, lambda: _scorer(packed)).score
        return pa.array([own(t) for t in text.to_pylist()], pa.float64())

    return lambda text: score(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row a document.

    A NULL text counts as empty and gets the bias's score. Repeated rows are scored each; a
    NULL doc_id stays NULL and is held out; other columns (labels, lang, source) take no part
    whatever their names; an empty table gives an empty result. Texts are read whole.
    """
    _shared.set_batches(docs.sparkSession)
    narrow = docs.select(_shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    scored = narrow.select("doc_id", scorer(machine)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
