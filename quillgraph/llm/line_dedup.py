"""Line deduplication by winnowing over line hashes.

A document is the sequence of its lines that hold a word. From each line on, the shortest run
of lines with GRAM_WORDS words is a gram; from each line on, the shortest run with
WINDOW_WORDS words is a window, and of the grams inside a window the one with the smallest
hash is a fingerprint. Two places with the same run of WINDOW_WORDS words in whole lines hold
the same window, so they share a fingerprint: this is guaranteed, while long repeated runs of
short lines get only a few. A line of WINDOW_WORDS words is a window on its own.

Each fingerprint hash keeps its first place in stored order; every later place joins that one
place (never each other), the match is extended both ways over equal lines, and what repeats
of GRAM_WORDS words or more is deleted from the later place. First places stay.

Passages that don't keep to lines are found by words (``repeated_words``): winnowing over grams of
GRAM_WORDS words proposes places, since two equal runs of WINDOW_WORDS words hold the same least gram;
every run of WINDOW_WORDS words whose least gram is repeated is then held against all others, and the
words of each that an earlier place holds are deleted, whatever the line breaks. 63 bits of hash decide
on equality there, 64 on that of lines and their grams. Lines and words are hashed in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.llm import _shared

GRAM_WORDS = 25
WINDOW_WORDS = 50
#: Keys that the later rows of one first place are spread over.
SALTS = 16


def lines_of(text: str) -> list[tuple[int, bytes, int]]:
    """(index among all lines, words joined by one space, number of words) of lines with words."""
    out = []
    for i, line in enumerate(text.encode().split(b"\n")):
        if words := line.split():
            out.append((i, b" ".join(words), len(words)))
    return out


def run_ends(words: list[int], least: int) -> list[int]:
    """For each line the last line of the shortest run from it with ``least`` words; -1: none."""
    out, end, total = [], -1, 0
    for i in range(len(words)):
        while total < least and end + 1 < len(words):
            end += 1
            total += words[end]
        out.append(end if total >= least else -1)
        total -= words[i]
    return out


def window_minima(digest: list[int], gram_end: list[int], window_end: list[int]) -> list[int]:
    """Lines whose gram is the least of a window, in order; of equal minima the last is taken. Ends are
    the last lines of runs that stay inside their text, -1: none."""
    chosen: dict[int, None] = {}
    for i, e in enumerate(window_end):
        if e < 0:
            continue
        inside, j = i, i + 1
        while j <= e and 0 <= gram_end[j] <= e:
            if digest[j] <= digest[inside]:
                inside = j
            j += 1
        chosen[inside] = None
    return sorted(chosen)


def winnow(lines: list[bytes], words: list[int], gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> list[tuple[int, int]]:
    """(gram hash, first line) of the fingerprints of one text's lines with words."""
    gram_end, window_end = run_ends(words, gram_words), run_ends(words, window_words)
    hashes, first = word_hashes(pa.array(lines, pa.binary()).cast(pa.string()))
    own = run_hashes(hashes, first[:-1], first[1:])
    held = [i for i, e in enumerate(gram_end) if e >= 0]
    digest = [0] * len(lines)
    for i, h in zip(held, run_hashes(own, np.array(held, dtype=np.int64), np.array([gram_end[i] + 1 for i in held], dtype=np.int64)).tolist(), strict=True):
        digest[i] = h
    return [(digest[i], i) for i in window_minima(digest, gram_end, window_end)]


def equal_runs(own: np.ndarray, other: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs [low, high) where the aligned line hashes agree, of ``least`` words or more."""
    same = np.concatenate(([0], (own == other).view(np.int8), [0]))
    edges = np.diff(same)
    total = np.concatenate(([0], np.cumsum(words)))
    pairs = zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist(), strict=True)
    return [(a, b) for a, b in pairs if total[b] - total[a] >= least]


def cut_text(text: str, cuts: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text without the given runs of word-holding lines, lines cut, words cut)."""
    gone = set()
    for low, high in cuts:
        gone.update(range(low, high))
    held = lines_of(text)
    drop = {held[k][0] for k in gone}
    kept = [line for i, line in enumerate(text.split("\n")) if i not in drop]
    return "\n".join(kept), len(gone), sum(held[k][2] for k in gone)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays; NULL is empty."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    return np.split(column.flatten().to_numpy(), ends[:-1]) if len(ends) else []


def text_hashes(rows: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """One pass over the texts of (_row, text), written as a table: hashes and words of the lines with
    words, grams and first lines of their fingerprints, and grams and first words of the least word grams."""

    @_shared.worker("line_dedup", trims=True)
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, starts, ends = word_bounds(batch.column(1))
            words, first = hashes_within(data, starts, ends), np.searchsorted(starts, offsets)
            begin, line = lines_within(data, first, starts)
            end = np.append(begin[1:], len(words))
            hashes = run_hashes(words, begin, end)
            # Ends may lie beyond a text's last line, or beyond all lines: then a text holds no such run.
            gram_end, window_end = (np.searchsorted(end, begin + n) for n in (gram_words, window_words))
            after = np.repeat(line[1:], np.diff(line))
            grams = np.zeros(len(begin), dtype=np.uint64)
            full = np.nonzero(gram_end < after)[0]
            grams[full] = run_hashes(hashes, full, gram_end[full] + 1)
            at = np.array(window_minima(grams.tolist(), _ends(gram_end, after), _ends(window_end, after)), dtype=np.int64)
            size = np.searchsorted(at, line)
            word_at, word_grams = least_grams(words, first, gram_words, window_words)
            word_size = np.searchsorted(word_at, first)
            inside = word_at - np.repeat(first[:-1], np.diff(word_size))
            columns = [
                _list_array(line, hashes.view(np.int64)),
                _list_array(line, (end - begin).astype(np.int32)),
                _list_array(size, grams[at].view(np.int64)),
                _list_array(size, (at - np.repeat(line[:-1], np.diff(size))).astype(np.int32)),
                _list_array(word_size, word_grams.view(np.int64)),
                _list_array(word_size, inside.astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_row", "hashes", "words", "grams", "at", "word_grams", "word_at"])

    schema = "_row long, hashes array<long>, words array<int>, grams array<long>, at array<int>, word_grams array<long>, word_at array<int>"
    return _shared.materialize(rows.mapInArrow(read, schema), "hashes")


def _ends(end: np.ndarray, after: np.ndarray) -> list[int]:
    return np.where(end < after, end, -1).tolist()


def _list_array(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def repeated_runs(lines: DataFrame, gram_words: int) -> DataFrame:
    """(_row, cuts): runs of lines to delete, with their words, from the table of ``text_hashes``.

    Joins on a first place are salted by the later row: a line that a third of all rows hold is
    spread over SALTS keys, and each first place is there once a salt.
    """

    @_shared.worker("line_dedup", trims=True)
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, low, high, start_word, end_word = [], [], [], [], []
            own, other, words = (_lists(batch.column(n)) for n in ("hashes", "other", "words"))
            for r, start, a, theirs, w in zip(batch.column("_row").to_pylist(), batch.column("start").to_pylist(), own, other, words, strict=True):
                along = slice(start, start + len(theirs))
                total = np.concatenate(([0], np.cumsum(w)))
                for x, y in equal_runs(a[along], theirs, w[along], gram_words):
                    row.append(r)
                    low.append(start + x)
                    high.append(start + y)
                    start_word.append(total[start + x])
                    end_word.append(total[start + y])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *[pa.array(x, pa.int32()) for x in (low, high, start_word, end_word)]], ["_row", "low", "high", "from", "to"])

    prints = lines.select("_row", F.size("hashes").alias("n"), F.explode(F.arrays_zip("grams", "at")).alias("p")).select("_row", "n", F.col("p.grams").alias("gram"), F.col("p.at").alias("at"))
    first = prints.groupBy("gram").agg(F.min(F.struct("_row", "at")).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1").select("gram", "first")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = prints.withColumn("salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
    later = salted.join(first.select("*", salts), ["gram", "salt"]).where(F.struct("_row", "at") > F.col("first"))
    # One row for a pair of documents and a diagonal, however many fingerprints lie on it.
    pairs = later.groupBy("_row", F.col("first._row").alias("first_row"), (F.col("at") - F.col("first.at")).alias("diagonal")).agg(F.max("n").alias("n"))
    shift = F.greatest(F.lit(0), -F.col("diagonal"))
    pairs = _shared.materialize(pairs, "pairs").withColumn("salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
    other = lines.select(F.col("_row").alias("first_row"), F.col("hashes").alias("theirs")).join(pairs.select("first_row").distinct(), "first_row", "left_semi").select("*", salts)
    # Only the part of the first document that lies along the later one travels on.
    length = F.least(F.size("theirs") - shift, F.col("n") - F.greatest(F.lit(0), F.col("diagonal")))
    reach = pairs.join(other, ["first_row", "salt"]).select("_row", F.greatest(F.lit(0), "diagonal").alias("start"), F.slice("theirs", shift + 1, length).alias("other"))
    both = reach.join(lines.select("_row", "hashes", "words"), "_row").select("_row", "start", "other", "hashes", "words")
    runs = both.mapInArrow(extend, "_row long, low int, high int, `from` int, `to` int")
    return runs.groupBy("_row").agg(F.collect_set(F.struct("low", "high", "from", "to")).alias("cuts"))


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.IntegerType()), T.StructField("words", T.IntegerType())])


@F.arrow_udf(_CUT)
def _cut(text: pa.Array, cuts: pa.Array) -> pa.Array:
    out = [
        (t, 0, 0) if not c else cut_text(t, [(x["low"], x["high"]) for x in c])
        for t, c in zip(text.to_pylist(), cuts.to_pylist(), strict=True)
    ]
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.StructArray.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["text", "lines", "words"]
    )


#: An odd factor and its inverse modulo 2^64: words and grams are hashed by differences of running sums.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
#: Rows marked in the bitmaps that keep rows without repeats from being shuffled; beyond, row numbers share bits.
MARKS = 1 << 26
#: Characters hashed at once; words of more than LONG_WORD bytes are hashed by the library instead.
PIECE, LONG_WORD = 1 << 17, 1 << 10
#: Places that a task combines by key before they are shuffled.
COMBINED = 1 << 18

_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([c])) for c in range(256)], dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_FACTOR, PIECE + LONG_WORD + 1), _powers(_INVERSE, PIECE + LONG_WORD + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each text and the last one's end lie in them, starts and ends of
    all words); words are split at ASCII white space and at the borders of texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    none = np.zeros(0, dtype=np.int64)
    if not len(texts):
        return none.astype(np.uint8), np.zeros(1, dtype=np.int64), none, none
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        return none.astype(np.uint8), np.zeros(len(texts) + 1, dtype=np.int64), none, none
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = (data == 32) | (data - np.uint8(9) < 5)
    # A place of ``gap`` lies before each character and at the end: white space or the border of a text.
    gap = np.empty(len(data) + 1, dtype=bool)
    gap[0], gap[1:] = True, space
    gap[offsets[:-1]] = True
    starts = np.flatnonzero(gap[:-1] & ~space)
    gap[:-1], gap[-1] = space, True
    gap[offsets[1:]] = True
    return data, offsets, starts, np.flatnonzero(gap[1:] & ~space) + 1


def hashes_within(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``word_bounds``."""
    out, long = np.zeros(len(starts), dtype=np.uint64), ends - starts > LONG_WORD
    # Pieces of neighbouring words that are all short.
    cuts = np.nonzero(np.diff(starts // PIECE * 2 + long))[0] + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True):
        if a == b:
            continue
        if long[a]:
            out[a:b] = [xxhash.xxh3_64_intdigest(data[x:y].tobytes()) for x, y in zip(starts[a:b], ends[a:b], strict=True)]
            continue
        low, high = starts[a], ends[b - 1]
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[low:high]] * _UP[: high - low], out=total[1:])
        x, y = starts[a:b] - low, ends[a:b] - low
        out[a:b] = _mixed((total[y] - total[x]) * _DOWN[x] + (y - x).astype(np.uint64))
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end)."""
    data, offsets, starts, ends = word_bounds(texts)
    return hashes_within(data, starts, ends), np.searchsorted(starts, offsets)


def lines_within(data: np.ndarray, first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each line with words, first such line of each text and the end)."""
    # A line's number among all; the border of a text begins a line too.
    line = np.searchsorted(np.flatnonzero(data == 10), starts) + np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    return begin, np.searchsorted(begin, first)


def _totals(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sums of the hashes times rising powers, the inverse powers)."""
    n = len(hashes)
    up, down = (_UP[:n], _DOWN[:n]) if n <= len(_UP) else (_powers(_FACTOR, n), _powers(_INVERSE, n))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return total, down


def run_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run [begin, end) of words or lines; runs of more than LONG_WORD by the library."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    total, down = _totals(hashes)
    # An empty run may begin at the end of all.
    out = _mixed((total[end] - total[begin]) * np.append(down, np.uint64(1))[begin] + (end - begin).astype(np.uint64))
    for i in np.flatnonzero(end - begin > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(hashes[begin[i] : end[i]].tobytes())
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row, also across texts."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    total, down = _totals(words)
    return _mixed((total[k:] - total[:-k]) * down[: n - k + 1])


def _of_every(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """The best of every ``span`` neighbours, by runs that double in length."""
    size = 1
    while size < span:
        step = min(size, span - size)
        x = best(x[:-step], x[step:])
        size += step
    return x


def least_grams(words: np.ndarray, first: np.ndarray, gram_words: int, window_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are least in a window inside one text; of equal ones the last."""
    grams = gram_hashes(words, gram_words)
    span = window_words - gram_words + 1
    if len(words) < window_words:
        return np.zeros(0, dtype=np.int64), grams[:0]
    # A gram is chosen if it equals the largest of the minima of the windows that it lies in.
    least = np.where(windows_inside(len(words), first, window_words), _of_every(grams, span, np.minimum), 0)
    around = np.concatenate((np.zeros(span - 1, dtype=np.uint64), least, np.zeros(span - 1, dtype=np.uint64)))
    at = np.nonzero((_of_every(around, span, np.maximum) == grams) & (grams > 0))[0]
    # Of equal minima in a window the last counts: texts with such ties are gone through window by window.
    tied = at[1:][(grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) < span)]
    for t in np.unique(np.searchsorted(first, tied, "right") - 1).tolist():
        views = np.lib.stride_tricks.sliding_window_view(grams[first[t] : first[t + 1] - gram_words + 1], span)[:, ::-1]
        chosen = first[t] + np.unique(np.arange(len(views)) + span - 1 - views.argmin(axis=1))
        at = np.concatenate((at[at < first[t]], chosen, at[at >= first[t + 1]]))
    return at, grams[at]


def windows_inside(n: int, first: np.ndarray, window_words: int) -> np.ndarray:
    """Whether the window from each word on lies inside one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return text[: n - window_words + 1] == text[window_words - 1 :]


def marked(spark: SparkSession, rows: DataFrame):
    """A test whether ``_row`` may be among the rows (bitmaps of MARKS bits at most)."""
    x = F.pmod(F.col("_row"), F.lit(MARKS)) + 1  # buckets hold 1 to 32,768 and so on
    maps = rows.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    bits = np.zeros((max([r["b"] for r in maps], default=1), 4096), dtype=np.uint8)
    for r in maps:
        bits[r["b"] - 1] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bits.ravel())

    @F.arrow_udf("boolean")
    def held(row: pa.Array) -> pa.Array:
        at = row.to_numpy(zero_copy_only=False) % MARKS
        flat = shared.value
        byte = at >> 3
        inside = byte < len(flat)
        return pa.array(inside & ((flat[np.where(inside, byte, 0)] >> (at & 7).astype(np.uint8)) & 1).astype(bool))

    return held("_row")


_PLACES = "key long, _row long, at int"


def _blocks(places: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, rows, words) joined to blocks of about COMBINED places, each sorted by key, row and word."""
    held, n = [], 0

    def joined():
        key, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
        in_order = ((row[1:] > row[:-1]) | ((row[1:] == row[:-1]) & (at[1:] >= at[:-1]))).all()
        order = np.argsort(key, kind="stable") if in_order else np.lexsort((at, row, key))
        return key[order], row[order], at[order]

    for x in places:
        held.append(x)
        n += len(x[0])
        if n >= COMBINED:
            yield joined()
            held, n = [], 0
    if n:
        yield joined()


def _placed(key: np.ndarray, known: np.ndarray, row: np.ndarray, at: np.ndarray, marker: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places as rows. A key's last bit tells known ones, which are dealt by place, as they needn't
    meet others; a marker has no row."""
    spread = _mixed(row.view(np.uint64) * np.uint64(_FACTOR) + at.astype(np.uint64))
    dealt = np.where(known, spread | np.uint64(1), key & ~np.uint64(1)).view(np.int64)
    for s in range(0, len(key), 1 << 16):
        e = s + (1 << 16)
        yield pa.RecordBatch.from_arrays([pa.array(dealt[s:e]), pa.array(row[s:e], mask=marker[s:e]), pa.array(at[s:e].astype(np.int32))], ["key", "_row", "at"])


def _repeated(places: Iterator) -> Iterator[pa.RecordBatch]:
    """Places whose key a block holds twice are known to be repeated; each such key leaves one marker."""
    for key, row, at in _blocks(places):
        new = np.concatenate(([True], key[1:] != key[:-1]))
        twice = np.diff(np.append(np.nonzero(new)[0], len(key))) > 1
        known, marks = np.repeat(twice, np.diff(np.append(np.nonzero(new)[0], len(key)))), np.nonzero(new)[0][twice]
        m = len(marks)
        columns = [np.concatenate((x, x[marks])) for x in (key, row, at)]
        marker = np.concatenate((np.zeros(len(key), dtype=bool), np.ones(m, dtype=bool)))
        yield from _placed(columns[0], np.concatenate((known, np.zeros(m, dtype=bool))), columns[1], columns[2], marker)


def _later(places: Iterator, window_words: int) -> Iterator[pa.RecordBatch]:
    """Places after the first of their key in a block are known to be later ones."""
    for key, row, at in _blocks(places):
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        known = (row > row[first]) | (at >= at[first] + window_words)
        yield from _placed(key, known, row, at, np.zeros(len(key), dtype=bool))


def repeated_words(rows: DataFrame, hashes: DataFrame, runs: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """(_row, places): first words of the windows that an earlier place holds, from rows of (_row, text)
    and their ``text_hashes``.

    Places are ordered by row, then word; in one text a window must not overlap its first place.
    Windows inside one of the ``runs`` of repeated lines are left out: an earlier place holds each of
    them, so none is the first of its kind. Places are combined by key in blocks before each shuffle, so
    a key meets at most one row a block there, however common it is.
    """
    spark = rows.sparkSession

    @_shared.worker("line_dedup", trims=True)
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            row = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy())
            yield batch.column(1).flatten().to_numpy().view(np.uint64), row, batch.column(2).flatten().to_numpy().astype(np.int64)

    @_shared.worker("line_dedup", trims=True)
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            words, first = word_hashes(batch.column(1))
            keys, grams = gram_hashes(words, window_words), gram_hashes(words, gram_words)
            if not len(keys):
                continue
            at = np.repeat(first[:-1], pc.list_value_length(batch.column(2)).to_numpy()) + batch.column(2).flatten().to_numpy()
            # Equal windows have equal least grams, so only windows whose least gram is repeated can be.
            least = _of_every(grams, window_words - gram_words + 1, np.minimum)
            chosen = np.isin(least, grams[at]) & windows_inside(len(words), first, window_words)
            for start, cuts in zip(first.tolist(), batch.column(3).to_pylist(), strict=False):
                for x in cuts or ():
                    chosen[start + x["from"] : max(start + x["from"], start + x["to"] - window_words + 1)] = False
            chosen = np.nonzero(chosen)[0]
            text = np.searchsorted(first, chosen, "right") - 1
            yield keys[chosen], batch.column(0).to_numpy()[text], chosen - first[text]

    found, known = hashes.select("_row", "word_grams", "word_at").mapInArrow(lambda batches: _repeated(grams(batches)), _PLACES), F.col("key").bitwiseAND(1) == 1
    # A marker stands for two places or more.
    weight = F.sum(F.when(F.col("_row").isNull(), 2).otherwise(1)).over(Window.partitionBy("key"))
    twice = found.withColumn("weight", weight).where((known | (F.col("weight") > 1)) & F.col("_row").isNotNull())
    near = _shared.materialize(twice.groupBy("_row").agg(F.collect_list("at").alias("near")), "near")
    # Merge joins at every size: what repeats grows with the corpus, so it is never broadcast.
    around = near.join(runs.hint("merge"), "_row", "left").select("_row", "near", "cuts")
    texts = rows.where(marked(spark, near)).join(around.hint("merge"), "_row").select("_row", "text", "near", "cuts")
    keyed = texts.mapInArrow(lambda batches: _later(windows(batches), window_words), _PLACES)
    first = keyed.withColumn("first", F.min(F.struct("_row", "at")).over(Window.partitionBy("key")))
    later = known | (F.col("_row") > F.col("first._row")) | (F.col("at") >= F.col("first.at") + window_words)
    return first.where(later).groupBy("_row").agg(F.collect_list("at").alias("places"))


def cut_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lines: list[tuple[int, int]], places: np.ndarray, window_words: int) -> tuple[bytes, int, int]:
    """(text without the given runs of lines and windows of words, whole lines cut as ``lines``, words cut).

    A word goes with the white space before the next one of its line; a line whose words all go, goes whole.
    """
    gone = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(gone, places, 1)
    np.add.at(gone, places + window_words, -1)
    gone = np.cumsum(gone)[:-1] > 0
    breaks = np.nonzero(data == 10)[0]
    line = np.searchsorted(breaks, starts)
    first = np.nonzero(np.diff(line, prepend=-1))[0]  # first words of the lines with words
    last = np.append(first[1:], len(line))
    whole = np.unique(np.concatenate([np.arange(a, b) for a, b in lines])) if lines else np.zeros(0, dtype=np.int64)
    for k in whole.tolist():
        gone[first[k] : last[k]] = True
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    until = np.append(starts[1:], len(data))
    until[last - 1] = ends[last - 1]
    np.add.at(edge, starts[gone], 1)
    np.add.at(edge, until[gone], -1)
    # Lines without words left, with their breaks.
    empty = np.minimum.reduceat(gone, first)
    begin, end = np.append(0, breaks + 1)[line[first]][empty], np.append(breaks + 1, len(data))[line[first]][empty]
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    out = data[np.cumsum(edge[:-1]) == 0].tobytes()
    if empty[-1] and line[-1] == len(breaks):
        out = out[:-1]  # the break before a last line that goes
    return out, len(whole), int(gone.sum())


def deduplicate_passages(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc, lines_cut, words_cut) like ``deduplicate_lines``, with passages inside lines cut too.

    Every run of WINDOW_WORDS words that an earlier place of the table holds is deleted, wherever its lines
    break; a line left without words goes whole. ``lines_cut`` counts the lines of repeated lines,
    ``words_cut`` all words. A word's deletion always rests on an equal word at an earlier place.
    """
    _shared.set_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows, _ = _shared.number_rows(docs, whole.alias("doc"))
    text = F.col("doc.text").cast("string")
    plain = rows.select("_row", F.coalesce(text, F.lit("")).alias("text"))
    hashes = text_hashes(plain, gram_words, window_words)
    lines = _shared.materialize(repeated_runs(hashes, gram_words), "runs")
    words = repeated_words(plain, hashes, lines, gram_words, window_words)
    cuts = _shared.materialize(lines.join(words.hint("merge"), "_row", "full"), "cuts")

    @F.arrow_udf(_CUT)
    def cut(text: pa.Array, lines: pa.Array, places: pa.Array) -> pa.Array:
        data, offsets, starts, ends = word_bounds(text)
        first, out = np.searchsorted(starts, offsets), []
        for i, runs in enumerate(lines.to_pylist()):
            a, b, low = first[i], first[i + 1], offsets[i]
            found = places[i].values
            at = np.zeros(0, dtype=np.int64) if found is None else found.to_numpy().astype(np.int64)
            if b > a:
                out.append(cut_words(data[low : offsets[i + 1]], starts[a:b] - low, ends[a:b] - low, [(x["low"], x["high"]) for x in runs or ()], at, window_words))
            else:
                out.append((data[low : offsets[i + 1]].tobytes(), 0, 0))
        done, n, words = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(done, pa.binary()).cast(pa.string()), pa.array(n, pa.int32()), pa.array(words, pa.int32())], ["text", "lines", "words"])

    return _applied(docs, rows, cuts, lambda: cut(F.coalesce(text, F.lit("")), F.col("cuts"), F.col("places")))


def _applied(docs: DataFrame, rows: DataFrame, cuts: DataFrame, cut: Callable[[], Column]) -> DataFrame:
    """(doc, lines_cut, words_cut): rows of (_row, doc) with ``cut`` applied where ``cuts`` has their row.

    Rows that no bitmap marks have no cuts and stay where they are; the others meet their cuts in a merge
    join, as cuts grow with the corpus and are never broadcast. Only rows with cuts pass through Python.
    """
    text, near = F.col("doc.text").cast("string"), marked(rows.sparkSession, cuts)

    def shaped(df: DataFrame, done: Callable[[str, Column], Column]) -> DataFrame:
        fields = [done("text", text).alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
        return df.select(F.struct(*fields).alias("doc"), done("lines", F.lit(0)).alias("lines_cut"), done("words", F.lit(0)).alias("words_cut"))

    joined = rows.where(near).join(cuts.hint("merge").withColumn("touched", F.lit(True)), "_row", "left").withColumn("done", F.when(F.col("touched"), cut()))
    return shaped(rows.where(~near), lambda _, own: own).unionByName(shaped(joined, lambda name, own: F.coalesce(f"done.{name}", own)))


def deduplicate_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc, lines_cut, words_cut): ``doc`` is a struct of the input's columns, its text cut.

    Places are ordered by stored row, then line. Blank lines never match and always stay. A
    document that repeats earlier ones whole keeps its row with what is left of its text. A
    NULL text stays NULL and has no lines; repeated rows are cut but for the first; the
    other columns pass through inside ``doc``, whatever their names; an empty table gives an
    empty result.
    """
    _shared.set_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows, _ = _shared.number_rows(docs, whole.alias("doc"))
    text = F.col("doc.text").cast("string")
    hashes = text_hashes(rows.select("_row", F.coalesce(text, F.lit("")).alias("text")), gram_words, window_words)
    cuts = _shared.materialize(repeated_runs(hashes, gram_words), "cuts")
    return _applied(docs, rows, cuts, lambda: _cut(F.coalesce(text, F.lit("")), F.col("cuts")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc.doc_id", "doc.text", "lines_cut", "words_cut")
