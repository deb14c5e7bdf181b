"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized and cut where they exceed a sequence; pieces are dealt to groups of
bounded size by a hash of row and piece numbers, and each group is packed on its own (a
group wastes less than one sequence). A bin is filled greedily with the longest piece that fits, again and again;
then its smallest piece gives way to two unpacked pieces that together fill its gap and
the remaining gap more tightly, as long as such a pair exists.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import _shared

#: Documents of a packing group; more groups, not larger ones, as the input grows.
GROUP_DOCUMENTS = 40_000
#: Pre-tokens whose ids a worker remembers before the table starts afresh.
REMEMBERED = 300_000

#: Characters from here on, and those whose lower case is one of them, need the library's normalization.
BELOW = 0x300
_LEAVING = "".join(chr(c) for c in range(BELOW) if any(ord(x) >= BELOW for x in chr(c).lower()))
#: Texts with none of these normalize character by character and hold no special token.
_UNUSUAL = re.compile(f"[{_LEAVING}{chr(BELOW)}-\U0010ffff]|<\\|")


class WordIds:
    """Ids of whole texts by a tokenizer file whose pre-tokens are encoded independently.

    Distinct pre-tokens go to the library once and their ids are joined; texts with
    characters that need real normalization, or with what may be a special token, go to
    the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        below = [chr(c) for c in range(BELOW)]
        letter = "".join(re.escape(c) for c in below if regex.match(r"\p{L}", c))
        number = "".join(re.escape(c) for c in below if regex.match(r"\p{N}", c))
        space = "".join(re.escape(c) for c in below if regex.match(r"\s", c))
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+").findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words, known = self.split(text.lower()), self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(words)
            known.update(self._encode_words(list(new)))
        return b"".join(map(known.__getitem__, words))

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens. One call for all, as white space parts them and is dropped."""
        found = self.library.encode(" ".join(words), add_special_tokens=False)
        ids, owner = np.array(found.ids, dtype="<u4").tobytes(), np.array(found.word_ids)
        if owner[-1] + 1 != len(words):
            each = self.library.encode_batch(words, add_special_tokens=False)
            return {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(words, each, strict=True)}
        cuts = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        return {w: ids[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}


def word_ids(path: str) -> WordIds:
    return _shared.worker_table("packing", (path,), lambda: WordIds(path))


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False) -> tuple[DataFrame, int]:
    """(doc_id, _row, piece, start, length, ids_crc32[, ids]) of every document; and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_ids(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, length, crc, kept = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                ids = own.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            piece = np.array(piece, dtype=np.int32)
            owner = pa.array(row, pa.int64())
            arrays = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "_row", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    _shared.set_batches(docs.sparkSession)
    rows, n = _shared.number_rows(docs, _shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    schema = "doc_id long, _row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return rows.select("doc_id", "_row", "text").mapInArrow(run, schema), n


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; equal lengths are taken in the order given."""
    order = np.argsort(-lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    free = sum(1 << x for x in stacks)  # bit x: a piece of length x is unpacked
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)

    def longest(most: int) -> int:
        return (free & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(x: int) -> int:
        nonlocal free
        i = stacks[x].pop()
        if not stacks[x]:
            free &= ~(1 << x)
        return i

    def pair(gap: int, least: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum over ``least`` and at most ``gap``."""
        best, x = None, longest(gap - 1)
        while x > 0 and 2 * x > least:
            y = longest(min(x, gap - x))
            if y == x and len(stacks[x]) < 2:
                y = longest(min(x - 1, gap - x))
            if y > 0 and x + y > least:
                best, least = (x, y), x + y
                if least == gap:
                    break
            x = longest(x - 1)
        return best

    count = 0
    while free:
        own, gap = [], capacity
        while (x := longest(gap)) > 0:
            own.append(take(x))
            gap -= x
        while gap > 0 and len(own) > 1:
            small = min(own, key=lambda i: (lengths[i], -i))
            size = int(lengths[small])
            if not (two := pair(gap + size, size)):
                break
            own.remove(small)
            own += [take(two[0]), take(two[1])]
            stacks.setdefault(size, []).append(small)
            free |= 1 << size
            gap += size - sum(two)
        at = 0
        for i in own:
            bins[i], offsets[i] = count, at
            at += int(lengths[i])
        count += 1
    return bins, offsets


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row a piece.

    Only documents longer than ``capacity`` are cut; all their pieces but the last are full.
    A NULL text counts as empty and is its end id alone; repeated rows are packed each; a
    NULL doc_id stays NULL; other columns of the input are ignored whatever their names; an
    empty table gives an empty result.
    """
    pieces, n = tokenized_pieces(docs, path, capacity, end_id, keep_ids)
    # The number of groups follows the input; their size doesn't.
    groups = max(1, -(-n // GROUP_DOCUMENTS))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("_row", "ascending"), ("piece", "ascending")])
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        ids = (key[0].as_py() << 40) + bins
        table = table.drop_columns(["group", "_row"])
        return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    # Rows count by position, so that no group of copies, however large, shares a key.
    keyed = pieces.withColumn("group", F.pmod(F.xxhash64("_row", "piece"), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return keyed.groupBy("group").applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
