"""License scans by diagonal voting.

All rolling word k-gram hashes of every document are joined in Spark to the positions of
those hashes in a small set of license templates. A hit votes for the diagonal
(position in the document - position in the template); votes are counted by diagonal, and a diagonal
with fewer than its template asks for is out. Each document's few diagonals then go with its text to a
verification. The diagonal with the most votes begins a span, each further one joins the span with
the nearest diagonal (a word more or less shifts the rest by one) or begins its own; the words are
compared with the template's along the span's diagonals, and spans that cover enough of it stay.
Where spans overlap, the one that covers most stands. Phrases whose words stand consecutively are
found by the same pass over the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import _shared
from quillgraph.llm.line_dedup import marked

K = 3
#: Diagonals this near belong to one span; so many words may be put in or left out at one place.
NEAR = 8
#: Votes that a diagonal needs: one for each so many grams of the template, ENOUGH at most.
VOTE_GRAMS, ENOUGH = 8, 3
#: A span counts if it covers this share of its template, or LONG words with this density.
COVER, LONG = 0.8, 25
#: Word hashes remembered by a worker before the table starts afresh.
REMEMBERED = 500_000

# Phrases that a label's base places consist of.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses and of the notices that name them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        "SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
        "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
        "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not "
        "be removed or altered from any source distribution.",
    ),
    (
        "bsl",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so",
    ),
    (
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters (folded to lower case), digits and non-ASCII."""
    return text.encode().translate(_FOLD).split()


def rolling_hashes(words: list[bytes], k: int = K) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, as signed integers."""
    if len(words) < k:
        return np.zeros(0, dtype=np.int64)
    known = _shared.worker_table("license_scan", (), dict)
    new = set(words).difference(known)
    if new:
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    h = np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _STEP + h[i : len(h) - k + 1 + i]
    return out.view(np.int64)


def base_places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    out, ends = [], {p[-1] for p in phrases}
    for end in ends:
        at = -1
        while True:
            try:
                at = words.index(end, at + 1)
            except ValueError:
                break
            for phrase, label in phrases.items():
                start = at - len(phrase) + 1
                if start >= 0 and tuple(words[start : at + 1]) == phrase:
                    out.append((start, label))
    return out


def gathered(diagonals: list[tuple[int, int, int, int]], length: int) -> list[list[tuple[int, int, int, int]]]:
    """Groups of one template's (diagonal, low, high, votes), by votes; each group may be one copy.

    A diagonal joins the group with the nearest diagonal, within NEAR and a template's length of it.
    """
    groups: list[list[tuple[int, int, int, int]]] = []
    for one in sorted(diagonals, key=lambda x: (-x[3], x[1], x[0])):
        d, low, high, _ = one
        best = None
        for g in groups:
            away = min(abs(d - x[0]) for x in g)
            reach = max(high, *[x[2] for x in g]) - min(low, *[x[1] for x in g])
            if away <= NEAR and reach <= length + NEAR * len(g) and (best is None or away < best[0]):
                best = away, g
        if best:
            best[1].append(one)
        else:
            groups.append([one])
    return groups


def aligned(words: list[bytes], template: list[bytes], group: list[tuple[int, int, int, int]]) -> tuple[int, int, int]:
    """(first place, end, template words found in order) along the group's diagonals.

    Each diagonal is followed from its hits over equal words, the one with most votes first; words
    of the template and of the text count once.
    """
    found: dict[int, int] = {}
    taken = set()
    for d, low, high, _ in group:
        ways = [range(low, min(high, len(words))), range(low - 1, -1, -1), range(high, len(words))]
        for k, way in enumerate(ways):
            for i in way:
                j = i - d
                equal = 0 <= j < len(template) and words[i] == template[j]
                if k and (not equal or i in taken or j in found):
                    break
                if equal and i not in taken and j not in found:
                    found[j] = i
                    taken.add(i)
    return min(taken, default=0), max(taken, default=-1) + 1, len(found)


def verify(words: list[bytes], diagonals: list[tuple[int, int, int, int, int]], templates: list[tuple[str, list[bytes]]]) -> list[tuple[str, int, int, float]]:
    """(label, start, end, cover) of the spans that hold, from (template, diagonal, low, high, votes).

    A span holds if most of its words are the template's, and these are most of the template or many.
    Of overlapping spans the one with the best cover (then the most words) stands.
    """
    spans = []
    for t in sorted({x[0] for x in diagonals}):
        label, template = templates[t]
        for group in gathered([x[1:] for x in diagonals if x[0] == t], len(template)):
            low, high, matched = aligned(words, template, group)
            cover = matched / len(template)
            if matched >= COVER * (high - low) and (cover >= COVER or matched >= LONG):
                spans.append((cover, matched, low, high, label))
    out: list[tuple[str, int, int, float]] = []
    for cover, _, low, high, label in sorted(spans, key=lambda x: (-x[0], -x[1], x[2], x[4])):
        if all(high <= a or b <= low for _, a, b, _ in out):
            out.append((label, low, high, cover))
    return out


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    ``spans`` lists the verified template spans as (label, start, end, cover), words counted
    from 0, ends exclusive. ``score`` is 1 where a phrase stands, else the best cover of a
    verified span, else 0. A NULL text counts as empty; repeated rows are scanned each; a
    NULL doc_id stays NULL; other columns are ignored whatever their names; an empty table
    gives an empty result. Texts are scanned whole, and no hit is capped.
    """
    spark = docs.sparkSession
    named = {tuple(words_of(p)): label for p, label in (PHRASES if phrases is None else phrases).items()}
    known = [(label, words_of(t)) for label, t in (TEMPLATES if templates is None else templates)]
    grams = [(int(h), t, at) for t, (_, words) in enumerate(known) for at, h in enumerate(rolling_hashes(words))]
    # As large as the templates, whatever the corpus.
    places = F.broadcast(spark.createDataFrame(grams, "gram long, template int, at int"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), batch.column(0)
            for a, b in _shared.by_bytes(texts):
                each = [rolling_hashes(words_of(t)) for t in texts[a:b]]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
                flat = np.concatenate(each) if each else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["_row", "grams"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                base = base_places(words, named)
                spans = verify(words, [(d["template"], d["diagonal"], d["low"], d["high"], d["votes"]) for d in found or []], known)
                own = {label for _, label in base}
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(min((s for s, _ in base), default=None))
                out["last_word"].append(max((s for s, _ in base), default=None))
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | {s[0] for s in spans})))
                out["score"].append(1.0 if base else min(1.0, max((s[3] for s in spans), default=0.0)))
                out["spans"].append([dict(zip(("label", "start", "end", "cover"), s, strict=True)) for s in sorted(spans, key=lambda s: s[1:])])
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], ["doc_id", *out])

    _shared.set_batches(spark)
    rows, _ = _shared.number_rows(docs, _shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    hits = rows.select("_row", "text").mapInArrow(hashes, "_row long, grams array<long>").select("_row", F.posexplode("grams").alias("pos", "gram")).join(places, "gram")
    votes = hits.groupBy("_row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("pos").alias("low"), (F.max("pos") + K).alias("high"), F.count(F.lit(1)).alias("votes"))
    asked = [min(ENOUGH, -(-max(1, len(words) - K + 1) // VOTE_GRAMS)) for _, words in known]
    votes = votes.where(F.col("votes") >= F.get(F.array(*map(F.lit, asked or [1])), F.col("template")))
    # As many as a text has words times the templates, at most.
    found = votes.groupBy("_row").agg(F.collect_list(F.struct("template", "diagonal", "low", "high", "votes")).alias("found"))
    # Written first: Spark then knows its size, and broadcasts it only within its own limit. Beyond it only the
    # texts that a bitmap marks as having diagonals are shuffled; the others are read and scanned where they lie.
    found = _shared.materialize(found, "diagonals")
    near = marked(spark, found)
    some = rows.where(near).join(found, "_row", "left").select("doc_id", "text", "found")
    joined = some.unionByName(rows.where(~near).select("doc_id", "text", F.lit(None).cast(some.schema["found"].dataType).alias("found")))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>"
    return joined.mapInArrow(check, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
