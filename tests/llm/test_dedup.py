"""Operators 7, 8 and 10."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import exact_dedup, line_dedup, near_dedup


def test_op8_matches_sql(spark, sf_dir):
    got = exact_dedup.query(spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({exact_dedup.ORACLE})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_op8_corner_cases(odd_docs, no_docs):
    rows = exact_dedup.deduplicate(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    fox = [r for r in rows if r.group_size == 3]
    assert len(fox) == 3 and {r.keep_id for r in fox} == {2} and sum(r.kept for r in fox) == 1  # the longer original
    empty = [r for r in rows if r.group_size == 4]
    assert len(empty) == 4 and {r.keep_id for r in empty} == {6}
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert exact_dedup.deduplicate(no_docs).collect() == []


def test_op8_compares_content_when_digests_collide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = exact_dedup.deduplicate(docs, lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1))
    columns = sorted(short.columns)
    assert sorted(map(tuple, short.select(*columns).collect())) == sorted(map(tuple, exact_dedup.deduplicate(docs).select(*columns).collect()))


def test_op8_keeps_one_row_a_group(odd_docs, no_docs):
    """Also of repeated rows and of rows without an id."""
    kept = exact_dedup.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    norm = lambda t: re.sub("[ \t-\r]", "", t or "")
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(r.text) for r in odd_docs.collect()})
    assert exact_dedup.kept_documents(no_docs).collect() == []


def test_op8_with_a_third_of_all_rows_in_one_group(spark):
    """Without adaptive execution the hot group's rows still don't meet in one task."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the hot text")).otherwise(F.concat(F.lit("t"), F.col("id") % 1500)).alias("text")).repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = exact_dedup.deduplicate(docs)
        rows = out.collect()
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(by) == 6000 and sum(r.kept for r in rows) == len({r.text_sha256 for r in rows}) == 1001
    assert all((by[i].keep_id, by[i].group_size) == (0, 2000) for i in range(0, 6000, 3))
    assert all(by[i].keep_id == min(j for j in range(i % 1500, 6000, 1500) if j % 3) for i in range(1, 6000, 7) if i % 3)
    assert max(sizes) < 6000 / 5


def brute_print(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum((sum(h >> k & 1 for h in hashes) * 2 > len(hashes)) << k for k in range(64))


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius)[0]:
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_op10(spark, sf_dir, texts):
    got = {r.doc_id: r for r in near_dedup.query(spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[c] for c in brute_components(prints, 3)]


@pytest.mark.parametrize("shard_size", [40, 10**6])
def test_shards_and_bounds_lose_no_link(spark, shard_size):
    rng = random.Random(shard_size)
    centres = [rng.getrandbits(64) for _ in range(60)]
    prints = [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for c in centres for _ in range(8)]
    rows = [(i, int(np.uint64(p).view(np.int64)), 1) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "_row long, w0 long, n_shingles long")
    for radius in (0, 3, 14):
        got = {r.node: r.component for r in near_dedup.near_components(df, radius, 1, shard_size).collect()}
        want = brute_components(prints, radius)
        first = {}
        for i, p in enumerate(prints):
            first.setdefault(p, i)
        assert all(got.get(first[p], first[p]) == want[i] for i, p in enumerate(prints))


def test_tasks_of_a_thousand_shards_stay_bounded():
    """Two blocks at most meet in a task, however many visitors a shard has, and no pair is lost."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 1 << 15, dtype=np.uint64)
    points = np.concatenate([base, base ^ (np.uint64(5) << rng.integers(0, 60, 1 << 15, dtype=np.uint64))])[:, None]
    none = np.zeros(len(points), dtype=np.int64)
    tree = near_dedup.VantageTree(points[::8], none[::8], 1024, 3)
    assert tree.leaves == 1024
    at, shard, home = tree.route(points, none)
    visits, homes = (-(-np.bincount(shard[home == own], minlength=tree.leaves) // 64) for own in (False, True))
    task = near_dedup.dealt(at, shard, home, near_dedup._spread(points[at, 0], 1), np.maximum(homes, 1), visits)
    _, which, held = np.unique(np.stack(task[1:4]), axis=1, return_inverse=True, return_counts=True)
    assert held.max() <= 4 * 64
    # The two copies of a print meet in exactly one task.
    keys = np.stack((which, task[0] % (1 << 15)))
    twins = np.unique(keys, axis=1, return_counts=True)
    both = twins[0][1][twins[1] == 2]
    assert len(np.unique(both)) == 1 << 15


@pytest.mark.parametrize("radius", [0, 3, 14])
def test_blocks_lose_no_link(spark, radius):
    """Shards of far more visitors and rows than a block."""
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(80)]
    prints = [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for c in centres for _ in range(8)]
    reps = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)], "node long, w0 long")
    tree = near_dedup.VantageTree(np.array(prints, dtype=np.uint64)[::4, None], np.zeros(160, dtype=np.int64), 8, radius)
    links = near_dedup._links(reps, tree, 1, 7)
    got = {r.node: r.component for r in near_dedup.connected_components(links).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == brute_components(prints, radius)


def test_linker_recursion_equals_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    points = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 60, 300, dtype=np.uint64)) for _ in range(8)])
    linker = near_dedup.Linker(points[:, None], 3)
    linker.alone(np.arange(len(points)))
    linker.forest()
    assert linker.root.tolist() == brute_components(points.tolist(), 3)


@pytest.mark.parametrize("ratio", [0.0, 0.75])
def test_linker_ends_on_equal_fingerprints(ratio):
    sizes = np.arange(1000, 1600)
    linker = near_dedup.Linker(np.zeros((600, 1), dtype=np.uint64), 3, sizes, ratio)
    linker.alone(np.arange(600))
    linker.forest()
    assert set(linker.root.tolist()) == {0}


def test_keep_one_takes_near_copies_and_leaves_others(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    originals = [[word() for _ in range(300)] for _ in range(30)]
    rows = []
    for i, words in enumerate(originals):
        rows.append((i, " ".join(words)))
        for k in range(2):
            changed = list(words)
            for _ in range(2):
                changed[rng.randrange(300)] = word()
            rows.append((1000 + 2 * i + k, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in near_dedup.keep_one(docs).collect()]
    assert len(kept) == 30
    assert len(near_dedup.keep_one(docs, shard_size=20).collect()) == 30


def exact_kept(docs, share=0.8):
    """Ids of (id, text) that are first of their component of exact five-word similarities."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in docs]
    root = list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or both >= share * len(sets[i] | sets[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {docs[i][0] for i in range(len(docs)) if root[i] == i}


def test_keep_one_equals_exact_similarity(spark):
    """Pairs with similarities from 0.6 to 1, at the stage's own settings."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = []
    for i in range(150):
        words = [word() for _ in range(rng.choice([60, 120, 300]))]
        docs.append((2 * i, " ".join(words)))
        # A changed run of c words takes c + 4 of n - 4 shingles from both sides.
        n, c = len(words), rng.randrange(0, len(words) // 4)
        at = rng.randrange(n - c)
        docs.append((2 * i + 1, " ".join([*words[:at], *[word() for _ in range(c)], *words[at + c :]])))
    want = exact_kept(docs)
    assert 170 < len(want) < 280
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in near_dedup.keep_one(df).collect()} == want
    assert {r.doc_id for r in near_dedup.keep_one(df, shard_size=60).collect()} == want


def test_op10_corner_cases(odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert near_dedup.near_duplicates(no_docs).collect() == []
    assert near_dedup.keep_one(no_docs).collect() == []
    assert near_dedup.keep_one(odd_docs).columns == odd_docs.columns


def brute_line_cuts(texts, gram_words, window_words):
    """The definition, document by document, without joins."""
    first, lines, cuts = {}, [], []
    for t in texts:
        held = line_dedup.lines_of(t)
        lines.append(([x[1] for x in held], [x[2] for x in held]))
    prints = [line_dedup.winnow(*x, gram_words, window_words) for x in lines]
    for row, own in enumerate(prints):
        for gram, at in sorted(own, key=lambda p: p[1]):
            first.setdefault(gram, (row, at))
    for row, own in enumerate(prints):
        gone = set()
        for gram, at in own:
            there, pos = first[gram]
            if (there, pos) == (row, at):
                continue
            shift = at - pos
            low = at
            while low - 1 >= 0 and low - 1 - shift >= 0 and lines[row][0][low - 1] == lines[there][0][low - 1 - shift]:
                low -= 1
            high = at
            while high < len(lines[row][0]) and high - shift < len(lines[there][0]) and lines[row][0][high] == lines[there][0][high - shift]:
                high += 1
            if sum(lines[row][1][low:high]) >= gram_words:
                gone.update(range(low, high))
        cuts.append(gone)
    return cuts


def passages(seed, n=80):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 8, 30, 60]))) for _ in range(60)]
    fresh = lambda: " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([2, 10, 40])))
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            a = rng.randrange(55)
            parts += pool[a : a + rng.randrange(1, 6)] if rng.random() < 0.6 else [fresh()]
            parts += [""] * rng.randrange(2)
        docs.append("\n".join(parts))
    return docs + docs[:5]


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_matches_definition(spark, seed):
    docs = passages(seed)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    got = {r.doc["doc_id"]: r for r in line_dedup.deduplicate_lines(df).collect()}
    cuts = brute_line_cuts(docs, line_dedup.GRAM_WORDS, line_dedup.WINDOW_WORDS)
    for i, gone in enumerate(cuts):
        held = line_dedup.lines_of(docs[i])
        want = "\n".join(x for k, x in enumerate(docs[i].split("\n")) if k not in {held[g][0] for g in gone})
        assert (got[i].doc["text"], got[i].lines_cut) == (want, len(gone))
    assert any(cuts)


def test_windows_are_guaranteed():
    """Every run of WINDOW_WORDS words in whole lines holds a fingerprint, in any context."""
    rng = random.Random(7)

    def line():
        n = rng.choice([2, 7, 20, 55])
        return b" ".join(b"%d" % rng.randrange(10**6) for _ in range(n)), n

    for _ in range(60):
        shared = [line() for _ in range(rng.randrange(1, 9))]
        if sum(n for _, n in shared) < line_dedup.WINDOW_WORDS:
            continue
        found = []
        for _ in range(2):
            before, after = [line() for _ in range(rng.randrange(5))], [line() for _ in range(rng.randrange(5))]
            whole = before + shared + after
            found.append({g for g, _ in line_dedup.winnow([x for x, _ in whole], [n for _, n in whole])})
        assert found[0] & found[1]


def test_passages_go_once_and_the_rest_stays(spark):
    passage = " ".join(f"word{i}" for i in range(55))
    rows = [(i, f"own line {i} with a few words\n{passage}\nAnd so on, {i}.") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc["doc_id"], r.doc["text"]) for r in line_dedup.deduplicate_lines(df).collect())
    assert got[0][1] == rows[0][1]
    assert all(t == f"own line {i} with a few words\nAnd so on, {i}." for i, t in got[1:])


def test_op7_corner_cases(odd_docs, no_docs):
    rows = line_dedup.deduplicate_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(set(r.doc.asDict()) == set(odd_docs.columns) for r in rows)
    assert sum(r.doc["text"] is None for r in rows) == 2 and sum(r.lines_cut for r in rows) == 0
    assert line_dedup.deduplicate_lines(no_docs).collect() == []
    twice = line_dedup.deduplicate_lines(odd_docs.unionAll(odd_docs)).collect()
    assert sum(r.lines_cut for r in twice) == 1  # the long line's copy


def brute_words_left(texts, n):
    """Words left per text: those of every n words that an earlier place holds go, in order."""
    first, out = {}, []
    for row, t in enumerate(texts):
        words = t.split()
        gone = set()
        for i in range(len(words) - n + 1):
            there, at = first.setdefault(tuple(words[i : i + n]), (row, i))
            if there < row or i >= at + n:
                gone.update(range(i, i + n))
        out.append([w for i, w in enumerate(words) if i not in gone])
    return out


def test_op7_cuts_passages_inside_lines(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    passages = [[f"p{i}w{j}" for j in range(rng.choice([49, 50, 51, 80, 140]))] for i in range(12)]
    docs = []
    for i in range(120):
        words = fresh(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            words += p[: rng.choice([len(p), 60])] + fresh(rng.randrange(20))
        words = ["same"] * 170 if i % 40 == 9 else words
        docs.append("".join(w + ("\n" if rng.random() < 0.05 else " ") for w in words))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    rows = {r.doc["doc_id"]: r for r in line_dedup.deduplicate_passages(df).collect()}
    lines = {r.doc["doc_id"]: r.lines_cut for r in line_dedup.deduplicate_lines(df).collect()}
    want = brute_words_left(docs, 50)
    assert sum(len(w) for w in want) < sum(len(d.split()) for d in docs) - 3000
    for i, words in enumerate(want):
        if not lines[i]:
            assert rows[i].doc["text"].split() == words and rows[i].words_cut == len(docs[i].split()) - len(words)
    assert sum(not n for n in lines.values()) > 80


def test_op7_over_whole_table(spark, sf_dir, texts):
    rows = line_dedup.query(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    order = sorted(texts)
    cuts = brute_line_cuts([texts[i] or "" for i in order], line_dedup.GRAM_WORDS, line_dedup.WINDOW_WORDS)
    assert {r.doc_id: r.lines_cut for r in rows} == {i: len(c) for i, c in zip(order, cuts, strict=True)}


def test_word_hashes_tell_words_apart():
    """Equal words hash alike wherever they stand, other words differently, also long ones."""
    rng = random.Random(3)
    pool = ["a", "b", "ab", "ba", "é", "日本", "x" * 3000, "x" * 3001, "y" * 1025] + [f"w{i}" for i in range(500)]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "\n", "  ", "\t\r\n"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += ["", " \n ", "end", "next", None, "z" * 300_000 + " tail"]
    hashes, first = line_dedup.word_hashes(line_dedup.pa.array(texts).slice(3))
    words = [(t or "").encode().split() for t in texts[3:]]
    assert np.diff(first).tolist() == [len(w) for w in words]
    by = {}
    for w, h in zip((w for x in words for w in x), hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by) > 500


def test_every_window_holds_a_least_gram():
    rng = random.Random(4)
    for text in ([rng.randrange(3) for _ in range(300)], [7] * 200, [rng.randrange(10**6) for _ in range(400)]):
        words = np.array([line_dedup.xxhash.xxh3_64_intdigest(b"%d" % w) for w in text * 2], dtype=np.uint64)
        first = np.array([0, len(text), 2 * len(text)])
        at, grams = line_dedup.least_grams(words, first, 5, 12)
        every = line_dedup.gram_hashes(words, 5)
        want = {max(range(a, a + 8), key=lambda i: (-int(every[i]), i)) for s in (0, len(text)) for a in range(s, s + len(text) - 11)}
        assert at.tolist() == sorted(want) and (every[at] == grams).all()


def test_op7_with_a_third_of_all_rows_on_one_passage(spark):
    """Without adaptive execution: no task of a join or a window holds the hot passage's rows."""
    passage = " ".join(f"hot{i}" for i in range(60))
    rng = random.Random(8)
    docs = [(i, (f"own{i} begins {passage} and ends {i}" if i % 6 == 0 else f"own line {i}\n{passage}\n" if i % 6 == 1 else " ".join(f"u{rng.randrange(10**9)}" for _ in range(70)))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.doc["doc_id"]: r.doc["text"].split() for r in line_dedup.deduplicate_passages(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for (i, text), words in zip(docs, brute_words_left([t for _, t in docs], 50), strict=True):
        assert got[i] == words
    places = [(np.full(500, 8, dtype=np.uint64), np.arange(500) + 500 * k, np.zeros(500, dtype=np.int64)) for k in range(4)]
    for found in (line_dedup._repeated(iter(places)), line_dedup._later(iter(places), 50)):
        assert sum(k == 8 for b in found for k in b.column(0).to_pylist()) == 1


def test_line_windows_hold_their_least_gram():
    """By the definition, with ends counted naively and few digests, so that there are ties."""
    rng = random.Random(12)
    for _ in range(80):
        words = [rng.choice([1, 2, 5, 9, 30]) for _ in range(rng.randrange(30))]
        n = len(words)
        ends = lambda least: [next((e for e in range(i, n) if sum(words[i : e + 1]) >= least), -1) for i in range(n)]  # noqa: E731, B023
        gram, window = ends(8), ends(20)
        assert (gram, window) == (line_dedup.run_ends(words, 8), line_dedup.run_ends(words, 20))
        digest = [rng.randrange(6) for _ in words]
        inside = [[j for j in range(i, e + 1) if 0 <= gram[j] <= e] for i, e in enumerate(window)]
        want = {max(x, key=lambda j: (-digest[j], j)) for x in inside if x}
        assert line_dedup.window_minima(digest, gram, window) == sorted(want)


def test_one_pass_hashes_each_text_for_itself(spark):
    """What the pass writes is what each text gives alone, whatever its neighbours, also with lines of many words."""
    rng = random.Random(13)
    line = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 4, 26, 60, 1500])))
    texts = ["", " \n\n", "a\r\nb"] + ["\n".join(line() for _ in range(rng.randrange(12))) + rng.choice(["", "\n", " \n"]) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").coalesce(2)
    got = {r._row: r for r in line_dedup.text_hashes(rows, line_dedup.GRAM_WORDS, line_dedup.WINDOW_WORDS).collect()}
    by = {}
    for i, text in enumerate(texts):
        held, r = line_dedup.lines_of(text), got[i]
        lines, words = [x[1] for x in held], [x[2] for x in held]
        assert r.words == words and len(r.hashes) == len(lines)
        for x, h in zip(lines, r.hashes, strict=True):
            assert by.setdefault(x, h) == h
        prints = [(np.uint64(g).astype(np.int64), at) for g, at in line_dedup.winnow(lines, words)]
        assert sorted(zip(r.at, r.grams, strict=True)) == sorted((at, g) for g, at in prints)
        hashes, first = line_dedup.word_hashes(line_dedup.pa.array([text]))
        at, grams = line_dedup.least_grams(hashes, first, line_dedup.GRAM_WORDS, line_dedup.WINDOW_WORDS)
        assert r.word_at == at.tolist() and r.word_grams == grams.view(np.int64).tolist()
    assert len(set(by.values())) == len(by) > 300
