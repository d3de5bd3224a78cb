"""The three deduplicators and their parts against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from landloom.llm import near_copies, phrase_dedup, simhash, suffix_dedup
from landloom.llm.components import components

LAST = (1 << 63) - 1


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def check_simhash(got, rows, radius=3):
    fps = sorted({brute_fingerprint(r[1]) for r in rows})
    label = brute_components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius])
    least = {}
    for r in rows:
        if r[0] is not None:
            c = label[brute_fingerprint(r[1])]
            least[c] = min(least.get(c, LAST), r[0])
    want = [(r[0], f"{brute_fingerprint(r[1]):016x}", least.get(label[brute_fingerprint(r[1])])) for r in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_simhash(docs, rows, empty):
    check_simhash(simhash.near_duplicates(docs).collect(), rows)
    check_simhash(simhash.near_duplicates(docs, tile=2).collect(), rows)  # every band value is cut into tiles
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_first(docs, rows, empty):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    groups = {}
    for r in simhash.near_duplicates(docs).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(groups, key=str)
    assert simhash.keep_first(empty).count() == 0


def brute_near(rows, similarity=0.8):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    sets = [grams(r[1]) for r in rows]
    near = [(i, k) for i, a in enumerate(sets) for k, b in enumerate(sets[:i]) if a == b or (a & b and len(a & b) >= round(similarity * len(a | b), 9))]
    groups = {}
    for k, g in brute_components(range(len(rows)), near).items():
        groups.setdefault(g, []).append(rows[k][0])
    return sorted((min(g, key=lambda i: (i is None, i)) for g in groups.values()), key=str)


def test_keep_distinct(spark, docs, rows, empty):
    """The pipeline's stage: copies with a few edits in 100 to 300 words go, which a radius of 3 bits keeps."""
    import corpus_pipeline

    rng = random.Random(9)
    more = list(rows)
    for k in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(100, 300))]
        for c in range(4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), c * len(copy) // 100):
                copy[at] = f"edit{c}"
            more.append((2000 + 10 * k + c, " ".join(copy), *rows[0][2:]))
    df = spark.createDataFrame(more, docs.schema).repartition(3)
    want = brute_near(more)
    for got in (corpus_pipeline.near_duplicates(spark, df, ""), near_copies.keep_distinct(df, tile=300)):  # the second cuts components into tiles
        assert got.columns == df.columns
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == want
    assert simhash.keep_first(df).count() > len(want)
    assert near_copies.keep_distinct(empty).count() == 0


def test_spanning():
    rng = random.Random(4)
    for _ in range(60):
        sets = [set(rng.sample(range(14), rng.randint(0, 12))) for _ in range(rng.randint(2, 14))]
        grams = [np.array(sorted(s), dtype=np.uint64) for s in sets]
        near = [(i, k) for i, a in enumerate(sets) for k, b in enumerate(sets[:i]) if a & b and len(a & b) >= round(0.6 * len(a | b), 9)]
        got = near_copies.spanning(grams, 0.6)
        assert brute_components(range(len(sets)), got) == brute_components(range(len(sets)), near)
        left = len(sets) // 2
        across = [(i, k) for i, k in near if (i < left) != (k < left)]
        assert brute_components(range(len(sets)), near_copies.spanning(grams, 0.6, left)) == brute_components(range(len(sets)), across)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(500, k) for k in range(501, 540)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == brute_components(nodes, edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_phrases(rows, window):
    first = {}
    split = [((r[0] if r[0] is not None else LAST), (r[1] or "").encode().split(), r) for r in rows]
    for i, w, _ in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, LAST), i)
    out = []
    for i, w, r in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def test_phrases(docs, rows, empty):
    got = phrase_dedup.dedup(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_phrases(rows, 50)
    assert sum(r["n_removed"] for r in got) > 1000
    small = phrase_dedup.dedup(docs, window=10, gram=4, shard_words=200, stream_bytes=3000).collect()
    assert sorted(str(tuple(r)) for r in small) == brute_phrases(rows, 10)
    assert phrase_dedup.dedup(empty).count() == 0


def brute_suffixes(rows, length):
    count = {}
    texts = [(r[1] or "").encode() for r in rows]
    for b in texts:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            count[s] = count.get(s, 0) + 1
    out = []
    for r, b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        n_spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(map(str, out))


def test_suffixes(docs, rows, empty):
    got = suffix_dedup.dedup(docs, part_bytes=100_000, run_bytes=20_000).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_suffixes(rows, 400)
    assert sum(r["n_removed"] for r in got) > 5000
    # Shorter strings, runs and chunks: clusters longer than a chunk go through the second step.
    small = suffix_dedup.dedup(docs, length=60, gram=8, part_bytes=50_000, run_bytes=5_000, chunk=500).collect()
    assert sorted(str(tuple(r)) for r in small) == brute_suffixes(rows, 60)
    hot = suffix_dedup.dedup(docs, length=60, gram=8, part_bytes=50_000, run_bytes=5_000, hot=3).collect()  # heads dealt to several parts
    assert sorted(str(tuple(r)) for r in hot) == brute_suffixes(rows, 60)
    assert suffix_dedup.dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=10).map(lambda b: bytes(x % 3 for x in b)), max_size=20), max_size=7))
def test_merge(runs):
    coded = [suffix_dedup.encode_run(sorted((s, b"left", 1, 2) for s in r)) for r in runs if r]
    got = list(suffix_dedup.merge([suffix_dedup.decode_run(c) for c in coded]))
    assert [g[0][0] for g in got] == sorted(s for r in runs for s in r)
    for (a, _), (b, lcp) in zip(got, got[1:], strict=False):
        assert lcp == suffix_dedup.shared(a[0], b[0], 0)


def test_periodic_text(spark):
    rows = [(1, "ab" * 900), (2, "x" * 399), (3, "y" * 401), (4, "abc " * 300)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_suffixes(rows, 400)


def test_copies_by_fingerprint(spark, docs, rows):
    """Candidates of the pipeline's stage are the near fingerprints, all of them, however the tiles are cut."""
    own = near_copies.marks(docs).cache()
    most = near_copies.radius()
    classes = {}
    for r in own.collect():
        f = [r[c] % 2**64 for c in ("f0", "f1", "f2", "f3")]
        if r["n"] >= 4:
            classes[r["key"]] = (r["n"], f)
    # The first word is the fingerprint of op7's rule, over the set of five-word shingles.
    text = max((r[1] or "" for r in rows), key=len)
    grams = near_copies.shingle_set(text).tolist()
    assert int(near_copies.set_print(near_copies.shingle_set(text))[0]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in grams) > len(grams))

    def near(a, b):
        bits = [(x ^ y).bit_count() for x, y in zip(a[1], b[1], strict=True)]
        return sum(bits) <= most and sum(bits[:2]) <= most * near_copies.HALF // 64 and min(a[0], b[0]) >= 0.8 * max(a[0], b[0])

    want = brute_components(classes, [(i, k) for i, a in classes.items() for k, b in classes.items() if i < k and near(a, b)])
    assert len(set(want.values())) < len(want)
    for rows_of_tile in (16384, 3):
        got = [(r["a"], r["b"]) for r in near_copies.ties(own, tile_rows=rows_of_tile).collect()]
        assert brute_components(classes, got) == want


def test_no_near_pair_beyond_the_radius():
    """Pairs at Jaccard 0.8 exactly, of few and of many shingles, are within the radius."""
    rng = np.random.default_rng(3)
    for both, left, right, times in ((4, 0, 1, 2000), (12, 0, 3, 1000), (32, 4, 4, 1000), (400, 50, 50, 200)):
        for _ in range(times):
            h = rng.integers(0, 1 << 63, both + left + right, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, both + left + right, dtype=np.uint64)
            bits = np.bitwise_count(near_copies.set_print(h[: both + left]) ^ near_copies.set_print(np.concatenate([h[:both], h[both + left :]])))
            assert bits.sum() <= near_copies.radius() and bits[:2].sum() <= near_copies.radius() * near_copies.HALF // 64


def test_tiles_of_uneven_stretches_are_compared_in_blocks():
    """A row that meets few sets, before rows that meet many, does not make a table of whole tiles; the ties stay right."""
    import tracemalloc

    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 63, (8000, near_copies.WORDS), dtype=np.uint64)
    prints[5000:5040] = prints[:40] ^ np.uint64(5)
    n = np.array([60] * 10 + [95] * 3990 + [76] * 20 + [100] * 3980)
    keys = np.arange(8000)
    left, right = ((keys[s], n[s], prints[s]) for s in (slice(0, 4000), slice(4000, 8000)))
    most = near_copies.radius()
    tracemalloc.start()
    got = near_copies.near_prints(left, right, 0.8, most)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(map(sorted, got)) == [[k, 5000 + k] for k in range(10, 40)]  # 60 shingles and 100 are never that similar
    assert peak < 100 * near_copies.BLOCK
    empty = tuple(x[:0] for x in left)
    assert near_copies.near_prints(left, empty, 0.8, most) == near_copies.near_prints(empty, right, 0.8, most) == []
