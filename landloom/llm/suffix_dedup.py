"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Texts are UTF-8 bytes. Every byte covered by a ``LENGTH``-byte string that also starts anywhere else goes.

1. Equal texts fall into classes; one of a class is searched, and a class of two or more long texts goes whole.
2. A sparse suffix array: only suffixes at minimizers of the first half of each window are kept (the leftmost least
   hash of its ``GRAM``-byte grams). Equal windows have their suffix at the same offset and so share at least ``HEAD``
   bytes after it; suffixes whose head occurs once are left out after a count of head hashes.
3. Every task sorts its suffixes and sends them as front-coded runs (shared-prefix length and the bytes after it), dealt
   by head. The receiver merges a part's runs with a loser tree that carries the length each entry shares with the last
   winner: unequal lengths decide without touching a byte, equal ones compare from there on.
4. The merged order decides what is repeated: the lengths that neighbours share, which the merge yields, and the same
   for the left contexts, tell for every window whether another entry has it (``repeated``). Bytes decide, not hashes.

A part is merged as a stream and looked at in chunks of ``CHUNK`` bytes. A head with more than ``HOT`` suffixes (a suffix
with its context is at most 1.5 x ``LENGTH`` bytes) is dealt to several parts by document, so neither a chunk nor a part
follows the size of a cluster. A cluster longer than a chunk, or dealt to several parts, leaves its windows that are single
within a chunk undecided; those alone are counted by a 128-bit cryptographic digest of their bytes in a second, partially
aggregated step. Front coding reduces equal contexts in a run to a few bytes each.

Defined results for odd input: null texts have no bytes; ids may be null or repeated, repeated rows are repeats of each
other; texts of any length are searched whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .rolling import mix, prefix, sliding_min, spans, windows

LENGTH = 400
GRAM = 16
#: Bytes of text per sorted run, of contexts per chunk of a merge, of contexts per merged part.
RUN_BYTES = 4_000_000
CHUNK = 2_000_000
PART_BYTES = 24_000_000
#: Suffixes of one head that one part may hold.
HOT = 16_000
_LAST = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _head(length: int, gram: int) -> int:
    """Bytes after its suffix position that a window always has: the position lies in the first half."""
    return length - (length // 2 - gram)


def suffixes(text: bytes, length: int, gram: int):
    """(positions, first and last window start of each, head hashes) of the sparse suffixes of one text."""
    n = len(text) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    sums = prefix(_BYTE[np.frombuffer(text, np.uint8)])
    grams = windows(sums, gram)
    width = length // 2 - gram + 1
    # Leftmost minimum: hashes are compared with their low bits replaced by the distance from the block's start, in
    # blocks of 2^16 positions that overlap by the width, so that equal hashes prefer the earlier gram.
    at = np.empty(n, np.int64)
    for b in range(0, n, 49152):
        part = grams[b : b + 49152 + width - 1] & ~np.uint64(0xFFFF) | np.arange(min(len(grams) - b, 49152 + width - 1), dtype=np.uint64)
        low = sliding_min(part, width)[: n - b]
        at[b : b + len(low)] = b + (low & np.uint64(0xFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:] - 1, n - 1)
    pos = at[first]
    head = _head(length, gram)
    heads = mix((sums[pos + head] - sums[pos]) * _inverse(pos))
    return pos, first, last, heads


def _inverse(pos: np.ndarray) -> np.ndarray:
    from .rolling import _grown

    return _grown(int(pos.max()) + 1)[1][pos] if len(pos) else np.zeros(0, np.uint64)


def _profile(length: int, gram: int):
    def run(batches):
        for batch in batches:
            keys, sizes, shas, once, twice = [], [], [], [], []
            for t in batch.column(3):
                b = (t.as_py() or "").encode()
                keys.append(hashlib.blake2b(b, digest_size=16).digest())
                shas.append(hashlib.sha256(b).hexdigest())
                sizes.append(len(b))
                heads, counts = np.unique(suffixes(b, length, gram)[3], return_counts=True)
                once.append(heads[counts == 1].view(np.int64))
                twice.append(heads[counts > 1].view(np.int64))

            def lists(x):
                return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(y) for y in x]))).astype(np.int32)), pa.array(np.concatenate([*x, np.zeros(0, np.int64)])))

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas), lists(once), lists(twice)],
                ["doc_id", "id", "h", "key", "n_bytes", "sha", "once", "twice"],
            )

    return run


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, which are known to agree on the first ``at`` bytes."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 16
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def encode_run(entries: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Sorted (suffix, left context, document, position) -> front-coded block."""
    lcps, tails, lefts, sizes = [], [], [], []
    before, left_before = b"", None
    for suffix, left, _, _ in entries:
        k = shared(before, suffix, 0)
        same = k == len(suffix) == len(before) and left == left_before
        lcps.append(k)
        tails.append(suffix[k:])
        lefts.append(b"" if same else left)
        sizes.append((len(suffix) - k, 65535 if same else len(left)))
        before, left_before = suffix, left
    n = len(entries)
    return b"".join(
        [
            np.array([n], "<u4").tobytes(),
            np.array(lcps, "<u2").tobytes(),
            np.array(sizes, "<u2").tobytes(),
            np.array([(d, p) for _, _, d, p in entries], "<i8").tobytes(),
            b"".join(tails),
            b"".join(lefts),
        ]
    )


def decode_run(block: bytes):
    """Yields (suffix, length shared with the one before, left context, document, position)."""
    n = int(np.frombuffer(block, "<u4", 1)[0])
    at = 4
    lcps = np.frombuffer(block, "<u2", n, at).tolist()
    at += 2 * n
    sizes = np.frombuffer(block, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n
    where = np.frombuffer(block, "<i8", 2 * n, at).reshape(n, 2).tolist()
    at += 16 * n
    left_at = at + int(sizes[:, 0].sum())
    before, left = b"", b""
    for lcp, (tail, size), (doc, pos) in zip(lcps, sizes.tolist(), where, strict=True):
        before = before[:lcp] + block[at : at + tail]
        at += tail
        if size != 65535:
            left = block[left_at : left_at + size]
            left_at += size
        yield before, lcp, left, doc, pos


def merge(runs: list):
    """Loser tree over sorted runs of (suffix, shared with the one before in its run, ...).

    Every loser carries the length that it shares with the winner it lost to; on the way up, the longer length is the
    smaller string, and only equal lengths compare bytes, from that length on.
    """
    k = len(runs)
    heads: list = [None] * k
    lcp = [0] * k
    for i in range(k):
        heads[i] = next(runs[i], None)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)  # the loser's shared length with the winner stays what it is
        m = shared(x[0], y[0], lcp[a])
        if m == len(x[0]) or (m < len(y[0]) and x[0][m] < y[0][m]):
            lcp[b] = m
            return a, b
        lcp[a] = m
        return b, a

    if k == 0:
        return
    if k == 1:
        last = 0
        while heads[0] is not None:
            yield heads[0], (heads[0][1] if last else 0)
            last = 1
            heads[0] = next(runs[0], None)
        return
    tree = [-1] * k  # inner nodes 1 .. k - 1 hold losers
    winners: dict[int, int] = {k + i: i for i in range(k)}
    for node in range(k - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    lcp_out = 0
    while heads[top] is not None:
        yield heads[top], lcp_out
        heads[top] = following = next(runs[top], None)
        lcp[top] = following[1] if following is not None else 0
        node = (k + top) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2
        lcp_out = lcp[top]


def _send(length: int, gram: int, parts: int, run_bytes: int):
    """(id, text, heads that recur with their salts) -> front-coded sorted runs, dealt by head (hot ones by salt too)."""

    def flush(found):
        for part, hot in sorted(found):
            entries = sorted(found[part, hot])
            yield part, hot, entries[0][2], encode_run(entries)

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            found: dict[tuple[int, bool], list] = {}
            size = 0

            def emit():
                for row in flush(found):
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                found.clear()

            for i, t, hs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                b = t.as_py().encode()
                pos, lo, hi, heads = suffixes(b, length, gram)
                known, salts = (hs.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.argsort(known.view(np.uint64))
                known, salts = known.view(np.uint64)[order], salts[order]
                at = np.minimum(np.searchsorted(known, heads), len(known) - 1)
                use = known[at] == heads
                n_salts = salts[at][use]
                dealt = mix(heads[use] + (np.int64(i) % n_salts).astype(np.uint64)) % np.uint64(parts)
                for p, a, z, part, n in zip(pos[use].tolist(), lo[use].tolist(), hi[use].tolist(), dealt.tolist(), n_salts.tolist(), strict=True):
                    found.setdefault((part, n > 1), []).append((b[p : z + length], b[a:p], i, p))
                size += len(b)
                if size >= run_bytes:
                    emit()
                    size = 0
            emit()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["part", "hot", "run", "block"])

    return run


def repeated(entries: list, lcps: np.ndarray, length: int, most: int):
    """(mask, valid): for neighbours of the merged order, whether the window that starts o bytes before entry i's suffix
    also stands at another entry, for every i and every o from 0 to ``most``; and whether entry i has such a window.

    ``lcps[i]`` is what entry i's suffix shares with the one before it. A window at o has ``length - o`` bytes of the
    suffix and o of the left context. The entries that share the former are a run of the merged order, cut where a
    shared prefix is shorter; those that share the latter are a run of the order by reversed context, cut likewise. Two
    windows are equal when both runs are the same. No byte is compared again and nothing is hashed.
    """
    m = len(entries)
    back = [e[2][::-1] for e in entries]
    by_left = np.array(sorted(range(m), key=back.__getitem__), np.int64)
    lcs = np.zeros(m, np.int64)
    for k in range(1, m):
        lcs[k] = shared(back[by_left[k - 1]], back[by_left[k]], 0)
    right_len = np.array([len(e[0]) for e in entries], np.int64)
    left_len = np.array([len(b) for b in back], np.int64)
    mask, valid = np.zeros((m, most + 1), bool), np.zeros((m, most + 1), bool)
    left_run = np.empty(m, np.int64)
    for o in range(most + 1):
        have = (right_len >= length - o) & (left_len >= o)
        valid[:, o] = have
        left_run[by_left] = np.cumsum(lcs < o)
        at = np.flatnonzero(have)
        run = (np.cumsum(lcps < length - o) * (m + 1) + left_run)[at]
        order = np.argsort(run, kind="stable")
        same = run[order][1:] == run[order][:-1]
        mask[at[order], o] = np.append(same, False) | np.append(False, same)
    return mask, valid


def _merge_parts(length: int, gram: int, chunk: int):
    """Blocks sorted by part and heat -> rows (id, s, e, wh, n): repeats (n null), and undecided windows of long clusters."""
    head, most = _head(length, gram), length // 2 - gram

    def batch_of(ids, s, e, hashes, ns):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(hashes, pa.binary()), pa.array(ns, pa.int64())], ["id", "s", "e", "wh", "n"]
        )

    def look(entries, lcps, split):
        mask, valid = repeated(entries, np.array(lcps, np.int64), length, most)
        docs, pos = (np.array([e[k] for e in entries], np.int64) for k in (3, 4))
        # Runs of offsets whose windows are repeated are runs of removed bytes.
        edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        none = [None] * len(row)
        yield batch_of(docs[row], pos[row] - high + 1, pos[row] - low + length, none, none)
        if not split:
            return
        # Undecided windows go on by a 128-bit cryptographic digest of their bytes; a repeated one stands for its like.
        def digest(i, o):
            suffix, _, left, _, _ = entries[i]
            return hashlib.blake2b(left[len(left) - o :] + suffix[: length - o], digest_size=16).digest()

        i, o = np.nonzero(valid & ~mask)
        for a in range(0, len(i), 100_000):
            x, y = i[a : a + 100_000], o[a : a + 100_000]
            start = pos[x] - y
            yield batch_of(docs[x], start, start + length, list(map(digest, x.tolist(), y.tolist())), np.ones(len(x), np.int64))
        i, o = np.nonzero(mask)
        seen: set[bytes] = set()
        for x, y in zip(i.tolist(), o.tolist(), strict=True):
            if lcps[x] == len(entries[x][0]) and x and entries[x - 1][2] == entries[x][2] and len(entries[x - 1][0]) == lcps[x]:
                continue  # the entry before is the same in full and has said so
            seen.add(digest(x, y))
        if seen:
            nothing = [None] * len(seen)
            yield batch_of(nothing, nothing, nothing, sorted(seen), [2] * len(seen))

    def done(blocks, hot):
        entries, lcps, size, split = [], [], 0, hot
        for entry, lcp in merge([decode_run(b) for b in blocks]):
            fresh = lcp < head
            if size >= chunk:
                if fresh:
                    yield from look(entries, lcps, split)
                    entries, lcps, size, split = [], [], 0, hot
                elif size >= 2 * chunk:
                    yield from look(entries, lcps, True)
                    entries, lcps, size, split = [], [], 0, True
            lcps.append(lcp if entries else 0)
            entries.append(entry)
            size += len(entry[0]) + len(entry[2])
        if entries:
            yield from look(entries, lcps, split)

    def run(batches):
        now, blocks = None, []
        for batch in batches:
            for part, hot, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (part, hot) != now:
                    if now is not None:
                        yield from done(blocks, now[1])
                    now, blocks = (part, hot), []
                blocks.append(block.as_py())
        if now is not None:
            yield from done(blocks, now[1])

    return run


def _cut(batches):
    for batch in batches:
        removed, n_spans, shas = [], [], []
        for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            b = text.as_py().encode()
            gone = np.zeros(len(b) + 1, np.int64)
            np.add.at(gone, [r["s"] for r in runs], 1)
            np.add.at(gone, [r["e"] for r in runs], -1)
            away = np.cumsum(gone)[:-1] > 0
            starts, _ = spans(away)
            removed.append(int(away.sum()))
            n_spans.append(len(starts))
            shas.append(hashlib.sha256(np.frombuffer(b, np.uint8)[~away].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas)], ["key", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, run_bytes: int = RUN_BYTES, chunk: int = CHUNK, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ident = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("id")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), ident, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col("text"))
    base = materialise(
        rows.mapInArrow(_profile(length, gram), "doc_id bigint, id bigint, h bigint, key binary, n_bytes bigint, sha string, once array<bigint>, twice array<bigint>"), "suffix-base"
    )
    classes = materialise(base.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("id", "h")).alias("rep")), "suffix-classes")
    reps = classes.select("key", "rep.id", "rep.h")
    which = F.xxhash64("key").alias("class")
    each = base.select("id", "h", which, F.lit(0).alias("again"), F.explode("once").alias("head")).unionByName(
        base.select("id", "h", which, F.lit(1).alias("again"), F.explode("twice").alias("head"))
    )
    recur = each.groupBy("head").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.max("again").alias("again"), F.ceil(F.count("*") / hot).cast("bigint").alias("salts")).filter("a <> b or again = 1").select("head", "salts")
    cand = each.select("head", "id", "h").join(recur, "head").groupBy("id", "h").agg(F.collect_set(F.struct("head", "salts")).alias("heads")).join(reps, ["id", "h"])
    cand = materialise(cand, "suffix-candidates")
    # One class member's text travels; searching uses its own number, since ids may repeat.
    texts = rows.select("id", "h", "text").join(cand, ["id", "h"]).dropDuplicates(["id", "h"]).select("key", F.xxhash64("key").alias("no"), "text", "heads")
    texts = materialise(texts, "suffix-texts")
    n = texts.agg(F.sum(F.size("heads"))).first()[0] or 0
    parts = -(-int(n) * 3 * length // 2 // part_bytes) or 1
    runs = texts.select("no", "text", "heads").mapInArrow(_send(length, gram, parts, run_bytes), "part int, hot boolean, run bigint, block binary")
    sent = runs.repartition(max(1, parts), "part").sortWithinPartitions("part", "hot", "run").select("part", "hot", "block")
    found = materialise(sent.mapInArrow(_merge_parts(length, gram, chunk), "id bigint, s bigint, e bigint, wh binary, n bigint"), "suffix-found")
    open_ = found.filter("n is not null")
    decided = open_.groupBy("wh").agg(F.sum("n").alias("total")).filter("total > 1").select(F.col("wh").alias("d_wh"))
    late = open_.filter("id is not null").join(decided, F.col("wh") == F.col("d_wh")).select("id", "s", "e")
    spans_ = found.filter("n is null").select("id", "s", "e").unionByName(late).groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    cut = texts.select("key", "no", "text").join(spans_, F.col("no") == F.col("id")).select("key", "text", "runs").mapInArrow(_cut, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    # A table of its own, so that the last join has two plain shuffles and adaptive execution can split a hot text's copies.
    by_class = materialise(classes.select("key", "members").join(cut, "key", "left").filter("members > 1 or n_removed is not null"), "suffix-classes-done")
    out = base.select("doc_id", "key", "n_bytes", "sha").join(by_class, "key", "left")
    copy = F.coalesce(F.col("members") > 1, F.lit(False))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
