"""Near-duplicate removal by exact Jaccard similarity of word shingles (the pipeline's stage).

Shingles: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, five words each; a text of one to four words has one shingle,
its whole word sequence. Texts are near-duplicates if their sets of shingles (64-bit hashes) have a Jaccard similarity
of at least ``similarity``; a group is a connected component of that relation, and one row of each stays.

Equal sets form one class, so any number of copies costs one comparison. Candidates come from SimHash by tiled exact
comparison, as in ``simhash``: a class's fingerprint is the majority of its set's hashes, ``WORDS`` 64-bit words of it (the
first from the hashes themselves, the others from mixed ones), and two fingerprints are tied if they differ in at most
``radius(similarity)`` bits, and in at most ``HALF`` of that share in the first two words. At 0.8 two texts differ in 39 of
256 bits on average; 78 are allowed, beyond which a pair at exactly 0.8 lies with probability 2e-10, and 2e-6 for sets of 4 and 5
shingles, the widest. Every class meets every other: the tiles (of ``tile_rows`` classes of like set size) are compared in pairs
with exclusive-or and bit counts; what is skipped are classes whose set sizes alone rule the similarity out. So no
pair is lost to bands or buckets, and the comparisons grow with the square of the different texts. The components of the ties
(every candidate pair lies within one) are compared exactly: nothing is linked on fingerprints alone. A component of more than ``tile`` shingles is cut into
tiles by set size and hash, and tiles are compared pair by pair in separate rows unless their sizes rule out the
similarity. A comparison walks from set to set and meets only sets that are not reached yet, so it emits links that
span the near pairs, never all pairs.

Defined results for odd input: null and blank texts share the empty set; repeated rows count as copies; null ids come
last when a row is chosen; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components
from .simhash import _text_hash, majority, without_later

SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint, and classes of a tile of fingerprints.
WORDS = 4
#: Bits the first two words may differ in, for 64 allowed in all.
HALF = 37
TILE_ROWS = 16384
#: Fingerprint pairs compared in one table of differences.
BLOCK = 1 << 16
#: Shingles of a tile (8 bytes each).
TILE = 500_000
#: Rows of a few longs that may be broadcast.
BROADCAST_ROWS = 1_000_000

_SALT = np.random.default_rng(42).integers(0, 1 << 63, WORDS - 1, dtype=np.uint64)
_PRINT = [f"f{k}" for k in range(WORDS)]


def radius(similarity: float = SIMILARITY, words: int = WORDS) -> int:
    """Bits in which fingerprints of sets of that Jaccard similarity may differ."""
    # A bit differs with probability angle / pi; up to 1.25 times that for the smallest sets, whose majorities are coarse.
    p = min(0.5, 1.25 * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)
    return math.ceil(64 * words * p + 4.7 * math.sqrt(64 * words * p * (1 - p)))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = (xxh64_intdigest(flat[s:e], 42) for s, e in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=len(words) - shingle + 1))


def set_print(grams: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of a set of hashes, ``WORDS`` words."""
    mixed = np.empty((len(grams), WORDS), dtype=np.uint64)
    mixed[:, 0] = grams
    for k, salt in enumerate(_SALT, 1):  # the finaliser of SplitMix64
        z = grams ^ salt
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed[:, k] = z ^ z >> np.uint64(31)
    return majority(mixed)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(arrays).view(np.int64))


def _marks(shingle: int):
    def run(batches):
        from xxhash import xxh64_intdigest

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                key, n, prints = [], [], []
                for t in batch.column(1):  # one set at a time
                    grams = shingle_set(t.as_py(), shingle)
                    key.append(xxh64_intdigest(grams.tobytes(), 42))
                    n.append(len(grams))
                    prints.append(set_print(grams))
                words = np.array(prints, dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
                columns = [batch.column(0), batch.column(2), pa.array(np.array(key, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int64()), *map(pa.array, words.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "key", "n", *_PRINT])

    return run


def _sets(shingle: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):  # bounded: the sets of 200 texts
                batch = whole.slice(at, 200)
                grams = _lists([shingle_set(t.as_py(), shingle) for t in batch.column(5)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], grams], ["root", "part", "whole", "key", "n", "grams"])

    return run


def _texts(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text"), _text_hash().alias("h"))


def marks(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, key, n, f0 ...): h a hash of the text, key one of its set of shingles, n the set's size, f its fingerprint."""
    return _texts(docs, id_col).mapInArrow(_marks(shingle), ", ".join(f"{c} bigint" for c in ("doc_id", "h", "key", "n", *_PRINT)))


def spanning(grams: list[np.ndarray], similarity: float, left: int | None = None):
    """Pairs (i, j) that span the near pairs of the sets; with ``left``, of those between the first ``left`` and the rest."""
    n = np.array([len(g) for g in grams], dtype=np.int64)
    ids, owner = np.unique(np.concatenate(grams), return_inverse=True)[1], np.repeat(np.arange(len(grams)), n)
    order = np.argsort(ids, kind="stable")
    holder = owner[order]  # sets by shingle, ascending within one
    first = np.searchsorted(ids[order], np.arange(len(np.unique(ids)) + 1))
    starts = np.concatenate(([0], np.cumsum(n)))
    open_, found = np.ones(len(grams), bool), []
    live, live_ids, live_owner = len(ids), ids, owner  # what open sets hold, thinned as they are reached
    for seed in range(len(grams)):
        if not open_[seed]:
            continue
        open_[seed] = False
        stack = [seed]
        while stack:
            i = stack.pop()
            own = ids[starts[i] : starts[i + 1]]
            if (first[own + 1] - first[own]).sum() < len(live_ids):
                shared = np.bincount(np.concatenate([holder[first[s] : first[s + 1]] for s in own.tolist()] or [holder[:0]]), minlength=len(grams))
            else:
                mark = np.zeros(len(first), bool)
                mark[own] = True
                shared = np.bincount(live_owner[mark[live_ids]], minlength=len(grams))
            near = open_ & (shared > 0) & (shared >= np.round(similarity * (n + n[i] - shared), 9))
            if left is not None:
                near[:left] &= i >= left
                near[left:] &= i < left
            for j in np.flatnonzero(near).tolist():
                open_[j] = False
                found.append((i, j))
                stack.append(j)
                live -= n[j]
            if 2 * live < len(live_ids):
                stay = open_[live_owner]
                live_ids, live_owner = live_ids[stay], live_owner[stay]
    return found


def _compare(similarity: float):
    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                keys, grams, left = [], [], None
                for c in (0, 1):
                    side = batch.column(c)[k].values
                    if side is None:
                        continue
                    keys += side.field("key").to_pylist()
                    lists = side.field("grams")
                    flat, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
                    grams += [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    left = len(keys) if c == 0 else left
                across = batch.column(1)[k].values is not None
                out += [(keys[i], keys[j]) for i, j in spanning(grams, similarity, left if across else None)]
            a, b = ([x[s] for x in out] for s in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _by_size(tile):
    order = np.argsort(tile[1], kind="stable")
    return tuple(x[order] for x in tile)


def near_prints(left, right, similarity: float, most: int):
    """Ties (x, y), keys of two tiles (keys, n, prints), or of one with itself (``right`` None), that span the near fingerprints."""
    same = right is None
    left = _by_size(left)
    right = left if same else _by_size(right)
    keys = left[0] if same else np.concatenate([left[0], right[0]])
    first = 0 if same else len(left[0])
    (_, n, mine), (_, sizes, other) = left, right
    own = [np.ascontiguousarray(other[:, k]) for k in range(WORDS)]
    label, half, out = np.arange(len(keys)), most * HALF // 64, []
    # A set meets only the stretch of sizes that can be as similar.
    start = np.arange(1, len(n) + 1) if same else np.searchsorted(sizes, n * similarity - 1e-6, "left")
    stop = np.searchsorted(sizes, n / similarity + 1e-6, "right")
    at = 0
    while at < len(n):
        lo = int(start[at])
        # As many rows as keep the table within BLOCK at the stretch of the last of them, which may be far longer than the first's.
        end = max(at + 1, bisect.bisect_right(range(len(n) + 1), BLOCK, at + 1, key=lambda e: (e - at) * (int(stop[e - 1]) - lo)) - 1)
        hi = int(stop[end - 1])
        rows = mine[at:end]
        differ = np.bitwise_count(own[0][None, lo:hi] ^ rows[:, :1])
        differ += np.bitwise_count(own[1][None, lo:hi] ^ rows[:, 1:2])
        i, j = np.divmod(np.flatnonzero(differ <= half), max(1, hi - lo))
        total = differ[i, j].astype(np.int64)
        i, j = i + at, j + lo
        for k in range(2, WORDS):
            total += np.bitwise_count(own[k][j] ^ mine[i, k])
        near = (total <= most) & (np.minimum(n[i], sizes[j]) >= similarity * np.maximum(n[i], sizes[j]) - 1e-6)
        if same:
            near &= j > i
        i, j = i[near], j[near] + first
        while len(i):  # one tie for each group that is not joined yet, row by row
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if len(i):
                met = j[i == i[0]]
                old, one = np.unique(label[met], return_index=True)
                out += [(int(keys[i[0]]), x) for x in keys[met[one]].tolist()]
                mark = np.zeros(len(label), bool)
                mark[old] = True
                label[mark[label]] = label[i[0]]
        at = end
    return out


def _tile(side):
    columns = [side.field(c).to_numpy(zero_copy_only=False) for c in ("key", "n", *_PRINT)]
    return columns[0], columns[1], np.stack([c.view(np.uint64) for c in columns[2:]], axis=1)


def _meet(similarity: float):
    most = radius(similarity)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k].values for c in (0, 1))
                out = near_prints(_tile(left), None if right is None else _tile(right), similarity, most)
                yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in out], pa.int64()) for s in (0, 1)], ["a", "b"])

    return run


def _size_class(n, similarity: float):
    """The sizes part the sets: similar ones are in the same size class or in two that touch."""
    return F.floor(F.log(n) / F.log(F.lit(1 / similarity)) + 1e-9).cast("int") if similarity < 1 else n.cast("int")


def ties(own: DataFrame, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): ties between classes that span all pairs of near fingerprints."""
    # Sets too small to be that similar to a different one have no ties.
    able = own.filter(F.col("n") + 1e-9 >= similarity * (F.col("n") + 1)).select("key", "n", *_PRINT).dropDuplicates(["key"]).withColumn("size", _size_class(F.col("n"), similarity))
    able = materialise(able, "copies-prints")
    count = able.groupBy("size").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("cut")).withColumnRenamed("size", "c_size")
    dealt = able.join(F.broadcast(count), F.col("size") == F.col("c_size")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("cut")).cast("int"))
    tiles = dealt.groupBy("size", "part").agg(F.collect_list(F.struct("key", "n", *_PRINT)).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    tiles = materialise(tiles, "copies-print-tiles")
    # Which tiles meet is settled on their names; then each is fetched by its name, so no size class is a key of its own.
    name = [F.col(c) for c in ("size", "part", "low", "high")]
    left, right = (tiles.select(*[c.alias(f"{side}_{x}") for c, x in zip(name, ("size", "part", "low", "high"), strict=True)]) for side in "lr")
    right = right.withColumn("meet", F.explode(F.array(F.col("r_size"), F.col("r_size") - 1)))
    later = (F.col("l_size") < F.col("r_size")) | (F.col("l_part") < F.col("r_part"))
    pairs = left.join(right, F.col("l_size") == F.col("meet")).filter(later & (F.col("l_high") >= F.floor(similarity * F.col("r_low"))))
    pairs = materialise(pairs.select("l_size", "l_part", "r_size", "r_part"), "copies-print-pairs")
    for side, held in (("l", "l"), ("r", "r")):
        other = tiles.select(F.col("size").alias("t_size"), F.col("part").alias("t_part"), F.col("members").alias(held))
        pairs = pairs.join(other, (F.col(f"{side}_size") == F.col("t_size")) & (F.col(f"{side}_part") == F.col("t_part"))).drop("t_size", "t_part")
    inner = tiles.filter(F.size("members") > 1).select(F.col("members").alias("l"), F.lit(None).cast(tiles.schema["members"].dataType).alias("r"))
    return inner.unionByName(pairs.select("l", "r")).mapInArrow(_meet(similarity), "a bigint, b bigint")


def links(docs: DataFrame, own: DataFrame, id_col: str = "doc_id", similarity: float = SIMILARITY, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """Documents and their ``marks`` -> (a, b): links between classes that span all near pairs."""
    roots = materialise(components(ties(own, similarity)), "copies-ties")
    few = roots.count() <= BROADCAST_ROWS
    # One row of each class lends its set; only these rows are cut into sets again, so sets of the rest are never stored.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")
    lender = own.select("key", place.alias("p")).join(F.broadcast(roots) if few else roots, F.col("key") == F.col("node")).groupBy("root", "key").agg(F.min("p").alias("p"))
    lender = lender.withColumn("size", _size_class(F.col("p.n"), similarity))
    lender = materialise(lender.select("root", "size", F.col("key").alias("l_key"), F.col("p.doc_id").alias("l_id"), F.col("p.h").alias("l_h"), "p.n"), "copies-lenders")
    whole = lender.groupBy("root").agg(F.sum("n").alias("whole")).withColumnRenamed("root", "w_root")
    sized = lender.groupBy("root", "size").agg(F.sum("n").alias("sized")).select(F.col("root").alias("s_root"), F.col("size").alias("s_size"), "sized")
    placed = lender.join(whole, F.col("root") == F.col("w_root")).join(sized, (F.col("root") == F.col("s_root")) & (F.col("size") == F.col("s_size")))
    part = F.when(F.col("whole") <= tile, F.lit(0)).otherwise(F.col("size") * 1_000_000 + F.pmod(F.xxhash64("l_key"), F.ceil(F.col("sized") / tile).cast("int")))
    placed = placed.select("root", part.cast("bigint").alias("part"), "whole", "l_key", "n", "l_id", "l_h")
    texts = _texts(docs, id_col)
    lent = texts.join(F.broadcast(placed) if few else placed, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("h") == F.col("l_h")))
    lent = lent.select("root", "part", "whole", "l_key", "n", "text").mapInArrow(_sets(shingle), "root bigint, part bigint, whole bigint, key bigint, n bigint, grams array<bigint>")
    tiles = lent.groupBy("root", "part").agg(F.collect_list(F.struct("key", "grams")).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("whole").alias("whole"))
    tiles = materialise(tiles, "copies-tiles")
    inner = tiles.filter(F.size("members") > 1).select(F.col("members").alias("l"), F.lit(None).cast("array<struct<key:bigint,grams:array<bigint>>>").alias("r"))
    cut = tiles.filter(F.col("whole") > tile)
    left, right = (cut.select("root", *[F.col(c).alias(f"{side}_{c}") for c in ("part", "members", "low", "high")]) for side in "lr")
    fits = (F.col("l_high") >= F.floor(similarity * F.col("r_low"))) & (F.col("r_high") >= F.floor(similarity * F.col("l_low")))
    pairs = left.join(right, "root").filter((F.col("l_part") < F.col("r_part")) & fits).select(F.col("l_members").alias("l"), F.col("r_members").alias("r"))
    return inner.unionByName(pairs).mapInArrow(_compare(similarity), "a bigint, b bigint")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", similarity: float = SIMILARITY, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row of each group of near-duplicates (the smallest id; null ids last, text hash among equal ids), all columns."""
    own = materialise(marks(docs, id_col, shingle), "copies-marks")
    roots = components(links(docs, own, id_col, similarity, shingle, tile))
    rows = own.select("doc_id", "h", "key").join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "h", F.coalesce("root", "key").alias("root"))
    return without_later(docs, materialise(rows, "copies-rows"), id_col)
