"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words (repeats included), XXH64 with seed
42; a bit is 1 if set in more than half of the hashes. Two fingerprints link if they differ in at most ``radius`` bits.

Comparison is exact. Different fingerprints only are compared, so any number of copies costs one row. They are dealt
into tiles; a pair of tiles is compared with numpy exclusive-or and bit counts unless the population counts of the two
tiles differ by more than the radius; within a pair (and a tile with itself) the same holds for sub-tiles of like counts. To keep the pairs of tiles from growing with the square of the corpus, tiles are
dealt by bands: two 64-bit words that differ in r bits agree on at least one of r + 1 bands, so tiles need only meet
within a band value and no link is lost. A band value with more than ``tile`` fingerprints is cut by population count
and a hash, and its tiles are compared pair by pair in separate rows. Each comparison emits the links that join its
fingerprints (at most one a fingerprint), never all pairs; components follow from those.

Defined results for odd input: null and empty texts have fingerprint zero, linked like any other; repeated rows share
a fingerprint and a component; null ids are ignored as representatives (a component of only null ids has a null id);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, without
from .components import components

RADIUS = 3
TILE = 4096
#: Fingerprints of a tile that are compared in one table of differences.
SUBTILE = 256
SHINGLE = 3


def majority(hashes: np.ndarray) -> np.ndarray:
    """(n, words) 64-bit hashes -> (words,): a bit is 1 if set in more than half of the n."""
    counts = np.zeros(64 * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), 255):  # bounded, and a count of up to 255 fits a byte, which adds fastest
        part = np.ascontiguousarray(hashes[at : at + 255], dtype="<u8").view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: lower() takes A-Z only, split() the white space above
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([xxh64_intdigest(b" ".join(words), 42)], dtype="<u8")
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.fromiter(
            (xxh64_intdigest(flat[s:e], 42) for s, e in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)),
            dtype="<u8",
            count=len(words) - SHINGLE + 1,
        )
    return int(majority(hashes[:, None])[0])


def _fingerprints(batches):
    for batch in batches:
        # Text by text, so that a batch of very long texts needs no second copy of itself.
        fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, h, fp): h a hash of the text, fp the fingerprint as a signed bigint."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text"), _text_hash().alias("h")).mapInArrow(_fingerprints, "doc_id bigint, h bigint, fp bigint")


def _links(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Links (x, y) that span the near pairs of two tiles: enough of them to join what the tiles join."""
    # Both sides in order of population count and cut into sub-tiles: two words that differ in at most ``radius`` bits have
    # counts that differ by no more, so a sub-tile meets only that stretch of the other side; the rest is skipped.
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    b = a if same else b[np.argsort(np.bitwise_count(b), kind="stable")]
    pa, pb = (np.bitwise_count(x).astype(np.int64) for x in (a, b))
    xs, ys = [], []
    for at in range(0, len(a), SUBTILE):
        rows = a[at : at + SUBTILE]
        lo = max(int(np.searchsorted(pb, pa[at] - radius)), at if same else 0)
        hi = int(np.searchsorted(pb, pa[at + len(rows) - 1] + radius, side="right"))
        near = np.bitwise_count(rows[:, None] ^ b[None, lo:hi]) <= radius
        if same:
            near &= np.arange(at, at + len(rows))[:, None] < np.arange(lo, hi)[None, :]
        i, j = np.nonzero(near)
        xs.append(i + at)
        ys.append(j + lo)
    i, j = np.concatenate(xs), np.concatenate(ys)
    if len(i) == 0:
        return a[:0], b[:0]
    # A forest over the near pairs by union-find keeps at most len(a) + len(b) links.
    shift = 0 if same else len(a)
    parent = list(range(len(a) + (0 if same else len(b))))
    keep = []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (x, y) in enumerate(zip(i.tolist(), (j + shift).tolist(), strict=True)):
        p, q = root(x), root(y)
        if p != q:
            parent[q] = p
            keep.append(k)
    return a[i[keep]], b[j[keep]]


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            left, right, same = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            xs, ys = [], []
            for k in range(batch.num_rows):
                a = left[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = a if same[k] else right[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                x, y = _links(a, b, radius, bool(same[k]))
                xs.append(x)
                ys.append(y)
            x, y = (np.concatenate(z) if z else np.zeros(0, np.uint64) for z in (xs, ys))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp) distinct -> (a, b): links that span all near pairs."""
    bands, width = radius + 1, -(-64 // (radius + 1))
    key = [F.expr(f"shiftrightunsigned(fp, {k * width}) & {(1 << min(width, 64 - k * width)) - 1}") for k in range(bands)]
    banded = fps.select("fp", F.bit_count("fp").alias("pop"), F.posexplode(F.array(*key)).alias("band", "value"))
    size = banded.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1").withColumnsRenamed({"band": "s_band", "value": "s_value"})
    dealt = banded.join(size, (F.col("band") == F.col("s_band")) & (F.col("value") == F.col("s_value")))
    # One tile for a band value of up to `tile` fingerprints, else tiles by population count and hash.
    cut = F.ceil(F.col("n") / tile).cast("int")
    dealt = dealt.withColumn("part", F.when(cut == 1, F.lit(0)).otherwise(F.col("pop") * 1000000 + F.pmod(F.xxhash64("fp"), cut)))
    tiles = dealt.groupBy("band", "value", "part").agg(F.collect_list("fp").alias("fps"), F.min("pop").alias("low"), F.max("pop").alias("high"), F.max("n").alias("n"))
    tiles = materialise(tiles, "simhash-tiles")
    own = tiles.filter(F.size("fps") > 1).select(F.col("fps").alias("l"), F.lit(None).cast("array<bigint>").alias("r"), F.lit(True).alias("same"))
    hot = tiles.filter(F.col("n") > tile)
    left, right = (hot.select("band", "value", *[F.col(c).alias(f"{side}_{c}") for c in ("part", "fps", "low", "high")]) for side in "lr")
    pairs = left.join(right, ["band", "value"]).filter((F.col("l_part") < F.col("r_part")) & (F.col("l_low") - F.col("r_high") <= radius) & (F.col("r_low") - F.col("l_high") <= radius))
    work = own.unionByName(pairs.select(F.col("l_fps").alias("l"), F.col("r_fps").alias("r"), F.lit(False).alias("same")))
    return work.mapInArrow(_compare(radius), "a bigint, b bigint")


def _grouped(fp: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fp, first, root) of the distinct fingerprints."""
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = links(classes.select("fp"), radius, tile)
    roots = components(edges)
    tagged = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return materialise(tagged, "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    fp = materialise(fingerprints(docs, id_col), "simhash-fps")
    tagged = _grouped(fp, radius, tile)
    # Tables of their own: both sides of each join are then plain shuffles, and adaptive execution can split a hot group.
    least = materialise(tagged.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    by_class = materialise(tagged.join(least, "root").select(F.col("fp").alias("c_fp"), "component_id"), "simhash-classes")
    out = fp.join(by_class, F.col("fp") == F.col("c_fp"), "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_later(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The first row of each group, all columns; ``rows`` (doc_id, h, root) has a row for each of ``docs``."""
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))
    best = materialise(rows.groupBy("root").agg(F.min(place).alias("best")).select(F.col("root").alias("b_root"), "best"), "first-rows")
    bad = rows.join(best, F.col("root") == F.col("b_root")).filter(~place.eqNullSafe(F.col("best"))).select("doc_id", "h")
    out = without(docs, bad, {"doc_id": F.col(id_col), "h": _text_hash()})
    # Repeated rows are equal in id and text; only where there are any does the result need a pass over them.
    if rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        out = out.withColumn("_h", _text_hash()).dropDuplicates([id_col, "_h"]).drop("_h")
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of each group of near-duplicates (the smallest id; null ids last, text hash among equal ids), all columns."""
    fp = materialise(fingerprints(docs, id_col), "simhash-fps")
    tagged = _grouped(fp, radius, tile).select(F.col("fp").alias("c_fp"), "root")
    rows = fp.join(tagged, F.col("fp") == F.col("c_fp")).select("doc_id", "h", "root")
    return without_later(docs, rows, id_col)
