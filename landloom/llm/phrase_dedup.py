"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window that covers it also starts in a
document with a smaller id.

1. Equal texts (by their words) fall into classes; only the smallest id of a class is searched, the other members are
   wholly repeated (or, under one window, wholly kept).
2. Every window has a minimizer, the least hash of its ``GRAM``-word grams. Equal windows have equal minimizers, so only
   windows whose minimizer occurs in two classes can repeat. Their hashes are counted (a partial aggregation) and
   confirm the recurring passages: maximal runs of windows that recur, in the document of smallest id that holds them.
3. Passages are dealt into shards of about ``SHARD_WORDS`` words. A shard's automaton (pyahocorasick, words as numbers)
   holds every aligned phrase of ``WINDOW // 2`` words of its passages: each window contains a whole one. Every document
   that has a confirmed window of a shard's passages streams through its automaton, with the owners of those windows;
   each phrase found in one of their passages is extended left and right word by word, so the result rests on the words
   and not on hashes.
4. Covered words are joined by document and removed.

Scale: hot passages cost one row per document that holds them; a shard that many documents stream through is copied to
as many tasks as their bytes need, while its passages stay bounded. Nothing is gathered by passage.

Defined results for odd input: null texts have no words; ids that are null count as larger than all others and equal to
each other; rows of one id never make each other repeat, and repeated rows get equal results; texts of any length are
searched whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise
from .rolling import prefix, sliding_min, spans, windows

WINDOW = 50
GRAM = 16
SHARD_WORDS = 100_000
#: Bytes of text that stream through one copy of an automaton.
STREAM_BYTES = 4_000_000
_LAST = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def _words(text) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at space and U+0009 to U+000D only


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _minimizers(sums: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The minimizer of every window."""
    return sliding_min(windows(sums, gram), window - gram + 1)


def _profile(window: int, gram: int):
    def run(batches):
        for batch in batches:
            keys, n_words, shas, anchors = [], [], [], []
            for t in batch.column(3):
                words = _words(t.as_py())
                flat = b" ".join(words)
                keys.append(hashlib.blake2b(flat, digest_size=16).digest())
                shas.append(hashlib.sha256(flat).hexdigest())
                n_words.append(len(words))
                anchors.append(np.unique(_minimizers(prefix(_hashes(words)), window, gram)).view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
            at = np.concatenate(([0], np.cumsum([len(x) for x in anchors]))).astype(np.int32)
            flat = np.concatenate(anchors) if anchors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.binary()), pa.array(n_words, pa.int64()), pa.array(shas), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["doc_id", "id", "h", "key", "n_words", "sha", "anchors"],
            )

    return run


def _window_rows(window: int, gram: int):
    """(id, words, anchors that recur) -> (wh, id): hashes of the windows that may repeat."""

    def run(batches):
        for batch in batches:
            out, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, t, vs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                sums = prefix(_hashes(t.as_py().split(b" ")))
                v = _minimizers(sums, window, gram)
                wh = np.unique(windows(sums, window)[np.isin(v, vs.values.to_numpy(zero_copy_only=False).view(np.uint64))])
                out.append(wh)
                ids.append(np.full(len(wh), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(ids))], ["wh", "id"])

    return run


def _passages(window: int):
    """(id, words, confirmed window hashes) -> the passages they make up."""

    def run(batches):
        for batch in batches:
            ids, texts, counts = [], [], []
            for i, t, whs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = t.as_py().split(b" ")
                sums = prefix(_hashes(words))
                for a, b in zip(*spans(np.isin(windows(sums, window), whs.values.to_numpy(zero_copy_only=False).view(np.uint64))), strict=True):
                    ids.append(i)
                    texts.append(b" ".join(words[a : b + window - 1]))
                    counts.append(int(b - a) + window - 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(counts, pa.int64())], ["owner", "words", "n"])

    return run


class Automaton:
    """The passages of one shard, and where they occur in a document."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int):
        import ahocorasick

        self.window, self.phrase = window, window // 2
        self.codes: dict[bytes, int] = {}
        self.passages = []
        at: dict[tuple[int, ...], dict[int, list[tuple[int, int]]]] = {}  # phrase -> owner -> places
        for k, (owner, text) in enumerate(passages):
            codes = [self.codes.setdefault(w, len(self.codes) + 1) for w in text.split(b" ")]
            self.passages.append(np.array(codes, np.int64))
            for o in range(0, len(codes) - self.phrase + 1, self.phrase):
                at.setdefault(tuple(codes[o : o + self.phrase]), {}).setdefault(owner, []).append((k, o))
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, places in at.items():
            self.tree.add_word(phrase, places)
        if at:
            self.tree.make_automaton()
        self.empty = not at

    def covered(self, text: bytes, owners: set[int]) -> list[tuple[int, int]]:
        """Runs (start, end) of words of a document that passages of the owners repeat."""
        if self.empty:
            return []
        codes = [self.codes.get(w, 0) for w in text.split(b" ")]
        d = np.array(codes, np.int64)
        done: dict[tuple[int, int], int] = {}  # passage and diagonal -> how far the document has been compared
        found = []
        for end, places in self.tree.iter(tuple(codes)):
            s = end - self.phrase + 1
            for k, o in chain.from_iterable(places[w] for w in (owners if len(owners) < len(places) else places) if w in places and w in owners):
                if done.get((k, s - o), -1) >= end:
                    continue
                p = self.passages[k]
                back = min(s, o)
                differ = np.flatnonzero(d[s - back : s] != p[o - back : o])
                left = back if len(differ) == 0 else back - 1 - int(differ[-1])
                ahead = min(len(d) - s, len(p) - o)
                differ = np.flatnonzero(d[s : s + ahead] != p[o : o + ahead])
                right = ahead if len(differ) == 0 else int(differ[0])
                done[k, s - o] = s + right - 1
                if left + right >= self.window:
                    found.append((s - left, s + right))
        return found


def _stream(window: int):
    """Rows sorted by (shard, salt, kind): passages (kind 0) build an automaton, documents (kind 1) stream through."""

    def run(batches):
        now, passages, automaton = None, [], None
        for batch in batches:
            ids, starts, ends = [], [], []
            for shard, salt, kind, i, text, owners in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (shard, salt) != now:
                    now, passages, automaton = (shard, salt), [], None
                if kind == 0:
                    passages.append((i, text))
                    continue
                if automaton is None:
                    automaton = Automaton(passages, window)
                for s, e in automaton.covered(text, set(owners)):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "s", "e"])

    return run


def _cut(batches):
    for batch in batches:
        removed, shas = [], []
        for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = text.as_py().split(b" ")
            gone = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                gone[r["s"]] += 1
                gone[r["e"]] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            removed.append(int(len(words) - keep.sum()))
            shas.append(hashlib.sha256(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas)], ["key", "n_removed", "kept_sha256"])


def repeated(docs: DataFrame, id_col: str, window: int, gram: int, shard_words: int, stream_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile of every row, representatives, (key, id, words, runs) of the documents that lose words)."""
    ident = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("id")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), ident, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col("text"))
    base = materialise(
        rows.mapInArrow(_profile(window, gram), "doc_id bigint, id bigint, h bigint, key binary, n_words bigint, sha string, anchors array<bigint>"), "phrase-base"
    )
    reps = base.filter(F.col("n_words") >= window).groupBy("key").agg(F.min(F.struct("id", "h")).alias("rep")).select("key", "rep.id", "rep.h")
    each = base.select("id", "h", F.xxhash64("key").alias("class"), F.explode("anchors").alias("v"))
    twice = each.groupBy("v").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("v")
    cand = each.select("v", "id", "h").join(twice, "v").groupBy("id", "h").agg(F.collect_set("v").alias("vs")).join(reps, ["id", "h"])
    cand = materialise(cand, "phrase-candidates")
    # Texts travel once: those that may repeat, one per class, as words with single spaces.
    texts = rows.select("id", "h", "text").join(cand, ["id", "h"]).select("key", "id", "text", "vs")

    def flat(batches):
        for batch in batches:
            words = pa.array([b" ".join(_words(t.as_py())) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, batch.column(3)], ["key", "id", "words", "vs"])

    texts = materialise(texts.mapInArrow(flat, "key binary, id bigint, words binary, vs array<bigint>"), "phrase-texts")
    # Confirmed windows and the smallest id that holds them.
    seen = materialise(texts.select("id", "words", "vs").mapInArrow(_window_rows(window, gram), "wh bigint, id bigint"), "phrase-windows")
    sure = seen.groupBy("wh").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner <> last").select("wh", "owner")
    sure = materialise(sure, "phrase-confirmed")
    # Which documents stream past which owners' passages: they share a confirmed window.
    meets = materialise(seen.join(sure, "wh").filter("id <> owner").select("id", "owner").distinct(), "phrase-routes")
    drop_table(seen)
    owned = sure.groupBy("owner").agg(F.collect_list("wh").alias("whs"))
    passages = texts.join(owned, F.col("id") == F.col("owner")).select("id", "words", "whs")
    passages = materialise(passages.mapInArrow(_passages(window), "owner bigint, words binary, n bigint"), "phrase-passages")
    total = passages.agg(F.sum("n")).first()[0] or 0
    shard = F.pmod(F.xxhash64("owner"), F.lit(-(-int(total) // shard_words) or 1)).cast("int").alias("shard")
    routes = meets.groupBy("id", shard).agg(F.collect_set("owner").alias("owners"))
    streams = materialise(routes.join(texts.select("id", "words", F.length("words").alias("size")), "id"), "phrase-streams")
    copies = streams.groupBy("shard").agg(F.ceil(F.sum("size") / stream_bytes).cast("int").alias("copies"))
    work = streams.join(copies, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "words", "owners")
    work = work.unionByName(
        passages.select(shard, F.col("owner").alias("id"), "words")
        .join(copies, "shard")
        .select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), "id", "words", F.lit(None).cast("array<bigint>").alias("owners"))
    )
    tasks = int(streams.agg(F.sum("size")).first()[0] or 0) // stream_bytes + 1
    runs = work.repartition(max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_stream(window), "id bigint, s bigint, e bigint")
    runs = runs.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    return base, reps, texts.select("key", "id", "words").join(runs, "id").select("key", "words", "runs")


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    window: int = WINDOW,
    gram: int = GRAM,
    shard_words: int = SHARD_WORDS,
    stream_bytes: int = STREAM_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256."""
    base, reps, lossy = repeated(docs, id_col, window, gram, shard_words, stream_bytes)
    cut = lossy.mapInArrow(_cut, "key binary, n_removed bigint, kept_sha256 string").dropDuplicates(["key"])
    # A table of its own: the last join then has two plain shuffles, and adaptive execution can split a hot text's copies.
    by_class = materialise(reps.select("key", F.col("id").alias("first")).join(cut, "key", "left"), "phrase-done")
    out = base.select("doc_id", "id", "key", "n_words", "sha").join(by_class, "key", "left")
    copy = F.col("first").isNotNull() & (F.col("id") > F.col("first"))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
