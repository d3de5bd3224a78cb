"""Benchmark decontamination by size-partitioned MinHash containment search [native].

Items are partitioned by size: class c holds those whose number n of distinct five-word shingles lies in [2^c, 2^(c+1)).
A class has its own sketch size and its own candidate threshold r (``needed``): the sketch of an item is its
``floor((1 - t) * n) + r`` smallest shingle hashes (a bottom-k MinHash). A document that contains a share ``t`` of the
item's shingles misses at most ``(1 - t) * n`` of them, so it must hold at least r hashes of the sketch. The search
therefore has no false negatives at any document length, which ordinary MinHash of whole long documents cannot promise for
short items, and large classes ask for several hits, so that a common shingle makes no candidate there. Candidates are then
verified by exact containment of the shingle texts.

Shingles: texts are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, five words each; a text of one to four words has
one shingle, its whole word sequence; a text without words has none and never matches.

Documents hash their shingles inside the row and explode distinct hashes into a join with the sketches. The sketches
are broadcast only while their counted rows stay under ``BROADCAST_ROWS``, the items' shingles (with their text) only while
their counted bytes stay under ``BROADCAST_BYTES``; beyond, the joins shuffle both sides. Only
candidates carry shingle text, and only for the item's own shingles.

Defined results for odd input: null texts have no shingles; a null id is matched like any other value; repeated rows
(same id and text) and repeated items are reported once; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, without, words_of

SHINGLE = 5
CONTAINMENT = 0.8
#: Sketch rows (16 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of item shingles (text, and 40 bytes a row) that may be broadcast.
BROADCAST_BYTES = 32_000_000
#: Hits that a class asks for: one for every so many shingles of its smallest item, one at least.
SHINGLES_PER_HIT = 16


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _shingles(words: str, make) -> Column:
    """``make(list of word columns)`` for each shingle of the array column ``words``."""
    n = F.size(words)
    long = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: make([F.get(words, i + k) for k in range(SHINGLE)]))
    short = F.array(make([F.array_join(words, " ")]))
    return F.when(n >= SHINGLE, long).when(n > 0, short)


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _text(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def item_shingles(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(item_id, iid, n, c, shingle, h): distinct shingles with the item's size and size class."""
    df = items.select(F.col(id_col).alias("item_id"), words_of(_lower(F.col("text"))).alias("w"))
    df = df.withColumn("both", F.array_distinct(_shingles("w", lambda p: F.struct(_hash(p).alias("h"), _text(p).alias("shingle")))))
    df = df.withColumn("n", F.size("both")).withColumn("iid", F.xxhash64("item_id", F.array_join("w", " ")))
    return df.dropDuplicates(["item_id", "iid"]).select(
        "item_id", "iid", "n", F.floor(F.log2("n")).cast("int").alias("c"), F.inline_outer("both").alias("h", "shingle")
    ).filter(F.col("h").isNotNull())


def needed(c: Column) -> Column:
    """Sketch hashes that a document must hold to be a candidate for an item of class ``c``."""
    return F.greatest(F.floor(F.pow(F.lit(2.0), c) / SHINGLES_PER_HIT).cast("int"), F.lit(1))


def sketches(shingles: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The bottom-k sketch of each item by its class: (c, r, iid, h), r the hits it needs.

    An item with fewer distinct hashes than its sketch asks for (two shingles of one hash) needs fewer hits by as many.
    """
    own = shingles.groupBy("iid", "n", "c").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    may_miss = F.floor(F.round((1 - containment) * F.col("n"), 9)).cast("int")
    own = own.withColumn("k", F.least(may_miss + needed(F.col("c")), F.size("hs")))
    return own.select("c", F.greatest(F.col("k") - may_miss, F.lit(1)).alias("r"), "iid", F.explode(F.slice("hs", F.lit(1), F.col("k"))).alias("h"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, n_shingles, n_shared, containment."""
    own = materialise(item_shingles(items, item_col), "decontaminate-items")
    sk = materialise(sketches(own, containment), "decontaminate-sketches")
    keys = sk.select("h").distinct()
    small = sk.count() <= BROADCAST_ROWS
    light = own.agg(F.sum(F.octet_length("shingle") + 40)).first()[0] or 0
    light = light <= BROADCAST_BYTES
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    hashed = d.withColumn("w", words_of(F.lower("t"))).select("doc_id", "t", _shingles("w", _hash).alias("hs"))
    # explode_outer throughout: for explode the optimizer infers a filter on the array's size, pushes it below the
    # projections and so splits the text anew for every shingle. The joins drop the null rows.
    # First the (document, hash) hits alone; texts travel only with documents that have a hit.
    hits = hashed.select("doc_id", F.xxhash64("t").alias("th"), F.explode_outer("hs").alias("h")).join(F.broadcast(keys) if small else keys, "h", "left_semi")
    met = hits.distinct().join(F.broadcast(sk) if small else sk, "h").groupBy("doc_id", "th", "c", "iid", "r").agg(F.count("*").alias("hits"))
    cand = met.filter(F.col("hits") >= F.col("r")).groupBy("doc_id", "th").agg(F.collect_set("iid").alias("iids"))
    cand = materialise(cand, "decontaminate-candidates").select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "iids")
    both = d.withColumn("th", F.xxhash64("t")).join(cand, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")))
    # Exact verification on shingle texts; a repeated row (same id and text) is verified and reported once.
    both = both.dropDuplicates(["doc_id", "th"]).withColumn("w", words_of(F.lower("t")))
    said = both.select("doc_id", "th", "iids", F.explode_outer(F.array_distinct(_shingles("w", _text))).alias("shingle"))
    wanted = own.select("iid", "shingle", "n")
    met = said.join(F.broadcast(wanted) if light else wanted, "shingle").filter(F.array_contains("iids", F.col("iid")))
    shared = met.groupBy("doc_id", "th", "iid", "n").agg(F.count("*").alias("n_shared"))
    shared = shared.filter(F.col("n_shared") >= F.ceil(F.round(containment * F.col("n"), 9)))
    names = own.select("iid", "item_id").distinct()
    return shared.join(F.broadcast(names) if light else names, "iid").select(
        "doc_id", "item_id", F.col("n").cast("bigint").alias("n_shingles"), F.col("n_shared").cast("bigint").alias("n_shared"), (F.col("n_shared") / F.col("n")).alias("containment")
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item (all columns kept)."""
    found = decontaminate(docs, items, id_col, **options).select("doc_id")
    return without(docs, found, {"doc_id": F.col(id_col)})
