"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Sizes (words) per source and shard, one partial aggregation over the documents.
2. Targets: sources share all words by weight; a target stops at ``max_repeats`` times its source's size and the
   excess goes to the others by weight until none is above (water-filling, closed form over the sorted sources).
3. A source's words are taken ``floor(target / size)`` times whole; the rest is taken in equal-token blocks. Shards are
   the seats' claimants: the number of blocks to take is apportioned over the source's shards by highest quotients
   ``blocks / (2 k + 1)``, which gives integer quotas.
4. In each shard the documents stand in seeded hash order, their words are cut into blocks of ``block`` words, and the
   quota's blocks of lowest seeded hash are taken. A document's taken words are its whole passes plus its overlap with
   taken blocks, so no document exceeds ``max_repeats`` times its size.

Scale: a source has as many shards as its size needs (``shard_words`` each), so a hot source is many small windows.
Quotas are exact for any votes and bounds: aggregates close in on the divisor, and only the seats near it are ranked, a
few a claimant. Two things stand in one task: the rank of a source's shards (a row a million words) and the targets (a row
a source). The driver holds a row a source. The table of sources and shards is tiny beside the documents.

Defined results for odd input: null text has size 0 and takes 0; a null source is a source of its own, last in order;
repeated rows are separate documents and equal ones take equal shares of the order (row order breaks ties by id and
text hash, so reruns agree); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, materialise

#: Production parameters.
BLOCK = 128
SHARD_WORDS = 1_000_000
MAX_REPEATS = 3
SEED = "mix-1"
#: Blocks that one task chooses from, about.
BLOCKS_PER_TASK = 200_000


def _size(text):
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(WS)) + 1).cast("bigint")


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> adds weight and target. Sources by code point, null last, weigh 1, 2, 3, repeating."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", max_repeats * F.col("source_size"))
    # Sources by cap / weight: those whose cap lies under the common level stop there, and they are a prefix.
    by = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    ranked = ranked.withColumn("open", F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level")))
    level = F.first("open", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("common", level)
    return ranked.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


#: Divisors tried at once for every group, and how many seats a claimant may leave open to ranking.
_TRIES, _OPEN = 32, 2


def _seats(votes, most, divisor):
    """Seats of a claimant whose quotients votes / (2 k + 1) reach the divisor."""
    return F.least(F.floor((votes / divisor + 1) / 2).cast("bigint"), most)


def _divisors(live: DataFrame, group: list[str]) -> list[tuple]:
    """(group, low, high) with the divisor that fills a group's seats between low and high, so close that they differ by
    few seats a claimant. The driver holds a row a group (a source); claimants are only ever aggregated."""
    first = live.groupBy(*group).agg(
        F.min(F.col("votes") / (2 * F.col("most") - 1)).alias("_least"), F.max("votes").alias("_top"), F.count("*").alias("_n"), F.sum("most").alias("_all"), F.max("seats").alias("_seats")
    )
    state = {tuple(r[g] for g in group): [r["_least"] * (1 - 1e-9), 2.0 * r["_top"], r["_all"], 0, r["_seats"], r["_n"]] for r in first.collect()}
    for s in state.values():
        if s[4] >= s[2]:  # all get all they may have
            s[1], s[3] = s[0], s[2]
    kinds = [live.schema[g] for g in group]
    while True:
        open_ = {k: s for k, s in state.items() if s[2] - s[3] > _OPEN * s[5] + 1024 and s[1] > s[0] * (1 + 1e-13)}
        if not open_:
            return [(*k, s[0], s[1]) for k, s in state.items()]
        tries = [(*k, [s[0] * (s[1] / s[0]) ** (j / (_TRIES + 1)) for j in range(1, _TRIES + 1)]) for k, s in open_.items()]
        names = [f"t_{g}" for g in group]
        t = live.sparkSession.createDataFrame(tries, T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, kinds, strict=True)), T.StructField("tries", T.ArrayType(T.DoubleType()))]))
        each = live.join(t, _same(group, names)).select(*group, "votes", "most", F.explode("tries").alias("q"))
        for r in each.groupBy(*group, "q").agg(F.sum(_seats(F.col("votes"), F.col("most"), F.col("q"))).alias("won")).collect():
            s = state[tuple(r[g] for g in group)]
            if r["won"] >= s[4] and r["q"] > s[0]:
                s[0], s[2] = r["q"], r["won"]
            if r["won"] <= s[4] and r["q"] < s[1]:
                s[1], s[3] = r["q"], r["won"]


def _same(left: list[str], right: list[str]):
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def quotas(claims: DataFrame, group: list[str], claimant: list[str]) -> DataFrame:
    """Sainte-Laguë by highest quotients: (group, claimant, votes, most, seats per group) -> quota per claimant.

    Seat k of a claimant (from 0) has the quotient votes / (2 k + 1); ``most`` bounds a claimant's seats, and seats that it
    may not have go to the next quotients. A few rounds of aggregates close in on the divisor at which a group's seats are
    filled; seats with clearly higher quotients are won, and only those near it are ranked: rows stay in proportion to
    claimants, not to seats. Claimants without votes win none; if the seats are more than all may have, all get ``most``.
    """
    claims = materialise(claims, "mix-claims")
    live = claims.filter("votes > 0 and most > 0 and seats > 0")
    kinds = [claims.schema[g] for g in group]
    names = [f"d_{g}" for g in group]
    fields = [*(T.StructField(n, f.dataType) for n, f in zip(names, kinds, strict=True)), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    near = claims.sparkSession.createDataFrame(_divisors(live, group), T.StructType(fields))
    near = live.join(near, _same(group, names)).drop(*names)
    # A seat to either side more, so that rounding in the count decides nothing.
    near = near.withColumn("sure", F.greatest(_seats(F.col("votes"), F.col("most"), F.col("high")) - 1, F.lit(0)))
    near = near.withColumn("top", F.least(_seats(F.col("votes"), F.col("most"), F.col("low")) + 1, F.col("most")))
    taken = near.groupBy(*group).agg(F.sum("sure").alias("taken")).withColumnsRenamed({g: f"d_{g}" for g in group})
    ranked = near.join(taken, _same(group, names)).withColumn("seat", F.explode(F.when(F.col("top") > F.col("sure"), F.sequence(F.col("sure"), F.col("top") - 1)).otherwise(F.array(F.col("most")))))
    able = F.col("seat") < F.col("most")
    quotient = F.when(able, F.col("votes") / (2 * F.col("seat") + 1))
    per = Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), F.col("votes").desc(), *claimant)
    won = (able & (F.row_number().over(per) <= F.col("seats") - F.col("taken"))).cast("bigint")
    ranked = ranked.withColumn("won", won).groupBy(*group, *claimant).agg((F.max("sure") + F.sum("won")).alias("quota"))
    keys = [*group, *claimant]
    ranked = ranked.withColumnsRenamed({k: f"d_{k}" for k in keys})
    return claims.join(ranked, _same(keys, [f"d_{k}" for k in keys]), "left").select(*keys, F.coalesce("quota", F.lit(0)).cast("bigint").alias("quota"))


def _row_key(id_col: str, seed: str):
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.coalesce("text", F.lit("")))


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, key, size, source_size, target, passes, and ``parts``, the word ranges taken once more."""
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        _size(F.col("text")).alias("size"),
        _row_key(id_col, seed).alias("key"),
    )
    d = materialise(d, "mix-sizes")  # no text from here on
    sources = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(sources, max_repeats), "mix-targets")
    goal = goal.withColumn("n_shards", F.ceil(F.greatest("source_size", F.lit(1)) / shard_words).cast("bigint")).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("bigint")
    )
    g = goal.withColumnRenamed("source", "g_source")
    d = d.join(g, F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_source")
    d = d.withColumn("shard", F.pmod(F.col("key"), F.col("n_shards")))
    order = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size")
    d = d.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shards = d.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    # Full blocks and a last one that may be short; it counts as a block, so a source lands within a block a shard.
    shards = materialise(shards.withColumn("blocks", F.ceil(F.col("words") / block).cast("bigint")).filter(F.col("blocks") > 0), "mix-shards")
    # Blocks to sources by their remaining words, then a source's blocks to its shards: integer quotas both times.
    per_source = shards.groupBy("source").agg(F.sum("blocks").alias("most")).join(g, F.col("source").eqNullSafe(F.col("g_source")))
    per_source = per_source.select(F.lit(0).alias("all"), "source", "most", (F.col("target") - F.col("passes") * F.col("source_size")).alias("votes"))
    per_source = per_source.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy("all")) / block).cast("bigint"))
    to_source = quotas(per_source, ["all"], ["source"]).select(F.col("source").alias("q_source"), F.col("quota").alias("seats"))
    per_shard = shards.join(to_source, F.col("source").eqNullSafe(F.col("q_source"))).select("source", "shard", F.col("words").alias("votes"), F.col("blocks").alias("most"), "seats")
    q = quotas(per_shard, ["source"], ["shard"]).join(
        shards.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "blocks"),
        F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")),
    )
    # Seeded choice: the quota's blocks of lowest hash in each shard, as a sorted list (a shard has few blocks).
    tasks = max(1, -(-int(shards.agg(F.sum("blocks")).first()[0] or 0) // BLOCKS_PER_TASK))
    chosen = q.repartition(tasks, "source", "shard").select("source", "shard", "quota", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    chosen = chosen.withColumn(
        "r", F.row_number().over(Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0")), "shard", "b"), "b"))
    ).filter(F.col("r") <= F.col("quota"))
    chosen = chosen.select(F.col("source").alias("b_source"), F.col("shard").alias("b_shard"), "b")
    # A document meets the blocks that it overlaps: its own list of block numbers, joined to the chosen ones.
    spans = d.filter(F.col("size") > 0).select(
        "doc_id", "key", "size", "upto", "source", "shard", F.explode(F.sequence(F.floor((F.col("upto") - F.col("size")) / block), F.floor((F.col("upto") - 1) / block))).alias("n")
    )
    hit = spans.join(chosen, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("shard") == F.col("b_shard")) & (F.col("n") == F.col("b")))
    begin = F.col("upto") - F.col("size")
    piece = F.struct((F.greatest(begin, F.col("n") * block) - begin).alias("s"), (F.least(F.col("upto"), (F.col("n") + 1) * block) - begin).alias("e"))
    got = hit.groupBy("source", "shard", "upto", "key").agg(F.sort_array(F.collect_list(piece)).alias("parts"))
    got = got.select(F.col("source").alias("p_source"), F.col("shard").alias("p_shard"), F.col("upto").alias("p_upto"), F.col("key").alias("p_key"), "parts")
    out = d.join(
        got,
        F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard")) & (F.col("upto") == F.col("p_upto")) & (F.col("key") == F.col("p_key")) & (F.col("size") > 0),
        "left",
    )
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return out.select("doc_id", "key", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "passes", F.coalesce("parts", none).alias("parts"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken."""
    once = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return plan(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + once).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", seed: str = SEED, **options) -> DataFrame:
    """The mix itself: ``docs`` rows, whole ones as often as passes take them, then the words taken once more, if any.

    A row taken in part has those words (single spaces) as its text and, where there is such a column, their number of
    characters as n_chars. Rows that are equal in id and text are planned one by one and emitted under one of them.
    """
    p = plan(docs, id_col=id_col, seed=seed, **options).groupBy("doc_id", "key").agg(F.sum("passes").alias("_passes"), F.flatten(F.collect_list("parts")).alias("_parts"))
    p = p.filter("_passes > 0 or size(_parts) > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_passes", "_parts")
    p = p.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_passes") + F.when(F.size("_parts") > 0, 1).otherwise(0))))
    keyed = docs.withColumn("_own", _row_key(id_col, seed)).dropDuplicates([id_col, "_own"]) if _repeats(docs, id_col, seed) else docs.withColumn("_own", _row_key(id_col, seed))
    out = keyed.join(p, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")))
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), WS, -1)
    out = out.withColumn("_words", F.when(F.col("_copy") > F.col("_passes"), words))
    cut = F.array_join(F.flatten(F.transform("_parts", lambda x: F.slice("_words", (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int")))), " ")
    # Two uses of _words keep the optimizer from moving the split into the lambda, where it would run for every part.
    out = out.withColumn("text", F.when(F.col("_words").isNotNull() & (F.size("_words") > 0), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_copy") > F.col("_passes"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _repeats(docs: DataFrame, id_col: str, seed: str) -> bool:
    return bool(docs.groupBy(id_col, _row_key(id_col, seed)).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count())
