"""Quality rules by distribution divergence [native].

Every document gets a character-class histogram and a common-word histogram. Both are compared with the reference
of the document's language by the Jensen-Shannon distance (base 2, 0 to 1). A reference is the sum of the histograms
of all documents of that language, so it is counted over the whole corpus and never sampled. Minimum lengths guard
the verdict: histograms of short texts are too noisy to judge.

Both word histograms have one more bin, the words that are not common, so that a text without common words is far from
its language. The word rule judges every text of ``min_words`` words.

Only DataFrame functions run: per-document features stay inside the row (no explode of words), the references are one
partial aggregation, and the join back is on the language.

Defined results for odd input: null text counts as empty (no words, base_failed); a null language is a language of its
own; repeated rows each get a row; a language whose reference is empty never rejects; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, without, words_of

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that for on with "
    "der die und den von zu das mit für ein "
    "de la le et les un des que pour du "
    "el y los se del las por con para en"
).split()

_LONGEST = max(len(w.encode()) for w in COMMON_WORDS)

#: Production parameters.
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CHAR_DISTANCE = 0.34
#: Distances over sf0.1 have a gap here, prose below it and word soup above it.
MAX_WORD_DISTANCE = 0.22
#: References of up to so many languages are broadcast; beyond it the join shuffles.
BROADCAST_LANGS = 1000

#: Character classes, taken off one after another; what is left after all is "other".
_CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("stop", "[.,;:!?'\"()-]+"), ("symbol", r"[\x00-\x7F]+"), ("letter", r"\p{L}+"))


def _row_key():
    return F.xxhash64(F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: the base counts and the two histograms (arrays of counts), in one pass over the text."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("t"), _row_key().alias("row_key"))
    df = df.withColumn("w", words_of(F.col("t"))).withColumn("left0", F.regexp_replace("t", r"[\x20\x09-\x0D]+", ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("known", F.filter("w", lambda x: (F.octet_length(x) <= _LONGEST) & x.isin(*COMMON_WORDS)))
    df = df.withColumn("joined", F.concat(F.lit(" "), F.array_join("known", "  "), F.lit(" ")))
    # Hashes of the windows of three words; most texts repeat none, and are done once that is known.
    df = df.withColumn("hashes", F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))))
    # Otherwise hash and position share a long (the position has as many bits as it needs), so that equal windows
    # are neighbours once the longs are sorted. Neighbours count only if their words are equal.
    df = df.withColumn("bits", F.length(F.bin(F.size("w").cast("bigint"))))
    df = df.withColumn(
        "win",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.sort_array(F.transform("hashes", lambda h, i: F.call_function("shiftleft", h, F.col("bits")).bitwiseOR(i.cast("bigint")))),
        ),
    ).withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))

    def same(x, y):
        a, b = x.bitwiseAND(F.col("mask")).cast("int"), y.bitwiseAND(F.col("mask")).cast("int")
        words = [F.get("w", a + k) == F.get("w", b + k) for k in range(3)]
        top = F.call_function("shiftright", x, F.col("bits")) == F.call_function("shiftright", y, F.col("bits"))
        return F.coalesce(top & words[0] & words[1] & words[2], F.lit(False))

    df = df.withColumn(
        "hits",
        F.sort_array(
            F.array_compact(F.transform("win", lambda x, i: F.when(same(x, F.get("win", i + 1)) | same(x, F.get("win", i - 1)), x.bitwiseAND(F.col("mask")).cast("int"))))
        ),
    )
    covered = F.aggregate(
        F.coalesce("hits", F.array().cast("array<int>")),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    counts, rest = [], "left0"
    for k, (name, pattern) in enumerate(_CLASSES, 1):
        df = df.withColumn(f"left{k}", F.regexp_replace(rest, pattern, ""))
        counts.append((F.length(rest) - F.length(f"left{k}")).cast("bigint"))
        rest = f"left{k}"
    counts.append(F.length(rest).cast("bigint"))
    return df.select(
        "doc_id",
        "lang",
        "row_key",
        F.size("w").cast("bigint").alias("n_words"),
        F.length("left0").cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.array(*counts).alias("chars"),
        F.array(*[F.regexp_count("joined", F.lit(f" {w} ")).cast("bigint") for w in COMMON_WORDS]).alias("common"),
    )


def _distance(p, q):
    """Jensen-Shannon distance of two count arrays; 0 when either is empty."""
    sp, sq = F.aggregate(p, F.lit(0.0), lambda a, x: a + x), F.aggregate(q, F.lit(0.0), lambda a, x: a + x)

    def term(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def pair(x, y):
        px, qy = x / sp, y / sq
        m = (px + qy) / 2
        return (term(px, m) + term(qy, m)) / 2

    div = F.aggregate(F.zip_with(p, q, pair), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(div, F.lit(0.0)))).otherwise(F.lit(0.0))


def judge(
    feats: DataFrame,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Add the distances and the verdict to ``features`` rows; references come from all rows given."""
    n_chars, n_common = len(_CLASSES) + 1, len(COMMON_WORDS) + 1
    total = F.aggregate("common", F.lit(0).cast("bigint"), lambda a, x: a + x)
    feats = feats.withColumn("common", F.concat("common", F.array(F.col("n_words") - total)))
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(n_chars)] + [F.sum(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(n_common)]
    refs = feats.groupBy("lang").agg(*sums).select(
        F.col("lang").alias("ref_lang"),
        F.array(*[F.col(f"c{k}") for k in range(n_chars)]).alias("ref_chars"),
        F.array(*[F.col(f"w{k}") for k in range(n_common)]).alias("ref_common"),
    )
    refs = materialise(refs, "quality-refs")
    if refs.count() <= BROADCAST_LANGS:
        refs = F.broadcast(refs)
    out = feats.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    out = out.withColumn("char_distance", _distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", _distance(F.col("common"), F.col("ref_common")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd_chars = (F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance)
    odd_words = (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance)
    return out.select(
        *[c for c in feats.columns if c not in ("chars", "common")],
        failed.alias("base_failed"),
        (~failed & ~odd_chars & ~odd_words).alias("kept"),
        F.round("char_distance", 6).alias("char_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", **limits) -> DataFrame:
    """One row per input row: base counts, distances to the language's references, and ``kept``."""
    # Features are read twice (references, verdicts); written once they cost one pass over the texts.
    return judge(materialise(features(docs, id_col), "quality-features"), **limits).drop("lang", "row_key")


def keep(docs: DataFrame, id_col: str = "doc_id", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns."""
    judged = judge(materialise(features(docs, id_col), "quality-features"), **limits)
    bad = judged.filter(~F.col("kept")).select("doc_id", "row_key")
    return without(docs, bad, {"doc_id": F.col(id_col), "row_key": _row_key()})
