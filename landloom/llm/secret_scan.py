"""Secret scans by multipart credential linking [native].

Strong findings (``assign``, ``access``, ``hex``) are reported by themselves. Weak candidates are ambiguous alone and
are reported only where complementary parts lie in one scope:

* ``id``: an access identifier (a user, login, client or account assignment, or an e-mail used as a login);
* ``opaque``: a lone token of 16 or more base64-like characters with letters of both cases and digits, of any length;
* ``endpoint``: a URL or a ``host``/``server``/``endpoint`` assignment.

A scope is ``SCOPE`` code points. Parts are dealt to the scope-sized cells they touch or border, the cells are
equi-joined within the document (an interval join: no pair of parts further apart than two cells ever meets), and the
exact distance is then checked. An ``id`` needs a secret (``opaque``, ``assign``, ``hex``); an ``opaque`` needs an
identifier (``id``, ``access``) or an endpoint and is then reported; an ``endpoint`` needs both an identifier and a
secret.

Only DataFrame functions run. Positions come from the gaps between matches: the text split by the pattern and the
matches themselves alternate, so running sums of their lengths are offsets in code points.

Defined results for odd input: a null text is empty and has no spans; rows are matched to their spans by id and text,
so repeated rows and repeated or null ids each keep their own result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The three base patterns; group 0 is the span.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
#: A match of AKIA[A-Z0-9]+ of 20 characters or more, and of [0-9a-f]+ of 24 or more, said so that short runs never match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

#: Weak candidates.
WEAK = {
    "id": r"""(?<![A-Za-z0-9_])(?i:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,64}""",
    "opaque": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"""(?<![A-Za-z0-9])(?:https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/_.?&=-]*|(?i:host(?:name)?|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?)""",
}
#: What an opaque token has to hold somewhere, asked of the whole match.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
KINDS = (*BASE, *WEAK)
SCOPE = 200


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _run(values: Column, at: Column) -> Column:
    """``at`` plus the sum of the entries before each one."""
    return F.aggregate(
        values,
        F.struct(at.alias("at"), F.array().cast("array<int>").alias("found")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["found"], F.array(a["at"])).alias("found")),
        lambda a: a["found"],
    )


def _starts(lengths: Column) -> Column:
    """Sums of the lengths before each one. Appending copies an array, so the sums run in pieces of about the root of
    their number: the cost of a text with n matches is n ** 1.5 small steps and not n ** 2."""

    def pieces(v, step):
        count = F.floor((F.size(v) - 1) / step).cast("int")
        part = lambda c: F.slice(v, c * step + 1, step)
        sums = F.transform(F.sequence(F.lit(0), count), lambda c: F.aggregate(part(c), F.lit(0), lambda a, x: a + x))
        return F.flatten(_bound(_run(sums, F.lit(0)), lambda firsts: F.transform(firsts, lambda at, c: _run(part(c), at))))

    return _bound(lengths, lambda v: _bound(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda step: pieces(v, step)))


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of (s, e, k, m): start, end (code points, exclusive), kind's rank, matched text."""
    rank = KINDS.index(kind)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    empty = F.array().cast("array<struct<s:int,e:int,k:int,m:string>>")

    def placed(both):
        lengths = F.transform(both, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))

        def found(starts):
            def span(x, i):
                s = F.get(starts, i) + F.length(x["gap"])
                return F.struct(s.alias("s"), (s + F.length(x["hit"])).alias("e"), F.lit(rank).alias("k"), x["hit"].alias("m"))

            return F.transform(F.slice(both, F.lit(1), F.size(both) - 1), span)  # the last gap has no match after it

        return _bound(_starts(lengths), found)

    return F.when(text.rlike(pattern), _bound(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), placed)).otherwise(empty)


def find_parts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: strong spans and weak candidate spans."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")

    def mixed(x):
        a, b, c = (x["m"].rlike(p) for p in MIXED)
        return a & b & c

    df = df.select(
        "doc_id",
        F.xxhash64("t").alias("h"),
        F.length("t").alias("len"),
        F.filter(_spans(t, "assign", ASSIGN), lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_VALUE, "")) >= 6).alias("assign"),
        _spans(t, "access", ACCESS).alias("access"),
        _spans(t, "hex", HEX).alias("hex"),
        *[(F.filter(_spans(t, k, p), mixed) if k == "opaque" else _spans(t, k, p)).alias(k) for k, p in WEAK.items()],
    )
    bare = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    return df.select(
        "doc_id",
        "h",
        "len",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
        bare(F.concat(*BASE)).alias("base"),
        bare(F.concat(*WEAK)).alias("weak"),
    )


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, h, len, spans of weak candidates whose complementary parts co-occur in a scope)."""
    keys = ["doc_id", "h", "len"]
    rows = parts.filter(F.size("weak") > 0).dropDuplicates(keys)
    span = rows.select(*keys, F.explode(F.concat("base", "weak")).alias("x")).select(*keys, "x.s", "x.e", "x.k")
    rank = {k: KINDS.index(k) for k in KINDS}
    # A candidate asks in the cells it touches; a part answers in those and the two next to them.
    ask = span.filter(F.col("k") >= len(BASE)).withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / scope), F.floor((F.col("e") - 1) / scope))))
    say = span.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("s") / scope) - 2, F.floor((F.col("e") - 1) / scope) + 2))
    ).select(*[F.col(c).alias(f"o_{c}") for c in (*keys, "s", "e", "k", "cell")])
    # Parts of one kind in a cell answer together: only the nearest ones before and after matter, but a cell holds at
    # most scope / 3 parts of a kind, so the pairs a candidate meets are bounded by the scope and not by the document.
    near = ask.join(
        say,
        F.col("doc_id").eqNullSafe(F.col("o_doc_id"))
        & (F.col("h") == F.col("o_h"))
        & (F.col("len") == F.col("o_len"))
        & (F.col("cell") == F.col("o_cell"))
        & (F.col("o_s") - F.col("e") <= scope)
        & (F.col("s") - F.col("o_e") <= scope)
        & ((F.col("o_s") != F.col("s")) | (F.col("o_k") != F.col("k"))),
    )
    apart = (F.col("o_e") <= F.col("s")) | (F.col("o_s") >= F.col("e"))
    seen = near.groupBy(*keys, "s", "e", "k").agg(
        *[F.max(F.when(F.col("o_k").isin(*[rank[n] for n in names]) & apart, 1).otherwise(0)).alias(what) for what, names in (("ids", ("id", "access")), ("secrets", ("opaque", "assign", "hex")), ("ends", ("endpoint",)))],
        F.max(F.when((F.col("o_k") < len(BASE)) & ~apart, 1).otherwise(0)).alias("inside"),
    )
    k = F.col("k")
    linked = (
        ((k == rank["id"]) & (F.col("secrets") == 1))
        | ((k == rank["opaque"]) & (F.col("inside") == 0) & ((F.col("ids") == 1) | (F.col("ends") == 1)))
        | ((k == rank["endpoint"]) & (F.col("ids") == 1) & (F.col("secrets") == 1))
    )
    return seen.filter(linked).groupBy(*keys).agg(F.collect_list(F.struct("s", "e", "k")).alias("more"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per input row: counts, the digest of base spans, and all spans."""
    parts = materialise(find_parts(docs, id_col), "secret-parts")  # small: no text, read for the links and the result
    more = link(parts, scope).select(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"), F.col("len").alias("m_len"), "more")
    out = parts.join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")) & (F.col("len") == F.col("m_len")), "left")
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,e:int,k:int>>")))).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("bigint").alias("n_linked"),
    )
