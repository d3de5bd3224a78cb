"""Queries of the training-data operators, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from .common import table


def op1_token_output(spark, sf_dir):
    from .token_output import token_output

    return token_output(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark, sf_dir):
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_html_extract(spark, sf_dir):
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    from .secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_phrase_dedup(spark, sf_dir):
    from .phrase_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = "unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
OP10_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents))),
b AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(round(0.8 * n, 9))
"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _op3_sql() -> str:
    from .quality_rules import _CLASSES, COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS

    ws = "[\\x20\\x09-\\x0D]"
    peel = "".join(f", l{k} AS (SELECT *, regexp_replace(left{k - 1}, '{_quoted(p)}', '', 'g') AS left{k} FROM {'f' if k == 1 else f'l{k - 1}'})" for k, (_, p) in enumerate(_CLASSES, 1))
    n = len(_CLASSES)
    counts = ", ".join([*(f"length(left{k - 1}) - length(left{k})" for k in range(1, n + 1)), f"length(left{n})"])
    words = ", ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in COMMON_WORDS)
    sums = lambda c, m: "[" + ", ".join(f"CAST(sum({c}[{k}]) AS BIGINT)" for k in range(1, m + 1)) + "]"

    def distance(p: str, q: str, m: int) -> str:
        a, b = f"({p}[k] / list_sum({p}))", f"({q}[k] / list_sum({q}))"
        term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
        total = f"list_sum(list_transform(range(1, {m + 1}), lambda k: ({term(a)} + {term(b)}) / 2))"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({total}, 0.0)) ELSE 0.0 END"

    return f"""
WITH f AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '{ws}+'), lambda x: x <> '') AS w, regexp_replace(t, '{ws}+', '', 'g') AS left0,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)){peel},
h AS (SELECT *, [{counts}] AS chars, [{words}] AS few, list_append(few, len(w) - list_sum(few)) AS common FROM l{n}),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM f)),
rep AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN rep USING (doc_id, s)) GROUP BY doc_id),
ref AS (SELECT lang AS r, {sums('chars', n + 1)} AS ref_chars, {sums('common', len(COMMON_WORDS) + 1)} AS ref_common FROM h GROUP BY lang),
j AS (SELECT h.*, coalesce(cov.n, 0) AS nr, {distance('chars', 'ref_chars', n + 1)} AS cd, {distance('common', 'ref_common', len(COMMON_WORDS) + 1)} AS wd
  FROM h LEFT JOIN cov USING (doc_id) JOIN ref ON h.lang IS NOT DISTINCT FROM ref.r),
b AS (SELECT *, len(w) < 50 OR 100 * nr > 50 * len(w) AS failed FROM j)
SELECT doc_id, len(w) AS n_words, length(left0) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  nr AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (length(left0) >= {MIN_CHARS} AND cd > {MAX_CHAR_DISTANCE}) AND NOT (len(w) >= {MIN_WORDS} AND wd > {MAX_WORD_DISTANCE}) AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM b
"""


def queries():
    return {f.__name__: f for f in (op1_token_output, op2_toxicity, op3_quality_rules, op4_html_extract, op5_mixing, op6_secret_scan, op7_simhash, op8_phrase_dedup, op9_suffix_dedup, op10_decontaminate)}


def oracle_sql():
    return {"op3_quality_rules": _op3_sql(), "op10_decontaminate": OP10_SQL}
