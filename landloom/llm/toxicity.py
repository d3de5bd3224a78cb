"""Toxicity by a counterfactually regularised classifier.

Features are the presence of word hashes, so a score does not depend on a text's length; identity terms have places of
their own beyond the hashes and share none with a word. Words are chosen by their chi-squared association with the label
in the training rows, and a logistic model over them is fitted with a second loss: a labelled text and its counterfactual
must get the same score. Counterfactuals of a text that names a group have the term swapped for others of its kind;
any other text gets a term inserted, and that term swapped, so that the penalty has rows whatever the corpus names; the
texts with an inserted term are training rows too, under the label of the text. The squared difference of the two scores
is penalised, which drives what the model gives to identity terms towards nothing and keeps neutral mentions unmarked.

Training uses at most ``MAX_TRAIN`` labelled rows (the lowest seeded hashes of their ids; a documented bound). Words are
counted and chosen by DataFrame aggregation; the driver gets the chosen words and, of each training row, which of them it
holds, never texts or whole word lists. Scoring covers every whole text. Labels, language, source and id are never inputs
of a score.

Defined results for odd input: null and empty texts score by the intercept alone; repeated rows score alike; a null id
is held out as the text "" would be; rows with a null label are no training rows, repeated label rows vote by their
largest value; without both classes among the training rows every score is the share of toxic ones (0 with none);
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise

#: Production parameters.
MAX_TRAIN = 20_000
BUCKETS = 1 << 20
MIN_DOCS = 5
MIN_CHI2 = 30.0
MAX_FEATURES = 4096
FAIRNESS = 20.0
RIDGE = 1e-3
STEPS = 400

#: Identity terms by kind and language; a term may be swapped for any other of its kind.
IDENTITY = {
    "gender": "woman women man men girl girls boy boys female male transgender nonbinary".split(),
    "faith": "christian christians muslim muslims jewish jews hindu hindus buddhist buddhists atheist atheists catholic catholics".split(),
    "origin": "black white asian african european american latino mexican chinese indian arab immigrant immigrants refugee refugees".split(),
    "orientation": "gay lesbian straight bisexual queer homosexual heterosexual".split(),
    "body": "disabled blind deaf autistic old young elderly".split(),
    "gender de": "frau frauen mann männer mädchen junge jungen weiblich männlich".split(),
    "faith de": "christ christen muslime jude juden hindus buddhisten atheisten katholiken".split(),
    "origin de": "schwarze weiße asiaten afrikaner europäer amerikaner chinesen inder araber einwanderer flüchtlinge ausländer".split(),
    "orientation de": "schwul schwule lesbisch lesben bisexuell homosexuell heterosexuell".split(),
    "body de": "behindert behinderte blinde gehörlos alte junger ältere".split(),
    "gender fr": "femme femmes homme hommes fille filles garçon garçons féminin masculin".split(),
    "faith fr": "chrétien chrétiens musulman musulmans juif juifs hindous bouddhistes athées catholiques".split(),
    "origin fr": "noir noirs blanc blancs asiatique africain européen américain chinois indien arabe immigré immigrés réfugiés".split(),
    "orientation fr": "lesbienne lesbiennes hétérosexuel homosexuel bisexuel".split(),
    "body fr": "handicapé handicapés aveugle sourd vieux jeune".split(),
    "gender es": "mujer mujeres hombre hombres niña niñas niño niños femenino masculino".split(),
    "faith es": "cristiano cristianos musulmán musulmanes judío judíos hindúes budistas ateos católicos".split(),
    "origin es": "negro negros blanco blancos asiático africano europeo americano chino indio árabe inmigrante inmigrantes refugiados".split(),
    "orientation es": "lesbiana lesbianas heterosexual bisexuales homosexuales".split(),
    "body es": "discapacitado discapacitados ciego sordo viejo joven".split(),
}

_EDGE = ".,;:!?\"'()[]{}<>|*#$%&+-_=/\\~`"


#: Places of identity terms, beyond all hashes, and the kind a term is swapped in (a term of two kinds has the first).
PLACE = {w: BUCKETS + k for k, w in enumerate(sorted({w for words in IDENTITY.values() for w in words}))}
KIND: dict[str, str] = {}
for _kind, _words in IDENTITY.items():
    for _w in _words:
        KIND.setdefault(_w, _kind)
_TERM = {place: w for w, place in PLACE.items()}
_WIDTH = BUCKETS + len(PLACE)


def _bucket(word: str) -> int:
    from xxhash import xxh32_intdigest

    place = PLACE.get(word)
    return xxh32_intdigest(word) & (BUCKETS - 1) if place is None else place


def tokens(text: str | None) -> set[str]:
    """The distinct words of a text: lower case, marks at their edges taken off."""
    return {w for x in set((text or "").lower().split()) if (w := x.strip(_EDGE))}


def _hashed(batches):
    for batch in batches:
        lists = [sorted({_bucket(w) for w in tokens(t.as_py())}) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "buckets"])


def choose(rows: DataFrame, n: int, n1: int) -> list[int]:
    """Buckets of (toxic, buckets) rows by chi-squared association with the label, at most ``MAX_FEATURES`` of them."""
    each = rows.select("toxic", F.explode("buckets").alias("b")).filter(F.col("b") < BUCKETS)
    counted = each.groupBy("b").agg(F.count("*").alias("k"), F.sum("toxic").alias("k1")).filter(F.col("k") >= MIN_DOCS)
    spread = F.col("k") * (1 - F.col("k") / n) * (n1 / n) * (1 - n1 / n)
    chi2 = (F.col("k1") - F.col("k") * (n1 / n)) ** 2 / F.greatest(spread, F.lit(1e-9))
    best = counted.select("b", chi2.alias("chi2")).filter(F.col("chi2") >= MIN_CHI2).orderBy(F.col("chi2").desc(), "b").limit(MAX_FEATURES)
    return [r["b"] for r in best.collect()]


class Model:
    """Feature buckets with their weights, and an intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order].astype(np.int64), weights[order].astype(np.float64), float(bias)

    def table(self) -> np.ndarray:
        dense = np.zeros(_WIDTH)
        dense[self.features] = self.weights
        return dense


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def counterfactuals(lists: list[list[int]], seed: int = 7):
    """(originals, swapped, inserted): pairs of feature sets that must score alike, and of each row its set with a term
    inserted (None for rows that name one already). Deterministic for the same lists."""
    rng = np.random.default_rng(seed)
    every = sorted(KIND)
    left, right, inserted = [], [], []

    def other(term: str) -> str:
        kin = [w for w in IDENTITY[KIND[term]] if w != term]
        return kin[int(rng.integers(len(kin)))]

    for own in lists:
        have, named = set(own), [_TERM[b] for b in own if b >= BUCKETS]
        for term in named:
            for _ in range(2):
                left.append(have)
                right.append((have - {PLACE[term]}) | {PLACE[other(term)]})
        if named:
            inserted.append(None)
            continue
        term = every[int(rng.integers(len(every)))]
        with_term = have | {PLACE[term]}
        inserted.append(with_term)
        left += [have, with_term]
        right += [with_term, have | {PLACE[other(term)]}]
    return left, right, inserted


def fit(labels: list, lists: list, chosen: list, fairness: float = FAIRNESS, steps: int = STEPS, seed: int = 7) -> Model:
    """``lists[i]`` are the features of a row of label ``labels[i]``, from ``chosen`` and identity terms. Deterministic."""
    y = np.array(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), math.log(max(p, 1e-9) / max(1 - p, 1e-9)))
    n, n1 = len(y), y.sum()
    # Identity terms are always features: the penalty has to see them.
    features = np.array(sorted({*chosen, *PLACE.values()}), dtype=np.int64)
    column = {int(b): k for k, b in enumerate(features)}

    def matrix(sets):
        pairs = [(i, column[b]) for i, bs in enumerate(sets) for b in bs if b in column]
        i, k = (np.array(z, dtype=np.int64) for z in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        return i, k

    originals, swapped, inserted = counterfactuals(lists, seed)
    ii, ik = matrix([x or () for x in inserted])
    named = np.array([x is None for x in inserted])
    xi, xk = matrix(lists)
    oi, ok = matrix(originals)
    si, sk = matrix(swapped)
    d, m = len(features), len(originals)
    w, bias, g2 = np.zeros(d), 0.0, np.full(d + 1, 1e-8)

    def score(i, k, rows_n):
        return np.bincount(i, weights=w[k], minlength=rows_n) + bias

    balance = np.where(y > 0, n / (2 * n1), n / (2 * (n - n1)))
    again = np.where(named, 0.0, balance)  # rows with a term inserted, under the same label
    for _ in range(steps):  # full-batch gradient with adaptive steps
        err = (_sigmoid(score(xi, xk, n)) - y) * balance / n
        err2 = (_sigmoid(score(ii, ik, n)) - y) * again / n
        grad = np.bincount(xk, weights=err[xi], minlength=d) + np.bincount(ik, weights=err2[ii], minlength=d) + RIDGE * w
        if m:
            po, ps = _sigmoid(score(oi, ok, m)), _sigmoid(score(si, sk, m))
            gap = 2 * fairness * (po - ps) / m
            grad += np.bincount(ok, weights=(gap * po * (1 - po))[oi], minlength=d)
            grad -= np.bincount(sk, weights=(gap * ps * (1 - ps))[si], minlength=d)
        full = np.append(grad, err.sum() + err2.sum())
        g2 = 0.9 * g2 + 0.1 * full**2
        step = 0.05 * full / np.sqrt(g2 + 1e-12)
        w, bias = w - step[:-1], bias - step[-1]
    # The threshold that separates best on the training rows becomes 0.5.
    z = score(xi, xk, n)
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    wrong = np.concatenate(([n - n1], (n - n1) + np.cumsum(np.where(ys > 0, 1, -1))))
    ends = np.concatenate(([True], zs[1:] > zs[:-1], [True]))
    cut = int(np.flatnonzero(ends)[np.argmin(wrong[ends])])
    middle = zs[0] - 1 if cut == 0 else zs[-1] + 1 if cut == n else (zs[cut - 1] + zs[cut]) / 2
    return Model(features, w, bias - middle)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_train: int = MAX_TRAIN, **options) -> Model:
    """Fit on labelled rows whose crc32(id) mod 5 is not 0, at most ``max_train`` of them."""
    marked = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.filter((F.crc32(F.col("l_id").cast("string")) % 5 != 0) & F.col("l_id").isNotNull())
    marked = marked.orderBy(F.xxhash64(F.lit("toxicity"), "l_id"), "l_id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("d_id"), "text").join(F.broadcast(marked), F.col("d_id") == F.col("l_id"))  # at most max_train rows of 12 bytes
    found = rows.select("toxic", "text").mapInArrow(_hashed, "toxic int, buckets array<int>")
    # Repeated documents may lift the rows above the bound; the sort makes the fit independent of task order.
    found = materialise(found.orderBy(F.xxhash64("buckets", "toxic")).limit(max_train), "toxicity-rows")
    n, n1 = found.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = choose(found, n, n1) if n else []
    held = F.array_intersect("buckets", F.lit([*chosen, *PLACE.values()]).cast("array<int>"))  # of each row only what the model can use
    got = found.select("toxic", F.sort_array(held).alias("buckets")).orderBy(F.xxhash64("buckets", "toxic")).toArrow()
    drop_table(found)
    return fit(got.column("toxic").to_pylist(), got.column("buckets").to_pylist(), chosen, **options)


def gap(model: Model, texts: list, seed: int = 11) -> float:
    """Mean change of a text's score when a seeded identity term, inserted or its own, is swapped for another of its kind."""
    left, right, _ = counterfactuals([sorted({_bucket(w) for w in tokens(t)}) for t in texts], seed)
    dense = model.table()
    change = [abs(float(_sigmoid(dense[sorted(a)].sum() + model.bias) - _sigmoid(dense[sorted(b)].sum() + model.bias))) for a, b in zip(left, right, strict=True)]
    return sum(change) / max(1, len(change))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    wanted, weights, bias = model.features, model.weights, model.bias

    def run(batches):
        of = {int(b): float(w) for b, w in zip(wanted, weights, strict=True)}
        memo: dict[str, float] = {}
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, t in enumerate(batch.column(1)):
                z = bias
                used = {}
                for word in tokens(t.as_py()):
                    w = memo.get(word)
                    if w is None:
                        b = _bucket(word)
                        w = (b, of[b]) if b in of else ()
                        if len(memo) < 500_000:
                            memo[word] = w
                    if w:
                        used[w[0]] = w[1]  # words of one bucket count once, as in training
                out[k] = z + math.fsum(used.values())
            s = _sigmoid(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    return score(docs, train(docs, labels, id_col, **options), id_col)
