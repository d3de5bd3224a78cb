import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, id string, key string, fp string, row string"


def corpus(seed=3):
    """Documents with copies, near copies, shared passages, nulls, empties, repeated rows and a very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 7))) for _ in range(900)] + ["the", "of", "and"] * 40

    def prose(n):
        words = rng.choices(vocabulary, k=n)
        return "".join(w + rng.choice([" ", " ", " ", " ", "\n", "  "]) for w in words).strip()

    passage = prose(120)
    texts = [prose(rng.randint(1, 260)) for _ in range(40)]
    texts += [f"{prose(rng.randint(0, 80))} {passage} {prose(rng.randint(0, 80))}" for _ in range(12)]
    texts += [texts[3]] * 3 + [texts[45]] * 2
    near = prose(400).split(" ")
    for k in range(8):
        copy = list(near)
        copy[17 * (k + 1)] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [prose(9000), "", " \n ", None, "one", "two words", passage + " " + passage]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c", None])) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += rows[:2] + [(None, passage, "en", "a"), (None, "no id", None, "b")]
    return [(*r, len(r[1] or ""), "x", "x", "x", "x", "x") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
