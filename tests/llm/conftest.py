import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: near and exact copies, shared passages, NULL, empty, blank and long texts, NULL and repeated keys."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(20, 200)) for _ in range(40)]
    texts += [t for t in texts[:6]] + [texts[0], texts[0]]
    for t in texts[6:14]:
        w = t.split()
        for n in (1, 2, 5):
            v = list(w)
            for _ in range(n):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    shared = prose(rng, 70)
    texts += [f"{prose(rng, 60)} {shared} {prose(rng, 30)}" for _ in range(4)]
    texts += [prose(rng, 6000), "One Two", "one TWO", "one", "", "   \n\t ", None, "Ünïcode 🙂 text", "a b c", "z" * 5000]
    rows = [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no key here", None, None, None), (None, None, None, None, 0)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="session")
def wide_docs(spark, corpus):
    """The same with columns named as the operators name theirs."""
    names = "doc key content label digest row n kept score ids rank units piece text_id sig chunk code size class root band keep_id".split()
    df = spark.createDataFrame(corpus, DOCS).repartition(3)
    return df.selectExpr("*", *(f"'clash' AS `{n}`" for n in names))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
