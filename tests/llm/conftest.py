import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators use themselves, to clash with.
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n bigint, rep string, size string, gone string, row__x string, component_id bigint, label string, part string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, sources=None):
        ids = ids or list(range(len(texts)))
        rows = [(i, t, "en", (sources[k] if sources else f"s{k % 3}"), None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, DOC)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty texts, white space only, one very long text, repeats, ties, clashing columns."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    base = words(rng, 200)
    texts = [None, "", " \t\n", "one", "One  two\nthree", "one two three", base, base, base + " tail", long, "İ ı é́   x", "a\x0bb\x0cc\rd"]
    rows = [(k if k != 7 else 6, t, None if k % 2 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "k", k, "r", "z", "g", "w", 1, "l", "p") for k, t in enumerate(texts)] + [(None, base, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)
