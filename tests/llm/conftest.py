import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, _id string, _text string, score string, spans int, part int, path string"


@pytest.fixture(scope="session")
def texts():
    """Prose, copies, near copies, nulls, empties, ties, odd white space, symbols and a very long text."""
    r = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "you", "the", "of", "and", "idiot", "мир", "数", "don't", "1st", "#x", "a.b"]
    prose = [" ".join(r.choice(words) for _ in range(n)) for n in (3, 9, 10, 12, 40, 41, 80, 200, 400)]
    near = prose[7].split()
    near[5] = "changed"
    odd = ["", " ", "\n\n", None, "one", "two words", "x" * 500, "\t a\x0bb\x0cc\rd ", "<|endoftext|> mid <|endoftext|>", "a\x1cb\x85c d　e  f", "line\nline\nother\nline\n", "!! ?? ### $$$ %%%"]
    return [*prose, " ".join(near), prose[4], prose[4], *odd, " ".join(r.choice(words) for _ in range(20000))]


@pytest.fixture(scope="session")
def rows(texts):
    """(doc_id, text): ids out of order, one null, one repeated with the same text, one with another."""
    out = [((i * 37) % 101, t) for i, t in enumerate(texts)]
    return [*out, (None, texts[4]), out[5], (out[6][0], "another text under the same id")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, 1, "x", "y", "z", 3, 4, "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
