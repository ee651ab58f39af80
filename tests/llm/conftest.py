import random

import pytest


@pytest.fixture
def docs(spark):
    """Documents from texts; the id is the position unless pairs (id, text) are given. Extra columns clash on purpose."""
    def make(texts):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame(
            [(i, t, "x", "y", 1, 2, 3) for i, t in rows],
            "doc_id long, text string, id string, n string, _text int, component_id int, start int").repartition(3)

    return make


@pytest.fixture
def words():
    """Random sentences, reproducible."""
    rng = random.Random(7)
    stock = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return lambda n: [rng.choice(stock) for _ in range(n)]


ODD = ["", None, " ", "\n", "a", "  two  blanks ", "line\n\n\nline\n", "tab\tand\r\nreturn", "é ñ ü ß İ ſ", "日本語のテキスト",
       "x" * 5000, "ab " * 2000, "I'll don't it's 'S", "1234 5,6.7 !!! ...a", "emoji 😀😀 é", "a\x1cb\x85c　d", "\0nul\0 \0"]


@pytest.fixture
def odd():
    return list(ODD)
