"""Small tables with every awkward row, shared by the operator tests."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def long_text(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(draw.randint(0, 400)) for _ in range(words))


def edge_rows() -> list[tuple]:
    base = long_text(1, 300)
    texts = [base, base, base.replace("alpha", "Alpha", 1), None, "", " ", "one", "one two three four five", "ä" * 700, "é\n" * 300, long_text(2, 20_000), base[:700] + long_text(3, 90), long_text(4, 90) + base[200:900],
             'token = "deadbeefdeadbeefdeadbeefdeadbeef" x', "x <|endoftext|> y  z\t", "ab " * 900]
    rows = [(i * 3, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return [*rows, rows[1], rows[6], (None, base, "en", "src0", len(base)), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge(spark):
    """Repeated rows, NULL in any column, empty and very long texts, ties."""
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
