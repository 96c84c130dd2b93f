"""Small tables with everything that may be odd about them."""

from __future__ import annotations

import pytest

from ..conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, id int, tid string, key string, h int, block int, sequence_id string, label string"


@pytest.fixture(scope="session")
def small(spark):
    def table(name):
        return spark.read.parquet(f"{SMALL}/{name}.parquet")

    return table


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns whose names clash with those of intermediate tables."""
    extra = (None, None, 0.5, "a", 1, "b", "c", 2, 3, "d", "e")
    rest = (None,) * 11
    long = " ".join(f"word{i % 977} tail{i % 31}." for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, long), (7, "One two three four five six seven eight nine ten."),
        (7, "One two three four five six seven eight nine ten."), (8, "a different text under one id"), (8, "and its other text, which is not the same"),
        (None, "a text without an id"), (None, None), (9, "été 数据 emoji 🎈 \u0000 nul"), (10, long + " and more"),
    ]
    made = [(r[0], r[1], *((extra if k % 2 else rest)[2:] if False else (None if k % 3 == 0 else "en", None if k % 4 == 0 else "src0", None if k % 5 == 0 else 3, *(extra[2:] if k % 2 else rest[2:])))) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def path():
    from rollbook.llm.queries import tokenizer_path

    return tokenizer_path()


@pytest.fixture(scope="session")
def encode(path):
    """Ids by the tokenizers library itself."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids
