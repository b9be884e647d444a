from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names the operators use inside.
CLASHES = ["id", "node", "sig", "root", "slot", "n_tokens", "score", "kept", "size", "shard", "p", "q", "k", "rank", "__id", "word", "c0", "lang_pred"]

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def passage(seed: int, n: int = 40) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 3),
    (4, passage(1), "en", "a", 1),
    (5, passage(1), "en", "b", 1),
    (5, passage(1), "en", "b", 1),
    (None, passage(2), None, "a", None),
    (6, "one two", "xx", "a", 7),
    (7, "password = hunter2secret é token:'abcdef' " + "f" * 30, "en", None, None),
    (8, "1234 !!! ...", "en", "a", 12),
    (9, passage(3, 30_000), "en", "c", None),
    (10, "x" * 200_000, "en", "c", None),
    (11, "Ünïcödé 你好 😀 <|endoftext|> it's", "de", "c", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, a repeated row, and clashing extra columns."""
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *[f"'extra' AS `{c}`" for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).selectExpr("*", *[f"'extra' AS `{c}`" for c in CLASHES])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
