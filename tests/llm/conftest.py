import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, places string, good boolean, h double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def fixture_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, long words, odd white space, shared passages, copies."""
    shared = passage(1, 45)
    texts = {
        1: passage(2, 60), 2: passage(3, 30) + " " + shared + " " + passage(4, 30), 3: "", 4: None, 5: "  \t\n ", 6: shared,
        7: passage(5, 10) + "\n" + shared + "\n\n" + passage(6, 300), 8: passage(2, 60), 9: passage(2, 59) + " End", 10: "one",
        11: "Ein Straße öäü ΣΑΣ <|endoftext|> x<|startoftext|>  y", 12: "x" * 3000 + " " + "y " * 200, 13: "na " * 90, 14: shared + " " + shared,
        15: "UPPER lower\r\n\x0btab\tsep | *** ### a\x1cb\x85c　d", 16: "\U0001f642 日本語 テスト" * 5, 17: passage(7, 5000),
    }
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), 0, "p", True, 0.5) for i, t in texts.items()]
    rows += [rows[1], rows[1]]  # the same row again
    rows += [(None, passage(8, 40) + " " + shared, None, None, None, None, None, None, None), (None, None, "en", "s0", 0, 0, "", False, 1.0)]
    rows += [(20, passage(9, 50), "en", "s0", 0, 0, "", False, 1.0), (20, passage(10, 25) + " " + shared, "en", "s0", 0, 0, "", False, 1.0)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizers_dir():
    return "/opt/tokenizers"
