import random

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD_WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def sentence(rng, n):
    return " ".join(rng.choice(ODD_WORDS) + str(rng.randrange(100)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(1)
    texts = [sentence(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s0", 1), (100, texts[0], "en", "s0", 1), (101, texts[0], None, None, None)]
    rows += [(None, texts[1], "en", "s1", 1), (None, None, None, None, None), (102, None, "en", "s1", 0), (103, "", "en", "", 0),
             (104, " \n\t \n", "en", "s2", 5), (105, "x", "en", "s2", 1), (106, sentence(rng, 30_000), "en", "s0", 9),
             (107, "z" * 200_000, "en", "s1", 9), (108, "naïve \U0001F600 " * 40, "en", "s2", 9)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for clash in ("h", "n", "score", "key", "size", "taken", "text_hash", "spans", "row", "cls"):
        df = df.withColumn(clash, df.n_chars)
    return df


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOC_SCHEMA))
