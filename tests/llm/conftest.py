import os
import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shipped(spark):
    from cohortlens.llm.shipping import ship_package
    ship_package(spark)
    return spark


@pytest.fixture()
def make_docs(shipped):
    """DataFrame of documents from (doc_id, text) pairs, in several partitions."""
    def make(rows, extra=None):
        df = shipped.createDataFrame([(i, t, "en", "s", None if t is None else len(t))
                                      for i, t in rows], SCHEMA).repartition(3)
        for name in extra or ():
            df = df.withColumn(name, F.lit("clash"))
        return df
    return make


@pytest.fixture()
def words():
    """Deterministic prose: words(seed, n)."""
    def make(seed, n, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
    return make


@pytest.fixture(scope="session")
def vocabulary():
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def edge_rows(words):
    """Nulls, empty and white texts, a very long text, ties and repeated rows."""
    long = words(1, 30_000)
    return [(0, None), (1, ""), (2, " \t\n "), (3, long), (4, long), (5, "Éa b"), (6, "éa b"),
            (7, "A B c"), (8, "a b C"), (9, words(2, 40)), (9, words(2, 40)), (None, words(3, 40)),
            (None, "a b c"), (10, "one"), (11, "two words"), (12, "x" * 5000)]
