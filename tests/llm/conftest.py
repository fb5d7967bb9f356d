import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    """Edge cases: nulls in any column, empty and blank texts, a very long text, ties, near copies, repeated rows."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, other = prose(120), prose(80)
    words = base.split()
    out = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n\x0b ", "en", "a", 5), (3, "One", "en", None, 3), (4, "oNE", "en", "a", 3),
        (5, "42 17 --- %%%", "en", "b", 10), (6, "Ünïcode ÄÖ straße 日本語 \U0001f600", "de", "b", 20), (None, "no id here at all", "en", "a", 17), (None, None, None, None, None),
        (7, base, "en", "hot", len(base)), (8, base.upper(), "en", "hot", len(base)), (9, base + " ", "en", "hot", 1), (10, "x y", "en", "hot", 3), (10, "x y", "en", "hot", 3), (10, "x z", "en", "hot", 3),
        (11, " ".join(words[:60] + ["changed"] + words[61:]), "en", "hot", 1), (12, " ".join(words[:20] + ["new"] + words[21:60] + ["changed"] + words[61:]), "en", "hot", 1),
        (13, " ".join(words[60:] + words[:60]), "fr", "hot", 1), (14, other, "fr", "c", 1), (15, other + " tail", "fr", "c", 1), (16, prose(30_000), "fr", "c", 1), (17, "ab " * 40_000, "fr", "c", 1),
        (18, "a b c a b c a b c\na b c\na b c\n\n x ", "es", "c", 1), (19, "one\r\none\none ", "es", "c", 1),
    ]
    out += [(100 + i, prose(rng.randint(1, 60)), rng.choice(["en", "fr"]), "hot", 1) for i in range(40)]
    out += [(200 + i, base, "en", "hot", 1) for i in range(30)]
    return out


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return df.select("*", *[F.lit(n).alias(n) for n in ("kept", "shard", "score", "size", "_h", "_id", "n", "sig", "mix_copy", "_rate", "bucket", "_digest", "_found")])


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def given():
    return rows()
