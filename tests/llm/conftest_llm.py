import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest binary, num long, label string, position double, n_tokens string, shard string, token_ids string, key string"


def table_of(spark, rows):
    """Rows (doc_id, source, text) with the columns of documents and others whose names operators use."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, b"x", 2, "y", 0.5, "z", "q", "p", "k") for d, s, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 5000}x{i % 7}" for i in range(60_000))
BASE = " ".join(f"term{i}" for i in range(60))
EDGE = [
    (1, "b", None),
    (2, "b", ""),
    (3, None, "  \t\n "),
    (4, "a", "One"),
    (5, "a", "one"),
    (5, "a", "one"),
    (6, "c", LONG),
    (7, "c", LONG + " end"),
    (8, "", BASE),
    (9, "b", BASE.upper()),
    (10, "b", BASE + " tail"),
    (11, "a", "This work is licensed under the GNU General Public License, version 3. All rights reserved. CC BY cc-by by"),
    (12, "a", "ünï çødé 日本語 👍🏽 \x00 it's 12 ½"),
    (13, "d", "a b c a b c a b c"),
    (14, "d", "line one here.\nline one here.\n\nhome | about | contact | more | news\n$$ ## && text!!"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return table_of(spark, EDGE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
