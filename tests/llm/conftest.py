import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, label string, keys string, hash string"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text) rows, with columns whose names the operators use inside."""

    def make(rows, sources=None, langs=None):
        full = [(d, t, (langs or {}).get(d, "en"), (sources or {}).get(d, "s"), None if t is None else len(t), 0.5, "r", "l", "k", "h") for d, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


LONG = "a long line that is in many documents"
#: Nulls, empty and blank texts, copies, near copies, repeats inside one text, a long text, control characters, other scripts.
ODD = [
    (7, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, "one two three four five six seven eight nine ten"),
    (1, "One  two three\tfour five six seven eight nine ten"),
    (9, "one two three four five six seven eight nine ten"),
    (2, f"{LONG}\nfirst\n{LONG.upper()}  \nend"),
    (8, f"x\n {LONG}\nsecond\n\n"),
    (11, "word " * 5000),
    (12, "word " * 4000),
    (13, "éÉ 一二三 가나 \U0001f600 naïve café"),
    (14, "\x00\x01 nul\x00inside"),
    (None, "one two three four five six seven eight nine ten"),
    (15, "ab" * 700),
]


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture(scope="session")
def corpus(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
