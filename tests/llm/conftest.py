import os
import re

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None, "", " ", "\n\n", "x", "one two three", "The same line\nThe same line\nother", "a b c d e f g h " * 30, "é ü ñ 日本語 🎉 naïve", "don't 'stop !!'s @'re\n\n\nx \n\n y\t\tz",
    "<|endoftext|>a<|endoftext|> b<|endof", "w" * 5000, "long " * 20000, " 　 z é  q", "▁▁a ▁ b", "\r\n\r\nfoo\x1f\x1fx\x85y", "me@example.com +1 (521) 555-2373 4111 1111 1111 1111 10.0.0.1",
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, ties and repeated rows, null ids, and columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "src", i) for i, t in enumerate(ODD_TEXTS)] + [(3, "\n\n", "en", "src", 3), (None, "no id here at all", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("n", "id", "key", "class", "bands", "t_", "d_", "n_words_", "length", "piece", "kept", "word", "uid", "g0", "rank_")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
