import os
import re

import duckdb
import public_tokenizers
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
TABLES = "documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def documents(con):
    return {i: t or "" for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and white texts, ties, repeats, special tokens, long words."""
    return [None, "", " ", "  \n\t ", "a", "a", "it's  we'll <|endoftext|>x<|startoftext|> y", "é" * 400, "x" * 5000, "日本語 テスト 🎉🎉",
            "a  b \n c\r\n\td ", "ΑΣ Σ ß İstanbul ½²", "one two three four", "One two three four", "word " * 3000, "\x1c a\x85b\xa0c", ".,;: 12,345.67"]


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path


@pytest.fixture()
def table(spark):
    """A table of documents with columns whose names clash with computed ones."""
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "x", None, 7, "row", 1.5) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, copy string, source string, n long, `row` string, SCORE double")

    return make


def shingles(text):
    """The word shingles of a text, by the letter of the contract."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
