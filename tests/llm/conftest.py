import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, c long, bands string"


@pytest.fixture()
def docs(spark):
    """A small table with every odd case: nulls, empty and very long texts,
    copies, repeated ids, and extra columns named like inner ones."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog while the old cat sleeps near the warm stove and dreams of many fish "
    rows = [(1, base * 2), (2, base * 2), (3, base * 2 + "tail"), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"),
            (8, "ONE  two"), (9, long), (10, long + " end"), (10, "other text under one id"), (None, "no id here at all ok"),
            (11, "ünïcode 文字 ▁ under\u2003space"), (12, "a" * 5000)]
    return spark.createDataFrame([(i, t, None, None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", len(t or ""), 1, 2, "x")
                                  for i, t in rows], DOCS)


@pytest.fixture()
def empty(docs):
    return docs.where("false")


@pytest.fixture()
def folder(tmp_path):
    def save(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return save
