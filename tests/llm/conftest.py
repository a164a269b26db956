import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """documents-like table with extra columns whose names clash with results and helpers."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, length long, start long, n int, "
              "id string, x string, node string, label string, slot string, host string, score string, base string, `a.b` string")
    return spark.createDataFrame([(i, t, lang, src, None, None, 1, 2, 3, "i", "x", "n", "l", "s", "h", "c", "b", "d") for i, t, lang, src in rows], schema)


WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix old potions near the quiet river bank".split()


def text(seed, n):
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2 ** 31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty, blank, short and very long texts, ties, repeated rows, a hot source."""
    long = text(5, 30_000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", None, "a"), (5, text(1, 80), "en", "a"),
            (6, text(1, 80), "en", None), (6, text(1, 80), "en", None), (6, text(2, 70), "fr", "a"), (None, text(1, 80), "fr", "b"), (None, None, None, None),
            (9, long, "en", "a"), (10, long + " tail", "en", "a"), (11, "12 34 -- !!", "en", "b"), (12, "<|endoftext|> token: abcdef0123456789abcdef012345", "fr", "b"),
            (13, "été naïve  Σίσυφος 漢字 \U0001f600 x́ \x1c \x85 end", "fr", "b"), (14, "a" * 5000, "en", "a"), (15, "line one here\nline one here\n\n", "en", "a")]
    rows += [(100 + i, text(3, 120 + i % 3), "en", "hot") for i in range(60)]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return df.select("doc_id", "text").toPandas().astype(object).where(lambda p: p.notna(), None)
