import pandas as pd
import pytest

HARD = [
    "", None, "one", "a b c d e", "Über straße naïve 東京 é é \U0001f600 x\x1cy z",
    "the cat sat on the mat " * 30, "x" * 3000, "line one here\nline one here\n\n  \nother", "tab\tsep\x0bform\x0cfeed\r\nend",
    "don't we'll I'VE 123 4567 ... !!! <|endoftext|> A.B,C", " lead and trail  ", "aaaaabbbbbaaaab" * 50, "# $ % & | < > * symbols 12",
]


@pytest.fixture(scope="session")
def texts(sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    return HARD + docs.text.tolist()[:120]


@pytest.fixture(scope="session")
def docs(spark, texts):
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "source": "s", "n_words": "clash"})
    return spark.createDataFrame(frame, "doc_id long, text string, source string, n_words string").repartition(3, "doc_id")
