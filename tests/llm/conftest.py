"""Documents with every edge case among ordinary ones."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "The quick brown fox jumps over the lazy dog while seven wizards box quietly near the old river bank at dawn"
SHARED = "a passage that several documents hold word for word, with more than fifty bytes in all of it"


def edge_rows():
    return [
        (9001, None, "en", "src1", None), (9002, "", None, None, 0), (9003, " \t\n\x0b ", "en", "src1", 5), (None, "no id but words", "fr", "src2", 15),
        (None, None, None, None, None), (9004, PLAIN, "en", "src1", 10), (9004, PLAIN, "en", "src1", 10), (9005, PLAIN.upper(), "en", None, 10),
        (9006, f"start one {SHARED} end one", "en", "src3", 1), (9007, f"other start {SHARED} other end", "en", "src3", 1), (9007, f"same id {SHARED}", "de", "src3", 1),
        (9008, "x" * 120_000, "en", "src4", 1), (9009, "1" * 50_000 + " 4111 1111 1111 1111 a@b.c 1.2.3.4 +1 (212) 555-0100", "en", "src4", 1),
        (9010, "word " * 30_000, "en", "src4", 1), (9011, "中文字 здраво", "zh", "src5", 1), (9012, "\U0001f600 café naïve", "fr", "src5", 1),
        (9013, "a.b" + ".c" * 20_000 + "@d" + ".e" * 20_000, "en", "src5", 1), (9014, "<|endoftext|> don't IT'S 12ab34 a_b", "en", "src5", 1),
        *[(9100 + i, f"{PLAIN} copy", "en", "src6", 1) for i in range(30)],
    ]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows only, with extra columns whose names clash with those the operators make."""
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    clash = ["_id", "fp", "size", "shard", "slot", "score", "kept", "spans", "uid", "target", "copies", "component_id", "fingerprint", "candidates", "keys", "sequence_id", "number", "block"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def docs(spark, edges):
    """The smallest table's documents and the edge rows."""
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(edges.select("doc_id", "text", "lang", "source", "n_chars"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
