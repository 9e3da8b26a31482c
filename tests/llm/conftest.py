import duckdb
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(n, T.StringType()) for n in
      ("n", "score", "t", "i", "p", "size", "target", "k__", "gram", "rate", "label", "y")]])
EXTRA = ("x",) * 12

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma "
         "tau upsilon phi chi psi omega").split()


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), *EXTRA)


def words(k, n, start=0):
    return " ".join(f"{WORDS[(start + j * (k + 1)) % len(WORDS)]}{j % 7}" for j in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long_text = words(3, 20_000)
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "one"), doc(5, "One"), doc(6, "one two three four"),
        doc(7, words(1, 60)), doc(8, words(1, 60)), doc(9, words(1, 60) + " tail"),
        doc(10, words(2, 60)), doc(11, long_text), doc(12, long_text + " more words here at the end"),
        doc(13, "x" * 5_000), doc(14, "日本語 ünï ΑΣ don't <|endoftext|> 12"), doc(15, words(4, 30), None, None),
        doc(16, "nothing", "fr", None), doc(None, "no id here", None, "b"), doc(17, "12 34 !!"),
        doc(18, words(5, 40), "de", "b"), doc(18, words(5, 40), "de", "b"),
        (19, words(6, 50), None, None, None, *[None] * 12)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def sf_rows():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def sf():
    return SF
