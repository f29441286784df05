import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("k1", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("rest", T.StringType())])


def prose(rng: random.Random, n: int) -> str:
    """Words of a language in which sequences don't repeat by chance, with all kinds of white space."""
    return "".join("".join(rng.choice("abdeéikßlmnorstu") for _ in range(rng.randint(2, 8)))
                   + rng.choice([" ", " ", " ", "\n", "\t", " \r\n", " x "]) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def odd_texts(rng):
    """(id, text): null, empty and blank texts, copies, near copies, shared and inner repeats, one very long text."""
    base, passage = prose(rng, 260), prose(rng, 60)
    long = prose(rng, 9000)
    edited = base.split(" ")
    edited[len(edited) // 2] = "edited"
    return [(1, None), (2, ""), (3, " \n\t"), (4, base), (5, base), (6, " ".join(edited)),
            (7, prose(rng, 80) + passage + prose(rng, 50)), (8, passage + prose(rng, 90)), (9, prose(rng, 40) + passage),
            (10, long), (11, long[:4000]), (12, "same words again " * 60), (13, "x"), (14, "Wörter ohne Ende"),
            (15, "a" * 900), (None, base), (17, prose(rng, 300)), (17, prose(rng, 35)), (18, passage[5:]), (18, passage[5:]),
            (19, prose(rng, 500)), (20, "tail " + passage[:-5])]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(pairs):
        rows = [(i, t, None if n % 7 == 0 else "en", None if n % 5 == 0 else f"s{n % 2}", None if t is None else len(t),
                 "key", 1.5, "rest") for n, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOCS).repartition(3)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_texts):
    return make_docs(odd_texts)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
