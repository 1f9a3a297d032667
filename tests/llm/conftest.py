import random

import pytest
from llm_helpers import prose

#: Columns beside those of documents, named like columns that operators make.
EXTRA = {"size": "bigint", "kept": "string", "n_words": "int", "c": "int", "comp": "bigint", "fp": "string", "tag": "string", "bucket": "int", "row": "string",
         "times": "int", "target": "string", "rank": "int", "line": "string", "w": "string", "text_key": "string", "spans": "string",
         "__key": "string", "__rows": "int", "__times": "string", "__id": "string", "__text": "int", "__copy": "int", "__found": "string"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, exact and near copies."""
    rng = random.Random(3)
    base = [prose(rng, n) for n in (40, 60, 90, 25, 200)]
    long = prose(rng, 30_000)
    near = base[4].replace("alpha", "omega", 2)
    rows = [(1, base[0], "en", "a", 10), (2, base[0], "en", "b", 10), (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "en", None, 3),
            (6, base[1] + "\n" + base[2], "fr", "c", 1), (7, base[2].upper(), "fr", "c", 1), (8, long, "en", "a", 1), (9, base[4], "de", "b", 5), (10, near, "de", "b", 5),
            (11, "one two", "en", "a", 7), (12, "one two", "en", "a", 7), (None, base[3], "en", "a", 1), (None, None, None, None, None), (None, base[3], "en", "a", 1),
            (13, base[1], "en", "b", 1), (13, base[1], "en", "b", 1), (13, base[3], "en", "b", 1), (14, long + " tail", "en", "c", 1), (15, "é" * 70 + " ünï", "xx", "é", 1),
            (16, "\n".join([base[0]] * 3), "en", "b", 1), (17, "word " * 400, "en", "c", 1), (-4, base[1][:120], "en", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(7).cast("string").cast(kind).alias(name) for name, kind in EXTRA.items()))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
