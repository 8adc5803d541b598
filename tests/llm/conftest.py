import pytest
from pyspark.sql import functions as F

CLASHES = "batch kind key value word shard found toxic row fp bucket block spotted kept_id kept_row n train index score".split()
LONG = "alpha beta gamma delta " * 9_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names the operators use themselves."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today."), (2, None), (3, ""), (4, "   \t\n "), (None, "No id here, mail a.b@mail1.example.com now"), (None, None),
        (5, LONG), (6, "The quick brown fox jumps over the lazy dog near the river bank today."), (7, "word"), (7, "word"), (7, "another text of the same id"), (8, "\x01 odd\x0b white space 　 İstanbul é́ <|endoftext|>"),
        (9, "call +1 (229) 555-4838, card 4046195599780836, host 57.96.160.157"), (-3, "Licensed under the Apache License, Version 2.0. and CC BY too"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return df.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
